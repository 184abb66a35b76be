"""Reductions and folds: per block, then over the mesh; many results in one pass.

Monoids: sum, max, min and count; NaN propagates through both max and min."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.sum(x)


def largest(x: Column) -> Column:
    """NaN is greatest, so it propagates."""
    return F.max(x)


def smallest(x: Column) -> Column:
    return F.when(F.max(F.isnan(x).cast("int")) == 1, F.lit(float("nan"))).otherwise(F.min(x))


def binned(x: Column, slot: Column, bins: int, monoid=total) -> list[Column]:
    """One aggregate a bin; slots outside 1 .. bins count nowhere."""
    return [monoid(F.when(slot == k, x)).alias(f"bin{k}") for k in range(1, bins + 1)]


def block_fold(points: DataFrame, aggregates: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """A row a leaf with all aggregates."""
    return points.groupBy("leaf", *keep).agg(*[c.alias(n) for n, c in aggregates.items()])


def mesh_fold(points: DataFrame, aggregates: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """All aggregates over the mesh, or for each group, in one pass."""
    cols = [c.alias(n) for n, c in aggregates.items()]
    return points.groupBy(*by).agg(*cols) if by else points.agg(*cols)


def mesh_mapreduce(points: DataFrame, leaves: DataFrame, value: Column, weight: Column, monoid: str = "sum") -> DataFrame:
    """Per-block values times a weight of the block's key, combined."""
    fold = {"sum": total, "max": largest, "min": smallest}[monoid]
    per = points.groupBy("leaf").agg(fold(value).alias("b")).join(leaves, "leaf")
    return per.agg(fold(F.col("b") * weight).alias("value"))


def norm(dims: int, variable: str, p: float) -> Column:
    """The aggregate (sum h^D |u|^p / V)^(1/p); the largest |u| for p infinite.  Points need ``h``."""
    u = F.abs(F.col(variable))
    if p == float("inf"):
        return largest(u)
    w = F.pow(F.col("h"), F.lit(float(dims)))
    return F.pow(F.sum(w * F.pow(u, F.lit(float(p)))) / F.sum(w), F.lit(1.0 / p))


def weighted_norm(points: DataFrame, dims: int, variable: str, p: float) -> DataFrame:
    return points.agg(norm(dims, variable, p).alias("norm"))


def total_mass(points: DataFrame, dims: int, variable: str) -> DataFrame:
    return points.agg(F.sum(F.col(variable) * F.pow(F.col("h"), F.lit(float(dims)))).alias("mass"))
