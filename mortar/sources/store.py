"""Saving and reloading a mesh and its owned points as Parquet."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from mortar.operators import leaves as tree
from mortar.operators.fields import interior
from mortar.plans.spec import Layout, MeshSpec


def save(path: str, mesh: MeshSpec, layout: Layout, leaves: DataFrame, points: DataFrame) -> None:
    """Keys of the leaves, owned points without ghosts, and the specifications as one JSON row."""
    spark = leaves.sparkSession
    leaves.select("leaf", "root", "level", *[f"c{d + 1}" for d in range(mesh.dims)]).write.mode("overwrite").parquet(f"{path}/leaves")
    interior(points, mesh, layout).write.mode("overwrite").parquet(f"{path}/points")
    told = {"mesh": asdict(mesh) | {k: sorted(getattr(mesh, k)) for k in ("reflecting", "outflow")}, "layout": asdict(layout)}
    spark.createDataFrame([(json.dumps(told),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def load(spark: SparkSession, path: str, levels: int) -> tuple[MeshSpec, Layout, DataFrame, DataFrame]:
    """The saved mesh, checked to tile the brick."""
    told = json.loads(spark.read.text(f"{path}/spec").first()[0])
    m, lay = told["mesh"], told["layout"]
    pairs = lambda x: frozenset(map(tuple, x))
    seam = lambda x: tuple(x) if x else None
    mesh = MeshSpec(tuple(m["roots"]), m["cells"], tuple(m["periodic"]), pairs(m["reflecting"]), pairs(m["outflow"]), seam(m["rotating"]), seam(m["halfturn"]), tuple(map(tuple, m["extents"])), m["generation"])
    layout = Layout(tuple(lay["centering"]), tuple(lay["ghosts"]), tuple(lay["variables"]), lay["order"], lay["walls"], lay["parity"])
    leaves = spark.read.parquet(f"{path}/leaves")
    if not tree.check_tiling(leaves, mesh, levels).first()["tiles"]:
        raise ValueError("the leaves do not tile the brick")
    return mesh, layout, leaves, spark.read.parquet(f"{path}/points")
