"""Maps from logical to physical positions, and the chain rule for derivatives.

A map gives columns: ``map(x)`` the physical position, ``jacobian(x)[k][a]`` the derivative of physical k along
logical a, ``hessian(x)[k][a][b]`` the second derivatives."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.plans.spec import MeshSpec


class Chart(Protocol):
    def map(self, x: list[Column]) -> list[Column]: ...
    def jacobian(self, x: list[Column]) -> list[list[Column]]: ...
    def hessian(self, x: list[Column]) -> list[list[list[Column]]]: ...


class Polar:
    """(radius, angle) to the plane."""

    def map(self, x: list[Column]) -> list[Column]:
        return [x[0] * F.cos(x[1]), x[0] * F.sin(x[1])]

    def jacobian(self, x: list[Column]) -> list[list[Column]]:
        c, s = F.cos(x[1]), F.sin(x[1])
        return [[c, -x[0] * s], [s, x[0] * c]]

    def hessian(self, x: list[Column]) -> list[list[list[Column]]]:
        c, s, zero = F.cos(x[1]), F.sin(x[1]), F.lit(0.0)
        return [[[zero, -s], [-s, -x[0] * c]], [[zero, c], [c, -x[0] * s]]]


def chart_locate(query: DataFrame, invert, mesh: MeshSpec, outside: str = "mark") -> DataFrame:
    """``(pid, x1 ..)`` of physical points as logical ones, by ``invert(columns)``, which gives logical columns.

    A chart folds the topology itself: a point that it puts outside the mesh's closed box is null, or refused on request."""
    dims = mesh.dims
    xs, inside = invert([F.col(f"x{d + 1}") for d in range(dims)]), F.lit(True)
    for x, (lo, hi) in zip(xs, mesh.extents, strict=True):
        inside = inside & x.between(lo, hi) & ~F.isnan(x)
    out = query.select("pid", *[F.when(inside, x).alias(f"x{d + 1}") for d, x in enumerate(xs)])
    if outside == "error" and not out.where(F.col("x1").isNull()).isEmpty():
        raise ValueError("the chart puts a point outside the mesh")
    return out


def from_plane(x: list[Column]) -> list[Column]:
    """The inverse of ``Polar``."""
    return [F.hypot(x[0], x[1]), F.atan2(x[1], x[0])]


def inverse(j: list[list[Column]]) -> list[list[Column]]:
    """K[a][k], the derivative of logical a along physical k; one or two dimensions by cofactors, three likewise."""
    n = len(j)
    if n == 1:
        return [[1 / j[0][0]]]
    if n == 2:
        det = j[0][0] * j[1][1] - j[0][1] * j[1][0]
        return [[j[1][1] / det, -j[0][1] / det], [-j[1][0] / det, j[0][0] / det]]
    minor = lambda r, c: j[(r + 1) % 3][(c + 1) % 3] * j[(r + 2) % 3][(c + 2) % 3] - j[(r + 1) % 3][(c + 2) % 3] * j[(r + 2) % 3][(c + 1) % 3]
    det = sum((j[0][c] * minor(0, c) for c in range(3)), F.lit(0.0))
    return [[minor(k, a) / det for k in range(3)] for a in range(3)]


def first(chart: Chart, x: list[Column], grad: list[Column]) -> list[Column]:
    """Physical first derivatives from logical ones."""
    k = inverse(chart.jacobian(x))
    n = range(len(x))
    return [sum((k[a][i] * grad[a] for a in n), F.lit(0.0)) for i in n]


def second(chart: Chart, x: list[Column], grad: list[Column], hess: list[list[Column]]) -> list[list[Column]]:
    """Physical second derivatives from logical first and second ones."""
    k, h, n = inverse(chart.jacobian(x)), chart.hessian(x), range(len(x))
    out = []
    for i in n:
        row = []
        for j in n:
            v = F.lit(0.0)
            for a in n:
                for b in n:
                    bend = sum((k[c][m] * h[m][a][b] * grad[c] for m in n for c in n), F.lit(0.0))
                    v = v + k[a][i] * k[b][j] * (hess[a][b] - bend)
            row.append(v)
        out.append(row)
    return out


def mapped(region, chart: Chart):
    """A physical region as a predicate over logical positions, for the stencil points of ``locate.interpolate``."""
    return lambda *xs: region(*chart.map(list(xs)))
