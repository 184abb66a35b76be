"""Fluxes at coarse-fine faces: the coarse side is overwritten by the mean of the fine side.

A flux set is vertex-like along its normal and cell-like along the others, so a face of a coarse block
meets 2^(D-1) fine faces for each of its own."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortar.functions.keys import coords
from mortar.operators import leaves as tree
from mortar.operators.exchange import apply
from mortar.operators.fields import index_names
from mortar.plans import weights
from mortar.plans.spec import Layout, MeshSpec


def plane_taps(normal: int, side: int, offset: tuple[int, ...], mesh: MeshSpec, layout: Layout) -> list[tuple]:
    """(target index, source index, weight): the boundary plane by injection, two-cell means along the others."""
    stencils = []
    for d, o in enumerate(offset):
        g, n = layout.ghosts[d], mesh.cells
        if d == normal:
            own, other = (g + n + 1, g + 1) if side == 1 else (g + 1, g + n + 1)
            stencils.append({own: [(other, weights.Fraction(1))]})
        else:
            half = range(o * n // 2, o * n // 2 + n // 2)
            stencils.append({g + 1 + j: [(g + 1 + 2 * j - o * n + k, weights.Fraction(1, 2)) for k in (0, 1)] for j in half})
    return weights.tensor(stencils)


def interface_plan(leaves: DataFrame, mesh: MeshSpec, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """``(tgt, src, grp, stage)`` for every finer neighbour across a face of a vertex-like dimension, and the taps."""
    if "element" in layout.centering or "vertex" not in layout.centering:
        raise ValueError("interfaces need a vertex-like dimension")
    dims = mesh.dims
    normals = [d for d, c in enumerate(layout.centering) if c == "vertex"]
    rows, wanted = [], F.lit(False)
    for d in normals:
        for side, sign in ((0, -1), (1, 1)):
            here = F.lit(True)
            for e in range(dims):
                here = here & (F.col(f"d{e + 1}") == (sign if e == d else 0))
            wanted = wanted | here
            for offset in product((0, 1), repeat=dims):
                rows += [(f"{d}:{sign}:{','.join(map(str, offset))}", *t, *s, w) for t, s, w in plane_taps(d, side, offset, mesh, layout)]
    names = [f"{x}{d + 1} int" for x in "ts" for d in range(dims)]
    taps = leaves.sparkSession.createDataFrame(rows, f"grp string, {', '.join(names)}, w double")
    fine = leaves.select(F.col("leaf").alias("neighbour"), *[(F.col(c) % 2).cast("string").alias(f"_{c}") for c in coords(dims)])
    near = tree.neighbours(leaves, mesh).where(wanted).join(leaves.select("leaf", "level"), "leaf").where(F.col("n_level") > F.col("level")).join(fine, "neighbour")
    normal = F.coalesce(*[F.when(F.col(f"d{d + 1}") != 0, F.lit(d)) for d in range(dims)])
    sign = sum((F.col(f"d{d + 1}") for d in range(dims)), F.lit(0))
    grp = F.concat_ws(":", normal.cast("string"), sign.cast("string"), F.concat_ws(",", *[F.col(f"_{c}") for c in coords(dims)]))
    return near.select(F.col("leaf").alias("tgt"), F.col("neighbour").alias("src"), grp.alias("grp"), normal.alias("stage")), taps


def restrict_interfaces(points: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """``points`` with the coarse planes overwritten, one normal after another."""
    plan, taps = interface_plan(leaves, mesh, layout)
    keys = ["leaf", *index_names(mesh.dims)]
    for d, kind in enumerate(layout.centering):
        if kind == "vertex":
            new = apply(plan.where(F.col("stage") == d), taps, points, mesh.dims, layout.variables)
            renamed = new.select(*keys, *[F.col(v).alias(f"_{v}") for v in layout.variables])
            points = points.join(renamed, keys, "left").select(*keys, *[F.coalesce(f"_{v}", v).alias(v) for v in layout.variables])
    return points
