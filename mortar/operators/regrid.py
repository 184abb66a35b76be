"""Regridding: marks from data, buffers, complete and balanced new leaves, transfer of the field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.functions.keys import coords, node
from mortar.functions.lineage import cut
from mortar.operators import leaves as tree
from mortar.operators.exchange import apply
from mortar.operators.fields import index_names
from mortar.plans import transfers as plans
from mortar.plans.spec import Layout, MeshSpec, Operators

COARSEN, KEEP, REFINE = 0, 1, 2


def firing_boxes(points: DataFrame, leaves: DataFrame, fires: Column, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """Per leaf: how many owned points fire, and the bounding box of their interior indices (1 .. 0 if none)."""
    boxes = []
    for name, g in zip(index_names(mesh.dims), layout.ghosts, strict=True):
        at = F.when(fires, F.col(name) - g)
        boxes += [F.min(at).alias(f"_lo_{name}"), F.max(at).alias(f"_hi_{name}")]
    hits = points.groupBy("leaf").agg(F.sum(F.when(fires, 1).otherwise(0)).alias("_n"), *boxes)
    sides = []
    for name in index_names(mesh.dims):
        sides += [F.coalesce(f"_lo_{name}", F.lit(1)).alias(f"lo_{name}"), F.coalesce(f"_hi_{name}", F.lit(0)).alias(f"hi_{name}")]
    return leaves.select("leaf").join(hits, "leaf", "left").select("leaf", F.coalesce("_n", F.lit(0)).cast("long").alias("n_firing"), *sides)


def flag_blocks(leaves: DataFrame, flag: Column) -> DataFrame:
    """``(leaf, flag)`` by a column of the leaves."""
    return leaves.select("leaf", flag.cast("int").alias("flag"))


def recruits(marks: DataFrame, leaves: DataFrame, mesh: MeshSpec, buffer: int) -> DataFrame:
    """``(leaf, wanted)``: the highest level that boxes dilated by ``buffer`` cells ask of the leaves they reach.

    ``marks`` has leaf, flag, and the box lo_i1, hi_i1 ..; a source is a box that is not to coarsen; Refine asks
    a level more than its own, Keep its own."""
    if not 0 <= buffer <= mesh.cells:
        raise ValueError("the buffer is 0 to the block's cells")
    names = index_names(mesh.dims)
    source = marks.where((F.col("flag") != COARSEN) & (F.col(f"hi_{names[0]}") >= F.col(f"lo_{names[0]}")))
    exits = F.lit(True)
    for d, n in enumerate(names):
        low, high = F.col(f"lo_{n}") - buffer < 1, F.col(f"hi_{n}") + buffer > mesh.cells
        exits = exits & F.when(F.col(f"d{d + 1}") == -1, low).when(F.col(f"d{d + 1}") == 1, high).otherwise(True)
    wanted = F.col("level") + F.when(F.col("flag") == REFINE, 1).otherwise(0)
    reached = tree.neighbours(leaves, mesh).join(source, "leaf").join(leaves.select("leaf", "level"), "leaf").where(exits)
    return reached.groupBy(F.col("neighbour").alias("leaf")).agg(F.max(wanted).alias("wanted"))


def buffered(marks: DataFrame, leaves: DataFrame, mesh: MeshSpec, buffer: int) -> DataFrame:
    """``(leaf, flag)`` after recruiting: reached leaves below the wanted level refine, those at it do not coarsen."""
    want = recruits(marks, leaves, mesh, buffer)
    rows = marks.select("leaf", "flag").join(leaves.select("leaf", "level"), "leaf").join(want, "leaf", "left")
    raised = F.when(F.col("level") < F.col("wanted"), REFINE).when((F.col("level") == F.col("wanted")) & (F.col("flag") == COARSEN), KEEP).otherwise(F.col("flag"))
    return rows.select("leaf", F.coalesce(raised, "flag").cast("int").alias("flag"))


def completed(marks: DataFrame, leaves: DataFrame, mesh: MeshSpec, levels: int) -> DataFrame:
    """New nodes: refined where marked, coarsened where all siblings agree, then balanced."""
    dims = mesh.dims
    keyed = leaves.join(marks.select("leaf", "flag"), "leaf")
    up = [F.shiftright(c, 1).alias(c) for c in coords(dims)]
    agree = keyed.where(f"level > 0 AND flag = {COARSEN}").select("root", (F.col("level") - 1).alias("level"), *up)
    parents = agree.groupBy(*node(dims)).agg(F.count("*").alias("n")).where(F.col("n") == 2**dims).drop("n")
    gone = tree.children(parents, dims)
    split = keyed.where(F.col("flag") == REFINE).select(*node(dims))
    kept = leaves.select(*node(dims)).join(split.unionByName(gone), node(dims), "left_anti")
    return tree.balance(kept.unionByName(tree.children(split, dims)).unionByName(parents), mesh, levels)


def transfer(points: DataFrame, old: DataFrame, new: DataFrame, mesh: MeshSpec, layout: Layout, ops: Operators) -> DataFrame:
    """The field on the new leaves: copied, prolonged from the parent (ghosts must be filled if the order needs them)
    or restricted from the children.  A jump of more than a level is refused."""
    plan = plans.regrid_transfers(old, new, mesh.dims)
    missing = new.join(plan.select(F.col("tgt").alias("leaf")), "leaf", "left_anti")
    if missing.limit(1).count():
        raise ValueError("a block moves by more than one level")
    still = (0,) * mesh.dims
    taps = plans.taps(points.sparkSession, mesh, layout, ops, [still])
    return apply(plan, taps, points, mesh.dims, layout.variables)


def adapt(make_points, flags, leaves: DataFrame, mesh: MeshSpec, levels: int, max_passes: int = 8) -> tuple[DataFrame, int, bool]:
    """Fill, flag and regrid until the leaves stay as they are; data are made anew each pass, never moved.

    ``make_points(leaves)`` gives the field, ``flags(points, leaves)`` the marks.  Returns leaves, passes, converged."""
    for n in range(1, max_passes + 1):
        new = cut(tree.numbered(completed(flags(make_points(leaves), leaves), leaves, mesh, levels), mesh.dims, levels))
        keys = node(mesh.dims)
        same = not new.join(leaves, keys, "left_anti").limit(1).count() and not leaves.join(new, keys, "left_anti").limit(1).count()
        if same:
            return leaves, n, True
        leaves = new
    return leaves, max_passes, False
