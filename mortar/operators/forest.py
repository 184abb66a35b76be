"""A mesh with its leaves and generation, and regrids of several field sets at once.

What is computed from a forest (located points, plans) remembers its generation, and is refused once a regrid has changed the leaves."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortar.functions.keys import node
from mortar.functions.lineage import cut
from mortar.operators import exchange, fields, locate, regrid
from mortar.operators import leaves as tree
from mortar.plans import transfers
from mortar.plans.spec import Layout, MeshSpec, Operators


@dataclass(frozen=True)
class Forest:
    """Numbered leaves of a mesh; ``mesh.generation`` counts the regrids that changed them."""

    leaves: DataFrame
    mesh: MeshSpec
    levels: int

    def scalars(self) -> DataFrame:
        """One row: leaves, deepest level, generation."""
        return self.leaves.agg(F.count("*").alias("n_leaves"), F.max("level").alias("maxlevel")).withColumn("generation", F.lit(self.mesh.generation).cast("int"))

    def is_stale(self, generation: int) -> bool:
        return generation != self.mesh.generation


@dataclass(frozen=True)
class FieldSet:
    """Owned points of a set; without operators a regrid gives it zeros."""

    points: DataFrame
    layout: Layout
    ops: Operators | None = None
    boundary: Mapping | None = None


@dataclass(frozen=True)
class Located:
    """Points with their leaves, and the generation that these are of."""

    points: DataFrame
    generation: int


def located(query: DataFrame, forest: Forest, outside: str = "mark") -> Located:
    return Located(locate.locate(query, forest.leaves, forest.mesh, forest.levels, outside), forest.mesh.generation)


def interpolate(at: Located, points: DataFrame, forest: Forest, layout: Layout, n: int, derivs: list[tuple[int, ...]], **more) -> DataFrame:
    """``locate.interpolate`` at points that were located in this very forest."""
    if forest.is_stale(at.generation):
        raise ValueError("the points were located before the last regrid")
    return locate.interpolate(at.points, points, forest.leaves, forest.mesh, layout, n, derivs, **more)


def regrid_sets(forest: Forest, sets: Mapping[str, FieldSet], marks: DataFrame, buffer: int | None = None, fill: Callable = exchange.fill_ghosts) -> tuple[Forest, dict[str, FieldSet], bool]:
    """The forest after the marks, every set moved to it, and whether leaves changed.

    ``marks`` has leaf and flag, and with a ``buffer`` the firing boxes.  Ghosts are filled first where a set's prolongation reads them."""
    mesh, old = forest.mesh, forest.leaves
    flags = regrid.buffered(marks, old, mesh, buffer) if buffer is not None else marks
    new = cut(tree.numbered(regrid.completed(flags, old, mesh, forest.levels), mesh.dims, forest.levels))
    keys = node(mesh.dims)
    if new.join(old, keys, "left_anti").isEmpty() and old.join(new, keys, "left_anti").isEmpty():
        return forest, dict(sets), False
    after, moved = Forest(new, replace(mesh, generation=mesh.generation + 1), forest.levels), {}
    for name, s in sets.items():
        if s.ops is None:
            points = fields.zerofill(fields.grid(new, s.layout.owned(mesh.cells)), s.layout)
        else:
            rows = transfers.tap_rows(mesh, s.layout, s.ops, [(0,) * mesh.dims])
            held = fill(s.points, old, mesh, s.layout, s.ops, s.boundary) if transfers.waiting(rows, mesh, s.layout) else s.points
            points = regrid.transfer(held, old, new, mesh, s.layout, s.ops)
        moved[name] = replace(s, points=cut(points))
    return after, moved, True
