"""Field sets as long tables: (leaf, i1 .. iD, variables); stored indices count from 1, ghosts first."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.operators.geometry import positions
from mortar.plans.spec import Layout, MeshSpec


def index_names(dims: int) -> list[str]:
    return [f"i{d + 1}" for d in range(dims)]


def grid(leaves: DataFrame, ranges: list[range]) -> DataFrame:
    """``(leaf, i1 ..)`` for every index in the ranges."""
    out = leaves.select("leaf")
    for name, r in zip(index_names(len(ranges)), ranges, strict=True):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(r.start), F.lit(r.stop - 1))))
    return out


def within(ranges: list[range]) -> Column:
    ok = F.lit(True)
    for name, r in zip(index_names(len(ranges)), ranges, strict=True):
        ok = ok & F.col(name).between(r.start, r.stop - 1)
    return ok


def allocate(leaves: DataFrame, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """Zeroed storage, ghosts included."""
    layout.check(mesh.cells)
    return zerofill(grid(leaves, layout.stored(mesh.cells)), layout)


def zerofill(points: DataFrame, layout: Layout) -> DataFrame:
    return points.withColumns({v: F.lit(0.0) for v in layout.variables})


def block_key(leaves: DataFrame, dims: int, leaf: int) -> DataFrame:
    """One row: how many blocks there are, and the node of one."""
    return leaves.where(F.col("leaf") == leaf).select(F.lit(leaves.count()).alias("n_blocks"), "root", "level", *[f"c{d + 1}" for d in range(dims)])


def block(points: DataFrame, leaf: int) -> DataFrame:
    return points.where(F.col("leaf") == leaf)


def interior(points: DataFrame, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """Owned points: half-open, without the shared high plane."""
    return points.where(within(layout.owned(mesh.cells)))


def closed(points: DataFrame, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """Owned points and the shared high plane."""
    return points.where(within(layout.closed(mesh.cells)))


def fill_by_coordinates(leaves: DataFrame, mesh: MeshSpec, layout: Layout, values: Mapping[str, Callable[..., Column]] | Callable[..., Mapping[str, Column]]) -> DataFrame:
    """Owned points with each variable set by a function of the position columns, or all by one function that gives a mapping."""
    own = positions(grid(leaves, layout.owned(mesh.cells)), leaves, mesh, layout)
    xs = [F.col(f"x{d + 1}") for d in range(mesh.dims)]
    filled = own.withColumns({v: values[v](*xs) for v in layout.variables} if isinstance(values, Mapping) else dict(values(*xs)))
    return filled.select("leaf", *index_names(mesh.dims), *layout.variables)


def gather(points: DataFrame, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """The state: owned points only, with ``place``, the position in the state vector from 0."""
    rank, stride = F.lit(0).cast("long"), 1
    for name, g in zip(index_names(mesh.dims), layout.ghosts, strict=True):
        rank, stride = rank + (F.col(name) - g - 1) * stride, stride * mesh.cells
    place = (F.col("leaf") - 1) * stride * len(layout.variables) + rank
    return interior(points, mesh, layout).withColumn("place", place)


def scatter(points: DataFrame, state: DataFrame, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """Stored points with the owned ones replaced by the state."""
    keys = ["leaf", *index_names(mesh.dims)]
    new = state.select(*keys, *[F.col(v).alias(f"_{v}") for v in layout.variables])
    return points.join(new, keys, "left").withColumns({v: F.coalesce(f"_{v}", v) for v in layout.variables}).drop(*[f"_{v}" for v in layout.variables])


def state_length(leaves: DataFrame, mesh: MeshSpec, layouts: list[Layout]) -> DataFrame:
    """Per set: its length and the range of its segment in the joined state vector."""
    n, at, rows = leaves.count(), 0, []
    for k, layout in enumerate(layouts):
        size = n * mesh.cells**mesh.dims * len(layout.variables)
        rows.append((k, size, at, at + size))
        at += size
    return leaves.sparkSession.createDataFrame(rows, "set_id int, length long, first long, last long")


def map_points(points: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """A kernel that reads and writes a point alone."""
    return points.withColumns(dict(values))


def shifted(points: DataFrame, dims: int, shift: tuple[int, ...], variable: str, name: str) -> DataFrame:
    """Adds the value ``shift`` cells away in the same block's stored array, null beyond it."""
    keys = index_names(dims)
    moved = points.select("leaf", *[(F.col(k) - s).alias(k) for k, s in zip(keys, shift, strict=True)], F.col(variable).alias(name))
    return points.join(moved, ["leaf", *keys], "left")
