"""Leaf algebra on forests of glued patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.functions.keys import coords, node, shift_left, shift_right
from mortar.functions.lineage import cut
from mortar.operators import leaves as tree
from mortar.operators.leaves import ancestors
from mortar.plans.patches import PatchMesh
from mortar.plans.spec import directions


def roots(spark: SparkSession, mesh: PatchMesh) -> DataFrame:
    zeros = [F.lit(0).cast("long").alias(c) for c in coords(mesh.dims)]
    return spark.range(mesh.n_roots).select(F.col("id").cast("int").alias("root"), F.lit(0).alias("level"), *zeros)


def patch_of(mesh: PatchMesh) -> Column:
    """The patch of a root."""
    out = F.lit(0)
    for k, first in enumerate(mesh.first_roots):
        out = F.when(F.col("root") >= first, k).otherwise(out)
    return out


def step(leaves: DataFrame, mesh: PatchMesh) -> DataFrame:
    """``(leaf, d1 .., crossed, root, level, c1 ..)``: same-level steps inside patches and across one glued face.

    ``crossed`` is the glue entry's number, null inside a patch; steps out of an unglued face, or out of two faces at once,
    are left out."""
    dims, parts = mesh.dims, None
    dirs = F.array(*[F.struct(*[F.lit(x).alias(f"d{d + 1}") for d, x in enumerate(s)]) for s in directions(dims)])
    rows = leaves.withColumn("patch", patch_of(mesh)).withColumn("_d", F.explode(dirs)).select("leaf", "root", "level", *coords(dims), "patch", *[F.col(f"_d.d{d + 1}").alias(f"d{d + 1}") for d in range(dims)])
    for p, shape in enumerate(mesh.patches):
        here, index, stride, at, beyond = rows.where(F.col("patch") == p), F.col("root") - mesh.first_roots[p], 1, [], []
        for d, c in enumerate(coords(dims)):
            place = F.floor(index / stride).cast("long") % shape[d]
            at.append(shift_left(place, F.col("level")) + F.col(c) + F.col(f"d{d + 1}"))
            beyond.append(F.when(at[d] < 0, -1).when(at[d] >= shift_left(F.lit(shape[d]), F.col("level")), 1).otherwise(0).alias(f"_b{d + 1}"))
            stride *= shape[d]
        moved = here.select("leaf", "level", *[f"d{d + 1}" for d in range(dims)], *[x.alias(f"_x{d + 1}") for d, x in enumerate(at)], *beyond)
        outs = F.lit(0)
        for d in range(dims):
            outs = outs + F.abs(F.col(f"_b{d + 1}"))
        pieces = [placed(moved.where(outs == 0), [F.col(f"_x{d + 1}") for d in range(dims)], p, None, mesh)]
        for k, g in enumerate(mesh.glue):
            if g.p != p:
                continue
            across = moved.where((outs == 1) & (F.col(f"_b{g.d + 1}") == (1 if g.side else -1)))
            xs = []
            for e in range(dims):
                x, a = F.col(f"_x{g.perm[e] + 1}"), g.perm[e]
                top = lambda n: shift_left(F.lit(n), F.col("level")) - 1
                if e == g.d2:
                    xs.append(F.lit(0).cast("long") if g.side2 == 0 else top(mesh.patches[g.q][e]))
                else:
                    xs.append(top(mesh.patches[p][a]) - x if g.flip[e] else x)
            there = [F.lit(1 if g.side2 == 0 else -1) if e == g.d2 else F.col(f"d{g.perm[e] + 1}") * (-1 if g.flip[e] else 1) for e in range(dims)]
            pieces.append(placed(across, xs, g.q, k, mesh, there))
        for piece in pieces:
            parts = piece if parts is None else parts.unionByName(piece)
    return parts


def placed(rows: DataFrame, xs: list[Column], patch: int, glue: int | None, mesh: PatchMesh, there: list[Column] | None = None) -> DataFrame:
    """Positions in a patch, in cells of the level, to root and coordinates; ``there`` is the direction seen in that patch."""
    root, stride, out = F.lit(mesh.first_roots[patch]), 1, []
    for x, n, c in zip(xs, mesh.patches[patch], coords(mesh.dims), strict=True):
        whole = shift_right(x, F.col("level"))
        root, stride = root + whole * stride, stride * n
        out.append((x - shift_left(whole, F.col("level"))).alias(c))
    ds = [F.col(f"d{d + 1}") for d in range(mesh.dims)]
    seen = [t.cast("int").alias(f"t{d + 1}") for d, t in enumerate(there or ds)]
    return rows.select("leaf", *ds, *seen, F.lit(glue).cast("int").alias("crossed"), root.cast("int").alias("root"), "level", *out)


def neighbours(leaves: DataFrame, mesh: PatchMesh) -> DataFrame:
    """``(leaf, d1 .., crossed, neighbour)``: the leaf that is, or covers, each stepped node, else all leaves inside
    it that touch the shared face, edge or corner."""
    dims = mesh.dims
    ds, ts, cs = ([f"{x}{d + 1}" for d in range(dims)] for x in "dtc")
    anchors = step(leaves, mesh)
    known = leaves.select(*node(dims), F.col("leaf").alias("neighbour"))
    above = ancestors(anchors, dims, "leaf", *ds, "crossed").join(known, node(dims)).select("leaf", *ds, "crossed", "neighbour")
    fine = leaves.select(*node(dims), F.col("leaf").alias("neighbour"), F.col("level").alias("_l"), *[F.col(c).alias(f"_f_{c}") for c in cs])
    under = ancestors(fine, dims, "neighbour", "_l", *[f"_f_{c}" for c in cs], strict=True)
    both, near = anchors.join(under, node(dims)), F.lit(True)
    for t, c in zip(ts, cs, strict=True):
        gap = F.col("_l") - F.col("level")
        low, high = F.col(f"_f_{c}") == shift_left(F.col(c), gap), F.col(f"_f_{c}") == shift_left(F.col(c) + 1, gap) - 1
        near = near & F.when(F.col(t) == 1, low).when(F.col(t) == -1, high).otherwise(True)
    return above.unionByName(both.where(near).select("leaf", *ds, "crossed", "neighbour"))


def across_faces(nodes: DataFrame, mesh: PatchMesh) -> DataFrame:
    """The same-level nodes that ``nodes`` meet across glued faces, with the ``leaf`` they were met from."""
    flat = sum((F.abs(F.col(f"d{d + 1}")) for d in range(mesh.dims)), F.lit(0)) == 1
    return step(nodes, mesh).where(F.col("crossed").isNotNull() & flat).select("leaf", *node(mesh.dims))


def balance(leaves: DataFrame, mesh: PatchMesh, levels: int) -> DataFrame:
    """The coarsest refinement in which touching leaves differ by one level at most, and by none across a glued face.

    A sweep from the finest level; a level's nodes are closed under siblings and images across glue before their parents' are made."""
    dims, keys, inner = mesh.dims, leaves.select(*node(mesh.dims)), None
    need = cut(keys.where(F.col("level") == levels))
    for level in range(levels, 0, -1):
        n = need.count()
        while n:
            whole = tree.children(tree.parent(need, dims).distinct(), dims).withColumn("leaf", F.lit(0))
            more = cut(need.unionByName(across_faces(whole, mesh).select(*node(dims))).distinct())
            if (grown := more.count()) == n:
                break
            need, n = more, grown
        up = cut(tree.parent(need, dims).distinct())
        inner = up if inner is None else inner.unionByName(up)
        around = step(up.withColumn("leaf", F.lit(0)), mesh).select(*node(dims))
        need = cut(keys.where(F.col("level") == level - 1).unionByName(up).unionByName(around).distinct())
    if inner is None:
        return keys
    return roots(leaves.sparkSession, mesh).unionByName(tree.children(inner, dims)).join(inner, node(dims), "left_anti")


def mismatched(leaves: DataFrame, mesh: PatchMesh) -> DataFrame:
    """``(leaf)``: leaves that meet no leaf of their own level across a glued face."""
    return across_faces(leaves, mesh).join(leaves.select(*node(mesh.dims)), node(mesh.dims), "left_anti").select("leaf").distinct()


def glued_ghosts(points: DataFrame, leaves: DataFrame, mesh: PatchMesh, ghosts: int, scalars: tuple[str, ...] = (), vector: tuple[str, ...] = ()) -> DataFrame:
    """Ghosts across glued faces, where all leaves must be of one level: ``(leaf, i1 .., scalars, vector)``.

    A ghost cell's place beyond the face is mapped into the other patch; a vector's components are read through the
    axis map, with the sign of its flips.  Stored indices count from 1, ``ghosts`` first."""
    dims, bits, cs = mesh.dims, mesh.cells.bit_length() - 1, coords(mesh.dims)
    if not mismatched(leaves, mesh).isEmpty():
        raise ValueError("leaves of two levels meet across a glued face; balance the forest")
    if 1 << bits != mesh.cells:
        raise ValueError("cells per block must be a power of two")
    names = [f"i{d + 1}" for d in range(dims)]
    rows, parts = leaves.withColumn("patch", patch_of(mesh)), None
    for g in mesh.glue:
        here, index, stride, at, index_of = rows.where(F.col("patch") == g.p), F.col("root") - mesh.first_roots[g.p], 1, [], []
        for d, (c, n) in enumerate(zip(cs, mesh.patches[g.p], strict=True)):
            place = F.floor(index / stride).cast("long") % n
            whole = shift_left(place, F.col("level")) + F.col(c)  # the leaf's place in the patch
            if d == g.d:
                last = shift_left(F.lit(n), F.col("level")) - 1
                here = here.where(whole == (last if g.side else 0))
            at.append(whole * mesh.cells)
            low = (ghosts + mesh.cells + 1 if g.side else 1) if d == g.d else ghosts + 1
            span = ghosts if d == g.d else mesh.cells
            index_of.append(F.sequence(F.lit(low), F.lit(low + span - 1)))
            stride *= n
        wide = here.select("leaf", "level", *[x.alias(f"_a{d + 1}") for d, x in enumerate(at)], *[x.alias(f"_q{d + 1}") for d, x in enumerate(index_of)])
        for d, name in enumerate(names):
            wide = wide.withColumn(name, F.explode(f"_q{d + 1}")).drop(f"_q{d + 1}")
        cell = [F.col(f"_a{d + 1}") + F.col(names[d]) - ghosts - 1 for d in range(dims)]
        top = lambda n: shift_left(F.lit(n * mesh.cells), F.col("level")) - 1
        xs = []
        for e in range(dims):
            a = g.perm[e]
            if e == g.d2:
                over = cell[a] - top(mesh.patches[g.p][a]) - 1 if g.side else -1 - cell[a]
                xs.append(over if g.side2 == 0 else top(mesh.patches[g.q][e]) - over)
            else:
                xs.append(top(mesh.patches[g.p][a]) - cell[a] if g.flip[e] else cell[a])
        root, stride, key, read = F.lit(mesh.first_roots[g.q]), 1, [], []
        for e, (x, n) in enumerate(zip(xs, mesh.patches[g.q], strict=True)):
            block = F.shiftright(x, bits)
            whole = shift_right(block, F.col("level"))
            root, stride = root + whole * stride, stride * n
            key.append((block - shift_left(whole, F.col("level"))).alias(cs[e]))
            read.append((x - F.shiftleft(block, bits) + ghosts + 1).cast("int").alias(f"_s{e + 1}"))
        wanted = wide.select(F.col("leaf").alias("_t"), *[F.col(n).alias(f"_t{n}") for n in names], root.cast("int").alias("root"), "level", *key, *read)
        source = wanted.join(leaves.select(*node(dims), F.col("leaf").alias("_src")), node(dims))
        data = points.select(F.col("leaf").alias("_src"), *[F.col(n).alias(f"_s{d + 1}") for d, n in enumerate(names)], *scalars, *vector)
        got = source.join(data, ["_src", *[f"_s{d + 1}" for d in range(dims)]])
        turned = [(F.col(vector[g.perm.index(a)]) * (-1 if g.flip[g.perm.index(a)] else 1)).alias(v) for a, v in enumerate(vector)]
        piece = got.select(F.col("_t").alias("leaf"), *[F.col(f"_t{n}").alias(n) for n in names], *scalars, *turned)
        parts = piece if parts is None else parts.unionByName(piece)
    return parts


def locate(query: DataFrame, leaves: DataFrame, mesh: PatchMesh, levels: int) -> DataFrame:
    """``(pid, leaf)`` of points named by patch and position in roots, ``(pid, patch, x1 ..)``; glue is not followed.

    Points outside their patch, or of no patch, have no leaf."""
    dims, parts = mesh.dims, None
    for p, shape in enumerate(mesh.patches):
        inside, xs = F.col("patch") == p, []
        for d, n in enumerate(shape):
            x = F.col(f"x{d + 1}")
            inside = inside & (x >= 0) & (x <= n) & ~F.isnan(x)
            xs.append(F.least(F.floor(x * (1 << levels)).cast("long"), F.lit((n << levels) - 1)))
        rows = query.where(inside).select(F.col("pid").alias("leaf"), *[F.lit(0).alias(f"d{d + 1}") for d in range(dims)], F.lit(levels).alias("level"), *[x.alias(f"_x{d + 1}") for d, x in enumerate(xs)])
        piece = placed(rows, [F.col(f"_x{d + 1}") for d in range(dims)], p, None, mesh).withColumnRenamed("leaf", "pid")
        parts = piece if parts is None else parts.unionByName(piece)
    hit = ancestors(parts, dims, "pid").join(leaves.select(*node(dims), "leaf"), node(dims)).select("pid", "leaf")
    return query.select("pid").join(hit, "pid", "left")
