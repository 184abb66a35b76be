"""Mesh operators: all registered SQL, polynomial exactness of the stencils, write-once ghosts,
conservation, symmetry and refusals."""

import math
import random
from fractions import Fraction
from itertools import product

import duckdb
import pytest
from mortar import queries
from mortar.functions import keys
from mortar.operators import elements as element_ops
from mortar.operators import exchange, fields, forest, geometry, leaves, locate, reduce, regrid
from mortar.plans import elements, transfers, weights
from mortar.plans.spec import Layout, MeshSpec, Operators, cellcentered, directions, staggers, vertexcentered
from mortar.sources import meshes
from pyspark.sql import functions as F


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def kept_meshes():
    """The meshes of a table are derived once for all tests of the module."""
    patch, held = pytest.MonkeyPatch(), {}
    for name in ("leaves2d", "balanced2d"):
        made = getattr(meshes, name)

        def keep(spark, sf_dir, *mesh, _name=name, _made=made):
            key = _name, sf_dir, mesh
            if key not in held:
                held[key] = _made(spark, sf_dir, *mesh)
            return held[key]

        patch.setattr(meshes, name, keep)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data)
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [[plain(v) for v in r] for r in got.select(*names).collect()]
    assert sorted(rows, key=str) == sorted(([plain(v) for v in r] for r in want.fetchall()), key=str)


# -- stencils ------------------------------------------------------------------


def poly(deg):
    return lambda x: sum(Fraction(k + 2, 3 + k) * x**k for k in range(deg + 1))


def average(lo, hi, deg):
    """The cell average of ``poly(deg)``, exactly."""
    total = Fraction(0)
    for k in range(deg + 1):
        total += Fraction(k + 2, 3 + k) * (hi ** (k + 1) - lo ** (k + 1)) / (k + 1)
    return total / (hi - lo)


@pytest.mark.parametrize("order", [2, 4, 6])
@pytest.mark.parametrize("c", [0, 1])
def test_point_prolongation_is_exact_to_its_order(order, c):
    n, g = 12, order // 2 - c
    shift = Fraction(0) if c else Fraction(1, 2)
    for deg, exact in ((order - 1, True), (order, False)):
        f, wrong = poly(deg), 0
        for step in (-1, 0, 1):
            for offset in (0, 1):
                sigma = weights.source_step(step, offset)
                for j, row in weights.prolong(n, g, c, step, offset, order, False).items():
                    fine = offset * n + j - g - 1
                    got = sum(w * f(Fraction(s - g - 1 + sigma * n) + shift) for s, w in row)
                    wrong += got != f((fine + shift) / 2)
        assert (wrong == 0) == exact


@pytest.mark.parametrize("order", [1, 3, 5])
def test_conservative_prolongation(order):
    n, g = 12, max(1, (order - 1) // 2)
    low, high = weights.subcell(order)
    assert [a + b for a, b in zip(low, high, strict=True)] == [2 * int(k == order // 2) for k in range(order)]
    for deg, exact in ((order - 1, True), (order, False)):
        wrong = 0
        for step in (-1, 0, 1):
            for offset in (0, 1):
                sigma = weights.source_step(step, offset)
                for j, row in weights.prolong(n, g, 0, step, offset, order, True).items():
                    fine = Fraction(offset * n + j - g - 1)
                    cell = lambda s: Fraction(s - g - 1 + sigma * n)  # noqa: B023, E731
                    got = sum(w * average(cell(s), cell(s) + 1, deg) for s, w in row)
                    wrong += got != average(fine / 2, (fine + 1) / 2, deg)
        assert (wrong == 0) == exact


@pytest.mark.parametrize("order", [2, 4])
def test_restriction_is_exact_to_its_order(order):
    n, g = 12, 2
    f = poly(order - 1)
    for offset in (0, 1):
        for j, row in weights.restrict(n, g, 0, 0, offset, order).items():
            got = sum(w * f((Fraction(s - g - 1) + Fraction(1, 2) + offset * n) / 2) for s, w in row)
            assert got == f(Fraction(j - g - 1) + Fraction(1, 2))
            assert all(g < s <= g + n for s, _ in row)


def test_element_tables():
    for p in (1, 2, 3, 5):
        up, down, project = elements.interpolation(p), elements.restriction(p), elements.coarsening(p)
        n = p + 1
        eye = [[float(sum(project[i][f] * up[f][j] for f in range(2 * n))) for j in range(n)] for i in range(n)]
        assert all(abs(eye[i][j] - (i == j)) < 1e-14 for i in range(n) for j in range(n))
        _, w = elements.lobatto(p)
        assert abs(float(sum(w)) - 2) < 1e-14
        mass = [sum(w[i] * down[i][f] for i in range(n)) for f in range(2 * n)]
        assert all(abs(float(m - w[f % n] / 2)) < 1e-14 for f, m in enumerate(mass))  # restriction conserves the integral
        xs, ws = elements.gauss(4)
        assert abs(float(sum(a * x**6 for x, a in zip(xs, ws, strict=True))) - 2 / 7) < 1e-14


# -- meshes ------------------------------------------------------------------------


def small_mesh(spark, mesh, levels=3, seed=3):
    rng = random.Random(seed)
    rows = leaves.roots(spark, mesh)
    for _ in range(levels):
        all_ = [tuple(r) for r in rows.collect()]
        deepest = max(r[1] for r in all_)
        pick = [r for r in all_ if r[1] == deepest and rng.random() < 0.5] or all_[:1]
        schema = ", ".join(["root int", "level int", *[f"{c} long" for c in keys.coords(mesh.dims)]])
        rows = leaves.refine(rows, spark.createDataFrame(pick, schema), mesh.dims)
    from mortar.functions.lineage import cut

    return cut(leaves.numbered(leaves.balance(cut(rows), mesh, levels), mesh.dims, levels))


@pytest.mark.parametrize("dims", [1, 2])
@pytest.mark.parametrize(("family", "order"), [("point", 2), ("point", 4), ("conservative", 3)])
def test_ghosts_of_polynomials(spark, dims, family, order):
    """On a mesh with outer faces every ghost inside the brick is exact for the order's polynomials, and written once."""
    mesh = MeshSpec(roots=(2,) * dims, cells=8)
    ls = small_mesh(spark, mesh, 2)
    g = order // 2 if family == "point" else 1
    layout, deg = Layout(cellcentered(dims), (g,) * dims), 1
    own = lambda *xs: sum((F.lit(0.3 * (d + 1)) + 0.7 * x for d, x in enumerate(xs)), F.lit(0.0)) if deg == 1 else None
    points = fields.fill_by_coordinates(ls, mesh, layout, {"v1": own})
    ops = Operators(family, order, 2)
    full = exchange.fill_ghosts(points, ls, mesh, layout, ops, {"v1": own})
    n = fields.grid(ls, layout.stored(8)).count()
    assert full.count() == n and full.select("leaf", *fields.index_names(dims)).distinct().count() == n
    at = geometry.positions(full, ls, mesh, layout)
    err = at.agg(F.max(F.abs(F.col("v1") - own(*[F.col(f"x{d + 1}") for d in range(dims)])))).first()[0]
    assert err < 1e-11


def test_reflecting_and_outflow_walls(spark):
    mesh = MeshSpec(roots=(2, 2), cells=8, reflecting=frozenset({(0, 0), (0, 1)}), outflow=frozenset({(1, 0), (1, 1)}))
    ls = small_mesh(spark, mesh, 2)
    layout = Layout(cellcentered(2), (1, 1), ("v1", "v2"), parity={"v2": {0: -1}})
    even = lambda x, y: F.cos(x * math.pi)
    odd = lambda x, y: F.sin(x * math.pi)
    points = fields.fill_by_coordinates(ls, mesh, layout, {"v1": even, "v2": odd})
    full = exchange.fill_ghosts(points, ls, mesh, layout, Operators("conservative", 1, 2))
    n = fields.grid(ls, layout.stored(8)).count()
    assert full.count() == n and full.select("leaf", "i1", "i2").distinct().count() == n
    at = geometry.positions(full, ls, mesh, layout)
    beyond = at.where(((F.col("x1") < 0) | (F.col("x1") > 2)) & F.col("i2").between(2, 9))  # corners mirror interpolated ghosts
    worst = beyond.agg(F.max(F.abs(F.col("v1") - even(F.col("x1"), None))), F.max(F.abs(F.col("v2") - odd(F.col("x1"), None)))).first()
    assert beyond.count() and max(worst) < 1e-12


def test_levels_that_read_owned_points_are_one_stage(spark):
    """Stages by what they read: order 1 needs no ghosts, order 4 does, and either way the ghosts are those of a level at a time."""
    mesh, layout = MeshSpec(roots=(2, 2), cells=8, periodic=(True, True)), Layout(cellcentered(2), (2, 2))
    for ops, some in ((Operators("conservative", 1, 2), False), (Operators("point", 4, 4), True)):
        rows = transfers.tap_rows(mesh, layout, ops)
        late = transfers.waiting(rows, mesh, layout)
        assert bool(late) == some and all(g.startswith("prolong") for g in late)
        owned = layout.owned(8)
        assert all((r[0] in late) or all(x in o for x, o in zip(r[3:5], owned, strict=True)) for r in rows)


def test_symmetric_walls_of_both_dimensions(spark):
    """Values even about every wall are the same on all planes, corners included, and an odd variable is 0 there."""
    mesh = MeshSpec(roots=(1, 1), cells=8, reflecting=frozenset(product((0, 1), (0, 1))))
    layout = Layout(vertexcentered(2), (1, 1), ("v1", "v2"), walls="symmetric", parity={"v2": {0: -1, 1: -1}})
    ls = small_mesh(spark, mesh, 2)
    square = lambda x, y: (x * x - x) * (x * x - x) + (y * y - y) * (y * y - y)
    points = fields.fill_by_coordinates(ls, mesh, layout, {"v1": square, "v2": square})
    full = exchange.fill_ghosts(points, ls, mesh, layout, Operators("point", 4, 2))
    n = fields.grid(ls, layout.stored(8)).count()
    assert full.count() == n == full.select("leaf", "i1", "i2").distinct().count()
    at = geometry.positions(full, ls, mesh, layout)
    on = at.where("x1 = 0 OR x1 = 1 OR x2 = 0 OR x2 = 1")
    worst = on.agg(F.max(F.abs(F.col("v1") - square(F.col("x1"), F.col("x2")))), F.max(F.abs("v2"))).first()
    assert worst[0] < 0.02 and worst[1] == 0.0


def test_refused_regrids_and_stale_points(spark):
    mesh, layout = MeshSpec(roots=(1, 1), cells=4, periodic=(True, True)), Layout(cellcentered(2), (0, 0))
    ls = small_mesh(spark, mesh, 2)
    start = forest.Forest(ls, mesh, 3)
    points = fields.fill_by_coordinates(ls, mesh, layout, lambda x, y: {"v1": x + y})
    sets = {"a": forest.FieldSet(points, layout, Operators("conservative", 1, 2))}
    at = forest.located(locate.uniform_grid(spark, mesh, (3, 3)), start)
    same, _, changed = forest.regrid_sets(start, sets, regrid.flag_blocks(ls, F.least(F.col("leaf"), F.lit(regrid.KEEP))))
    assert not changed and same is start
    after, moved, changed = forest.regrid_sets(start, sets, regrid.flag_blocks(ls, F.least(F.col("leaf") + 1, F.lit(regrid.REFINE))))
    assert changed and after.scalars().first() == (4 * ls.count(), 3, 1)
    with pytest.raises(ValueError, match="regrid"):
        forest.interpolate(at, moved["a"].points, after, layout, 2, [(0, 0)])
    again = forest.located(locate.uniform_grid(spark, mesh, (3, 3)), after)
    assert forest.interpolate(again, moved["a"].points, after, layout, 2, [(0, 0)]).count() == 9
    with pytest.raises(ValueError, match="leaves"):
        leaves.refine(ls, leaves.children(ls, 2), 2, strict=True)
    with pytest.raises(ValueError, match="parents"):
        leaves.coarsen(ls, leaves.children(ls, 2), 2, strict=True)
    assert [leaves.part_range(11, 3, k) for k in range(3)] == [(1, 4), (5, 8), (9, 11)]


def test_glue_refuses_two_levels(spark):
    from mortar.operators import patched
    from mortar.queries.exchange import PAIR

    roots = patched.roots(spark, PAIR)
    both = leaves.numbered(leaves.refine(roots, roots.where("root = 0"), 2), 2, 1)
    points = fields.grid(both, [range(2, 6)] * 2).withColumn("v1", F.lit(1.0))
    assert patched.mismatched(both, PAIR).count() == 3
    with pytest.raises(ValueError, match="two levels"):
        patched.glued_ghosts(points, both, PAIR, 1, ("v1",))
    fine = leaves.numbered(patched.balance(both, PAIR, 1), 2, 1)
    assert fine.count() == 8 and patched.mismatched(fine, PAIR).isEmpty()
    assert patched.glued_ghosts(points.limit(0).unionByName(fields.grid(fine, [range(2, 6)] * 2).withColumn("v1", F.lit(1.0))), fine, PAIR, 1, ("v1",)).count() == 16


def test_regrids_conserve_mass(spark):
    mesh = MeshSpec(roots=(1, 1), cells=4, periodic=(True, True))
    layout, ops = Layout(cellcentered(2), (1, 1)), Operators("conservative", 3, 2)
    old = small_mesh(spark, mesh, 3)
    points = fields.fill_by_coordinates(old, mesh, layout, {"v1": lambda x, y: F.floor(x * 64) + 3 * F.floor(y * 32)})
    full = exchange.fill_ghosts(points, old, mesh, layout, ops)
    marks = old.select("leaf", (F.col("leaf") % 3).cast("int").alias("flag"))
    new = leaves.numbered(regrid.completed(marks, old, mesh, 4), 2, 4)
    moved = regrid.transfer(full, old, new, mesh, layout, ops)
    mass = lambda p, ls: reduce.total_mass(geometry.positions(p, ls, mesh, layout), 2, "v1").first()[0]
    assert mass(points, old) == mass(moved, new) and moved.count() == new.count() * 16
    assert leaves.check_tiling(new, mesh, 4).first()["tiles"]
    skipped = leaves.numbered(leaves.refine(leaves.refine(old.where("level = 2"), old, 2), leaves.children(old, 2), 2), 2, 4)
    with pytest.raises(ValueError, match="more than one level"):
        regrid.transfer(full, old, skipped, mesh, layout, ops)


@pytest.mark.parametrize(("family", "p", "r"), [("conservative", 3, 2), ("point", 4, 4)])
def test_bounded_operators_make_no_new_extrema(spark, family, p, r):
    mesh, layout = MeshSpec(roots=(2, 2), cells=8, periodic=(True, True)), Layout(cellcentered(2), (2, 2))
    old = small_mesh(spark, mesh, 2)
    new = leaves.numbered(leaves.refine(old.where("level = 1 AND root = 3"), old, 2), 2, 4)
    points = fields.fill_by_coordinates(old, mesh, layout, {"v1": lambda x, y: F.when((x > 0.3) & (y > 0.4) & (x < 1.33), 1.0).otherwise(0.0)})
    reach = {}
    for bounded in (False, True):
        ops = Operators(family, p, r, bounded)
        full = exchange.fill_ghosts(points, old, mesh, layout, ops)
        for name, got in (("fill", full), ("regrid", regrid.transfer(full, old, new, mesh, layout, ops))):
            reach[bounded, name] = got.agg(F.min("v1"), F.max("v1")).first()
            assert not got.where("v1 IS NULL").count()
    assert reach[False, "fill"][0] < -1e-3 or reach[False, "fill"][1] > 1.001
    assert reach[True, "fill"] == reach[True, "regrid"] == (0.0, 1.0)


def test_interpolation_is_exact(spark):
    mesh = MeshSpec(roots=(2, 1), cells=8, extents=((-1.0, 1.0), (0.0, 1.0)))
    ls, layout = small_mesh(spark, mesh, 2), Layout(cellcentered(2), (0, 0))
    f = lambda x, y: x * x * y + 2 * x - y * y
    points = fields.fill_by_coordinates(ls, mesh, layout, {"v1": f})
    query = spark.createDataFrame([(k, random.Random(k).uniform(-1, 1), random.Random(k + 99).uniform(0, 1)) for k in range(40)] + [(40, 1.0, 1.0), (41, 0.0, 0.5), (42, 3.0, 0.5), (43, float("nan"), 0.5)], "pid long, x1 double, x2 double")
    found = locate.locate(query, ls, mesh, 2)
    assert found.where("inside AND leaf IS NOT NULL").count() == 42
    with pytest.raises(ValueError, match="outside"):
        locate.locate(query, ls, mesh, 2, outside="error")
    got = locate.interpolate(found, points, ls, mesh, layout, 4, [(0, 0), (1, 0), (1, 1), (0, 2)], locate.ellipsoid((0.0, 0.5), (0.2, 0.2))).join(found, "pid")
    x, y = F.col("x1"), F.col("x2")
    want = F.when(F.col("k") == 0, f(x, y)).when(F.col("k") == 1, 2 * x * y + 2).when(F.col("k") == 2, 2 * x).otherwise(-2.0)
    assert got.count() == 168 and got.agg(F.max(F.abs(F.col("v1") - want))).first()[0] < 1e-9
    assert got.where("excluded").count() and not got.where("excluded AND abs(x1) > 0.9").count()
    with pytest.raises(ValueError, match="order 2"):
        locate.interpolate(found, points, ls, mesh, layout, 4, [(2, 1)])


def test_points_outside_are_filled(spark):
    mesh = MeshSpec(roots=(2, 1), cells=8, extents=((-1.0, 1.0), (0.0, 1.0)))
    ls = small_mesh(spark, mesh, 2)
    query = spark.createDataFrame([(0, 0.1, 0.5), (1, 3.0, 0.5), (2, float("nan"), 0.5), (3, -0.7, -1.0)], "pid long, x1 double, x2 double")
    found = locate.locate(query, ls, mesh, 2)
    layout = Layout(cellcentered(2), (0, 0))
    points = fields.fill_by_coordinates(ls, mesh, layout, {"v1": lambda x, y: x + y})
    got = {(r["pid"], r["k"]): (r["inside"], r["v1"]) for r in locate.interpolate(found, points, ls, mesh, layout, 2, [(0, 0), (1, 0)], fill=-7.0).collect()}
    assert len(got) == 8 and all(got[p, k] == (False, -7.0) for p in (1, 2, 3) for k in (0, 1))
    assert got[0, 0][0] and abs(got[0, 0][1] - 0.6) < 1e-12
    layout = Layout(("element", "element"), (0, 0), order=1)
    ones = fields.fill_by_coordinates(ls, mesh, Layout(cellcentered(2), (0, 0)), {"v1": lambda x, y: F.lit(1.0)})
    got = {r["pid"]: r["v1"] for r in element_ops.interpolate(found, ones, ls, mesh, layout, fill=float("nan")).collect()}
    assert abs(got[0] - 1) < 1e-12 and len(got) == 4 and all(math.isnan(got[p]) for p in (1, 2, 3))


def test_sort_keys_agree(spark):
    ls = small_mesh(spark, MeshSpec(roots=(2, 2), cells=4), 3)
    by_binary = [r["leaf"] for r in ls.withColumn("k", keys.skey(2)).orderBy("k").collect()]
    assert by_binary == list(range(1, len(by_binary) + 1))


def test_adapt_reaches_a_fixed_point(spark, data):
    mesh = meshes.UNIT2
    start = leaves.numbered(leaves.roots(spark, mesh), 2, 4)
    flags = lambda points, ls: ls.select("leaf", F.when((F.col("c1") == 0) & (F.col("level") < 3), 2).otherwise(1).cast("int").alias("flag"))
    got, passes, done = regrid.adapt(lambda ls: ls, flags, start, mesh, 4)
    assert done and passes == 4 and got.agg(F.max("level")).first()[0] == 3


def test_patch_refusals():
    from mortar.plans.patches import Glue, PatchMesh, both_ways, half_turn, quarter_turn

    fine = Glue(0, 0, 1, 1, 0, 0, (0, 1), (False, False))
    assert PatchMesh(((2, 1), (2, 1)), both_ways(fine)).n_roots == 4 and fine.reverse().reverse() == fine
    for shape, glue in ((((2, 1), (2, 1)), (fine,)), (((2, 1), (2, 3)), both_ways(fine)), (((2, 1), (2, 1)), both_ways(Glue(0, 0, 1, 1, 0, 0, (0, 1), (True, False)))), (((2, 2), (2, 2)), both_ways(Glue(0, 0, 1, 1, 0, 0, (1, 0), (False, False))))):
        with pytest.raises(ValueError):
            PatchMesh(shape, glue)
    for turn, roots_ in ((quarter_turn, (2, 3)), (half_turn, (2, 3))):
        with pytest.raises(ValueError):
            turn(roots_)


def test_refusals():
    for bad in (dict(roots=(0,)), dict(roots=(1, 1), cells=3), dict(roots=(1,), periodic=(True,), reflecting=frozenset({(0, 0)})), dict(roots=(1,), reflecting=frozenset({(0, 0)}), outflow=frozenset({(0, 0)})), dict(roots=(1, 2), extents=((0.0, 1.0), (0.0, 1.0))), dict(roots=(2, 3), rotating=(0, 1)), dict(roots=(2, 3), halfturn=(0, 1))):
        with pytest.raises(ValueError):
            MeshSpec(**bad)
    for bad in (("point", 3, 2), ("point", 2, 1), ("conservative", 2, 2), ("conservative", 3, 4), ("element", 2, 2), ("other", 2, 2)):
        with pytest.raises(ValueError):
            Operators(*bad)
    for bad in (dict(centering=("cell",), ghosts=(-1,)), dict(centering=("cell", "element"), ghosts=(1, 1)), dict(centering=("element",), ghosts=(2,), order=2), dict(centering=("cell",), ghosts=(1,), variables=())):
        with pytest.raises(ValueError):
            Layout(**bad)
    with pytest.raises(ValueError):
        Operators("point", 4, 2).check(Layout(cellcentered(1), (1,)), 8)
    with pytest.raises(ValueError):
        keys.morton(3, 30)
    assert len(staggers(3)) == 8 and len(directions(3)) == 26 and vertexcentered(2) == ("vertex", "vertex")
    assert transfers.group_name("copy", (1, 0), (0, 0)) == "copy:1,0:0,0"
