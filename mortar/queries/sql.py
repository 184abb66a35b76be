"""Shared common table expressions for DuckDB: the graded mesh of line items."""

L, PARTS, N = 6, 66, 4


def cells(bits: int, name: str = "cell") -> str:
    n = 1 << bits
    return f"""{name} AS (
  SELECT (l_partkey * l_partkey * {n}) // (p * p) AS c1, (l_suppkey * l_suppkey * {n}) // (s * s) AS c2,
    count(*) AS cnt, sum(l_quantity) AS mass
  FROM lineitem, (SELECT max(l_partkey) + 1 AS p, max(l_suppkey) + 1 AS s FROM lineitem) GROUP BY 1, 2)"""


def totals(bits: int, source: str = "cell", name: str = "tot") -> str:
    return f"""{name} AS (
  SELECT l.l AS level, c1 >> ({bits} - l.l) AS c1, c2 >> ({bits} - l.l) AS c2, CAST(sum(cnt) AS BIGINT) AS cnt, sum(mass) AS mass
  FROM {source}, (SELECT CAST(range AS INTEGER) AS l FROM range({bits + 1})) l GROUP BY ALL)"""


KIDS = "(SELECT CAST(range AS BIGINT) AS a FROM range(2)), (SELECT CAST(range AS BIGINT) AS b FROM range(2))"
DIRS = "(SELECT CAST(x.range - 1 AS INTEGER) AS d1, CAST(y.range - 1 AS INTEGER) AS d2 FROM range(3) x, range(3) y WHERE x.range <> 1 OR y.range <> 1) d"


def from_inner(inner: str, name: str) -> str:
    """Leaves of the tree whose inner nodes are given."""
    return f"""{name} AS (
  SELECT n.* FROM (SELECT 0 AS level, CAST(0 AS BIGINT) AS c1, CAST(0 AS BIGINT) AS c2
    UNION ALL SELECT level + 1, c1 * 2 + a, c2 * 2 + b FROM {inner}, {KIDS}) n ANTI JOIN {inner} USING (level, c1, c2))"""


def spread(x: str, shift: int) -> str:
    return " + ".join(f"(((({x} << ({L} - level)) >> {b}) & 1) << {2 * b + shift})" for b in range(L))


def numbered(source: str, name: str) -> str:
    key = f"CAST({spread('c1', 1)} + {spread('c2', 0)} AS BIGINT)"
    return f"""{name} AS (
  SELECT 0 AS root, level, c1, c2, {key} AS skey, row_number() OVER (ORDER BY {key}) AS leaf FROM {source})"""


INNER = f"inn AS (SELECT level, c1, c2 FROM tot WHERE cnt * {PARTS} > (SELECT count(*) FROM lineitem) AND level < {L})"
#: leaf: the graded mesh, numbered.
GRADED = ",\n".join([cells(L), totals(L), INNER, from_inner("inn", "raw"), numbered("raw", "leaf")])


def balanced(source: str, name: str, periodic: bool = False) -> str:
    """Needs WITH RECURSIVE; the balanced refinement of ``source``, numbered as ``name``."""
    at = lambda c, d: f"(((c.{c} >> 1) + {d} + (1 << (level - 1))) % (1 << (level - 1)))" if periodic else f"((c.{c} >> 1) + {d})"
    inside = "" if periodic else " AND (c1 >> 1) + d1 BETWEEN 0 AND (1 << (level - 1)) - 1 AND (c2 >> 1) + d2 BETWEEN 0 AND (1 << (level - 1)) - 1"
    here = "(SELECT CAST(x.range - 1 AS INTEGER) AS d1, CAST(y.range - 1 AS INTEGER) AS d2 FROM range(3) x, range(3) y) d"
    return f"""{name}_need AS (
  SELECT level, c1, c2 FROM {source}
  UNION SELECT level - 1, CAST({at("c1", "d1")} AS BIGINT), CAST({at("c2", "d2")} AS BIGINT) FROM {name}_need c, {here} WHERE level >= 1{inside}),
{name}_inn AS (SELECT DISTINCT level - 1 AS level, c1 >> 1 AS c1, c2 >> 1 AS c2 FROM {name}_need WHERE level > 0),
{from_inner(f"{name}_inn", f"{name}_raw")},
{numbered(f"{name}_raw", name)}"""


FINE = L + 2
#: val: the quantity in each owned cell of the leaves ``leaf``: (leaf, level, i1, i2, x1, x2, v1), x being the cell at its level.
def values(leaves: str = "leaf", name: str = "val") -> str:
    return f"""{cells(FINE, "fcell")},
{totals(FINE, "fcell", "ftot")},
{name} AS (
  SELECT g.*, coalesce(t.mass, 0.0) AS v1 FROM (
    SELECT leaf, level, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2, c1 * {N} + i.range - 1 AS x1, c2 * {N} + j.range - 1 AS x2
    FROM {leaves}, range(1, {N + 1}) i, range(1, {N + 1}) j) g
  LEFT JOIN ftot t ON t.level = g.level + 2 AND t.c1 = g.x1 AND t.c2 = g.x2)"""
