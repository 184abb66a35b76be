"""Node keys as columns: ``root``, ``level`` and coordinates ``c1`` .. ``cD``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coords(dims: int) -> list[str]:
    return [f"c{d + 1}" for d in range(dims)]


def node(dims: int) -> list[str]:
    return ["root", "level", *coords(dims)]


def is_valid(dims: int, max_level: int = 32) -> Column:
    """Root and level in range, coordinates below 2**level."""
    ok = (F.col("root") >= 0) & F.col("level").between(0, max_level)
    for c in coords(dims):
        ok = ok & (F.col(c) >= 0) & (shift_right(F.col(c), F.col("level")) == 0)
    return ok


def shift_right(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", value.cast("long"), F.lit(by) if isinstance(by, int) else by.cast("int"))


def shift_left(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", value.cast("long"), F.lit(by) if isinstance(by, int) else by.cast("int"))


def morton(dims: int, levels: int, level: Column | None = None, names: list[str] | None = None) -> Column:
    """The place on the curve as a long: coordinates at the finest level, bits interleaved, the first
    dimension most significant.  Needs dims * levels <= 62."""
    if dims * levels > 62:
        raise ValueError("the curve's key holds 62 bits")
    at = F.col("level") if level is None else level
    fine = [shift_left(F.col(c), F.lit(levels) - at) for c in names or coords(dims)]
    key = F.lit(0).cast("long")
    for bit in range(levels - 1, -1, -1):
        for x in fine:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(x, bit).bitwiseAND(F.lit(1).cast("long")))
    return key


def skey(dims: int) -> Column:
    """The general sort key as binary: root, interleaved coordinates of 32 levels, level; unsigned bytes sort in curve order."""
    fine = [shift_left(F.col(c), F.lit(32) - F.col("level")) for c in coords(dims)]
    hexes = [F.lpad(F.hex(F.col("root").cast("long")), 8, "0")]
    for word in range(0, 32 * dims, 32):
        part = F.lit(0).cast("long")
        for k in range(word, word + 32):
            bit = F.shiftright(fine[k % dims], 31 - k // dims).bitwiseAND(F.lit(1).cast("long"))
            part = F.shiftleft(part, 1).bitwiseOR(bit)
        hexes.append(F.lpad(F.hex(part), 8, "0"))
    hexes.append(F.lpad(F.hex(F.col("level").cast("long")), 2, "0"))
    return F.unhex(F.concat(*hexes))


def is_ancestor(a: str, b: str, dims: int) -> Column:
    """Whether the node of struct ``a`` is a strict ancestor of that of struct ``b``."""
    ok = (F.col(f"{a}.root") == F.col(f"{b}.root")) & (F.col(f"{a}.level") < F.col(f"{b}.level"))
    for c in coords(dims):
        gap = F.greatest(F.col(f"{b}.level") - F.col(f"{a}.level"), F.lit(0))
        ok = ok & (shift_right(F.col(f"{b}.{c}"), gap) == F.col(f"{a}.{c}"))
    return ok
