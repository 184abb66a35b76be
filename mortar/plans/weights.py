"""One-dimensional stencils in exact rationals, rounded once.

A stencil maps each target row (a stored index from 1) to its source rows and weights.
Indices, targets and source windows follow the stored layout: ``g`` ghosts, ``n`` cells, ``g`` ghosts,
and one more row for a vertex dimension.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from itertools import product
from math import floor

Stencil = dict[int, list[tuple[int, Fraction]]]


@cache
def lagrange(order: int, at: Fraction) -> tuple[Fraction, ...]:
    """Weights of the nodes 0 .. order-1 for the value at ``at``."""
    out = []
    for k in range(order):
        w = Fraction(1)
        for j in range(order):
            if j != k:
                w *= (at - j) / Fraction(k - j)
        out.append(w)
    return tuple(out)


@cache
def subcell(order: int) -> tuple[tuple[Fraction, ...], tuple[Fraction, ...]]:
    """Averages over the low and high half of the middle of ``order`` cells, through the primitive."""
    middle = order // 2
    edge = lagrange(order + 1, Fraction(2 * middle + 1, 2))  # the primitive at the middle's centre, from the edges
    # the primitive's value at edge e is the sum of the cells before it
    centre = [sum(edge[e] for e in range(k + 1, order + 1)) for k in range(order)]
    low = tuple(2 * (centre[k] - int(k < middle)) for k in range(order))
    high = tuple(2 * (int(k < middle + 1) - centre[k]) for k in range(order))
    return low, high


def targets(n: int, g: int, c: int, step: int, kind: str = "copy", offset: int = 0) -> range:
    if step > 0:
        return range(g + n + 1, n + 2 * g + c + 1)
    if step < 0:
        return range(1, g + 1)
    if kind == "restrict":
        return range(g + 1 + offset * n // 2, g + offset * n // 2 + n // 2 + 1)
    return range(g + 1, g + n + 1)


def copy(n: int, g: int, c: int, step: int) -> Stencil:
    return {j: [(j - n * step, Fraction(1))] for j in targets(n, g, c, step)}


def window(order: int, at: Fraction, first: int, last: int) -> list[tuple[int, Fraction]]:
    """The ``order`` rows around ``at``, moved into ``first`` .. ``last``, and their weights; a place outside them is refused."""
    low = min(max(floor(at) - order // 2 + 1, first), last - order + 1)
    if low < first or not low <= at <= low + order - 1:
        raise ValueError("the stencil would extrapolate")
    return [(low + k, w) for k, w in enumerate(lagrange(order, at - low))]


def restrict(n: int, g: int, c: int, step: int, offset: int, order: int) -> Stencil:
    """From a finer source with child offset ``offset``; windows stay inside the fine interior."""
    out = {}
    for j in targets(n, g, c, step, "restrict", offset):
        place = j - n * step - g - 1  # in the source's parent, from 0
        if 0 <= place - offset * n // 2 < n // 2 + c:
            fine = Fraction(2 * place - offset * n + g + 1)
            row = [(int(fine), Fraction(1))] if c else window(order, fine + Fraction(1, 2), g + 1, g + n)
            if all(g < s <= g + n + c for s, _ in row):
                out[j] = row
    return out


def source_step(step: int, offset: int) -> int:
    """The step to a coarser source, seen from the target's parent: a child steps out of it on its own side only."""
    return step if (step > 0) == bool(offset) else 0


def prolong(n: int, g: int, c: int, step: int, offset: int, order: int, conservative: bool) -> Stencil:
    """From a coarser source, for a target with child offset ``offset``; ``conservative`` by averages of cells."""
    first, out = g + 1 - n * source_step(step, offset), {}
    for j in targets(n, g, c, step):
        fine = offset * n + j - g - 1  # in half cells of the parent, from 0
        if conservative and not c:
            low = first + fine // 2 - order // 2
            out[j] = [(low + k, w) for k, w in enumerate(subcell(order)[fine % 2])]
        else:
            out[j] = window(order, first + Fraction(fine, 2) - Fraction(1 - c, 4), 1, n + 2 * g + c)
    return out


def wall_plane(n: int, g: int, order: int, side: int) -> list[tuple[int, Fraction]]:
    """A vertex dimension's wall plane from the ``order / 2`` rows on its inner side: the symmetric interpolant, folded."""
    half = order // 2
    places = [k for k in range(-half, half + 1) if k]
    plane, out = (g + n + 1, []) if side else (g + 1, [])
    for k in range(1, half + 1):
        w = Fraction(2)
        for other in places:
            if other != k:
                w *= Fraction(-other, k - other)
        out.append((plane - k if side else plane + k, w))
    return sorted(out)


def tensor(stencils: list[Stencil]) -> list[tuple[tuple[int, ...], tuple[int, ...], float]]:
    """(target index, source index, weight) rows of the product; zero weights are left out."""
    rows = []
    for target in product(*stencils):
        for taps in product(*(s[t] for s, t in zip(stencils, target, strict=True))):
            w = Fraction(1)
            for _, x in taps:
                w *= x
            if w:
                rows.append((target, tuple(s for s, _ in taps), float(w)))
    return rows
