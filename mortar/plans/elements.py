"""Gauss-Lobatto element tables, computed with 60 decimal digits and rounded once.

For order P an element has P + 1 nodes.  ``interpolation`` takes a parent's nodes to those of its two
halves, ``restriction`` is the compatible M_c^-1 I^T M_f with lumped masses, ``coarsening`` the exact
least-squares projection of the halves onto the parent."""

from __future__ import annotations

from decimal import Decimal, getcontext
from functools import cache

getcontext().prec = 60
Matrix = list[list[Decimal]]


def legendre(n: int, x: Decimal) -> tuple[Decimal, Decimal]:
    """P_n(x) and P_n'(x)."""
    before, now = Decimal(1), x
    if n == 0:
        return Decimal(1), Decimal(0)
    for k in range(2, n + 1):
        before, now = now, ((2 * k - 1) * x * now - (k - 1) * before) / k
    slope = n * (x * now - before) / (x * x - 1) if abs(x) != 1 else x ** (n - 1) * n * (n + 1) / 2
    return now, slope


def roots(f, slope, guesses: list[float]) -> list[Decimal]:
    out = []
    for g in guesses:
        x = Decimal(g)
        for _ in range(60):
            dx = f(x) / slope(x)
            x -= dx
            if abs(dx) < Decimal(10) ** -55:
                break
        out.append(x)
    return sorted(out)


@cache
def lobatto(order: int) -> tuple[tuple[Decimal, ...], tuple[Decimal, ...]]:
    """Nodes and weights on [-1, 1]."""
    import numpy as np

    p = np.polynomial.legendre.Legendre.basis(order)
    inner = roots(lambda x: legendre(order, x)[1], lambda x: (2 * x * legendre(order, x)[1] - order * (order + 1) * legendre(order, x)[0]) / (1 - x * x), [float(x) for x in p.deriv().roots()] if order > 1 else [])
    nodes = (Decimal(-1), *inner, Decimal(1))
    return nodes, tuple(Decimal(2) / (order * (order + 1) * legendre(order, x)[0] ** 2) for x in nodes)


@cache
def gauss(n: int) -> tuple[tuple[Decimal, ...], tuple[Decimal, ...]]:
    import numpy as np

    guesses = [float(x) for x in np.polynomial.legendre.leggauss(n)[0]]
    nodes = tuple(roots(lambda x: legendre(n, x)[0], lambda x: legendre(n, x)[1], guesses))
    return nodes, tuple(2 / ((1 - x * x) * legendre(n, x)[1] ** 2) for x in nodes)


def barycentric(nodes: tuple[Decimal, ...]) -> list[Decimal]:
    out = []
    for k, x in enumerate(nodes):
        w = Decimal(1)
        for j, y in enumerate(nodes):
            if j != k:
                w /= x - y
        out.append(w)
    return out


def basis(nodes: tuple[Decimal, ...], x: Decimal) -> list[Decimal]:
    """The nodal polynomials at ``x``."""
    out = []
    for k, a in enumerate(nodes):
        v = Decimal(1)
        for j, b in enumerate(nodes):
            if j != k:
                v *= (x - b) / (a - b)
        out.append(v)
    return out


def halves(nodes: tuple[Decimal, ...]) -> list[Decimal]:
    return [(x - 1) / 2 for x in nodes] + [(x + 1) / 2 for x in nodes]


@cache
def interpolation(order: int) -> Matrix:
    """2(P+1) rows by P+1 columns."""
    nodes, _ = lobatto(order)
    return [basis(nodes, x) for x in halves(nodes)]


@cache
def restriction(order: int) -> Matrix:
    """P+1 rows by 2(P+1) columns."""
    _, w = lobatto(order)
    up = interpolation(order)
    fine = [x / 2 for x in w] * 2
    return [[up[f][c] * fine[f] / w[c] for f in range(len(fine))] for c in range(order + 1)]


@cache
def coarsening(order: int) -> Matrix:
    """P+1 rows by 2(P+1) columns: the exact projection, by Gauss quadrature."""
    nodes, _ = lobatto(order)
    xs, ws = gauss(order + 1)
    mass = [[sum(w * basis(nodes, x)[i] * basis(nodes, x)[j] for x, w in zip(xs, ws, strict=True)) for j in range(order + 1)] for i in range(order + 1)]
    right: Matrix = [[] for _ in range(order + 1)]
    for half in (0, 1):
        for k in range(order + 1):
            for i in range(order + 1):
                right[i].append(sum(w / 2 * basis(nodes, (x + 2 * half - 1) / 2)[i] * basis(nodes, x)[k] for x, w in zip(xs, ws, strict=True)))
    return solve(mass, right)


def solve(a: Matrix, b: Matrix) -> Matrix:
    """Gauss-Jordan elimination with pivoting."""
    n, rows = len(a), [list(x) + list(y) for x, y in zip(a, b, strict=True)]
    for k in range(n):
        p = max(range(k, n), key=lambda r: abs(rows[r][k]))  # noqa: B023
        rows[k], rows[p] = rows[p], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [r[n:] for r in rows]


def stencil(kind: str, n: int, g: int, order: int, step: int, offset: int, whole: bool) -> dict[int, list[tuple[int, float]]]:
    """One dimension of a transfer between blocks of ``n`` points.  Across a face the source's face node is copied; along it
    parents are interpolated and children restricted, or, when whole blocks move (``whole``), projected."""
    if step:
        return {g + n + 1: [(g + 1, 1.0)]} if step > 0 else {g: [(g + n, 1.0)]}
    width = order + 1
    if kind == "copy":
        return {g + 1 + k: [(g + 1 + k, 1.0)] for k in range(n)}
    half, out = n // width // 2, {}  # of the block's elements
    if kind == "prolong":
        table = interpolation(order)
        for k in range(n):
            parent, side = divmod(offset * n // width + k // width, 2)
            out[g + 1 + k] = [(g + 1 + parent * width + b, float(w)) for b, w in enumerate(table[side * width + k % width])]
        return out
    table = coarsening(order) if whole else restriction(order)
    for k in range(half * width):
        first = g + 1 + k // width * 2 * width
        out[g + 1 + offset * half * width + k] = [(first + f, float(w)) for f, w in enumerate(table[k % width])]
    return out
