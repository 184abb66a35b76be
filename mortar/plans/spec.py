"""Specifications of meshes, field layouts and operator families, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

MAX_LEVEL = 32
FAMILIES = ("point", "conservative", "element")


@dataclass(frozen=True)
class MeshSpec:
    """A brick of root boxes; faces are outer unless named periodic, reflecting or outflow.

    ``reflecting`` and ``outflow`` hold (dimension, side) pairs, dimensions from 0, sides 0 and 1.
    ``rotating`` names two dimensions joined by a quarter turn, ``halfturn`` two joined by a half turn.
    """

    roots: tuple[int, ...]
    cells: int = 4
    periodic: tuple[bool, ...] = ()
    reflecting: frozenset[tuple[int, int]] = frozenset()
    outflow: frozenset[tuple[int, int]] = frozenset()
    rotating: tuple[int, int] | None = None
    halfturn: tuple[int, int] | None = None
    extents: tuple[tuple[float, float], ...] = ()
    generation: int = 0

    def __post_init__(self) -> None:
        d = len(self.roots)
        object.__setattr__(self, "periodic", self.periodic or (False,) * d)
        object.__setattr__(self, "extents", self.extents or tuple((0.0, float(r)) for r in self.roots))
        if not 1 <= d <= 3 or min(self.roots) < 1:
            raise ValueError("a mesh has one to three dimensions of one root or more")
        if len(self.periodic) != d or len(self.extents) != d:
            raise ValueError("periodic and extents need one entry a dimension")
        if self.cells < 2 or self.cells % 2:
            raise ValueError("cells per block must be even")
        for dim, side in self.reflecting | self.outflow:
            if not (0 <= dim < d and side in (0, 1)):
                raise ValueError("no such face")
            if self.periodic[dim]:
                raise ValueError("a periodic dimension has no reflecting or outflow face")
        if self.reflecting & self.outflow:
            raise ValueError("a face is reflecting or outflow, not both")
        if any(hi <= lo for lo, hi in self.extents):
            raise ValueError("extents must increase")
        widths = [(hi - lo) / r for (lo, hi), r in zip(self.extents, self.roots, strict=True)]
        if max(widths) - min(widths) > 4096 * 2.3e-16 * max(widths):
            raise ValueError("root boxes must be cubes")
        if self.rotating and self.halfturn:
            raise ValueError("one seam at most")
        for seam in filter(None, (self.rotating, self.halfturn)):
            a, b = seam
            if a == b or not (0 <= a < d and 0 <= b < d):
                raise ValueError("a seam joins two dimensions")
            if self.periodic[a] or self.periodic[b]:
                raise ValueError("a seam's dimensions are not periodic")
            if any(dim in seam and side == 1 for dim, side in self.reflecting | self.outflow):
                raise ValueError("high faces of a seam's dimensions must be outer")
        if self.rotating and self.roots[self.rotating[0]] != self.roots[self.rotating[1]]:
            raise ValueError("a quarter turn needs as many roots in both dimensions")
        if self.halfturn and self.roots[self.halfturn[1]] % 2:
            raise ValueError("a half turn needs an even number of roots across")

    @property
    def dims(self) -> int:
        return len(self.roots)

    def without_seam(self) -> None:
        """Refuses a brick with a seam where steps across it are not followed; ``patches.of_brick`` gives the forest that follows them."""
        if self.rotating or self.halfturn:
            raise ValueError("a brick with a seam is stepped through as a forest of patches")

    @property
    def root_spacing(self) -> float:
        lo, hi = self.extents[0]
        return (hi - lo) / self.roots[0] / self.cells

    def spacing(self, level: int) -> float:
        return self.root_spacing / 2**level

    def root_position(self, root: int) -> tuple[int, ...]:
        """The root's place in the brick, the first dimension fastest."""
        out = []
        for r in self.roots:
            out.append(root % r)
            root //= r
        return tuple(out)

    def root_index(self, position: tuple[int, ...]) -> int:
        index = 0
        for p, r in zip(reversed(position), reversed(self.roots), strict=True):
            index = index * r + p
        return index


def directions(dims: int) -> list[tuple[int, ...]]:
    """The nonzero steps of -1, 0 and 1."""
    return [d for d in product((-1, 0, 1), repeat=dims) if any(d)]


@dataclass(frozen=True)
class Layout:
    """How a field set is stored: centering and ghost width by dimension, and the variables."""

    centering: tuple[str, ...]
    ghosts: tuple[int, ...]
    variables: tuple[str, ...] = ("v1",)
    order: int = 0
    walls: str = "half_open"
    parity: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if len(self.centering) != len(self.ghosts) or not self.variables:
            raise ValueError("one centering and ghost width a dimension, and a variable")
        kinds = set(self.centering)
        if kinds - {"cell", "vertex", "element"} or ("element" in kinds and len(kinds) > 1):
            raise ValueError("cell or vertex by dimension, or element in all")
        if min(self.ghosts) < 0:
            raise ValueError("ghost widths are not negative")
        if "element" in kinds and (self.order < 1 or max(self.ghosts) > 1):
            raise ValueError("elements have an order and one ghost at most")
        if self.walls not in ("half_open", "symmetric"):
            raise ValueError("walls are half_open or symmetric")

    @property
    def stagger(self) -> tuple[int, ...]:
        return tuple(int(c == "vertex") for c in self.centering)

    def check(self, cells: int) -> None:
        for g, c in zip(self.ghosts, self.stagger, strict=True):
            if cells < 2 * g + 2 * c:
                raise ValueError("a block needs twice its ghosts and its shared plane")
        if self.centering[0] == "element" and cells % (2 * (self.order + 1)):
            raise ValueError("cells must hold whole pairs of elements")

    def stored(self, cells: int) -> list[range]:
        return [range(1, cells + 2 * g + c + 1) for g, c in zip(self.ghosts, self.stagger, strict=True)]

    def owned(self, cells: int) -> list[range]:
        return [range(g + 1, g + cells + 1) for g in self.ghosts]

    def closed(self, cells: int) -> list[range]:
        return [range(g + 1, g + cells + c + 1) for g, c in zip(self.ghosts, self.stagger, strict=True)]


def cellcentered(dims: int) -> tuple[str, ...]:
    return ("cell",) * dims


def vertexcentered(dims: int) -> tuple[str, ...]:
    return ("vertex",) * dims


def facecentered(dims: int, normal: int) -> tuple[str, ...]:
    return tuple("vertex" if d == normal else "cell" for d in range(dims))


def edgecentered(dims: int, along: int) -> tuple[str, ...]:
    return tuple("cell" if d == along else "vertex" for d in range(dims))


def elementcentered(dims: int) -> tuple[str, ...]:
    return ("element",) * dims


def staggers(dims: int) -> list[tuple[str, ...]]:
    return [tuple("vertex" if c else "cell" for c in s) for s in product((0, 1), repeat=dims)]


@dataclass(frozen=True)
class Operators:
    """An operator family and its orders; there are no default orders.

    ``vertex_prolongation`` is the even order that a conservative set takes along its vertex dimensions."""

    family: str
    prolongation: int = 0
    restriction: int = 0
    bounded: bool = False
    vertex_prolongation: int = 0

    def __post_init__(self) -> None:
        p, r = self.prolongation, self.restriction
        if self.family not in FAMILIES:
            raise ValueError("unknown family")
        if self.family == "element":
            if p or r or self.bounded or self.vertex_prolongation:
                raise ValueError("the element family takes no orders")
        elif self.family == "point":
            if p < 2 or r < 2 or p % 2 or r % 2:
                raise ValueError("point values need even orders of 2 or more")
        elif p < 1 or p % 2 == 0 or r != 2 or (self.bounded and p > 3):
            raise ValueError("the conservative family needs an odd prolongation (1 or 3 if bounded) and restriction 2")

        if v := self.vertex_prolongation:
            if self.family != "conservative" or v < 2 or v % 2 or self.bounded:
                raise ValueError("vertex_prolongation is an even order of the unbounded conservative family")

    def order_along(self, stagger: int) -> int:
        """The order of prolongation along a cell (0) or vertex (1) dimension."""
        return self.vertex_prolongation if stagger and self.family == "conservative" else self.prolongation

    def check(self, layout: Layout, cells: int) -> None:
        """Whether a layout has the ghosts and cells that the orders need."""
        layout.check(cells)
        p, r = self.prolongation, self.restriction
        for g, kind in zip(layout.ghosts, layout.centering, strict=True):
            if (kind == "element") != (self.family == "element"):
                raise ValueError("element sets take the element family, and no other sets do")
            if kind == "element":
                continue
            if kind == "vertex" and not self.order_along(1):
                raise ValueError("a conservative set with a vertex dimension needs vertex_prolongation")
            if self.family == "point" and kind == "cell":
                if g < p // 2 or cells < 2 * g + r // 2 - 1 or cells < r:
                    raise ValueError("too few ghosts or cells for these orders")
            elif self.family == "conservative" and kind == "cell":
                if g < (p - 1) // 2:
                    raise ValueError("too few ghosts for this prolongation")
            elif kind == "vertex" and g < self.order_along(1) // 2 - 1:
                raise ValueError("too few ghosts for this prolongation")
