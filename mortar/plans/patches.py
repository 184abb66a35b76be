"""Forests of several bricks glued face to face.

A glue entry says that patch ``p`` meets patch ``q`` across face (d, side) at face (d2, side2); ``perm`` and ``flip``
are in gather form: axis e of ``q`` runs along axis perm[e] of ``p``, backwards if flip[e]."""

from __future__ import annotations

from dataclasses import dataclass

from mortar.plans.spec import MeshSpec


@dataclass(frozen=True)
class Glue:
    p: int
    d: int
    side: int
    q: int
    d2: int
    side2: int
    perm: tuple[int, ...]
    flip: tuple[bool, ...]

    def reverse(self) -> Glue:
        perm, flip = [0] * len(self.perm), [False] * len(self.perm)
        for e, (a, f) in enumerate(zip(self.perm, self.flip, strict=True)):
            perm[a], flip[a] = e, f
        return Glue(self.q, self.d2, self.side2, self.p, self.d, self.side, tuple(perm), tuple(flip))


@dataclass(frozen=True)
class PatchMesh:
    """Patches of roots, numbered flat one patch after another, and glue in both directions."""

    patches: tuple[tuple[int, ...], ...]
    glue: tuple[Glue, ...]
    cells: int = 4

    def __post_init__(self) -> None:
        dims = {len(p) for p in self.patches}
        if len(dims) != 1:
            raise ValueError("all patches have one number of dimensions")
        if len(self.glue) > 127:
            raise ValueError("at most 127 glued faces")
        seen = set()
        for g in self.glue:
            if (g.p, g.d, g.side) in seen:
                raise ValueError("a face is glued once")
            seen.add((g.p, g.d, g.side))
            if sorted(g.perm) != list(range(self.dims)) or g.perm[g.d2] != g.d:
                raise ValueError("the axis map is a permutation that takes normal to normal")
            # outward along (d, side) must run inward along (d2, side2)
            if g.flip[g.d2] != (g.side == g.side2):
                raise ValueError("the map must send outward to inward")
            for e in range(self.dims):
                if e != g.d2 and self.patches[g.q][e] != self.patches[g.p][g.perm[e]]:
                    raise ValueError("root counts must agree under the map")
            if g.reverse() not in self.glue:
                raise ValueError("glue goes both ways, each the inverse of the other")

    @property
    def dims(self) -> int:
        return len(self.patches[0])

    @property
    def corners(self) -> list[int]:
        """Patches glued along two dimensions or more: an edge of theirs is met through two faces."""
        return [p for p in range(len(self.patches)) if len({g.d for g in self.glue if g.p == p}) > 1]

    @property
    def first_roots(self) -> list[int]:
        out, at = [], 0
        for p in self.patches:
            out.append(at)
            n = 1
            for r in p:
                n *= r
            at += n
        return out

    @property
    def n_roots(self) -> int:
        n = 1
        for r in self.patches[-1]:
            n *= r
        return self.first_roots[-1] + n


def both_ways(*entries: Glue) -> tuple[Glue, ...]:
    """The entries and their inverses; a face glued to itself by its own inverse stands once."""
    return tuple(dict.fromkeys(x for g in entries for x in (g, g.reverse())))


def quarter_turn(roots: tuple[int, int], cells: int = 4) -> PatchMesh:
    """A quadrant whose low faces meet by a quarter turn about their common edge."""
    if roots[0] != roots[1]:
        raise ValueError("a quarter turn needs as many roots in both dimensions")
    return PatchMesh((roots,), both_ways(Glue(0, 0, 0, 0, 1, 0, (1, 0), (False, True))), cells)


def half_turn(roots: tuple[int, int], cells: int = 4) -> PatchMesh:
    """A half plane whose low face of the first dimension meets itself by a half turn about its middle."""
    if roots[1] % 2:
        raise ValueError("a half turn needs an even number of roots across")
    return PatchMesh((roots,), both_ways(Glue(0, 0, 0, 0, 0, 0, (0, 1), (True, True))), cells)


def of_brick(mesh: MeshSpec) -> PatchMesh:
    """The forest of one patch whose glue is a brick's seam: the low faces of the two dimensions meet by a quarter turn, or
    the first one's low face meets itself by a half turn."""
    axes = list(range(mesh.dims))
    if mesh.rotating:
        a, b = mesh.rotating
        axes[a], axes[b] = b, a
        seam = Glue(0, a, 0, 0, b, 0, tuple(axes), tuple(d == b for d in range(mesh.dims)))
    elif mesh.halfturn:
        a, b = mesh.halfturn
        seam = Glue(0, a, 0, 0, a, 0, tuple(axes), tuple(d in (a, b) for d in range(mesh.dims)))
    else:
        return PatchMesh((mesh.roots,), (), mesh.cells)
    return PatchMesh((mesh.roots,), both_ways(seam), mesh.cells)
