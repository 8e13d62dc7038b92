"""Partitioned tensors: disjoint regions of fixed coordinates, each a tensor of its own."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from ..index import Index
from ..session import cut_lineage
from ..tensor import Tensor, contract_pair


@dataclass(frozen=True)
class Projector:
    """Fixed coordinates on some indices."""

    at: tuple[tuple[Index, int], ...] = ()

    @staticmethod
    def of(at: Mapping[Index, int]) -> Projector:
        if any(not 0 <= k < i.dim for i, k in at.items()):
            raise ValueError("a coordinate is outside its index")
        return Projector(tuple(sorted(at.items(), key=lambda x: x[0].column)))

    @property
    def fixed(self) -> dict[Index, int]:
        return dict(self.at)

    def compatible(self, other: Projector) -> bool:
        return all(other.fixed.get(i, k) == k for i, k in self.at)

    def disjoint(self, other: Projector) -> bool:
        return not self.compatible(other)

    def intersection(self, other: Projector) -> Projector | None:
        """The common region, or None."""
        return Projector.of(self.fixed | other.fixed) if self.compatible(other) else None

    def common_restriction(self, other: Projector) -> Projector:
        """The smallest region that holds both."""
        return Projector.of({i: k for i, k in self.at if other.fixed.get(i) == k})

    def subset_of(self, other: Projector) -> bool:
        return all(self.fixed.get(i) == k for i, k in other.at)

    def filter(self, indices: Sequence[Index]) -> Projector:
        return Projector.of({i: k for i, k in self.at if i in indices})


@dataclass(frozen=True)
class Partitioned:
    """Pairwise disjoint patches; a patch is masked to its region."""

    patches: tuple[tuple[Projector, Tensor], ...]

    @staticmethod
    def of(patches: Sequence[tuple[Projector, Tensor]]) -> Partitioned:
        for k, (p, _) in enumerate(patches):
            if any(not p.disjoint(q) for q, _ in patches[:k]):
                raise ValueError("regions overlap")
        return Partitioned(tuple((p, t.mask_index(p.fixed)) for p, t in patches))

    @staticmethod
    def split(t: Tensor, index: Index) -> Partitioned:
        """A patch for each coordinate of an index; filters on it then reach one patch only."""
        return Partitioned.of([(Projector.of({index: k}), t) for k in range(index.dim)])

    def insert(self, p: Projector, t: Tensor) -> Partitioned:
        return Partitioned.of([*self.patches, (p, t)])

    def prune(self, at: Mapping[Index, int]) -> Partitioned:
        """The patches that meet a region, restricted to it."""
        region = Projector.of(at)
        return Partitioned(tuple((p.intersection(region), t.mask_index(at)) for p, t in self.patches if p.compatible(region)))

    def whole(self) -> Tensor:
        """The union of all patches; regions are disjoint, so nothing has to be summed."""
        df, t = None, self.patches[0][1]
        for _, x in self.patches:
            df = t._as(x) if df is None else df.unionByName(t._as(x))
        return t._like(df)

    def norm_squared(self) -> float:
        return self.whole().norm_squared()

    def norm(self) -> float:
        return math.sqrt(self.norm_squared())

    @staticmethod
    def summed(parts: Sequence[tuple[Projector, Tensor]]) -> Partitioned:
        """Sums where regions meet: those that overlap become one patch, on the smallest region that holds them."""
        out: list[tuple[Projector, Tensor]] = []
        for p, t in parts:
            t = t.mask_index(p.fixed)
            while (k := next((k for k, (q, _) in enumerate(out) if not q.disjoint(p)), None)) is not None:
                q, x = out.pop(k)
                p, t = p.common_restriction(q), x.add(t)
            out.append((p, t))
        return Partitioned(tuple(out))

    def append(self, other: Partitioned) -> Partitioned:
        """The patches of both; regions must stay disjoint."""
        return Partitioned.of([*self.patches, *other.patches])

    def inner(self, other: Partitioned) -> complex:
        """Sum of conj(self) * other; only patches that meet are joined."""
        return sum(a.inner(b) for p, a in self.patches for q, b in other.patches if p.compatible(q))

    def add(self, other: Partitioned) -> Partitioned:
        return Partitioned.summed([*self.patches, *other.patches])

    def contract(self, other: Partitioned) -> Partitioned:
        """Products of compatible patches, summed where their regions on the remaining indices meet."""
        parts = []
        for p, a in self.patches:
            for q, b in other.patches:
                if p.compatible(q):
                    c = contract_pair(a, b)
                    parts.append((p.intersection(q).filter(c.indices), c))
        return Partitioned.summed(parts)


def adaptive(t: Tensor, indices: Sequence[Index], most_rows: int) -> Partitioned:
    """Splits along indices in turn until no patch stores more than most_rows rows (or no index is left)."""
    done, todo = [], [(Projector(), t, list(indices))]
    while todo:
        p, x, rest = todo.pop()
        if not rest or x.df.limit(most_rows + 1).count() <= most_rows:
            done.append((p, x))
            continue
        i = rest[0]
        for k in range(i.dim):
            part = x.mask_index({i: k})
            if not part.df.isEmpty():
                todo.append((Projector.of(p.fixed | {i: k}), part._like(cut_lineage(part.df)), rest[1:]))
    return Partitioned(tuple(done))
