"""Labelled axes and the algebra of index lists."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Index:
    """An axis of a tensor. Two axes are the same if id, dimension, tags and prime level are."""

    id: str
    dim: int
    tags: frozenset[str] = field(default=frozenset())
    plev: int = 0

    def __post_init__(self) -> None:
        if self.dim < 1 or self.plev < 0:
            raise ValueError(f"index {self.id}: dimension {self.dim}, prime level {self.plev}")

    @property
    def column(self) -> str:
        """The coordinate column that carries this axis."""
        tags = "".join(f"_{t}" for t in sorted(self.tags))
        return f"{self.id}{tags}" + "__p" * self.plev

    def prime(self, n: int = 1) -> Index:
        return replace(self, plev=self.plev + n)

    def noprime(self) -> Index:
        return replace(self, plev=0)

    def set_plev(self, n: int) -> Index:
        return replace(self, plev=n)

    def sim(self) -> Index:
        """The same kind of axis with a fresh identity."""
        return replace(self, id=f"i{uuid.uuid4().hex[:12]}")

    def conj(self) -> Index:
        """Undirected axes are their own conjugates."""
        return self

    def is_contractable(self, other: Index) -> bool:
        return self == other

    def has_tag(self, tag: str) -> bool:
        return tag in self.tags


def new_index(dim: int, *tags: str) -> Index:
    return Index(f"i{uuid.uuid4().hex[:12]}", dim, frozenset(tags))


def new_link(dim: int) -> Index:
    return new_index(dim, "Link")


def dummy_link_pair() -> tuple[Index, Index]:
    """Two ends of a bond of dimension 1."""
    link = new_link(1)
    return link, link


def product_link(indices: Sequence[Index]) -> Index:
    dim = 1
    for i in indices:
        dim *= i.dim
    return new_link(dim)


def sort_indices(indices: Iterable[Index]) -> list[Index]:
    return sorted(indices, key=lambda i: (i.id, i.plev, sorted(i.tags), i.dim))


def check_unique(indices: Sequence[Index]) -> None:
    if len(set(indices)) != len(indices) or len({i.column for i in indices}) != len(indices):
        raise ValueError("an index occurs twice")


def replace_in(indices: Sequence[Index], pairs: Sequence[tuple[Index, Index]]) -> list[Index]:
    """Each old index replaced by its new one; dimensions must agree and every old index must be there."""
    change = dict(pairs)
    for old, new in pairs:
        if old not in indices or old.dim != new.dim:
            raise ValueError(f"can't replace {old.column} by {new.column}")
    out = [change.get(i, i) for i in indices]
    check_unique(out)
    return out


def unique_inds(a: Sequence[Index], b: Sequence[Index]) -> list[Index]:
    return [i for i in a if i not in b]


def common_inds(a: Sequence[Index], b: Sequence[Index]) -> list[Index]:
    return [i for i in a if i in b]


def noncommon_inds(a: Sequence[Index], b: Sequence[Index]) -> list[Index]:
    return unique_inds(a, b) + unique_inds(b, a)


def union_inds(a: Sequence[Index], b: Sequence[Index]) -> list[Index]:
    return [*a, *unique_inds(b, a)]


def has_ind(a: Sequence[Index], i: Index) -> bool:
    return i in a


def has_inds(a: Sequence[Index], wanted: Iterable[Index]) -> bool:
    return all(i in a for i in wanted)


def has_common_inds(a: Sequence[Index], b: Sequence[Index]) -> bool:
    return bool(common_inds(a, b))


def common_positions(a: Sequence[Index], b: Sequence[Index]) -> list[tuple[int, int]]:
    return [(k, list(b).index(i)) for k, i in enumerate(a) if i in b]


def permutation(have: Sequence[Index], want: Sequence[Index]) -> list[int]:
    if sorted(map(hash, have)) != sorted(map(hash, want)):
        raise ValueError("not a permutation")
    return [list(have).index(i) for i in want]
