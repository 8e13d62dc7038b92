"""Tensor networks on trees and chains.

The topology is a small dictionary on the driver: node name to tensor; two nodes are joined if they share an index. The
payload of each node stays a coordinate table. Chains (trains) and operators on chains are networks with numbered nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..index import Index, common_inds, new_index, new_link
from ..operators.factorize import Truncation, qr, svd, tensor_of
from ..session import cut_lineage
from ..tensor import Tensor, contract, contract_pair, copy_tensor, delta, direct_sum, from_dense, onehot

#: Steps of a fold over nodes after which its plan is cut.
CUT_EVERY = 6


@dataclass(frozen=True)
class Network:
    """A tree of tensors."""

    tensors: dict[Hashable, Tensor]

    # -- topology ---------------------------------------------------------------------------------

    @property
    def nodes(self) -> list[Hashable]:
        return list(self.tensors)

    def edges(self) -> dict[tuple[Hashable, Hashable], Index]:
        holders: dict[Index, list[Hashable]] = {}
        for n, t in self.tensors.items():
            for i in t.indices:
                holders.setdefault(i, []).append(n)
        return {tuple(h): i for i, h in holders.items() if len(h) == 2}

    def neighbours(self, node: Hashable) -> list[Hashable]:
        return [b if a == node else a for a, b in self.edges() if node in (a, b)]

    def external_indices(self) -> list[Index]:
        bonds = set(self.edges().values())
        return [i for t in self.tensors.values() for i in t.indices if i not in bonds]

    def site_indices(self, node: Hashable) -> list[Index]:
        bonds = set(self.edges().values())
        return [i for i in self.tensors[node].indices if i not in bonds]

    def indices_with_tag(self, tag: str) -> list[Index]:
        return [i for i in self.external_indices() if i.has_tag(tag)]

    def find_node(self, index: Index) -> Hashable:
        return next(n for n, t in self.tensors.items() if index in t.indices)

    def link_dims(self) -> list[int]:
        return [i.dim for i in self.edges().values()]

    def rank(self) -> int:
        return max(self.link_dims(), default=1)

    def validate_tree(self) -> None:
        edges = self.edges()
        if len(edges) != len(self.tensors) - 1 or len(self.walk(self.nodes[0])) != len(self.tensors):
            raise ValueError("not a tree")

    def is_chain(self) -> bool:
        return max((len(self.neighbours(n)) for n in self.nodes), default=0) <= 2

    def walk(self, root: Hashable) -> list[tuple[Hashable, Hashable | None]]:
        """Nodes with the neighbour towards the root, leaves first."""
        near: dict[Hashable, list[Hashable]] = {n: [] for n in self.nodes}
        for a, b in self.edges():
            near[a].append(b), near[b].append(a)
        out, todo, seen = [], [(root, None)], {root}
        while todo:
            node, parent = todo.pop()
            out.append((node, parent))
            for n in near[node]:
                if n not in seen:
                    seen.add(n)
                    todo.append((n, node))
        return out[::-1]

    def path(self, a: Hashable, b: Hashable) -> list[Hashable]:
        up = dict(self.walk(b))
        out = [a]
        while out[-1] != b:
            out.append(up[out[-1]])
        return out

    def steiner_nodes(self, wanted: Sequence[Hashable]) -> set[Hashable]:
        return {n for w in wanted for n in self.path(w, wanted[0])}

    def same_topology(self, other: Network) -> bool:
        return {frozenset(e) for e in self.edges()} == {frozenset(e) for e in other.edges()} and set(self.nodes) == set(other.nodes)

    def rename(self, names: Mapping[Hashable, Hashable]) -> Network:
        return Network({names.get(n, n): t for n, t in self.tensors.items()})

    def sim_links(self) -> Network:
        """Fresh bonds, so that a network can be joined with its own copy."""
        fresh = {i: i.sim() for i in self.edges().values()}
        return self.map(lambda t: t.replace_indices(*((i, fresh[i]) for i in t.indices if i in fresh)))

    def map(self, f: Callable[[Tensor], Tensor]) -> Network:
        return Network({n: f(t) for n, t in self.tensors.items()})

    def replace_site_indices(self, *pairs: tuple[Index, Index]) -> Network:
        change = dict(pairs)
        return self.map(lambda t: t.replace_indices(*((i, change[i]) for i in t.indices if i in change)))

    def replace_tensor(self, node: Hashable, tensor: Tensor) -> Network:
        if set(tensor.indices) != set(self.tensors[node].indices):
            raise ValueError("the new tensor has other indices")
        return Network(self.tensors | {node: tensor})

    @property
    def root(self) -> Hashable:
        return self.nodes[-1]

    # -- contraction ------------------------------------------------------------------------------

    def _fold(self, leaf: Callable[[Hashable, Tensor], Tensor], keep: Sequence[Index] = ()) -> Tensor:
        """Contracts leaf(node) over the tree, from the leaves to the root."""
        held: dict[Hashable, Tensor] = {}
        for k, (node, parent) in enumerate(self.walk(self.root)):
            t = leaf(node, self.tensors[node])
            t = contract_pair(held[node], t, retain=keep) if node in held else t
            if k % CUT_EVERY == CUT_EVERY - 1:
                t = t._like(cut_lineage(t.df))
            if parent is None:
                return t
            held[parent] = contract_pair(held[parent], t, retain=keep) if parent in held else t
        raise ValueError("an empty network")

    def to_tensor(self) -> Tensor:
        """All nodes contracted; the result is as large as its external indices make it."""
        return self._fold(lambda _, t: t)

    def sum(self) -> complex:
        """The sum of all values: each site is summed first."""
        return self._fold(lambda n, t: t.sum_over(self.site_indices(n)) if self.site_indices(n) else t).only()

    def partial_sum(self, indices: Sequence[Index]) -> Network:
        return self.map(lambda t: t.sum_over(common_inds(t.indices, indices)) if common_inds(t.indices, indices) else t)

    def project(self, at: Mapping[Index, int]) -> Network:
        """Masked at fixed coordinates."""
        return self.map(lambda t: t.mask_index({i: k for i, k in at.items() if i in t.indices}))

    def select(self, at: Mapping[Index, int]) -> Network:
        return self.map(lambda t: t.select_indices({i: k for i, k in at.items() if i in t.indices}))

    def weighted_remove(self, index: Index, weights: Sequence[float]) -> Network:
        """The sum over one site index with weights."""
        node = self.find_node(index)
        t = self.tensors[node]
        return Network(self.tensors | {node: contract_pair(t, from_dense(t.spark, [index], list(weights)))})

    def insert_onehot(self, node: Hashable, index: Index, at: int) -> Network:
        """A further site index that is non-zero at one coordinate only."""
        t = self.tensors[node]
        return Network(self.tensors | {node: contract_pair(t, onehot(t.spark, {index: at}))})

    def evaluate(self, points: DataFrame, point: str = "point") -> DataFrame:
        """point, re (and im) for each row of points, which has a column for each external index."""
        p = Index(point, 1 << 40)
        own = [i.column for i in self.external_indices()]
        points = points.select(point, *own)

        def at(node: Hashable, t: Tensor) -> Tensor:
            sites = [i.column for i in self.site_indices(node)]
            rest = [i for i in t.indices if i.column not in sites]
            if not sites:
                return t
            rows = points.select(point, *sites).join(t.df, sites).select(point, *(i.column for i in rest), *t.values)
            return Tensor(rows, (p, *rest), t.is_complex)

        out = self._fold(at, keep=[p])
        return points.select(point).join(out.df, point, "left").select(point, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in out.values))

    def inner(self, other: Network) -> complex:
        """Sum of conj(self) * other over shared external indices; node by node, so that nothing dense is built."""
        mine = self.map(Tensor.conj).sim_links()
        both = {n: (mine.tensors[n], other.tensors[n]) for n in self.nodes}
        held: dict[Hashable, Tensor] = {}
        for k, (node, parent) in enumerate(self.walk(self.root)):
            a, b = both[node]
            t = contract_pair(held[node], a) if node in held else a
            t = contract_pair(t, b)
            if k % CUT_EVERY == CUT_EVERY - 1:
                t = t._like(cut_lineage(t.df))
            if parent is None:
                return t.only()
            held[parent] = contract_pair(held[parent], t) if parent in held else t
        raise ValueError("an empty network")

    def norm_squared(self) -> float:
        return complex(self.inner(self)).real

    def norm(self) -> float:
        return math.sqrt(max(0.0, self.norm_squared()))

    def log_norm(self) -> float:
        """The logarithm of the norm, with the scale taken out node by node so that it never overflows."""
        mine, total = self.map(Tensor.conj).sim_links(), 0.0
        held: dict[Hashable, Tensor] = {}
        for node, parent in self.walk(self.root):
            t = contract_pair(held[node], mine.tensors[node]) if node in held else mine.tensors[node]
            t = contract_pair(t, self.tensors[node])
            t = t._like(cut_lineage(t.df))
            size = t.maxabs()
            if size == 0:
                return -math.inf
            total, t = total + math.log(size), t.scale(1 / size)
            if parent is None:
                return (total + math.log(abs(t.only()))) / 2
            held[parent] = contract_pair(held[parent], t) if parent in held else t
        raise ValueError("an empty network")

    # -- algebra ----------------------------------------------------------------------------------

    def scale(self, a: complex) -> Network:
        return Network(self.tensors | {self.root: self.tensors[self.root].scale(a)})

    def conj(self) -> Network:
        return self.map(Tensor.conj)

    def add(self, other: Network) -> Network:
        """Bonds add up: each node is a direct sum along its bonds. External indices must be the same."""
        if not self.same_topology(other):
            raise ValueError("topologies differ")
        if len(self.tensors) == 1:
            n = self.nodes[0]
            return Network({n: self.tensors[n].add(other.tensors[n])})
        b = other.sim_links()
        mine = {frozenset(e): i for e, i in self.edges().items()}
        theirs = {frozenset(e): i for e, i in b.edges().items()}
        fresh = {e: new_link(mine[e].dim + theirs[e].dim) for e in mine}
        out = {}
        for n in self.nodes:
            around = [e for e in mine if n in e]
            joined, made = direct_sum(self.tensors[n], b.tensors[n], [(mine[e], theirs[e]) for e in around])
            out[n] = joined.replace_indices(*((m, fresh[e]) for m, e in zip(made, around, strict=True)))
        return Network(out)

    def axpby(self, a: complex, other: Network, b: complex) -> Network:
        return self.scale(a).add(other.scale(b))

    def hadamard(self, other: Network) -> Network:
        """Products of values with equal external coordinates; bonds multiply."""
        b = other.sim_links()
        fused = {frozenset(e): (i, b.edges().get(e) or b.edges()[e[::-1]]) for e, i in self.edges().items()}
        fresh = {e: new_link(x.dim * y.dim) for e, (x, y) in fused.items()}
        out = {}
        for n in self.nodes:
            t = contract_pair(self.tensors[n], b.tensors[n], retain=self.site_indices(n))
            for e, (x, y) in fused.items():
                if n in e:
                    t, _ = t.fuse_indices([x, y], fresh[e])
            out[n] = t
        return Network(out)

    def apply(self, state: Network) -> Network:
        """Self as an operator: nodes pair up, common site indices are summed, bonds multiply."""
        b = state.sim_links()
        mine, theirs = {frozenset(e): i for e, i in self.edges().items()}, {frozenset(e): i for e, i in b.edges().items()}
        fresh = {e: new_link(mine[e].dim * theirs[e].dim) for e in theirs}
        out = {}
        for n in b.nodes:
            t = contract_pair(self.tensors[n], b.tensors[n])
            for e in theirs:
                if n in e:
                    t, _ = t.fuse_indices([mine[e], theirs[e]], fresh[e])
            out[n] = t
        return Network(out)

    # -- gauges and truncation --------------------------------------------------------------------

    def canonicalize(self, centre: Hashable) -> Network:
        """Every node but the centre isometric towards it; values stay. One Gram matrix for each bond."""
        out = dict(self.tensors)
        for node, parent in self.walk(centre):
            if parent is not None:
                _shift(out, node, parent)
        return Network(out)

    def truncate(self, how: Truncation) -> Network:
        """Bonds cut down by singular values, from the root outwards; the centre goes along, so that each cut is the best one."""
        out = dict(self.canonicalize(self.root).tensors)
        children: dict[Hashable, list[Hashable]] = {}
        for node, parent in self.walk(self.root):
            children.setdefault(parent, []).append(node)

        def down(node: Hashable) -> None:
            for child in children.get(node, []):
                _shift(out, node, child, how)
                down(child)
                _shift(out, child, node)

        down(self.root)
        return Network(out)


def _shift(out: dict, a: Hashable, b: Hashable, how: Truncation | None = None) -> None:
    """Moves the centre from node a to its neighbour b; with how the bond is truncated."""
    bond = common_inds(out[a].indices, out[b].indices)
    rest = [i for i in out[a].indices if i not in bond]
    if how is None:
        first, second = qr(out[a], rest)
    else:
        first, s, v = svd(out[a], rest, how)
        link = common_inds(first.indices, v.indices)[0]
        second = contract_pair(tensor_of(v, [link, link.prime()], np.diag(s)), v.replace_indices((link, link.prime())))
    moved = contract_pair(second, out[b])
    out[a], out[b] = first._like(cut_lineage(first.df)), moved._like(cut_lineage(moved.df))


# -- trains ---------------------------------------------------------------------------------------


def train(cores: Sequence[Tensor]) -> Network:
    """A chain of tensors with nodes 0, 1, ...; neighbours share one index."""
    out = Network(dict(enumerate(cores)))
    out.validate_tree()
    return out


def constant_train(spark: SparkSession, sites: Sequence[Index], value: float = 1.0) -> Network:
    links = [new_link(1) for _ in sites[1:]]
    cores = []
    for k, s in enumerate(sites):
        around = [*links[max(0, k - 1) : k], s, *links[k : k + 1]]
        cores.append(from_dense(spark, around, [float(value) if k == 0 else 1.0] * s.dim))
    return train(cores)


def train_of(t: Tensor, sites: Sequence[Index], how: Truncation = Truncation()) -> Network:
    """A tensor as a train, by one truncated factorization for each bond."""
    cores, rest, link = [], t, None
    for s in sites[:-1]:
        left = [*([link] if link else []), s]
        u, sv, v = svd(rest, left, how)
        bond = common_inds(u.indices, v.indices)[0]
        cores.append(u._like(cut_lineage(u.df)))
        rest = contract_pair(tensor_of(t, [bond, bond.prime()], np.diag(sv)), v.replace_indices((bond, bond.prime())))
        rest = rest._like(cut_lineage(rest.df))
        link = bond
    return train([*cores, rest])


def reverse(chain: Network) -> Network:
    n = len(chain.tensors)
    return Network({n - 1 - k: chain.tensors[k] for k in reversed(range(n))})


def vidal(chain: Network) -> tuple[list[np.ndarray], Network]:
    """The singular values at each bond of a chain, and the chain in left-canonical form."""
    left = chain.canonicalize(len(chain.tensors) - 1)
    out, rest = [], dict(left.tensors)
    for k in reversed(range(1, len(rest))):
        bond = common_inds(rest[k].indices, rest[k - 1].indices)
        u, s, v = svd(rest[k], bond)
        out.append(s)
        link = common_inds(u.indices, v.indices)[0]
        carried = contract_pair(contract_pair(u, tensor_of(u, [link, link.prime()], np.diag(s))).replace_indices((link.prime(), link)), rest[k - 1])
        rest = rest | {k: v._like(cut_lineage(v.df)), k - 1: carried._like(cut_lineage(carried.df))}
    return out[::-1], left


def identity_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]]) -> Network:
    """The identity from the second to the first index of each pair, with bonds of dimension 1."""
    links = [new_link(1) for _ in pairs[1:]]
    cores = []
    for k, (a, b) in enumerate(pairs):
        t = delta(spark, [(a, b)])
        for link in [*links[max(0, k - 1) : k], *links[k : k + 1]]:
            t = contract_pair(t, onehot(spark, {link: 0}))
        cores.append(t)
    return train(cores)


def compose(outer: Network, inner: Network) -> Network:
    """The product of two operators whose middle legs share indices."""
    return outer.apply(inner)


def diagonal_operator(state: Network, pairs: Sequence[tuple[Index, Index]]) -> Network:
    """A train as the diagonal of an operator: site index i becomes (out, in) for each pair, in the order of nodes."""
    out = {}
    for n, (a, b) in zip(state.nodes, pairs, strict=True):
        (i,) = state.site_indices(n)
        fresh = i.sim()
        t = state.tensors[n].replace_indices((i, fresh))
        out[n] = contract_pair(t, copy_tensor(t.spark, [fresh, a, b]))
    return Network(out)


def restructure(t: Network, groups: Mapping[Hashable, Sequence[Hashable]]) -> Network:
    """Nodes of each group as one: fuses neighbours and keeps values."""
    out = {}
    for name, members in groups.items():
        out[name] = contract([t.tensors[m] for m in members])
    return Network(out)


def split_node(t: Network, node: Hashable, names: tuple[Hashable, Hashable], left: Sequence[Index], how: Truncation = Truncation()) -> Network:
    """One node as two, by a truncated factorization; left are the indices of the first."""
    u, s, v = svd(t.tensors[node], left, how)
    bond = common_inds(u.indices, v.indices)[0]
    second = contract_pair(tensor_of(u, [bond, bond.prime()], np.diag(s)), v.replace_indices((bond, bond.prime())))
    out = {}
    for n, x in t.tensors.items():
        out |= {names[0]: u, names[1]: second} if n == node else {n: x}
    return Network(out)


def fresh_sites(dims: Sequence[int]) -> list[Index]:
    return [new_index(d, "Site", f"n{k}") for k, d in enumerate(dims)]
