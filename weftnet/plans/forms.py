"""Editing of trees, environments, and forms of chains with singular values at their bonds."""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from ..index import Index, common_inds, new_link
from ..operators.factorize import Truncation, factorize, svd, tensor_of
from ..session import cut_lineage
from ..tensor import Tensor, contract, contract_pair, from_dense, onehot
from .network import Network, _shift

# -- editing --------------------------------------------------------------------------------------


def add_node(net: Network, node: Hashable, tensor: Tensor) -> Network:
    """A further node; it is joined to those it shares an index with."""
    if node in net.tensors:
        raise ValueError(f"node {node} exists")
    return Network(net.tensors | {node: tensor})


def remove_node(net: Network, node: Hashable) -> Network:
    """The network without a node; bonds to it become site indices of its neighbours."""
    return Network({n: t for n, t in net.tensors.items() if n != node})


def connect(net: Network, a: Hashable, b: Hashable) -> Network:
    """A bond of dimension 1 between two nodes."""
    link = new_link(1)
    return Network(net.tensors | {n: contract_pair(net.tensors[n], onehot(net.tensors[n].spark, {link: 0})) for n in (a, b)})


def replace_bond(net: Network, a: Hashable, b: Hashable, link: Index) -> Network:
    """Another index for the bond of two nodes."""
    old = common_inds(net.tensors[a].indices, net.tensors[b].indices)[0]
    return Network(net.tensors | {n: net.tensors[n].replace_indices((old, link)) for n in (a, b)})


def euler_tour(net: Network, root: Hashable) -> list[tuple[Hashable, Hashable]]:
    """Each edge twice, as a walk around the tree that starts and ends at root."""
    out: list[tuple[Hashable, Hashable]] = []

    def around(node: Hashable, parent: Hashable | None) -> None:
        for n in net.neighbours(node):
            if n != parent:
                out.append((node, n))
                around(n, node)
                out.append((n, node))

    around(root, None)
    return out


def euler_tour_nodes(net: Network, root: Hashable) -> list[Hashable]:
    return [root, *(b for _, b in euler_tour(net, root))]


def is_connected(net: Network, nodes: Sequence[Hashable]) -> bool:
    return bool(nodes) and net.steiner_nodes(list(nodes)) == set(nodes)


def boundary_edges(net: Network, nodes: Sequence[Hashable]) -> list[tuple[Hashable, Hashable]]:
    """Edges from a region outwards: (inside, outside)."""
    inside = set(nodes)
    return [(a, b) if a in inside else (b, a) for a, b in net.edges() if (a in inside) != (b in inside)]


def edges_towards(net: Network, region: Sequence[Hashable]) -> list[tuple[Hashable, Hashable]]:
    """Steps (node, next node) that make everything outside a region isometric towards it, in a valid order."""
    inside = set(region)
    return [(n, p) for n, p in net.walk(region[0]) if p is not None and n not in inside]


def canonicalize_to(net: Network, region: Sequence[Hashable]) -> Network:
    """Every node outside a connected region isometric towards it."""
    out = dict(net.tensors)
    for a, b in edges_towards(net, region):
        _shift(out, a, b)
    return Network(out)


def extract_subtree(net: Network, nodes: Sequence[Hashable]) -> Network:
    """The part on connected nodes; bonds that leave it are site indices of it."""
    if not is_connected(net, nodes):
        raise ValueError("the nodes are not connected")
    return Network({n: net.tensors[n] for n in net.nodes if n in set(nodes)})


def replace_subtree(net: Network, part: Network) -> Network:
    """Another part on the same nodes, with the same indices towards the rest."""
    old = extract_subtree(net, part.nodes)
    if set(old.external_indices()) != set(part.external_indices()):
        raise ValueError("the new part has other indices")
    return Network(net.tensors | part.tensors)


def same_appearance(a: Network, b: Network) -> bool:
    """The same nodes, edges and site indices; values may differ."""
    return a.same_topology(b) and all(set(a.site_indices(n)) == set(b.site_indices(n)) for n in a.nodes)


def reindexed_like(net: Network, other: Network) -> Network:
    """With other's site indices, node by node in order; dimensions must agree."""
    return net.replace_site_indices(*(p for n in net.nodes for p in zip(net.site_indices(n), other.site_indices(n), strict=True)))


def add_reindexed(a: Network, b: Network) -> Network:
    """The sum, where b may have other site indices."""
    return a.add(reindexed_like(b, a))


def swap_path(net: Network, moves: Mapping[Index, Hashable]) -> list[tuple[Hashable, Hashable, Index]]:
    """Steps (from, to, index) that bring site indices of a tree to the nodes asked for, one edge at a time."""
    out = []
    for i, to in moves.items():
        path = net.path(net.find_node(i), to)
        out += [(a, b, i) for a, b in zip(path[:-1], path[1:], strict=True)]
    return out


def move_sites(net: Network, moves: Mapping[Index, Hashable], how: Truncation = Truncation()) -> Network:
    """Site indices moved to other nodes of the tree, by a factorization at each step."""
    tensors = dict(net.tensors)
    for a, b, i in swap_path(net, moves):
        bond = common_inds(tensors[a].indices, tensors[b].indices)
        keep = [x for x in tensors[a].indices if x not in bond and x != i]
        first, second = factorize(contract_pair(tensors[a], tensors[b]), keep, how)
        tensors[a], tensors[b] = first._like(cut_lineage(first.df)), second._like(cut_lineage(second.df))
    return Network(tensors)


# -- operators on chains --------------------------------------------------------------------------


def constant_operator(spark: SparkSession, pairs: Sequence[tuple[Index, Index]], value: float = 1.0) -> Network:
    """An operator whose entries all are one value; 0 gives the zero operator."""
    links = [new_link(1) for _ in pairs[1:]]
    out = {}
    for k, (o, i) in enumerate(pairs):
        around = [*links[max(0, k - 1) : k], o, i, *links[k : k + 1]]
        out[k] = from_dense(spark, around, [float(value) if k == 0 else 1.0] * (o.dim * i.dim))
    return Network(out)


def environments(a: Network, b: Network, upto: int, left: bool = True) -> Tensor:
    """All nodes of a chain's product before (or after) one, contracted over common indices, bonds open towards it."""
    b = b.sim_links()
    ends = [n for n in a.nodes if len(a.neighbours(n)) < 2]
    order = a.path(ends[0], ends[-1])
    if order[0] != 0 and order[-1] == 0:  # numbered chains run upwards
        order = order[::-1]
    at = order.index(upto)
    nodes = order[:at] if left else order[at + 1 :]
    t = None
    for n in nodes if left else nodes[::-1]:
        t = a.tensors[n] if t is None else contract_pair(t, a.tensors[n])
        t = contract_pair(t, b.tensors[n])
    return t


def _inverse(values: np.ndarray) -> np.ndarray:
    """Of singular values; that of 0, which a chain of zeros has, is 0."""
    return np.divide(1.0, values, out=np.zeros_like(values), where=values > 0)


@dataclass(frozen=True)
class Vidal:
    """A chain as site tensors with the singular values of each bond between them."""

    gammas: Network
    lambdas: tuple[np.ndarray, ...]

    @staticmethod
    def of(chain: Network, how: Truncation = Truncation()) -> Vidal:
        """From the chain's canonical form: a sweep of factorizations from the last node to the first."""
        rest = dict(chain.canonicalize(len(chain.tensors) - 1).tensors)
        out, values = {}, []
        for k in reversed(range(1, len(rest))):
            bond = common_inds(rest[k].indices, rest[k - 1].indices)
            u, s, v = svd(rest[k], bond, how)
            link = common_inds(u.indices, v.indices)[0]
            carried = contract_pair(contract_pair(u, tensor_of(u, [link, link.prime()], np.diag(s))).replace_indices((link.prime(), link)), rest[k - 1])
            out[k], rest[k - 1] = (v, link), carried._like(cut_lineage(carried.df))
            values.append(s)
        values = values[::-1]
        tensors = {0: _along(rest[0], out[1][1], _inverse(values[0])) if values else rest[0]}
        for k in range(1, len(rest)):
            v, _ = out[k]
            tensors[k] = _along(v, out[k + 1][1], _inverse(values[k])) if k + 1 in out else v
        return Vidal(Network(tensors), tuple(values))

    def bonds(self) -> list[Index]:
        return [common_inds(self.gammas.tensors[k].indices, self.gammas.tensors[k + 1].indices)[0] for k in range(len(self.lambdas))]

    def to_chain(self) -> Network:
        """Site tensors times the singular values to their right."""
        out = dict(self.gammas.tensors)
        for k, (link, s) in enumerate(zip(self.bonds(), self.lambdas, strict=True)):
            out[k] = _along(out[k], link, s)
        return Network(out)


@dataclass(frozen=True)
class InverseForm:
    """A chain as site tensors that hold the singular values on both sides, with inverses between them; each two-site
    block is then a product of neighbours and one inverse."""

    tensors: Network
    inverses: tuple[np.ndarray, ...]

    @staticmethod
    def of(vidal: Vidal) -> InverseForm:
        out = dict(vidal.gammas.tensors)
        for k, (link, s) in enumerate(zip(vidal.bonds(), vidal.lambdas, strict=True)):
            out[k], out[k + 1] = _along(out[k], link, s), _along(out[k + 1], link, s)
        return InverseForm(Network(out), tuple(map(_inverse, vidal.lambdas)))

    def to_chain(self) -> Network:
        out = dict(self.tensors.tensors)
        for k, s in enumerate(self.inverses):
            link = common_inds(out[k].indices, out[k + 1].indices)[0]
            out[k] = _along(out[k], link, s)
        return Network(out)


def _along(t: Tensor, link: Index, values: np.ndarray) -> Tensor:
    """t times a value for each coordinate of one index."""
    return contract_pair(t, from_dense(t.spark, [link], values.tolist()), retain=[link])


def set_two(chain: Network, k: int, first: Tensor, second: Tensor) -> Network:
    """Two neighbours replaced together; their indices towards others must stay."""
    return replace_subtree(chain, Network({k: first, k + 1: second}))


def partial_contract_networks(a: Network, b: Network, diagonal: Sequence[Index] = ()) -> Network:
    """Node by node product: common sites are summed but for those in diagonal, which stay; bonds multiply."""
    b = b.sim_links()
    mine, theirs = {frozenset(e): i for e, i in a.edges().items()}, {frozenset(e): i for e, i in b.edges().items()}
    fresh = {e: new_link(i.dim * theirs[e].dim) for e, i in mine.items()}
    out = {}
    for n in a.nodes:
        t = contract_pair(a.tensors[n], b.tensors[n], retain=diagonal)
        for e, link in fresh.items():
            if n in e:
                t, _ = t.fuse_indices([mine[e], theirs[e]], link)
        out[n] = t
    return Network(out)


def scalar_operator(net: Network) -> complex:
    """The value of a network without site indices."""
    if net.external_indices():
        raise ValueError("the network has site indices")
    return contract([net.to_tensor()]).only()


def random_network(spark: SparkSession, like: Network, seed: int) -> Network:
    """Seeded random values with the indices of another network."""
    from ..tensor import random

    return Network({n: random(spark, list(t.indices), seed + k) for k, (n, t) in enumerate(like.tensors.items())})
