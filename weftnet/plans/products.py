"""Products and sums of networks on one tree with bonds that are cut on the way, so that they never multiply in full."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

from ..index import common_inds
from ..operators.factorize import Truncation, svd, tensor_of
from ..session import cut_lineage
from ..tensor import Tensor, contract_pair
from .network import Network, _shift


def zip_up(a: Network, b: Network, how: Truncation, gauged: bool = True) -> Network:
    """The product of a and b, node by node over common site indices, cut at each bond on the way from the leaves to the root.

    Gauged, both are first made isometric towards the first leaf, so that a cut at a bond of a chain is the best there;
    on branching trees truncate the result once more.
    """
    if not a.same_topology(b):
        raise ValueError("topologies differ")
    b = b.sim_links()
    order = a.walk(a.root)
    if gauged:
        a, b = a.canonicalize(order[0][0]), b.canonicalize(order[0][0])
    held: dict[Hashable, list[Tensor]] = {}
    out = {}
    for node, parent in order:
        t, links = a.tensors[node], []
        for carried, link in held.get(node, []):
            t = contract_pair(t, carried)
            links.append(link)
        t = contract_pair(t, b.tensors[node])
        if parent is None:
            out[node] = t
            break
        towards = [*common_inds(t.indices, a.tensors[parent].indices), *common_inds(t.indices, b.tensors[parent].indices)]
        bonds = [i for i in towards if i in a.edges().values() or i in b.edges().values()]
        first, s, v = svd(t, [i for i in t.indices if i not in bonds], how)
        link = common_inds(first.indices, v.indices)[0]
        carried = contract_pair(tensor_of(v, [link, link.prime()], np.diag(s)), v.replace_indices((link, link.prime())))
        out[node] = first._like(cut_lineage(first.df))
        held.setdefault(parent, []).append((carried._like(cut_lineage(carried.df)), link))
    return Network({n: out[n] for n in a.nodes})


class _Overlap:
    """Environments of one target, a product of networks, around the nodes of a trial network."""

    def __init__(self, target: Sequence[Network]) -> None:
        self.target = [x.sim_links() for x in target]
        self.held: dict[tuple[Hashable, Hashable], Tensor] = {}

    def forget(self, trial: Network, changed: Sequence[Hashable]) -> None:
        self.held = {(s, d): t for (s, d), t in self.held.items() if not any(s in trial.path(c, d) for c in changed)}

    def product(self, node: Hashable, parts: Sequence[Tensor], bra: Tensor | None) -> Tensor:
        t = self.target[0].tensors[node]
        for p in parts:
            t = contract_pair(t, p)
        for x in self.target[1:]:
            t = contract_pair(t, x.tensors[node])
        return contract_pair(t, bra) if bra is not None else t

    def message(self, bra: Network, node: Hashable, to: Hashable) -> Tensor:
        if (node, to) not in self.held:
            parts = [self.message(bra, n, node) for n in bra.neighbours(node) if n != to]
            t = self.product(node, parts, bra.tensors[node])
            self.held[node, to] = t._like(cut_lineage(t.df))
        return self.held[node, to]

    def around(self, bra: Network, node: Hashable) -> Tensor:
        return self.product(node, [self.message(bra, n, node) for n in bra.neighbours(node)], None)


def fit(targets: Sequence[Sequence[Network]], start: Network, sweeps: int = 2, tolerance: float = 0.0) -> Network:
    """The network with start's bonds that is nearest to a sum of products of networks, by sweeps over its nodes.

    With the centre at a node its best tensor is the environment of the targets there. Environments are kept until a node
    behind them changes. Sweeps end early when the norm changes by less than tolerance, relatively.
    """
    order = [n for n, _ in start.walk(start.root)]
    overlaps = [_Overlap(t) for t in targets]
    trial = dict(start.canonicalize(order[0]).tensors)
    centre, last = order[0], None
    for sweep in range(sweeps):
        for node in order if sweep % 2 == 0 else order[::-1]:
            path = Network(trial).path(centre, node)
            for a, b in zip(path[:-1], path[1:], strict=True):
                _shift(trial, a, b)
            for o in overlaps:
                o.forget(Network(trial), path)
            centre = node
            bra = Network(trial).map(Tensor.conj)
            new = None
            for o in overlaps:
                t = o.around(bra, node)
                new = t if new is None else new.add(t)
            trial[node] = new.permute(trial[node].indices)._like(cut_lineage(new.permute(trial[node].indices).df))
            for o in overlaps:
                o.forget(Network(trial), [node])
        size = trial[centre].norm()
        if last is not None and abs(size - last) <= tolerance * size:
            break
        last = size
    return Network(trial)


def contract_fit(a: Network, b: Network, start: Network, sweeps: int = 2, tolerance: float = 0.0) -> Network:
    """The product of a and b with start's bonds."""
    return fit([[a, b]], start, sweeps, tolerance)


def fit_sum(parts: Sequence[Network], start: Network, sweeps: int = 2, tolerance: float = 0.0) -> Network:
    """The sum of networks with start's bonds."""
    return fit([[p] for p in parts], start, sweeps, tolerance)


def multiply(a: Network, b: Network, method: str = "zipup", how: Truncation = Truncation(), sweeps: int = 2) -> Network:
    """The product by method: naive (bonds multiply, then one truncation), zipup, or fit (from a zip-up)."""
    if method == "naive":
        out = a.apply(b)
        return out.truncate(how) if how != Truncation() else out
    if method == "zipup":
        return zip_up(a, b, how)
    if method == "fit":
        return contract_fit(a, b, zip_up(a, b, how, gauged=False), sweeps)
    raise ValueError(f"unknown method {method}")
