"""Linear operators on networks: which of an operator's indices take a state's sites, and which give the result's.

An operator may act on some nodes of a state only. Its bonds follow the state's tree: where two of its neighbours are not
neighbours in the state, the bond is led through the nodes between.
"""

from __future__ import annotations

import re
from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np

from ..index import Index, new_link
from ..operators.factorize import tensor_of
from ..tensor import contract_pair, delta, onehot
from .network import Network, restructure


@dataclass(frozen=True)
class LinearOperator:
    """A network with maps from state sites to its own input and output indices."""

    net: Network
    inputs: dict[Index, Index]
    outputs: dict[Index, Index]

    def __post_init__(self) -> None:
        own = set(self.net.external_indices())
        for where in (self.inputs, self.outputs):
            if any(i not in own or i.dim != s.dim for s, i in where.items()):
                raise ValueError("an index that the operator doesn't have, or of another dimension")

    @staticmethod
    def from_state(net: Network, state: Network, pairs: Mapping[Hashable, Sequence[tuple[Index, Index]]]) -> LinearOperator:
        """From (output, input) of each node, in the order of the state's sites there."""
        ins, outs = {}, {}
        for node, own in pairs.items():
            for site, (o, i) in zip(state.site_indices(node), own, strict=True):
                ins[site], outs[site] = i, o
        return LinearOperator(net, ins, outs)

    # -- maps -------------------------------------------------------------------------------------

    def transpose(self) -> LinearOperator:
        """Input and output change places."""
        return LinearOperator(self.net, dict(self.outputs), dict(self.inputs))

    def adjoint(self) -> LinearOperator:
        return LinearOperator(self.net.conj(), dict(self.outputs), dict(self.inputs))

    def align_to_state(self, state: Network) -> LinearOperator:
        """The same operator for the sites of another state: node by node, in order."""
        ins, outs = {}, {}
        for node in self.net.nodes:
            own = set(self.net.site_indices(node))
            before = [s for s, i in self.inputs.items() if i in own]
            sites = state.site_indices(node)
            if [s.dim for s in before] != [s.dim for s in sites]:
                raise ValueError(f"node {node}: sites don't fit")
            ins |= {new: self.inputs[old] for old, new in zip(before, sites, strict=True)}
            outs |= {new: self.outputs[old] for old, new in zip(before, sites, strict=True) if old in self.outputs}
        return LinearOperator(self.net, ins, outs)

    def set_input_space(self, state: Network) -> LinearOperator:
        """The operator's own input indices become the state's sites, which it then takes as they are."""
        return self._renamed(self.align_to_state(state).inputs, {})

    def set_output_space(self, state: Network) -> LinearOperator:
        return self._renamed({}, self.align_to_state(state).outputs)

    def _renamed(self, ins: Mapping[Index, Index], outs: Mapping[Index, Index]) -> LinearOperator:
        change = {own: site for site, own in [*ins.items(), *outs.items()]}
        net = self.net.map(lambda t: t.replace_indices(*((i, change[i]) for i in t.indices if i in change)))
        turned = lambda now, new: {s: s for s in new} if new else {s: change.get(i, i) for s, i in now.items()}
        return LinearOperator(net, turned(self.inputs, ins), turned(self.outputs, outs))

    def rename_nodes(self, names: Mapping[Hashable, Hashable]) -> LinearOperator:
        return LinearOperator(self.net.rename(names), dict(self.inputs), dict(self.outputs))

    def restructure(self, groups: Mapping[Hashable, Sequence[Hashable]]) -> LinearOperator:
        """Nodes of each group as one."""
        return LinearOperator(restructure(self.net, groups), dict(self.inputs), dict(self.outputs))

    def _unfused(self, which: str, site: Index, group: Sequence[tuple[Index, Index]]) -> LinearOperator:
        maps = {"inputs": dict(self.inputs), "outputs": dict(self.outputs)}
        own = maps[which].pop(site)
        node = self.net.find_node(own)
        maps[which] |= dict(group)
        return LinearOperator(Network(self.net.tensors | {node: self.net.tensors[node].unfuse_index(own, [i for _, i in group])}), **maps)

    def unfuse_input(self, site: Index, group: Sequence[tuple[Index, Index]]) -> LinearOperator:
        """The input for a site as several, (site, own index) each, the first running fastest."""
        return self._unfused("inputs", site, group)

    def unfuse_output(self, site: Index, group: Sequence[tuple[Index, Index]]) -> LinearOperator:
        return self._unfused("outputs", site, group)

    def bind(self, change: Mapping[Index, Index]) -> LinearOperator:
        """For other sites: each old one replaced by a new one."""
        return LinearOperator(self.net, {change.get(s, s): i for s, i in self.inputs.items()}, {change.get(s, s): i for s, i in self.outputs.items()})

    # -- products ---------------------------------------------------------------------------------

    def apply(self, state: Network) -> Network:
        """The operator applied to a state; the result has the state's sites, and bonds that multiply where the operator's run."""
        fresh = {s: s.sim() for s in self.inputs}
        op = self.net.sim_links()
        takes = {i: fresh[s] for s, i in self.inputs.items()}
        gives = {i: s for s, i in self.outputs.items()}
        op = op.map(lambda t: t.replace_indices(*((i, (takes | gives)[i]) for i in t.indices if i in takes or i in gives)))
        out = {n: t.replace_indices(*((i, fresh[i]) for i in t.indices if i in fresh)) for n, t in state.tensors.items()}
        crossing: dict[frozenset, list[Index]] = {}
        tensors = dict(op.tensors)
        through: dict[Hashable, list] = {}
        for (a, b), bond in op.edges().items():
            path, link = state.path(a, b), bond
            for k, (x, y) in enumerate(zip(path[:-1], path[1:], strict=True)):
                crossing.setdefault(frozenset((x, y)), []).append(link)
                if k < len(path) - 2:
                    after = link.sim()
                    through.setdefault(y, []).append((link, after))
                    link = after
            if link != bond:
                tensors[b] = tensors[b].replace_indices((bond, link))
        for n in out:
            if n in tensors:
                out[n] = contract_pair(out[n], tensors[n])
            for pair in through.get(n, []):
                out[n] = contract_pair(out[n], delta(out[n].spark, [pair]))
        for (a, b), bond in state.edges().items():
            extra = crossing.get(frozenset((a, b)))
            if extra:
                link = new_link(bond.dim * int(np.prod([i.dim for i in extra])))
                for n in (a, b):
                    out[n], _ = out[n].fuse_indices([bond, *extra], link)
        return Network(out)

    def apply_local(self, state: Network, node: Hashable) -> Network:
        """An operator of one node on that node of a state."""
        if self.net.nodes != [node]:
            raise ValueError("the operator has other nodes")
        return self.apply(state)

    def compose(self, inner: LinearOperator) -> LinearOperator:
        """First inner, then self, for the same sites and nodes."""
        middle = {s: s.sim() for s in inner.outputs}
        ins = {s: i.sim() for s, i in inner.inputs.items()}
        change = {i: middle[s] for s, i in inner.outputs.items()} | {i: ins[s] for s, i in inner.inputs.items()}
        b = inner.net.map(lambda t: t.replace_indices(*((i, change[i]) for i in t.indices if i in change)))
        mine = {i: middle[s] for s, i in self.inputs.items()}
        a = self.net.map(lambda t: t.replace_indices(*((i, mine[i]) for i in t.indices if i in mine)))
        return LinearOperator(a.apply(b), ins, dict(self.outputs))


def are_exclusive(operators: Sequence[LinearOperator], state: Network) -> bool:
    """Do the parts of the state's tree that the operators span have no node in common?"""
    spans = [state.steiner_nodes(op.net.nodes) for op in operators]
    return all(not (a & b) for k, a in enumerate(spans) for b in spans[:k])


def compose_exclusive(operators: Sequence[LinearOperator], state: Network) -> LinearOperator:
    """One operator for the whole tree from several on parts of it; other sites stay as they are, joined by bonds of dimension 1."""
    if not are_exclusive(operators, state):
        raise ValueError("the operators share nodes")
    spark = state.tensors[state.root].spark
    tensors, ins, outs = {}, {}, {}
    taken = {}
    for op in operators:
        net = op.net.sim_links()
        if state.steiner_nodes(net.nodes) != set(net.nodes):
            raise ValueError("an operator with gaps")
        tensors |= net.tensors
        ins |= op.inputs
        outs |= op.outputs
        taken |= {frozenset(e): True for e in net.edges()}
    for n in state.nodes:
        if n not in tensors:
            pairs = [(s, s.sim(), s.sim()) for s in state.site_indices(n)]
            ins |= {s: i for s, _, i in pairs}
            outs |= {s: o for s, o, _ in pairs}
            tensors[n] = delta(spark, [(o, i) for _, o, i in pairs]) if pairs else None
    for a, b in state.edges():
        if frozenset((a, b)) not in taken:
            link = new_link(1)
            for n in (a, b):
                bond = onehot(spark, {link: 0})
                tensors[n] = bond if tensors[n] is None else contract_pair(tensors[n], bond)
    return LinearOperator(Network({n: tensors[n] for n in state.nodes}), ins, outs)


def numbered_sites(state: Network, tag: str) -> list[Index]:
    """Site indices tagged tag1, tag2, ... in the order of their numbers."""
    found = []
    for i in state.external_indices():
        for t in i.tags:
            if m := re.fullmatch(re.escape(tag) + r"(\d+)", t):
                found.append((int(m[1]), i))
    return [i for _, i in sorted(found, key=lambda x: x[0])]


def apply_to_indices(op: LinearOperator, state: Network, sites: Sequence[Index]) -> Network:
    """The operator on the listed sites, in the order of its own; its nodes are renamed to theirs."""
    bound = op.bind(dict(zip(op.inputs, sites, strict=True)))
    names = {op.net.find_node(i): state.find_node(s) for s, i in bound.inputs.items()}
    return bound.rename_nodes(names).apply(state)


def matrix_operator(state: Network, node: Hashable, values: np.ndarray) -> LinearOperator:
    """A matrix on the one site of a node."""
    (site,) = state.site_indices(node)
    o, i = site.sim(), site.sim()
    return LinearOperator(Network({node: tensor_of(state.tensors[node], [o, i], values)}), {site: i}, {site: o})
