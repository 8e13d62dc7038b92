"""Sweeps over chains: lowest states, linear systems and time steps with projected operators.

The operator is a chain whose nodes hold (out, in) site pairs, out = in primed. Environments left and right of two sites
are tensors; a local problem is solved by Krylov steps whose products are contractions of environments, operator and state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from ..index import Index, common_inds
from ..operators.factorize import Truncation, svd, tensor_of
from ..operators.krylov import expm_multiply, gmres, lowest_eigenpair
from ..session import cut_lineage
from ..tensor import Tensor, contract, contract_pair
from .network import Network, train


def _held(t: Tensor) -> Tensor:
    return t._like(cut_lineage(t.df))


@dataclass
class Environments:
    """For a bra, an operator and a ket on the same chain: everything left or right of a bond, contracted."""

    bra: Network
    operator: Network
    ket: Network
    left: dict[int, Tensor]
    right: dict[int, Tensor]

    @staticmethod
    def of(bra: Network, operator: Network, ket: Network) -> Environments:
        out = Environments(bra, operator, ket, {}, {})
        for k in reversed(range(2, len(ket.tensors))):
            out.grow_right(k)
        return out

    def _layer(self, k: int) -> list[Tensor]:
        """Bra (its sites primed), operator and ket of one node."""
        sites = self.ket.site_indices(k)
        return [self.bra.tensors[k].conj().replace_indices(*((i, i.prime()) for i in sites)), self.operator.tensors[k], self.ket.tensors[k]]

    def grow_left(self, k: int) -> None:
        before = [self.left[k - 1]] if k else []
        self.left[k] = _held(contract([*before, *self._layer(k)]))

    def grow_right(self, k: int) -> None:
        after = [self.right[k + 1]] if k + 1 in self.right else []
        self.right[k] = _held(contract([*after, *self._layer(k)]))


def _primed_links(state: Network) -> Network:
    links = list(state.edges().values())
    return state.map(lambda t: t.replace_indices(*((i, i.prime()) for i in t.indices if i in links)))


def _split(two: Tensor, left: Sequence[Index], how: Truncation, forward: bool) -> tuple[Tensor, Tensor]:
    u, s, v = svd(two, left, how)
    link = common_inds(u.indices, v.indices)[0]
    weight = tensor_of(u, [link, link.prime()], np.diag(s))
    move = lambda x: contract_pair(x, weight).replace_indices((link.prime(), link))
    return (_held(u), _held(move(v))) if forward else (_held(move(u)), _held(v))


def sweep(operator: Network, state: Network, local, how: Truncation, sweeps: int) -> Network:
    """Two-site sweeps left to right and back; local(apply, two_sites, bond) gives the new two-site tensor."""
    n = len(state.tensors)
    if n < 2:
        raise ValueError("a chain of two sites at least")
    state = state.canonicalize(0)
    for _ in range(sweeps):
        for forward in (True, False):
            bonds = range(n - 1) if forward else range(n - 2, -1, -1)
            for k in bonds:
                state = _update(operator, state, k, forward, local, how)
    return state


def _update(operator: Network, state: Network, k: int, forward: bool, local, how: Truncation) -> Network:
    bra = _primed_links(state)
    env = Environments(bra, operator, state, {}, {})
    for j in range(k):
        env.grow_left(j)
    for j in reversed(range(k + 2, len(state.tensors))):
        env.grow_right(j)
    parts = [*([env.left[k - 1]] if k else []), operator.tensors[k], operator.tensors[k + 1], *([env.right[k + 2]] if k + 2 in env.right else [])]
    two = _held(contract_pair(state.tensors[k], state.tensors[k + 1]))

    def apply(x: Tensor) -> Tensor:
        y = contract([*parts, x])
        return y.replace_indices(*((i, i.noprime()) for i in y.indices if i.plev)).permute(list(x.indices))

    new = local(apply, two, k)
    left = [i for i in state.tensors[k].indices if i not in state.tensors[k + 1].indices]
    a, b = _split(new, left, how, forward)
    return Network(state.tensors | {k: a, k + 1: b})


def dmrg(operator: Network, state: Network, how: Truncation = Truncation(), sweeps: int = 2, steps: int = 8) -> tuple[float, Network]:
    """The lowest eigenvalue of a Hermitian operator and its state."""
    energy = [0.0]

    def local(apply, two, _):
        energy[0], vector = lowest_eigenpair(apply, two, steps=steps, restarts=2)
        return vector

    state = sweep(operator, state, local, how, sweeps)
    return energy[0], state


def time_step(operator: Network, state: Network, step: complex, how: Truncation = Truncation(), steps: int = 8) -> Network:
    """exp(step * operator) state, by Krylov steps on the whole vector; for chains whose vector Spark can hold."""
    from .network import train_of

    sites = [i for k in range(len(state.tensors)) for i in state.site_indices(k)]
    full = _held(state.to_tensor())
    out = expm_multiply(lambda x: apply_operator(operator, x), full, step, steps)
    return train_of(_held(out), sites, how)


def apply_operator(operator: Network, x: Tensor) -> Tensor:
    """An operator chain on a tensor over its in-sites."""
    y = contract([*operator.tensors.values(), x])
    return y.replace_indices(*((i, i.noprime()) for i in y.indices if i.plev)).permute(list(x.indices))


def linear_solve(operator: Network, rhs: Network, start: Network, how: Truncation = Truncation(), sweeps: int = 2, a0: float = 0.0, a1: float = 1.0, rtol: float = 1e-8) -> Network:
    """x with (a0 + a1 * operator) x = rhs, by two-site sweeps with projected right-hand sides."""
    state = start.canonicalize(0)
    n = len(state.tensors)
    for _ in range(sweeps):
        for forward in (True, False):
            for k in range(n - 1) if forward else range(n - 2, -1, -1):
                projected = _projected(rhs, state, k)
                local = lambda apply, two, _, b=projected: gmres(lambda x: x.axpby(a0, apply(x), a1), b.permute(list(two.indices)), two, rtol=rtol)[0]
                state = _update(operator, state, k, forward, local, how)
    return state


def _projected(rhs: Network, state: Network, k: int) -> Tensor:
    """rhs contracted with the isometric parts of state left and right of two sites."""
    b = rhs.sim_links()
    others = [state.tensors[j].conj() for j in range(len(state.tensors)) if j not in (k, k + 1)]
    return _held(contract([*others, *b.tensors.values()]))


def relative_residual(operator: Network, x: Network, rhs: Network) -> float:
    y = operator.apply(x)
    y = y.map(lambda t: t.replace_indices(*((i, i.noprime()) for i in t.indices if i.plev)))
    return y.axpby(1, rhs, -1).norm() / rhs.norm()


def sum_of_local_terms(spark, sites: Sequence[Index], one_site: np.ndarray, two_site: Sequence[tuple[np.ndarray, np.ndarray]]) -> Network:
    """The operator sum_k h_k + sum_k sum_j a_j(k) b_j(k + 1) as a chain, with bonds of dimension 2 + the number of pairs."""
    from ..index import new_link
    from ..tensor import from_dense

    d, w = sites[0].dim, 2 + len(two_site)
    bulk = np.zeros((w, d, d, w))
    bulk[0, :, :, 0] = bulk[-1, :, :, -1] = np.eye(d)
    bulk[-1, :, :, 0] = one_site
    for j, (a, b) in enumerate(two_site, 1):
        bulk[-1, :, :, j], bulk[j, :, :, 0] = a, b
    links = [new_link(w) for _ in sites[1:]]
    cores = []
    for k, s in enumerate(sites):
        core = bulk[-1:] if k == 0 else bulk
        core = core[..., :1] if k == len(sites) - 1 else core
        around = [*links[max(0, k - 1) : k], s.prime(), s, *links[k : k + 1]]
        shape = [i.dim for i in around]
        cores.append(from_dense(spark, around, core.reshape(shape).ravel(order="F").tolist()))
    return train(cores)


def swap_neighbours(chain: Network, k: int, how: Truncation = Truncation()) -> Network:
    """Sites k and k + 1 of a chain in exchanged order."""
    two = contract_pair(chain.tensors[k], chain.tensors[k + 1])
    sites = chain.site_indices(k + 1)
    outer = [i for i in chain.tensors[k].indices if i not in chain.site_indices(k) and i not in chain.tensors[k + 1].indices]
    a, b = _split(two, [*outer, *sites], how, True)
    return Network(chain.tensors | {k: a, k + 1: b})


def apply_truncated(operator: Network, state: Network, how: Truncation) -> Network:
    """Operator times state with bonds cut by singular values; sites come back unprimed."""
    out = operator.apply(state).truncate(how)
    return out.map(lambda t: t.replace_indices(*((i, i.noprime()) for i in t.indices if i.plev)))


def gradient(tensors: Sequence[Tensor], k: int) -> Tensor:
    """The derivative of the full contraction of real tensors by the k-th: all others contracted, its indices open."""
    others = [t for j, t in enumerate(tensors) if j != k]
    return contract(others, retain=tensors[k].indices)
