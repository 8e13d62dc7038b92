"""Gradients of real scalars through contractions and factorizations.

Operations on variables are recorded; going back over them in reverse, each adds to the gradients of what it was made from.
Every rule is made of joins and sums on tensors, but for squares of rank by rank that a factorization has on the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..index import Index, common_inds
from ..operators import factorize as X
from ..session import cut_lineage
from ..tensor import Tensor, contract_pair, from_dense, ones, scalar

_order = itertools.count()


@dataclass(frozen=True, eq=False)
class Step:
    """An operation: its inputs, and how gradients of its outputs (None where there is none) become those of its inputs."""

    inputs: tuple[Var, ...]
    back: Callable[[list[Tensor | None]], list[Tensor]]
    outputs: int = 1
    number: int = field(default_factory=lambda: next(_order))


@dataclass(frozen=True, eq=False)
class Var:
    """A tensor that gradients may be asked of; the output of a step, or a leaf."""

    value: Tensor
    step: Step | None = None
    output: int = 0

    def __add__(self, other: Var) -> Var:
        return Var(self.value.add(other.value), Step((self, other), lambda g: [g[0], g[0]]))

    def __sub__(self, other: Var) -> Var:
        return Var(self.value.sub(other.value), Step((self, other), lambda g: [g[0], g[0].neg()]))

    def scale(self, a: float) -> Var:
        return Var(self.value.scale(a), Step((self,), lambda g: [g[0].scale(a)]))

    def replace_indices(self, *pairs: tuple[Index, Index]) -> Var:
        return Var(self.value.replace_indices(*pairs), Step((self,), lambda g: [g[0].replace_indices(*((b, a) for a, b in pairs))]))

    def contract(self, other: Var, retain: Sequence[Index] = ()) -> Var:
        """Sum over common indices but for those retained."""
        a, b = self.value, other.value
        kept = [i for i in common_inds(a.indices, b.indices) if i in retain]
        return Var(contract_pair(a, b, retain), Step((self, other), lambda g: [contract_pair(g[0], b, kept), contract_pair(g[0], a, kept)]))

    def sum_over(self, indices: Sequence[Index]) -> Var:
        gone = list(indices)
        return Var(self.value.sum_over(gone), Step((self,), lambda g: [contract_pair(g[0], ones(self.value.spark, gone))]))

    def norm_squared(self) -> Var:
        """Sum of squares, a tensor without indices."""
        return Var(scalar(self.value.spark, float(self.value.norm_squared())), Step((self,), lambda g: [self.value.scale(2 * g[0].only())]))


def leaf(t: Tensor) -> Var:
    if t.is_complex:
        raise ValueError("gradients of real tensors are asked for")
    return Var(t)


def svd(a: Var, left: Sequence[Index], how: X.Truncation = X.Truncation()) -> tuple[Var, Var, Var]:
    """U (left, bond), S (bond), V (right, bond) as variables.

    What truncation drops is taken as not there: gradients are those of the kept values, exact as long as a function depends
    on the kept product or on S, or nothing was dropped. Gradients of single vectors of equal values don't exist and count 0.
    """
    u, s, v = X.svd(a.value, left, how)
    (bond,) = common_inds(u.indices, v.indices)
    u, v = (t._like(cut_lineage(t.df)) for t in (u, v))
    spark, prime = u.spark, bond.prime()
    values = from_dense(spark, [bond], s.tolist())

    def square(x: Tensor, y: Tensor) -> np.ndarray:
        """x* y over the long side: [bond of x, bond of y]."""
        return X.matrix(contract_pair(x, y.replace_indices((bond, prime))), [bond])

    def turned(x: Tensor, m: np.ndarray) -> Tensor:
        """Columns of x combined by a small matrix."""
        return contract_pair(x, from_dense(spark, [bond, prime], m.ravel(order="F").tolist())).replace_indices((prime, bond))

    def back(g: list[Tensor | None]) -> list[Tensor]:
        gu, gs, gv = g
        apart = s[None, :] ** 2 - s[:, None] ** 2
        f = np.where(np.abs(apart) > 1e-12 * s[0] ** 2, 1 / np.where(apart == 0, 1, apart), 0)
        inner, inverse = np.zeros((len(s), len(s))), np.divide(1, s, out=np.zeros_like(s), where=s > 0)
        out = None
        if gs is not None:
            inner += np.diag(X.matrix(gs, [bond]).ravel())
        if gu is not None:
            x = square(u, gu)
            inner += f * (x - x.T) * s[None, :]
            out = contract_pair(turned(gu.sub(turned(u, x)), np.diag(inverse)), v)
        if gv is not None:
            x = square(v, gv)
            inner += s[:, None] * f * (x - x.T)
            more = contract_pair(u, turned(gv.sub(turned(v, x)), np.diag(inverse)))
            out = more if out is None else out.add(more)
        whole = contract_pair(turned(u, inner), v)
        return [whole if out is None else whole.add(out)]

    step = Step((a,), back, outputs=3)
    return Var(u, step, 0), Var(values, step, 1), Var(v, step, 2)


def qr(a: Var, left: Sequence[Index]) -> tuple[Var, Var]:
    """Q (left, bond) with orthonormal columns and R (bond, right), by singular vectors."""
    u, s, v = svd(a, left)
    (bond,) = s.value.indices
    return u, v.contract(s, retain=[bond])


def gradients(of: Var, wanted: Sequence[Var]) -> list[Tensor]:
    """The gradient of a variable without indices by each wanted one: a tensor of its indices; zeros where nothing leads to it."""
    if of.value.indices:
        raise ValueError("the gradient of a tensor with indices")
    found: dict[int, Tensor] = {id(of): scalar(of.value.spark, 1.0)}
    steps: dict[int, Step] = {}
    outputs: dict[int, dict[int, Var]] = {}
    todo, seen = [of], {id(of)}
    while todo:
        x = todo.pop()
        if x.step is None:
            continue
        steps[x.step.number] = x.step
        outputs.setdefault(x.step.number, {})[x.output] = x
        for y in x.step.inputs:
            if id(y) not in seen:
                seen.add(id(y))
                todo.append(y)
    for number in sorted(steps, reverse=True):  # a step's outputs are used by later steps only
        own = outputs[number]
        grads = [found.get(id(own[k])) if k in own else None for k in range(steps[number].outputs)]
        if all(g is None for g in grads):
            continue
        for y, g in zip(steps[number].inputs, steps[number].back(grads), strict=True):
            g = g.permute(y.value.indices)
            total = found[id(y)].add(g) if id(y) in found else g
            found[id(y)] = total._like(cut_lineage(total.df))
    return [found.get(id(w), w.value.scale(0)) for w in wanted]

