"""Krylov solvers whose vectors are partitioned trains, cut after every step.

A vector is a table of patches, the basis is one table with one more coordinate that says whose a patch is. So the products with
all basis vectors are one join, and taking them off is one sum by region, whatever their number; the driver holds the projected
matrix alone. What a step may lose grows as the residual falls: an operator applied late in a cycle changes little. A cycle ends
with the true residual, from which the next one starts, so that what was lost on the way is made good.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np

from ..index import Index
from .patches import PatchedTrain, inner_each, stacked, weighted

#: A linear operator. Patches of what it gives may meet; solvers add them up together with what they take off.
Apply = Callable[[PatchedTrain], PatchedTrain]
#: The share of the goal that cuts may take, the least cut, and the drop of a norm at which a vector is made orthogonal again.
SLACK, LEAST, AGAIN = 0.1, 1e-15, 0.1


def operator(op: PatchedTrain, pairs: Sequence[tuple[Index, Index]], order: Sequence[Index]) -> Apply:
    """Applies a partitioned train with indices (out, in) at each site to a vector on the in-indices, whose regions fix order.

    Patches of the result are as deep as the operator's: it should be split at least as deep as vectors are, or their patches
    become one.
    """
    outs = {i: o for o, i in pairs}
    back = {o: i for o, i in pairs}
    return lambda v: op.pieces(v, [outs[i] for i in order]).relabelled(back)


def affine(apply: Apply, a0: complex, a1: complex) -> Apply:
    """a0 x + a1 apply(x)."""

    def run(x: PatchedTrain) -> PatchedTrain:
        index = Index("term", 2)
        y = _held(apply(x))
        return weighted(stacked([x, y], index), [a0, a1])

    return run


@dataclass(frozen=True)
class Solution:
    """x, its true relative residual, applications of the operator, cycles, and whether the goal was met."""

    x: PatchedTrain
    residual: float
    steps: int
    cycles: int
    converged: bool


def _cut(t: PatchedTrain, rtol: float, max_bond: int | None) -> PatchedTrain:
    return _held(t.summed().truncate_adaptive(min(0.5, max(rtol, LEAST)), max_bond))


def _held(t: PatchedTrain) -> PatchedTrain:
    """Settled in no more partitions than a shuffle has: unions would add up from step to step."""
    most = int(t.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return replace(t, df=t.df.coalesce(most)).settled()


class _Arnoldi:
    """An orthonormal basis that grows by one application at a time, and the projected matrix."""

    def __init__(self, apply: Apply, start: PatchedTrain, size: float, most: int, max_bond: int | None) -> None:
        self.apply, self.max_bond, self.index = apply, max_bond, Index("krylov", most + 1)
        self.vectors, self.h = [_held(start.scale(1 / size))], np.zeros((most + 1, most), complex)
        self.closed = False

    @property
    def size(self) -> int:
        return len(self.vectors)

    def grow(self, rtol: float) -> None:
        j = self.size - 1
        stack = stacked(self.vectors, self.index)
        w = _held(self.apply(self.vectors[-1]))
        c = inner_each(stack, w)[: j + 1]
        w = _cut(weighted(stack, -c, w), rtol, self.max_bond)
        norm = w.norm()
        self.h[: j + 1, j] += c
        if norm < AGAIN * np.linalg.norm(c):
            c = inner_each(stack, w)[: j + 1]
            w = _cut(weighted(stack, -c, w), rtol, self.max_bond)
            norm = w.norm()
            self.h[: j + 1, j] += c
        self.h[j + 1, j] = norm
        self.closed = norm <= max(rtol, 1e-14) * abs(self.h).max()
        if not self.closed:
            self.vectors.append(_held(w.scale(1 / norm)))

    def projected(self, steps: int) -> np.ndarray:
        return self.h[: steps + 1, :steps]

    def combined(self, weights: np.ndarray, more: PatchedTrain | None = None) -> PatchedTrain:
        return weighted(stacked(self.vectors[: len(weights)], self.index), weights, more)


def gmres(apply: Apply, b: PatchedTrain, x0: PatchedTrain | None = None, rtol: float = 1e-8, atol: float = 0.0, max_bond: int | None = None, restart: int = 20, max_steps: int = 100) -> Solution:
    """x with apply(x) = b up to max(rtol |b|, atol), by restarted cycles of at most restart steps on vectors that are cut.

    max_bond splits patches with larger bonds and loses nothing. If a cycle doesn't lower the true residual, the x before it
    is returned as not converged.
    """
    if restart < 1 or max_steps < 0 or rtol < 0 or atol < 0:
        raise ValueError("no steps or negative tolerance")
    scale = b.norm()
    goal = max(rtol * scale, atol)
    if scale == 0:
        return Solution(b, 0.0, 0, 0, True)

    def residual_of(x: PatchedTrain) -> tuple[PatchedTrain, float]:
        out = weighted(stacked([_held(apply(x))], Index("krylov", 1)), [-1.0], b).summed()
        size = out.norm()
        return (_cut(out, SLACK * goal / size, max_bond) if size > goal else out), size

    x, used, cycles = x0, 0, 0
    residual, size = (b, scale) if x0 is None else residual_of(x0)
    while size > goal and used < max_steps:
        most = min(restart, max_steps - used)
        basis, left, n = _Arnoldi(apply, residual, size, most, max_bond), size, 0
        while n < most and left > 0.5 * goal and not basis.closed:
            basis.grow(SLACK * goal / left / most)
            n += 1
            rhs = np.zeros(n + 1, complex)
            rhs[0] = size
            y = np.linalg.lstsq(basis.projected(n), rhs, rcond=None)[0]
            left = float(np.linalg.norm(rhs - basis.projected(n) @ y))
        used, cycles = used + n, cycles + 1
        new = basis.combined(y, x).summed()
        reach = np.linalg.norm(basis.projected(n), 2) * new.norm()
        new = _cut(new, SLACK * goal / reach if reach else 0.0, max_bond)
        fresh, now = residual_of(new)
        if now > 0.9999 * size:
            break
        x, residual, size = new, fresh, now
    if x is None:
        x = b.scale(0.0)
    return Solution(x, size / scale, used, cycles, size <= goal)


def lowest_eigenpair(apply: Apply, start: PatchedTrain, rtol: float = 1e-8, max_bond: int | None = None, steps: int = 12, restarts: int = 10) -> tuple[float, PatchedTrain, float]:
    """The smallest eigenvalue of a Hermitian operator, its vector, and |A v - value v|; cycles of steps from the best vector so far.

    Ends where that distance is at most rtol times the operator's size as seen, or after restarts cycles.
    """
    size = start.norm()
    if size == 0 or steps < 1 or restarts < 1:
        raise ValueError("a start of zeros or no steps")
    vector, value, off = start, 0.0, 0.0
    for _ in range(restarts):
        basis, n = _Arnoldi(apply, vector, size, steps, max_bond), 0
        while n < steps and not basis.closed:
            basis.grow(SLACK * rtol)
            n += 1
        small = basis.projected(n)[:n]
        values, vectors = np.linalg.eigh((small + small.conj().T) / 2)
        vector = _cut(basis.combined(vectors[:, 0]), SLACK * rtol, max_bond)
        size = vector.norm()
        image = _held(apply(vector))
        value = float((inner_each(stacked([vector], Index("krylov", 1)), image)[0] / size**2).real)
        off = weighted(stacked([vector], Index("krylov", 1)), [-value], image).summed().norm() / size
        if off <= rtol * abs(values).max():
            break
    return value, vector.scale(1 / size), off


def expm_multiply(apply: Apply, vector: PatchedTrain, t: complex, rtol: float = 1e-8, max_bond: int | None = None, steps: int = 20) -> PatchedTrain:
    """exp(t A) vector for a Hermitian operator A, with as many steps as rtol needs and at most steps."""
    size = vector.norm()
    if size == 0:
        return vector
    basis, n, y = _Arnoldi(apply, vector, size, steps, max_bond), 0, np.ones(1)
    while n < steps and not basis.closed:
        basis.grow(SLACK * rtol)
        n += 1
        small = basis.projected(n)[:n]
        values, vectors = np.linalg.eigh((small + small.conj().T) / 2)
        y = (vectors * np.exp(t * values)) @ vectors[0].conj()
        if abs(y[-1]) * abs(basis.h[n, n - 1]) <= SLACK * rtol * np.linalg.norm(y):
            break
    else:
        if not basis.closed:
            raise ValueError("more steps are needed")
    return _cut(basis.combined(size * y), rtol, max_bond)
