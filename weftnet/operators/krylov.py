"""Krylov solvers for operators given as functions from tensor to tensor.

Vectors are coordinate tables; only inner products and a small projected matrix come to the driver. Each basis vector is
checkpointed, so that a step's plan holds one application of the operator.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from ..index import Index
from ..session import cut_lineage
from ..tensor import Tensor, contract_pair, from_dense

Apply = Callable[[Tensor], Tensor]


def _held(t: Tensor) -> Tensor:
    return t._like(cut_lineage(t.df))


class _Basis:
    """Checkpointed vectors side by side along an index, so that all products with them are one job."""

    def __init__(self, first: Tensor, most: int) -> None:
        self.index, self.most, self.vectors = Index("krylov", most), most, []
        self.add(first)

    def add(self, v: Tensor) -> None:
        self.vectors.append(v)

    def table(self) -> Tensor:
        rich = any(v.is_complex for v in self.vectors)
        parts = [v.to_complex() if rich else v for v in self.vectors]
        first, df = parts[0], None
        for k, v in enumerate(parts):
            part = first._as(v).withColumn(self.index.column, F.lit(k).cast("long"))
            df = part if df is None else df.unionByName(part)
        return Tensor(df, (*first.indices, self.index), rich)

    def dots(self, w: Tensor) -> np.ndarray:
        out = np.zeros(len(self.vectors), complex)
        product = contract_pair(self.table().conj(), w)
        for r in product.df.collect():
            out[r[self.index.column]] = complex(r.re, r.im) if product.is_complex else r.re
        return out

    def combined(self, weights: np.ndarray) -> Tensor:
        """The sum of the vectors times weights: one join with a few numbers and one aggregation."""
        w = np.zeros(self.most, complex)
        w[: len(weights)] = weights
        values = w.tolist() if abs(w.imag).max() > 1e-300 else w.real.tolist()
        return contract_pair(self.table(), from_dense(self.vectors[0].spark, [self.index], values))


def _arnoldi(apply: Apply, start: Tensor, steps: int) -> tuple[_Basis, np.ndarray]:
    basis, h = _Basis(_held(start.scale(1 / start.norm())), steps + 1), np.zeros((steps + 1, steps), complex)
    for j in range(steps):
        w = _held(apply(basis.vectors[j]))
        for _ in range(2):  # twice is enough
            c = basis.dots(w)
            h[: j + 1, j] += c
            w = _held(w.sub(basis.combined(c)))
        h[j + 1, j] = w.norm()
        if abs(h[j + 1, j]) < 1e-13 * max(1.0, abs(h).max()):
            return basis, h[: j + 1, : j + 1]
        if j < steps - 1:
            basis.add(_held(w.scale(1 / h[j + 1, j].real)))
    return basis, h


def gmres(apply: Apply, b: Tensor, x0: Tensor | None = None, rtol: float = 1e-10, atol: float = 0.0, restart: int = 20, max_steps: int = 100) -> tuple[Tensor, float]:
    """x with apply(x) = b, and the relative residual; restarted, within max_steps applications."""
    scale = b.norm()
    if scale == 0:
        return b.scale(0), 0.0
    x, used = x0, 0
    residual = b if x is None else b.sub(apply(x))
    size = residual.norm()
    while size > max(rtol * scale, atol) and used < max_steps:
        basis, h = _arnoldi(apply, residual, min(restart, max_steps - used))
        k = h.shape[1]
        used += k
        rhs = np.zeros(h.shape[0], complex)
        rhs[0] = size
        y = np.linalg.lstsq(h, rhs, rcond=None)[0]
        step = basis.combined(y)
        x = _held(step if x is None else x.add(step))
        residual = _held(b.sub(apply(x)))
        size, last = residual.norm(), size
        if size > 0.9999 * last:
            break
    return x, size / scale


def gmres_affine(apply: Apply, a0: float, a1: float, b: Tensor, **how) -> tuple[Tensor, float]:
    """x with a0 x + a1 apply(x) = b."""
    return gmres(lambda x: x.axpby(a0, apply(x), a1), b, **how)


def lowest_eigenpair(apply: Apply, start: Tensor, steps: int = 30, rtol: float = 1e-10, restarts: int = 5) -> tuple[float, Tensor]:
    """The smallest eigenvalue of a Hermitian operator and its vector, by restarted Lanczos steps."""
    vector, last = start, None
    for _ in range(restarts):
        basis, h = _arnoldi(apply, vector, steps)
        k = h.shape[1]
        small = h[:k, :k]
        values, vectors = np.linalg.eigh((small + small.conj().T) / 2)
        y = vectors[:, 0]
        vector = _held(basis.combined(np.where(abs(y.imag) > 1e-14, y, y.real)))
        if k < steps or (last is not None and abs(values[0] - last) <= rtol * max(1, abs(values[0]))):
            break
        last = values[0]
    return float(values[0]), vector


def expm_multiply(apply: Apply, vector: Tensor, t: complex, steps: int = 20) -> Tensor:
    """exp(t A) vector for a Hermitian operator A."""
    norm = vector.norm()
    if norm == 0:
        return vector
    basis, h = _arnoldi(apply, vector, steps)
    k = h.shape[1]
    small = h[:k, :k]
    values, vectors = np.linalg.eigh((small + small.conj().T) / 2)
    y = norm * (vectors * np.exp(t * values)) @ vectors[0].conj()
    return basis.combined(y)
