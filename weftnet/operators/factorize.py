"""Factorizations of tensors seen as matrices.

A matrix has its rows distributed; its columns are the smaller side, whose dimension is checked against a limit. Blocks of
rows are factorized in tasks, and their triangles are joined and factorized again, a few at a time, until one is left (a
tall-skinny QR by reduction). Its singular values are exact to machine precision; the isometric factor comes by a join, and
by a second round where singular values lie so far apart that one leaves it skewed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..index import Index, new_link, unique_inds
from ..session import cut_lineage
from ..tensor import Tensor, contract_pair, from_dense

#: Largest dimension of the smaller side: its triangle has to fit into a task, and goes to the driver.
SMALL_SIDE = 2048
#: Values of a block of rows that a task factorizes, triangles that are joined at a time, and singular values (in shares of
#: the largest) that count as noise, or make a second round worth while.
BLOCK_VALUES, FAN_IN, NOISE, SKEWED = 4 << 20, 16, 2e-15, 1e-5


@dataclass(frozen=True)
class Truncation:
    """What to drop: singular values below rtol times the largest, or a tail of squares below cutoff of all; at most max_dim stay."""

    rtol: float = 0.0
    cutoff: float = 0.0
    max_dim: int | None = None

    def __post_init__(self) -> None:
        if self.rtol < 0 or self.cutoff < 0 or not (self.max_dim is None or self.max_dim > 0):
            raise ValueError("negative tolerance or no dimension left")

    def rank(self, singular: np.ndarray) -> int:
        """How many of the descending singular values stay; one at least."""
        s = np.asarray(singular, float)
        n = int((s > max(self.rtol, NOISE) * s[0]).sum()) if len(s) and s[0] > 0 else 0
        if self.cutoff and n:
            tail = np.cumsum((s**2)[::-1])[::-1]
            n = min(n, int((tail > self.cutoff * tail[0]).sum()))
        return max(1, min(n, self.max_dim or n))


def _sides(t: Tensor, left: Sequence[Index]) -> tuple[list[Index], list[Index]]:
    right = unique_inds(t.indices, left)
    if len(right) + len(left) != len(t.indices):
        raise ValueError("left indices that the tensor doesn't have")
    return list(left), right


def matrix(t: Tensor, rows: Sequence[Index], limit: int = SMALL_SIDE) -> np.ndarray:
    """A small tensor as a driver matrix; both sides column-major."""
    rows, cols = _sides(t, rows)
    n, m = math.prod(i.dim for i in rows), math.prod(i.dim for i in cols)
    if max(n, m) > limit:
        raise ValueError(f"a {n} x {m} matrix is too large for the driver")
    values = t.permute([*rows, *cols]).to_list()
    return np.array(values).reshape((n, m), order="F")


def tensor_of(t: Tensor, indices: Sequence[Index], values: np.ndarray) -> Tensor:
    """A driver matrix as a tensor in the session of t."""
    flat = np.asarray(values).ravel(order="F")
    return from_dense(t.spark, indices, flat.tolist())


def gram(t: Tensor, side: Sequence[Index]) -> np.ndarray:
    """A* A over the given side: one self-join on the other side, summed before the shuffle."""
    primed = t.replace_indices(*((i, i.prime()) for i in side))
    return matrix(contract_pair(t.conj(), primed), side)


def hermitian_eigen(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and eigenvectors in columns."""
    values, vectors = np.linalg.eigh(h)
    return values[::-1], vectors[:, ::-1]


def triangle(t: Tensor, left: Sequence[Index]) -> np.ndarray:
    """R of the QR factorization of t, rows left, in column-major order of the other indices."""
    left, right = _sides(t, left)
    m = math.prod(i.dim for i in right)
    if m > SMALL_SIDE:
        raise ValueError(f"the smaller side has {m} entries, more than {SMALL_SIDE}")
    col, step = F.lit(0).cast("long"), 1
    for i in right:
        col, step = col + F.col(i.column) * F.lit(step), step * i.dim
    rich = t.is_complex
    n_rows = math.prod(i.dim for i in left)
    n_blocks = int(max(1, min(1 << 20, -(-n_rows * m // max(BLOCK_VALUES, 4 * m * m)))))
    keys = [i.column for i in left]
    row = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    rows = t.df.select(F.pmod(row, F.lit(n_blocks)).alias("block"), (F.struct(*keys) if keys else row).alias("row"), col.alias("col"), "re", (F.col("im") if rich else F.lit(0.0)).alias("im"))
    schema = "block long, tri binary"

    def packed(block: int, a: np.ndarray) -> pa.Table:
        r = np.linalg.qr(a, mode="r") if len(a) else a
        return pa.table({"block": pa.array([block], pa.int64()), "tri": pa.array([np.ascontiguousarray(r, np.complex128).tobytes()], pa.binary())})

    def first(table: pa.Table) -> pa.Table:
        at = table.column("row").combine_chunks()
        names = [np.asarray(at.field(k)) for k in range(at.type.num_fields)] if pa.types.is_struct(at.type) else [np.asarray(at)]
        order = np.lexsort(names)
        change = np.concatenate([[False], np.any([n[order][1:] != n[order][:-1] for n in names], axis=0)])
        row = np.empty(len(order), np.int64)
        row[order] = np.cumsum(change)
        a = np.zeros((int(row.max()) + 1, m), np.complex128)
        np.add.at(a, (row, np.asarray(table.column("col"))), np.asarray(table.column("re")) + 1j * np.asarray(table.column("im")))
        return packed(table.column("block")[0].as_py(), a if rich else a.real)

    def joined(table: pa.Table) -> pa.Table:
        a = np.concatenate([np.frombuffer(x, np.complex128).reshape(-1, m) for x in table.column("tri").to_pylist()])
        return packed(table.column("block")[0].as_py(), a if rich else a.real)

    parts = rows.groupBy("block").applyInArrow(first, schema)
    while n_blocks > 1:
        parts = cut_lineage(parts)
        n_blocks = -(-n_blocks // FAN_IN)
        parts = parts.withColumn("block", F.pmod("block", F.lit(n_blocks))).groupBy("block").applyInArrow(joined, schema)
    found = next(iter(parts.collect()), None)
    r = np.frombuffer(found.tri, np.complex128).reshape(-1, m) if found else np.zeros((1, m))
    return r if rich else r.real


def _isometric(t: Tensor, right: Sequence[Index], vectors: np.ndarray, s: np.ndarray, bond: Index) -> tuple[Tensor, np.ndarray]:
    """t V / s as columns that are orthonormal, and the small matrix by which they had to be changed."""
    u = contract_pair(t, tensor_of(t, [*right, bond], vectors / np.where(s > 0, s, 1)))
    if not len(s) or s[-1] > SKEWED * s[0] or s[0] == 0:
        return u, np.eye(len(s))
    u = u._like(cut_lineage(u.df))
    skew = triangle(u, [i for i in u.indices if i != bond])
    if skew.shape[0] < skew.shape[1]:
        return u, np.eye(len(s))
    turned = contract_pair(u, tensor_of(u, [bond, bond.prime()], np.linalg.inv(skew))).replace_indices((bond.prime(), bond))
    return turned, skew


#: Random columns that a range finder begins with, fresh ones that its residual is judged by, and what counts as exact.
PROBES, FRESH, EXACT = 128, 8, 1e-13


def range_finder(t: Tensor, left: Sequence[Index], tolerance: float = EXACT, most: int | None = None, seed: int = 0) -> tuple[Tensor, Tensor, float]:
    """Q (left, bond) with orthonormal columns, B = Q* t (bond, right), and a bound of what t - Q B holds, relative to t.

    For matrices of which neither side is small: t times random columns spans its range if there are more of them than its
    rank; their number doubles until fresh random columns show no residual beyond tolerance (the bound fails with a chance
    of 10^-FRESH). Only triangles of the number of columns squared leave Spark. With most, columns stop at that number and a
    few; otherwise a matrix whose rank is over SMALL_SIDE is refused.
    """
    from ..tensor import random

    left, right = _sides(t, left)
    size, k = t.norm(), PROBES if most is None else most + 8
    if size == 0:
        bond = new_link(1)
        return t.sum_over(right)._like(t.sum_over(right).df.where("false").withColumn(bond.column, F.lit(0).cast("long")), [*left, bond]), t.sum_over(left)._like(t.sum_over(left).df.where("false").withColumn(bond.column, F.lit(0).cast("long")), [*right, bond]), 0.0
    probe = Index("weft_fresh", FRESH)
    fresh = random(t.spark, [*right, probe], seed + 99)
    fresh = fresh._like(cut_lineage(fresh.df))
    seen = contract_pair(t, fresh)
    seen = seen._like(cut_lineage(seen.df))
    while True:
        k = min(k, SMALL_SIDE)
        y = contract_pair(t, random(t.spark, [*right, Index("weft_probe", k)], seed + k))
        q, _ = qr(y._like(cut_lineage(y.df)), left)
        q = q._like(cut_lineage(q.df))
        b = contract_pair(q.conj(), t)
        b = b._like(cut_lineage(b.df))
        rest = seen.sub(contract_pair(q, contract_pair(b, fresh)).permute(seen.indices))
        most_left = rest._like(rest.df.groupBy(probe.column).agg(F.sqrt(F.sum(rest.abs2())).alias("re")), [probe], False).maxabs()
        # uniform columns in [-1/2, 1/2) have a variance of 1/12
        bound = 10 * math.sqrt(2 / math.pi) * math.sqrt(12) * most_left / size
        if bound <= 10 * tolerance or most is not None:
            return q, b, bound
        if k == SMALL_SIDE:
            raise ValueError(f"neither side is below {SMALL_SIDE}, nor is the rank")
        k *= 2


def svd(t: Tensor, left: Sequence[Index], how: Truncation = Truncation()) -> tuple[Tensor, np.ndarray, Tensor]:
    """U (left, bond), singular values, V (bond, right) with t = U diag(s) V; the smaller side is solved.

    Where both sides have over SMALL_SIDE entries, their ranges are found first (range_finder).
    """
    left, right = _sides(t, left)
    if min(math.prod(i.dim for i in left), math.prod(i.dim for i in right)) > SMALL_SIDE:
        q, b, _ = range_finder(t, left, max(EXACT, how.rtol / 10, math.sqrt(how.cutoff) / 10), how.max_dim)
        (bond,) = [i for i in q.indices if i not in left]
        u, s, v = svd(b, [bond], how)
        return contract_pair(q, u), s, v
    if math.prod(i.dim for i in left) < math.prod(i.dim for i in right):
        v, s, u = svd(t, right, how)
        return u, s, v
    _, s, rows = np.linalg.svd(triangle(t, left), full_matrices=False)
    n = how.rank(s)
    s, vectors = s[:n], rows[:n].conj().T
    bond = new_link(n)
    u, skew = _isometric(t, right, vectors, s, bond)
    if not np.array_equal(skew, np.eye(n)):  # fold the second round in, so that the middle is diagonal again
        a, s, b = np.linalg.svd((skew * s) @ vectors.conj().T, full_matrices=False)
        u = contract_pair(u, tensor_of(u, [bond, bond.prime()], a)).replace_indices((bond.prime(), bond))
        vectors = b.conj().T
    return u, s, tensor_of(t, [*right, bond], vectors.conj())


def qr(t: Tensor, left: Sequence[Index], rtol: float = 1e-15) -> tuple[Tensor, Tensor]:
    """Q (left, bond) with orthonormal columns and R (bond, right) with t = Q R; dependent columns are left out."""
    left, right = _sides(t, left)
    n, m = math.prod(i.dim for i in left), math.prod(i.dim for i in right)
    if n < m or m > SMALL_SIDE:
        u, s, v = svd(t, left, Truncation(rtol=rtol))
        bond = next(i for i in u.indices if i in v.indices)
        return u, contract_pair(tensor_of(t, [bond.prime(), bond], np.diag(s)), v).replace_indices((bond.prime(), bond))
    _, s, rows = np.linalg.svd(triangle(t, left), full_matrices=False)
    n = Truncation(rtol=rtol).rank(s)
    bond = new_link(n)
    s, vectors = s[:n], rows[:n].conj().T
    q, skew = _isometric(t, right, vectors, s, bond)
    return q, tensor_of(t, [bond, *right], (skew * s) @ vectors.conj().T)


def factorize(t: Tensor, left: Sequence[Index], how: Truncation = Truncation(), method: str = "svd", canonical: str = "left") -> tuple[Tensor, Tensor]:
    """Two factors that share a bond; the one on the canonical side is isometric. Methods svd, qr, lu, ci."""
    left, right = _sides(t, left)
    if method == "svd":
        u, s, v = svd(t, left, how)
        bond = next(i for i in u.indices if i in v.indices)
        scaled = tensor_of(t, [bond, bond.prime()], np.diag(s))
        move = lambda x: contract_pair(x, scaled).replace_indices((bond.prime(), bond))
        return (u, move(v)) if canonical == "left" else (move(u), v)
    if method == "qr":
        if canonical == "left":
            return qr(t, left)
        q, r = qr(t, right)
        return r, q
    if method in ("lu", "ci"):
        cross = rank_revealing_lu(t, left, how.max_dim, how.rtol or 1e-12)
        return cross.left(), cross.right()
    raise ValueError(f"unknown method {method}")


@dataclass(frozen=True)
class Cross:
    """t = sum over pivots of column k times row k / pivot k, from residuals."""

    columns: Tensor
    rows: Tensor
    pivots: list[tuple[dict[str, int], dict[str, int], complex]]
    errors: list[float]

    def left(self) -> Tensor:
        return self.columns

    def right(self) -> Tensor:
        return self.rows

    def full(self) -> Tensor:
        return contract_pair(self.columns, self.rows)


def rank_revealing_lu(t: Tensor, left: Sequence[Index], max_rank: int | None = None, rtol: float = 1e-12, atol: float = 0.0) -> Cross:
    """Full-pivot elimination: each round finds the largest residual, and subtracts its cross.

    Ties go to the first position in column-major order. The residual stays distributed; a round costs an argmax, two
    filters and a join. errors holds the pivots' absolute values, and last the residual that is left.
    """
    left, right = _sides(t, left)
    if t.has_nonfinite():
        raise ValueError("values are not finite")
    residual, k, first = t, 0, None
    bond = None
    cols, rows, pivots, errors = [], [], [], []
    limit = min(math.prod(i.dim for i in left), math.prod(i.dim for i in right), max_rank or SMALL_SIDE)
    order = [F.desc("weft_abs"), *(F.asc(i.column) for i in reversed([*left, *right]))]
    while True:
        top = residual.df.withColumn("weft_abs", residual.abs2()).orderBy(*order).first()
        size = math.sqrt(top.weft_abs) if top else 0.0
        first = first if first is not None else size
        errors.append(size)
        if k == limit or size <= max(atol, rtol * first) or size == 0:
            break
        at_left, at_right = {i: top[i.column] for i in left}, {i: top[i.column] for i in right}
        pivot = complex(top.re, top.im) if residual.is_complex else top.re
        column, row = residual.select_indices(at_right), residual.select_indices(at_left).scale(1 / pivot)
        residual = residual.sub(contract_pair(column, row)).nonzero()
        residual = residual._like(cut_lineage(residual.df))
        cols.append(column), rows.append(row)
        pivots.append(({i.column: c for i, c in at_left.items()}, {i.column: c for i, c in at_right.items()}, pivot))
        k += 1
    from ..tensor import stack, zeros

    bond = new_link(max(1, k))
    if not k:
        return Cross(zeros(t.spark, [*left, bond]), zeros(t.spark, [bond, *right]), [], errors)
    return Cross(stack(cols, bond), stack(rows, bond), pivots, errors)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A small square system on the driver; least squares where it is singular."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def interpolative(t: Tensor, left: Sequence[Index], pivots: Cross) -> Tensor:
    """C P^-1 R from t's own rows and columns at pivots: equal to t at those and everywhere if t has their rank."""
    left, right = _sides(t, left)
    if not pivots.pivots:
        return t.scale(0)
    from ..tensor import stack

    bond = new_link(len(pivots.pivots))
    columns = stack([t.select_indices({i: c[i.column] for i in right}) for _, c, _ in pivots.pivots], bond)
    rows = stack([t.select_indices({i: r[i.column] for i in left}) for r, _, _ in pivots.pivots], bond.prime())
    square = stack([columns.select_indices({i: r[i.column] for i in left}) for r, _, _ in pivots.pivots], bond.prime())
    inverse = np.linalg.pinv(matrix(square, [bond.prime()]))
    return contract_pair(contract_pair(columns, tensor_of(t, [bond, bond.prime()], inverse)), rows)
