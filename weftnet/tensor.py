"""Labelled tensors as coordinate tables.

A tensor is a DataFrame with an integer column for each index, re, and for complex values im. Rows that are absent are
zero. Flat positions are column-major: the first index runs fastest. Every operation is a plan; nothing runs until a
caller asks for a number or rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .index import Index, check_unique, common_inds, new_index, permutation, replace_in, unique_inds

#: Values that a driver may hand in or take out as a list.
DRIVER_VALUES = 1_000_000


def whole(x: Column, step: int) -> Column:
    """The whole part, downwards, of a long over a positive number: exact over all 64 bits."""
    return F.call_function("div", x - F.pmod(x, F.lit(step)), F.lit(step))


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    indices: tuple[Index, ...]
    is_complex: bool = False

    def __post_init__(self) -> None:
        check_unique(self.indices)

    # -- shape -----------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return [i.column for i in self.indices]

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.is_complex else ["re"]

    @property
    def size(self) -> int:
        return math.prod(i.dim for i in self.indices)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def _like(self, df: DataFrame, indices: Sequence[Index] | None = None, is_complex: bool | None = None) -> Tensor:
        return Tensor(df, self.indices if indices is None else tuple(indices), self.is_complex if is_complex is None else is_complex)

    def to_complex(self) -> Tensor:
        return self if self.is_complex else self._like(self.df.withColumn("im", F.lit(0.0)), is_complex=True)

    def nonzero(self) -> Tensor:
        """Without stored zeros."""
        return self._like(self.df.where((F.col("re") != 0) | (F.col("im") != 0) if self.is_complex else F.col("re") != 0))

    def densified(self) -> Tensor:
        """With a row for each coordinate; for functions that do not map 0 to 0."""
        grid = positions(self.spark, self.indices).drop("pos")
        full = grid.join(self.df, self.columns, "left") if self.indices else self.df
        return self._like(full.select(*self.columns, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in self.values)))

    # -- indices ---------------------------------------------------------------------------------

    def replace_indices(self, *pairs: tuple[Index, Index]) -> Tensor:
        new = replace_in(self.indices, pairs)
        return self._like(self.df.select(*(F.col(a.column).alias(b.column) for a, b in zip(self.indices, new, strict=True)), *self.values), new)

    def prime(self, n: int = 1) -> Tensor:
        return self.replace_indices(*((i, i.prime(n)) for i in self.indices))

    def sim(self, *indices: Index) -> Tensor:
        return self.replace_indices(*((i, i.sim()) for i in indices))

    def permute(self, indices: Sequence[Index]) -> Tensor:
        permutation(self.indices, indices)
        return self._like(self.df.select(*(i.column for i in indices), *self.values), indices)

    def select_indices(self, at: Mapping[Index, int]) -> Tensor:
        """The slice at fixed coordinates; a filter that reaches the scan."""
        self._known(at)
        df = self.df
        for i, k in at.items():
            if not 0 <= k < i.dim:
                raise ValueError(f"{i.column}: {k} is outside 0..{i.dim - 1}")
            df = df.where(F.col(i.column) == k)
        rest = [i for i in self.indices if i not in at]
        return self._like(df.select(*(i.column for i in rest), *self.values), rest)

    def mask_index(self, at: Mapping[Index, int]) -> Tensor:
        """Zero everywhere but at fixed coordinates; the shape stays."""
        self._known(at)
        df = self.df
        for i, k in at.items():
            df = df.where(F.col(i.column) == k)
        return self._like(df)

    def index_select(self, index: Index, coordinates: Sequence[int]) -> tuple[Tensor, Index]:
        """Rows at the listed coordinates, in that order and as often, along a fresh index."""
        self._known([index])
        fresh = new_index(len(coordinates), *index.tags)
        cases = F.filter(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(k).alias("k")) for k, c in enumerate(coordinates))), lambda x: x["c"] == F.col(index.column))
        df = self.df.where(F.col(index.column).isin(*set(coordinates))).withColumn(fresh.column, F.explode(F.transform(cases, lambda x: x["k"])))
        new = [fresh if i == index else i for i in self.indices]
        return self._like(df.select(*(i.column for i in new), *self.values), new), fresh

    def fuse_indices(self, group: Sequence[Index], fused: Index | None = None) -> tuple[Tensor, Index]:
        """Indices of a group as one, the first running fastest; it stands where the first stood."""
        self._known(group)
        fused = fused or new_index(math.prod(i.dim for i in group))
        code, step = F.lit(0).cast("long"), 1
        for i in group:
            code, step = code + F.col(i.column) * F.lit(step), step * i.dim
        if step != fused.dim:
            raise ValueError("dimensions of the group don't fit the fused index")
        new = [fused if i == group[0] else i for i in self.indices if i == group[0] or i not in group]
        return self._like(self.df.withColumn(fused.column, code).select(*(i.column for i in new), *self.values), new), fused

    def unfuse_index(self, fused: Index, group: Sequence[Index]) -> Tensor:
        self._known([fused])
        if math.prod(i.dim for i in group) != fused.dim:
            raise ValueError("dimensions of the group don't fit the fused index")
        df, step = self.df, 1
        for i in group:
            df = df.withColumn(i.column, whole(F.col(fused.column), step) % i.dim)
            step *= i.dim
        new = [x for i in self.indices for x in (group if i == fused else [i])]
        return self._like(df.select(*(i.column for i in new), *self.values), new)

    def diagonal(self, a: Index, b: Index) -> Tensor:
        """The entries with equal coordinates on two indices, along the first."""
        self._known([a, b])
        rest = [i for i in self.indices if i != b]
        return self._like(self.df.where(F.col(a.column) == F.col(b.column)).select(*(i.column for i in rest), *self.values), rest)

    def _known(self, indices) -> None:
        for i in indices:
            if i not in self.indices:
                raise ValueError(f"no index {i.column}")

    def _as(self, other: Tensor) -> DataFrame:
        if set(self.indices) != set(other.indices):
            raise ValueError("index sets differ")
        same = other.to_complex() if self.is_complex else other
        return same.df.select(*self.columns, *self.values)

    # -- algebra ---------------------------------------------------------------------------------

    def axpby(self, a: complex, other: Tensor, b: complex) -> Tensor:
        """a * self + b * other: a union and a sum for each coordinate."""
        x, y = self.scale(a), other.scale(b)
        if x.is_complex != y.is_complex:
            x, y = x.to_complex(), y.to_complex()
        both = x.df.unionByName(x._as(y))
        if not self.indices:
            return x._like(both.agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in x.values)))
        return x._like(both.groupBy(*x.columns).agg(*(F.sum(v).alias(v) for v in x.values)))

    def add(self, other: Tensor) -> Tensor:
        return self.axpby(1, other, 1)

    def sub(self, other: Tensor) -> Tensor:
        return self.axpby(1, other, -1)

    def neg(self) -> Tensor:
        return self.scale(-1)

    def scale(self, a: complex) -> Tensor:
        if a == 1:
            return self
        if isinstance(a, complex) and a.imag:
            x = self.to_complex()
            re, im = F.col("re") * a.real - F.col("im") * a.imag, F.col("re") * a.imag + F.col("im") * a.real
            return x._like(x.df.select(*x.columns, re.alias("re"), im.alias("im")))
        real = float(a.real)
        return self._like(self.df.select(*self.columns, *((F.col(v) * real).alias(v) for v in self.values)))

    def conj(self) -> Tensor:
        return self._like(self.df.withColumn("im", -F.col("im"))) if self.is_complex else self

    def real_part(self) -> Tensor:
        return self._like(self.df.select(*self.columns, "re"), is_complex=False)

    def imag_part(self) -> Tensor:
        im = F.col("im") if self.is_complex else F.lit(0.0)
        return self._like(self.df.select(*self.columns, im.alias("re")), is_complex=False)

    def combined(self, imaginary: Tensor) -> Tensor:
        """self + i * imaginary for two real tensors."""
        return self.axpby(1, imaginary, 1j)

    def map_values(self, f) -> Tensor:
        """f(re) or f(re, im) -> re or (re, im) for each stored value; densify first if f(0) is not 0."""
        out = f(*(F.col(v) for v in self.values))
        pair = out if isinstance(out, tuple) else (out,)
        return self._like(self.df.select(*self.columns, *(c.alias(n) for c, n in zip(pair, ("re", "im"), strict=False))), is_complex=len(pair) == 2)

    def hadamard(self, other: Tensor) -> Tensor:
        """Product of values with equal coordinates on the indices of both."""
        return contract_pair(self, other, retain=common_inds(self.indices, other.indices))

    # -- reductions ------------------------------------------------------------------------------

    def sum_over(self, indices: Sequence[Index]) -> Tensor:
        self._known(indices)
        rest = unique_inds(self.indices, indices)
        sums = [F.sum(v).alias(v) for v in self.values]
        if not rest:
            return self._like(self.df.agg(*(F.coalesce(s, F.lit(0.0)).alias(v) for s, v in zip(sums, self.values, strict=True))), [])
        return self._like(self.df.groupBy(*(i.column for i in rest)).agg(*sums), rest)

    def sum(self) -> complex:
        return self.sum_over(self.indices).only()

    def only(self) -> complex:
        """The value of a tensor without indices."""
        if self.indices:
            raise ValueError("the tensor has indices")
        row = self.df.agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in self.values)).first()
        return complex(row.re, row.im) if self.is_complex else row.re

    def _reduced(self, value: Column) -> float:
        return self.df.agg(F.coalesce(value, F.lit(0.0))).first()[0]

    def abs2(self) -> Column:
        return F.col("re") * F.col("re") + (F.col("im") * F.col("im") if self.is_complex else F.lit(0.0))

    def norm_squared(self) -> float:
        return self._reduced(F.sum(self.abs2()))

    def norm(self) -> float:
        return math.sqrt(self.norm_squared())

    def maxabs(self) -> float:
        return math.sqrt(self._reduced(F.max(self.abs2())))

    def argmax(self) -> dict[Index, int]:
        """Coordinates of the largest absolute value; on ties the first in column-major order."""
        row = self.df.withColumn("weft_abs", self.abs2()).orderBy(F.desc("weft_abs"), *reversed(self.columns)).first()
        return {i: int(row[i.column]) if row else 0 for i in self.indices}

    def inner(self, other: Tensor) -> complex:
        """Sum of conj(self) * other."""
        return contract_pair(self.conj(), other).only()

    def distance(self, other: Tensor) -> float:
        """Norm of the difference relative to self's norm; plain if that is 0."""
        base = self.norm()
        return self.sub(other).norm() / (base or 1.0)

    def isapprox(self, other: Tensor, atol: float = 0.0, rtol: float = 0.0) -> bool:
        if self.has_nonfinite() or other.has_nonfinite():
            return False
        return self.sub(other).norm() <= max(atol, rtol * max(self.norm(), other.norm()))

    def has_nonfinite(self) -> bool:
        odd = F.lit(False)
        for v in self.values:
            odd = odd | F.isnan(v) | (F.abs(v) == float("inf"))
        return not self.df.where(odd).isEmpty()

    def to_list(self) -> list:
        """All values in column-major order, on the driver; for tensors of a bounded size."""
        if self.size > DRIVER_VALUES:
            raise ValueError(f"{self.size} values are too many for the driver")
        out = [0j if self.is_complex else 0.0] * self.size
        steps = [math.prod(i.dim for i in self.indices[:k]) for k in range(len(self.indices))]
        for row in self.df.collect():
            at = sum(row[c] * s for c, s in zip(self.columns, steps, strict=True))
            out[at] += complex(row.re, row.im) if self.is_complex else row.re
        return out

    def __add__(self, other: Tensor) -> Tensor:
        return self.add(other)

    def __sub__(self, other: Tensor) -> Tensor:
        return self.sub(other)

    def __neg__(self) -> Tensor:
        return self.neg()

    def __mul__(self, other) -> Tensor:
        return contract_pair(self, other) if isinstance(other, Tensor) else self.scale(other)

    __rmul__ = __mul__


# -- constructors --------------------------------------------------------------------------------


def positions(spark: SparkSession, indices: Sequence[Index]) -> DataFrame:
    """A row for each coordinate, with its flat position pos; made on the executors."""
    df, step = spark.range(math.prod(i.dim for i in indices)).withColumnRenamed("id", "pos"), 1
    for i in indices:
        df = df.withColumn(i.column, whole(F.col("pos"), step) % i.dim)
        step *= i.dim
    return df


def from_table(df: DataFrame, axes: Mapping[Index, Column], value: Column) -> Tensor:
    """Dimension encoding: the sum of value for each coordinate; axes gives an integer code for each index."""
    return Tensor(df.groupBy(*(c.cast("long").alias(i.column) for i, c in axes.items())).agg(F.sum(value).cast("double").alias("re")), tuple(axes))


def from_dense(spark: SparkSession, indices: Sequence[Index], values: Sequence[complex]) -> Tensor:
    if len(values) != math.prod(i.dim for i in indices):
        raise ValueError("the number of values doesn't fit the indices")
    rich = any(isinstance(v, complex) for v in values)
    rows = []
    for k, v in enumerate(values):
        if v != 0:
            at, rest = [], k
            for i in indices:
                rest, c = divmod(rest, i.dim)
                at.append(c)
            rows.append((*at, float(v.real), float(v.imag)))
    t = Tensor(spark.createDataFrame(rows, ", ".join([*(f"`{i.column}` long" for i in indices), "re double", "im double"])), tuple(indices), True)
    return t if rich else t.real_part()


def from_function(spark: SparkSession, indices: Sequence[Index], f) -> Tensor:
    """Values as a column expression of the coordinate columns."""
    return Tensor(positions(spark, indices).withColumn("re", f(*(F.col(i.column) for i in indices)).cast("double")).drop("pos"), tuple(indices))


def from_diag(spark: SparkSession, indices: Sequence[Index], values: Sequence[float]) -> Tensor:
    """Values on the diagonal of indices of equal dimension; sparse as it is."""
    if {i.dim for i in indices} != {len(values)}:
        raise ValueError("dimensions differ")
    first = from_dense(spark, [indices[0]], values)
    return Tensor(first.df.select(*(F.col(indices[0].column).alias(i.column) for i in indices), *first.values), tuple(indices), first.is_complex)


def copy_tensor(spark: SparkSession, indices: Sequence[Index]) -> Tensor:
    """1 where all coordinates are equal."""
    dim = min(i.dim for i in indices)
    return Tensor(spark.range(dim).select(*(F.col("id").alias(i.column) for i in indices), F.lit(1.0).alias("re")), tuple(indices))


def delta(spark: SparkSession, pairs: Sequence[tuple[Index, Index]]) -> Tensor:
    """The identity from the first to the second index of each pair."""
    ks = [new_index(a.dim) for a, _ in pairs]
    df = positions(spark, ks)
    cols = [F.col(k.column).alias(i.column) for k, pair in zip(ks, pairs, strict=True) for i in pair]
    return Tensor(df.select(*cols, F.lit(1.0).alias("re")), tuple(i for p in pairs for i in p))


def ones(spark: SparkSession, indices: Sequence[Index]) -> Tensor:
    return from_function(spark, indices, lambda *_: F.lit(1.0))


def zeros(spark: SparkSession, indices: Sequence[Index]) -> Tensor:
    return Tensor(positions(spark, indices).withColumn("re", F.lit(0.0)).drop("pos").where("false"), tuple(indices))


def onehot(spark: SparkSession, at: Mapping[Index, int]) -> Tensor:
    if any(not 0 <= k < i.dim for i, k in at.items()):
        raise ValueError("a coordinate is outside its index")
    return Tensor(spark.range(1).select(*(F.lit(k).cast("long").alias(i.column) for i, k in at.items()), F.lit(1.0).alias("re")), tuple(at))


def scalar(spark: SparkSession, value: complex) -> Tensor:
    df = spark.range(1).select(F.lit(float(value.real)).alias("re"), F.lit(float(value.imag)).alias("im"))
    return Tensor(df, (), True) if isinstance(value, complex) else Tensor(df.drop("im"), ())


def random(spark: SparkSession, indices: Sequence[Index], seed: int) -> Tensor:
    """Uniform values in [-1/2, 1/2) from a hash of the position: the same whatever the partitioning."""
    value = F.pmod(F.xxhash64(F.lit(seed), "pos"), F.lit(1 << 52)) / F.lit(float(1 << 52)) - 0.5
    return Tensor(positions(spark, indices).withColumn("re", value).drop("pos"), tuple(indices))


def stack(tensors: Sequence[Tensor], index: Index) -> Tensor:
    """Tensors of the same indices side by side along a new one."""
    if index.dim != len(tensors):
        raise ValueError("as many tensors as the new index has coordinates")
    rich = any(t.is_complex for t in tensors)
    parts = [t.to_complex() if rich else t for t in tensors]
    df = None
    for k, t in enumerate(parts):
        part = parts[0]._as(t).withColumn(index.column, F.lit(k).cast("long"))
        df = part if df is None else df.unionByName(part)
    return Tensor(df, (*parts[0].indices, index), rich)


def direct_sum(a: Tensor, b: Tensor, pairs: Sequence[tuple[Index, Index]]) -> tuple[Tensor, list[Index]]:
    """a and b in blocks along paired indices, whose dimensions add up; the other indices are shared."""
    fresh = [new_index(x.dim + y.dim, *x.tags) for x, y in pairs]
    mine = {x: f for (x, _), f in zip(pairs, fresh, strict=True)}
    theirs = {y: (f, x.dim) for (x, y), f in zip(pairs, fresh, strict=True)}
    if set(unique_inds(a.indices, list(mine))) != set(unique_inds(b.indices, list(theirs))):
        raise ValueError("the indices that are not paired differ")
    if a.is_complex != b.is_complex:
        a, b = a.to_complex(), b.to_complex()
    left = a.df.select(*(F.col(i.column).alias(mine.get(i, i).column) for i in a.indices), *a.values)
    right = b.df.select(*((F.col(i.column) + theirs[i][1]).alias(theirs[i][0].column) if i in theirs else F.col(i.column) for i in b.indices), *b.values)
    return Tensor(left.unionByName(right), tuple(mine.get(i, i) for i in a.indices), a.is_complex), fresh


# -- contraction ---------------------------------------------------------------------------------


def _product(a: Tensor, b: Tensor, left: str, right: str) -> list[Column]:
    l_re, r_re = F.col(f"{left}.re"), F.col(f"{right}.re")
    if not a.is_complex and not b.is_complex:
        return [(l_re * r_re).alias("re")]
    l_im = F.col(f"{left}.im") if a.is_complex else F.lit(0.0)
    r_im = F.col(f"{right}.im") if b.is_complex else F.lit(0.0)
    return [(l_re * r_re - l_im * r_im).alias("re"), (l_re * r_im + l_im * r_re).alias("im")]


def contract_pair(a: Tensor, b: Tensor, retain: Sequence[Index] = ()) -> Tensor:
    """Sum over the common indices, but for those retained: an equi-join and an aggregation.

    Catalyst chooses the join; the aggregation is partial before the shuffle.
    """
    shared = common_inds(a.indices, b.indices)
    gone = [i for i in shared if i not in retain]
    out = [i for i in a.indices if i not in gone] + unique_inds(b.indices, a.indices)
    left, right = a.df.alias("l"), b.df.alias("r")
    keys = [F.col(f"l.{i.column}") == F.col(f"r.{i.column}") for i in shared]
    joined = left.join(right, keys, "inner") if keys else left.crossJoin(right)
    side = lambda i: F.col(f"{'l' if i in a.indices else 'r'}.{i.column}").alias(i.column)
    product = Tensor(joined.select(*map(side, [*out, *gone]), *_product(a, b, "l", "r")), (*out, *gone), a.is_complex or b.is_complex)
    return product.sum_over(gone) if gone else product


def tensordot(a: Tensor, b: Tensor, pairs: Sequence[tuple[Index, Index]]) -> Tensor:
    """Sum over pairs of an index of a and one of b, whatever their identities."""
    return contract_pair(a, b.replace_indices(*((y, x) for x, y in pairs if x != y)))


def outer_product(a: Tensor, b: Tensor) -> Tensor:
    if common_inds(a.indices, b.indices):
        raise ValueError("factors of an outer product share an index")
    return contract_pair(a, b)


def connected_parts(tensors: Sequence[Tensor]) -> list[list[int]]:
    """Numbers of tensors that hang together by shared indices."""
    parts: list[tuple[set[Index], list[int]]] = []
    for k, t in enumerate(tensors):
        touching = [p for p in parts if p[0] & set(t.indices)]
        merged = (set(t.indices).union(*(p[0] for p in touching)), sorted([k, *(n for p in touching for n in p[1])]))
        parts = [p for p in parts if p not in touching] + [merged]
    return sorted(p[1] for p in parts)


def contract(tensors: Sequence[Tensor], retain: Sequence[Index] = ()) -> Tensor:
    """Sum over all indices that two or more tensors share, but for those retained.

    The pair with the smallest result is contracted first, and an index is summed as soon as no other tensor needs it.
    Tensors that do not hang together are refused.
    """
    if not tensors:
        raise ValueError("no tensors")
    if len(connected_parts(tensors)) > 1:
        raise ValueError("the tensors do not hang together")
    uses = {i: sum(i in t.indices for t in tensors) for t in tensors for i in t.indices}
    keep = {i for i, n in uses.items() if n == 1} | set(retain)
    todo = list(tensors)
    while len(todo) > 1:
        best = None
        for x in range(len(todo)):
            for y in range(x + 1, len(todo)):
                a, b = todo[x], todo[y]
                if not has_common(a, b):
                    continue
                others = {i for k, t in enumerate(todo) if k not in (x, y) for i in t.indices}
                out = [i for i in {*a.indices, *b.indices} if i in keep or i in others]
                cost = (math.prod(i.dim for i in out), x, y)
                best = min(best or cost, cost)
        _, x, y = best
        others = {i for k, t in enumerate(todo) if k not in (x, y) for i in t.indices}
        joined = contract_pair(todo[x], todo[y], retain=[i for i in todo[x].indices if i in keep or i in others])
        todo = [t for k, t in enumerate(todo) if k not in (x, y)] + [joined]
    rest = [i for i in todo[0].indices if i not in keep]
    return todo[0].sum_over(rest) if rest else todo[0]


def has_common(a: Tensor, b: Tensor) -> bool:
    return bool(common_inds(a.indices, b.indices))


def weighted_sum(t: Tensor, index: Index, weights: Tensor) -> Tensor:
    """Sum over an index with weights along it."""
    return contract_pair(t, weights.replace_indices((weights.indices[0], index)) if weights.indices[0] != index else weights)


def partial_contract(a: Tensor, b: Tensor, contracted: Sequence[tuple[Index, Index]], diagonal: Sequence[tuple[Index, Index]] = ()) -> Tensor:
    """Pairs in contracted are summed, pairs in diagonal are kept once along a's index."""
    b = b.replace_indices(*((y, x) for x, y in [*contracted, *diagonal] if x != y))
    return contract_pair(a, b, retain=[x for x, _ in diagonal])
