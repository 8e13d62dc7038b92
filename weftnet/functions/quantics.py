"""Transforms of functions on grids of 2^R points, as column expressions on a coordinate.

A function of x in 0..2^R-1 is a tensor with one index of dimension 2^R; bits(...) and number(...) change between that and
R indices of dimension 2, most significant bit first. What moves points is arithmetic on the coordinate; what sums over
points is an aggregation; none builds a matrix.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, Window, functions as F

from ..index import Index, new_index
from ..tensor import Tensor, contract_pair, whole

PERIODIC, ANTIPERIODIC, OPEN = "periodic", "antiperiodic", "open"


def n_bits(index: Index) -> int:
    r = index.dim.bit_length() - 1
    if 1 << r != index.dim:
        raise ValueError(f"{index.column}: {index.dim} is not a power of two")
    return r


def bits(t: Tensor, index: Index) -> tuple[Tensor, list[Index]]:
    """One index of dimension 2^R as R binary ones, most significant first."""
    group = [new_index(2, "Bit", f"b{k}") for k in range(n_bits(index))]
    return t.unfuse_index(index, group[::-1]).permute([x for i in t.indices for x in (group if i == index else [i])]), group


def number(t: Tensor, group: Sequence[Index], index: Index | None = None) -> tuple[Tensor, Index]:
    """Binary indices, most significant first, as one."""
    return t.fuse_indices(list(group)[::-1], index)


def _moved(t: Tensor, new: Mapping[Index, Column], factor: Column | None = None, keep: Column | None = None) -> Tensor:
    df = t.df if keep is None else t.df.where(keep)
    values = [(F.col(v) * factor).alias(v) if factor is not None else F.col(v) for v in t.values]
    return t._like(df.select(*(new[i].alias(i.column) if i in new else F.col(i.column) for i in t.indices), *values))


def shift(t: Tensor, offsets: Mapping[Index, int], boundary: str | Mapping[Index, str] = PERIODIC) -> Tensor:
    """g(x) = f(x + offset) on each index; beyond the ends periodic, with changed sign, or nothing."""
    new, factor, keep = {}, F.lit(1.0), F.lit(True)
    for i, offset in offsets.items():
        how, n = boundary if isinstance(boundary, str) else boundary[i], i.dim
        to = F.col(i.column) - F.lit(offset)
        turns = whole(to, n)
        if how == OPEN:
            keep = keep & (to >= 0) & (to < n)
        elif how == ANTIPERIODIC:
            factor = factor * F.when(F.pmod(turns, F.lit(2)) == 0, 1.0).otherwise(-1.0)
        elif how != PERIODIC:
            raise ValueError(f"unknown boundary {how}")
        new[i] = F.pmod(to, F.lit(n)).cast("long")
    return _moved(t, new, factor, keep)


def flip(t: Tensor, indices: Sequence[Index], boundary: str = PERIODIC) -> Tensor:
    """g(x) = f(2^R - x); at x = 0 periodic, with changed sign, or nothing."""
    new, factor, keep = {}, F.lit(1.0), F.lit(True)
    for i in indices:
        x = F.col(i.column)
        new[i] = F.pmod(-x, F.lit(i.dim)).cast("long")
        if boundary == OPEN:
            keep = keep & (x != 0)
        elif boundary == ANTIPERIODIC:
            factor = factor * F.when(x == 0, -1.0).otherwise(1.0)
    return _moved(t, new, factor, keep)


def phase_rotation(t: Tensor, angles: Mapping[Index, float]) -> Tensor:
    """g(x) = exp(i angle x) f(x)."""
    angle = F.lit(0.0)
    for i, a in angles.items():
        angle = angle + F.col(i.column) * F.lit(float(a))
    c = t.to_complex()
    re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    return c._like(c.df.select(*c.columns, re.alias("re"), im.alias("im")))


def triangle(t: Tensor, index: Index, lower: bool = True) -> Tensor:
    """g(x) = sum of f(y) for y < x (lower) or y > x, without x itself.

    Two levels: sums of blocks of about sqrt(2^R) points and their running totals, then running sums within blocks, so
    that no task holds more than a block or a row for each block (of each combination of the other indices).
    """
    block = 1 << (n_bits(index) // 2)
    others = [i.column for i in t.indices if i != index]
    dense = t.densified()
    df = dense.df.withColumn("weft_block", whole(F.col(index.column), block))
    order = lambda c: F.asc(c) if lower else F.desc(c)
    before = lambda parts, c: Window.partitionBy(*parts).orderBy(order(c)).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*others, "weft_block").agg(*(F.sum(v).alias(f"weft_{v}") for v in t.values))
    sums = sums.select(*others, "weft_block", *(F.coalesce(F.sum(f"weft_{v}").over(before(others, "weft_block")), F.lit(0.0)).alias(f"weft_{v}") for v in t.values))
    inside = before([*others, "weft_block"], index.column)
    joined = df.select(*t.columns, "weft_block", *(F.coalesce(F.sum(v).over(inside), F.lit(0.0)).alias(v) for v in t.values)).join(sums, [*others, "weft_block"])
    return t._like(joined.select(*t.columns, *((F.col(v) + F.col(f"weft_{v}")).alias(v) for v in t.values)))


def cumsum(t: Tensor, index: Index) -> Tensor:
    """The strict prefix sum."""
    return triangle(t, index, lower=True)


def fourier(t: Tensor, index: Index, sign: int = -1, normalize: bool = True) -> Tensor:
    """g(k) = sum over x of exp(sign 2 pi i k x / 2^R) f(x), over sqrt(2^R) if normalized; k in natural order.

    Radix two: one step for each bit, which doubles rows and sums them again, so that the work is R 2^R.
    """
    r, n = n_bits(index), index.dim
    c, col = t.to_complex(), index.column
    others = [i.column for i in t.indices if i != index]
    # after step j the coordinate holds the low bits of x above and the j bits of k found so far
    df = c.df.select(*others, F.col(col).alias("weft_x"), F.lit(0).cast("long").alias("weft_k"), "re", "im")
    for j in range(r):
        half = 1 << (r - 1 - j)
        top, rest = whole(F.col("weft_x"), half), F.col("weft_x") % half
        df = df.withColumn("weft_b", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("weft_top", top).withColumn("weft_rest", rest)
        # k gains bit j with value b: x = top * half + rest, phase of top with the bits known so far
        k = F.col("weft_k") + F.col("weft_b") * (1 << j)
        angle = F.lit(sign * 2 * math.pi / n) * ((k * F.col("weft_top") * half) % n)
        re = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)
        im = F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
        df = df.select(*others, F.col("weft_rest").alias("weft_x"), k.alias("weft_k"), re.alias("re"), im.alias("im"))
        df = df.groupBy(*others, "weft_x", "weft_k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    scale = 1 / math.sqrt(n) if normalize else 1.0
    return c._like(df.withColumnRenamed("weft_k", col).select(*c.columns, (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im")))


def affine(t: Tensor, inputs: Sequence[Index], matrix: Sequence[Sequence], offset: Sequence, outputs: Sequence[Index], boundary: str = PERIODIC) -> Tensor:
    """g(y) = sum of f(x) over all x with y = A x + b, entries rational.

    With open ends, y is d y = A' x + b' divided by the common denominator d, where that is whole and on the grid. Around a
    ring of N points d y need only be equal up to multiples of N (odd multiples change the sign if it is antiperiodic), so
    that an x has gcd(d, N) solutions or none.
    """
    df, turns = t.df, F.lit(1.0)
    for k, (row, b, y) in enumerate(zip(matrix, offset, outputs, strict=True)):
        fractions = [Fraction(a) for a in row] + [Fraction(b)]
        d, n = math.lcm(*(f.denominator for f in fractions)), y.dim
        scaled = [int(f * d) for f in fractions]
        sum_ = F.lit(scaled[-1]).cast("long")
        for a, x in zip(scaled, inputs, strict=False):
            sum_ = sum_ + F.lit(a) * F.col(x.column)
        to = f"weft_y{k}"
        if boundary == OPEN:
            df = df.where(F.pmod(sum_, F.lit(d)) == 0).withColumn(to, whole(sum_, d)).where((F.col(to) >= 0) & (F.col(to) < n))
            continue
        if boundary not in (PERIODIC, ANTIPERIODIC):
            raise ValueError(f"unknown boundary {boundary}")
        g = math.gcd(d, n)
        m = n // g
        first = F.pmod(whole(sum_, g), F.lit(m))
        if d // g != 1:
            inverse = pow(d // g, -1, m) if m > 1 else 0
            wide = "long" if m <= 1 << 31 else "decimal(19,0)"  # the product needs up to 38 digits
            first = F.pmod(first.cast(wide) * F.lit(inverse).cast(wide), F.lit(m).cast(wide)).cast("long")
        df = df.where(F.pmod(sum_, F.lit(g)) == 0)
        df = df.withColumn(to, first) if g == 1 else df.withColumn(to, F.explode(F.array(*(first + j * m for j in range(g)))))
        if boundary == ANTIPERIODIC:
            turns = turns * F.when(F.pmod(whole(sum_ - F.col(to) * d, n), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    rest = [i for i in t.indices if i not in inputs]
    df = df.select(*(F.col(f"weft_y{k}").cast("long").alias(y.column) for k, y in enumerate(outputs)), *(i.column for i in rest), *((F.col(v) * turns).alias(v) for v in t.values))
    return Tensor(df, (*outputs, *rest), t.is_complex).sum_over([])


def pullback(t: Tensor, index: Index, output: Index, expression) -> Tensor:
    """g(y) = f(expression(y)) for a column expression that may be null where there is no point."""
    grid = t.spark.range(output.dim).select(F.col("id").alias(output.column), expression(F.col("id")).cast("long").alias(index.column))
    rest = [i for i in t.indices if i != index]
    return Tensor(t.df.join(grid, index.column).select(output.column, *(i.column for i in rest), *t.values), (output, *rest), t.is_complex)


def difference_kernel(kernel: Tensor, t: Tensor, index: Index, boundary: str = PERIODIC) -> Tensor:
    """g(x) = sum over y of kernel(x - y) f(y), kernel on the same grid from 0 up.

    Through the transform: a product of two spectra, R steps each way. Without wrapping, both are padded to twice the grid.
    """
    (d,) = kernel.indices
    wide = Index(index.id, index.dim * (2 if boundary == OPEN else 1), index.tags, index.plev)
    along = lambda x, i: Tensor(x.df.withColumnRenamed(i.column, wide.column), tuple(wide if j == i else j for j in x.indices), x.is_complex)
    spectrum = contract_pair(fourier(along(t, index), wide), fourier(along(kernel, d), wide, normalize=False), retain=[wide])
    out = fourier(spectrum, wide, sign=1)
    out = out if t.is_complex or kernel.is_complex else out.real_part()
    return Tensor(out.df.where(F.col(wide.column) < index.dim), tuple(index if i == wide else i for i in out.indices), out.is_complex)
