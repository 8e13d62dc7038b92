"""Interpolation trains that refine where a function is not smooth, in one dimension and more.

The box is cut into halves (quarters, ...) as long as a polynomial doesn't follow the function; open boxes of a level are rows
of one table, and a level is one job: the function is evaluated at the nodes of each box and of its children, as columns, and
boxes are judged a batch at a time. The leaves become one train: as long as a point's box is not settled, the bond holds the
box; from then on it holds the polynomial at its nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..index import Index, new_link
from ..plans.network import Network, train
from ..plans.prefixes import numbered_prefixes
from ..session import cut_lineage
from ..tensor import Tensor
from .cross import chebyshev_nodes

#: A coordinate for each dimension.
Box = Sequence[float]


def basis(nodes: Sequence[float], at: Sequence[float]) -> np.ndarray:
    """[point, k]: the k-th Lagrange polynomial of nodes at each point."""
    x, t = np.asarray(at)[:, None], np.asarray(nodes)
    out = np.ones((len(x), len(t)))
    for k, node in enumerate(t):
        for j, other in enumerate(t):
            if j != k:
                out[:, k] *= (x[:, 0] - other) / (node - other)
    return out


def local_basis(order: int, at: Sequence[float], window: int) -> np.ndarray:
    """[point, k]: weights of Chebyshev nodes by interpolation in the angle, from window nodes on either side of a point.

    In the angle nodes are evenly spaced and a function is even at both ends, so a window that reaches over an end takes the
    nodes that lie there in a mirror. At most 2 window weights of a point are not zero.
    """
    if window < 1 or 2 * window > order + 1:
        raise ValueError("a window takes from 1 to (order + 1) / 2 nodes on either side")
    out = np.zeros((len(at), order + 1))
    for row, x in enumerate(at):
        place = math.acos(max(-1.0, min(1.0, 1 - 2 * x))) * order / math.pi
        own = [int(math.floor(place)) + k for k in range(1 - window, window + 1)]
        for k in own:
            weight = math.prod((place - j) / (k - j) for j in own if j != k)
            out[row, order - abs(order - abs(k))] += weight
    return out


def _grid(axis: Sequence[float], n: int) -> list[list[float]]:
    """Coordinates of the product of an axis with itself, a list for each dimension, the first fastest."""
    return [[axis[(p // len(axis) ** d) % len(axis)] for p in range(len(axis) ** n)] for d in range(n)]


def _power(a: np.ndarray, n: int) -> np.ndarray:
    """The n-fold product of a map with itself, first dimension fastest."""
    out = a
    for _ in range(n - 1):
        out = np.kron(a, out)
    return out


def _halves(nodes: Sequence[float]) -> list[float]:
    return [(b + t) / 2 for b in (0, 1) for t in nodes]


def leaves(spark: SparkSession, function: Callable[..., Column], n_levels: int, lower: Box, upper: Box, degree: int, tolerance: float, cusps: Sequence[Box] = ()) -> DataFrame:
    """level, k0, k1, ..., values, error: the boxes on which the polynomial with these values at its nodes follows function.

    Box k of a level is the k-th of 2^level in each dimension. A box is settled if the polynomial is within tolerance at the
    nodes of its children and no cusp lies in it; at the last level a box is one point. The function may be undefined
    (null, NaN) at points: their boxes are refined, and a point of the last level without a value counts as 0.
    """
    n, nodes = len(lower), chebyshev_nodes(degree)
    m, finer = len(nodes) ** n, _halves(nodes)
    places = [a + b for a, b in zip(_grid(nodes, n), _grid(finer, n), strict=True)]
    follow = _power(basis(nodes, finer), n)
    ks = [f"k{d}" for d in range(n)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("values").flatten()).reshape(-1, m + len(follow))
            error = np.abs(values[:, m:] - values[:, :m] @ follow.T).max(1)
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * m, pa.int32()), pa.array(values[:, :m].ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("level", *ks)), own, pa.array(error)], names=["level", *ks, "values", "error"])

    schema = ", ".join(["level long", *(f"{k} long" for k in ks), "values array<double>", "error double"])
    at = lambda u: [F.lit(lo) + (hi - lo) * (F.col(k) + x) / F.pow(F.lit(2.0), "level") for lo, hi, k, x in zip(lower, upper, ks, u, strict=True)]
    now = spark.range(1).select(F.lit(0).cast("long").alias("level"), *(F.lit(0).cast("long").alias(k) for k in ks))
    done = None
    for level in range(n_levels + 1):
        if level == n_levels:
            value = F.coalesce(F.nanvl(function(*at([F.lit(0.0)] * n)).cast("double"), F.lit(0.0)), F.lit(0.0))
            settled = cut_lineage(now.select("level", *ks, F.array(value).alias("values"), F.lit(0.0).alias("error")))
            return settled if done is None else done.unionByName(settled)
        points = now.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(len(places[0]) - 1))))
        u = [F.get(F.lit(x), F.col("p")) for x in places]
        valued = points.select("level", *ks, "p", F.coalesce(function(*at(u)).cast("double"), F.lit(math.nan)).alias("v"))
        rows = valued.groupBy("level", *ks).agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("l")).select("level", *ks, F.col("l.v").alias("values"))
        judged = cut_lineage(rows.mapInArrow(judge, schema))
        size = F.pow(F.lit(2.0), "level")
        inside = F.lit(False)
        for cusp in cusps:
            hit = F.lit(True)
            for lo, hi, k, c in zip(lower, upper, ks, cusp, strict=True):
                place = F.lit((c - lo) / (hi - lo)) * size
                hit = hit & (place >= F.col(k)) & (place <= F.col(k) + 1)
            inside = inside | hit
        good = (F.col("error") <= tolerance) & ~F.isnan("error") & ~inside
        settled = judged.where(good)
        done = settled if done is None else done.unionByName(settled)
        children = F.explode(F.array(*(F.struct(*((F.col(k) * 2 + b).alias(k) for k, b in zip(ks, bits, strict=True))) for bits in product((0, 1), repeat=n))))
        now = judged.where(~good).select((F.col("level") + 1).alias("level"), children.alias("c")).select("level", "c.*")
        if level + 1 < n_levels and now.isEmpty():
            return done
    raise AssertionError("levels end above")


def _table(spark: SparkSession, values: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Entries of a small array that are not zero, a coordinate column for each axis."""
    at = np.nonzero(values)
    return spark.createDataFrame(pa.table({**{c: pa.array(x, pa.int64()) for c, x in zip(names, at, strict=True)}, "re": pa.array(values[at])}))


def leaf_train(found: DataFrame, sites: Sequence[Index], n: int, degree: int, window: int | None = None) -> Network:
    """The train of leaves over sites of dimension 2^n, most significant first; a site's digit holds the first dimension's bit lowest.

    A bond's first (degree + 1)^n states are the polynomial's nodes, the others number the boxes that are not settled yet.
    """
    spark, r, nodes = found.sparkSession, len(sites), chebyshev_nodes(degree)
    m = len(nodes) ** n
    weights = (lambda at: basis(nodes, at)) if window is None else (lambda at: local_basis(degree, at, window))
    half = weights(_halves(nodes)).reshape(2, len(nodes), len(nodes))  # bit, node of the half, node
    end = weights([0.0, 0.5])  # bit, node
    step, stop = np.zeros((m, 2**n, m)), np.zeros((m, 2**n))
    for digit in range(2**n):
        bits = [digit >> d & 1 for d in range(n)]
        down, last = half[bits[0]], end[bits[0]]
        for b in bits[1:]:
            down, last = np.kron(half[b], down), np.kron(end[b], last)
        step[:, digit, :], stop[:, digit] = down.T, last
    number = lambda j: sum((F.shiftright(F.expr(f"shiftleft(k{d}, cast({r} - level AS int))"), r - 1 - j).bitwiseAND(F.lit(1)) * (1 << d) for d in range(n)), F.lit(0))
    code = F.lit(0).cast("long")
    for j in range(r):
        code = code * (1 << n) + number(j)
    rows, total = numbered_prefixes(found.withColumn("weft_code", code), [1 << n] * r, "weft_code", "level")
    digit = lambda k: F.pmod(F.call_function("div", F.col("weft_code"), F.lit(1 << n * (r - 1 - k))), F.lit(1 << n))
    links = [new_link(m + total[k]) for k in range(1, r)]
    settled_at_once = total[0] == 0
    cores = []
    for k, s in enumerate(sites):
        left, right = (links[k - 1].column if k else None), (links[k].column if k < r - 1 else None)
        around = [*links[max(0, k - 1) : k], s, *links[k : k + 1]]
        inner = [(F.get("numbers", F.lit(k)) + m).alias(left)] if left else []
        if settled_at_once and not k:
            values = np.array(rows.first().values)
            core = np.tensordot(values, step if right else stop, 1)
            df = _table(spark, core, [i.column for i in around])
        elif right is None:
            df = rows.where(F.col("level") == r).select(*inner, digit(k).alias(s.column), F.get("values", F.lit(0)).alias("re"))
            df = df.unionByName(_table(spark, stop, [left, s.column])) if left else df
        else:
            into = rows.where(F.col("level") > k + 1).select(*inner, digit(k).alias(s.column), (F.get("numbers", F.lit(k + 1)) + m).alias(right)).distinct().withColumn("re", F.lit(1.0))
            settled = rows.where(F.col("level") == k + 1).select(*inner, digit(k).alias(s.column), F.posexplode("values").alias(right, "re"))
            df = into.unionByName(settled.withColumn(right, F.col(right).cast("long")))
            df = df.unionByName(_table(spark, step, [left, s.column, right])) if left else df
        cores.append(Tensor(df, tuple(around)))
    return train(cores)


def adaptive_train(spark: SparkSession, function: Callable[..., Column], sites: Sequence[Index], degree: int, tolerance: float, lower: Box = (0.0,), upper: Box = (1.0,), cusps: Sequence[Box] = ()) -> Network:
    """function on the 2^R points a side of a box as a train, by polynomials of a degree on boxes as large as tolerance lets them be.

    function takes a column for each dimension; sites have dimension 2^n. A box with a cusp is refined to the last level.
    """
    n = len(lower)
    if len(upper) != n or any(s.dim != 1 << n for s in sites) or tolerance < 0 or any(b <= a for a, b in zip(lower, upper, strict=True)):
        raise ValueError("boxes, sites or tolerance don't fit")
    found = leaves(spark, function, len(sites), lower, upper, degree, tolerance, cusps)
    return leaf_train(found, sites, n, degree)


def multiscale_train(spark: SparkSession, function: Callable[..., Column], sites: Sequence[Index], degree: int, cusps: Sequence[Box], lower: Box = (0.0,), upper: Box = (1.0,)) -> Network:
    """The same with boxes that are refined around known cusps only, whatever the error."""
    return adaptive_train(spark, function, sites, degree, math.inf, lower, upper, cusps)


def single_scale_train(spark: SparkSession, function: Callable[..., Column], sites: Sequence[Index], degree: int, lower: Box = (0.0,), upper: Box = (1.0,), window: int | None = None) -> Network:
    """function by one polynomial on the whole box: only its values at (degree + 1)^n nodes are taken.

    With window, cores hold local weights only, so that they are sparse however large degree is.
    """
    n, nodes = len(lower), chebyshev_nodes(degree)
    at = _grid(nodes, n)
    points = spark.range(len(at[0])).select(F.col("id").alias("p"), *((F.lit(lo) + (hi - lo) * F.get(F.lit(u), F.col("id").cast("int"))).alias(f"u{d}") for d, (lo, hi, u) in enumerate(zip(lower, upper, at, strict=True))))
    valued = points.select("p", function(*(F.col(f"u{d}") for d in range(n))).cast("double").alias("v"))
    values = valued.agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("l")).select(F.col("l.v").alias("values"))  # as many as nodes
    whole = values.select(F.lit(0).cast("long").alias("level"), *(F.lit(0).cast("long").alias(f"k{d}") for d in range(n)), "values", F.lit(0.0).alias("error"))
    return leaf_train(whole, sites, n, degree, window)
