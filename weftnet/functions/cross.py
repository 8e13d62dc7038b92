"""Functions given as code: cached evaluation, cross interpolation of tensors on chains, Chebyshev interpolation.

A function takes coordinate columns and gives a column, so that points are evaluated on the executors. Pivots are lists of
bounded length on the driver. A bond's matrix of pivot rows and columns is built, evaluated and pivoted by Spark: blocks of
rows choose their own pivot rows, winners meet in ever fewer blocks, and only the last winners' places come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..index import Index, new_link
from ..plans.network import Network, train
from ..session import cut_lineage
from ..tensor import Tensor, from_dense, whole

Function = Callable[..., Column]


@dataclass
class CachedFunction:
    """Remembers evaluated points in a table; only points not seen before reach the function."""

    spark: SparkSession
    function: Function
    dims: Sequence[int]
    seen: DataFrame | None = None
    evaluations: int = 0
    #: Instead of function: a table of points to the same table with re.
    batch: Callable[[DataFrame], DataFrame] | None = None

    @property
    def columns(self) -> list[str]:
        return [f"x{k}" for k in range(len(self.dims))]

    def key(self) -> Column:
        """The flat position of a point: first coordinate fastest; an array of coordinates where that needs over 62 bits."""
        if math.prod(self.dims) >= 1 << 62:
            return F.array(*self.columns)
        code, step = F.lit(0).cast("long"), 1
        for c, d in zip(self.columns, self.dims, strict=True):
            code, step = code + F.col(c) * F.lit(step), step * d
        return code

    def eval_no_cache(self, points: DataFrame) -> DataFrame:
        if self.batch is not None:
            return self.batch(points)
        return points.withColumn("re", self.function(*map(F.col, self.columns)).cast("double"))

    def eval(self, points: DataFrame) -> DataFrame:
        """points with their values; new points are evaluated once, however often they occur."""
        wanted = points.select(*self.columns).distinct()
        new = wanted if self.seen is None else wanted.join(self.seen, self.columns, "left_anti")
        got = cut_lineage(self.eval_no_cache(new))
        self.evaluations += got.count()
        self.seen = got if self.seen is None else cut_lineage(self.seen.unionByName(got))
        return points.join(self.seen, self.columns)

    def is_cached(self, points: DataFrame) -> DataFrame:
        if self.seen is None:
            return points.withColumn("cached", F.lit(False))
        return points.join(self.seen.select(*self.columns, F.lit(True).alias("hit")), self.columns, "left").withColumn("cached", F.coalesce("hit", F.lit(False))).drop("hit")

    def clear(self) -> None:
        self.seen = None


def pivot_rows(a: np.ndarray, rtol: float, max_rank: int) -> tuple[list[int], list[int], list[float]]:
    """Rows and columns of full-pivot elimination, first in column-major order on ties, and the residual before each."""
    rest = a.copy()
    rows, cols, errors = [], [], []
    first = None
    while True:
        at = int(np.argmax(np.abs(rest).ravel(order="F")))
        i, j = at % rest.shape[0], at // rest.shape[0]
        size = float(abs(rest[i, j]))
        first = size if first is None else first
        errors.append(size)
        if len(rows) == min(*a.shape, max_rank) or size <= rtol * first or size == 0:
            return rows, cols, errors
        rows.append(i), cols.append(j)
        rest = rest - np.outer(rest[:, j], rest[i] / rest[i, j])


#: Values of a block of rows that one task pivots.
BLOCK_VALUES = 1 << 20


def chosen_pivots(values: DataFrame, n_rows: int, n_cols: int, rtol: float, max_rank: int, block_values: int | None = None) -> tuple[list[int], list[int], list[float]]:
    """Rows, columns and residuals of full-pivot elimination of values (i, j, re), by a tournament of blocks of rows.

    With one block this is elimination itself. A block hands on its pivot rows only, at most max_rank of them.
    """
    rank = min(max_rank, n_rows, n_cols)
    block = max(2 * rank, (block_values or BLOCK_VALUES) // n_cols, 1)
    n_blocks = -(-n_rows // block)

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows, at = np.unique(np.asarray(table.column("i")), return_inverse=True)
        a = np.zeros((len(rows), n_cols))
        a[at, np.asarray(table.column("j"))] = np.asarray(table.column("re"))
        return rows, a

    def winners(table: pa.Table) -> pa.Table:
        rows, a = matrix(table)
        i, _, _ = pivot_rows(a, 0.0, rank)
        i = np.array(sorted(i or [0]))
        k, j = np.divmod(np.arange(len(i) * n_cols), n_cols)
        return pa.table({"i": pa.array(rows[i][k], pa.int64()), "j": pa.array(j, pa.int64()), "re": pa.array(a[i].ravel())})

    def last(table: pa.Table) -> pa.Table:
        rows, a = matrix(table)
        i, j, errors = pivot_rows(a, rtol, rank)
        pad = len(errors) - len(i)
        return pa.table({"i": pa.array([*rows[i].tolist(), *[None] * pad], pa.int64()), "j": pa.array([*j, *[None] * pad], pa.int64()), "error": pa.array(errors)})

    while n_blocks > 1:
        values = cut_lineage(values.withColumn("block", F.pmod("i", F.lit(n_blocks))).groupBy("block").applyInArrow(winners, "i long, j long, re double"))
        n_blocks = -(-n_blocks * rank // block) if n_blocks * rank < n_rows else 1
        n_rows = n_blocks * rank
    found = values.groupBy(F.lit(0).alias("all")).applyInArrow(last, "i long, j long, error double").collect()  # a row for each pivot
    return [r.i for r in found if r.i is not None], [r.j for r in found if r.j is not None], [r.error for r in found]


def times_inverse(values: DataFrame, square: np.ndarray, block_values: int | None = None) -> DataFrame:
    """values (i, j, re), a row i at a time, times the inverse of a small square: solved in blocks of rows, not multiplied.

    With pivots chosen by size the solutions are of the size of 1, while the inverse itself may be huge.
    """
    n = square.shape[0]
    block = max(1, (block_values or BLOCK_VALUES) // n)

    def solve(table: pa.Table) -> pa.Table:
        rows, at = np.unique(np.asarray(table.column("i")), return_inverse=True)
        a = np.zeros((len(rows), n))
        a[at, np.asarray(table.column("j"))] = np.asarray(table.column("re"))
        try:
            x = np.linalg.solve(square.T, a.T).T
        except np.linalg.LinAlgError:
            x = np.linalg.lstsq(square.T, a.T, rcond=None)[0].T
        k, j = np.divmod(np.arange(x.size), n)
        return pa.table({"i": pa.array(rows[k], pa.int64()), "j": pa.array(j, pa.int64()), "re": pa.array(x.ravel())})

    # a block is a run of rows, whose numbers are dense
    return values.groupBy(F.floor(F.col("i") / block).alias("block")).applyInArrow(solve, "i long, j long, re double")


@dataclass
class CrossInterpolation:
    """Pivot lists of a tensor train: left[k] are values of the first k coordinates, right[k] of those after k."""

    f: CachedFunction
    left: list[list[tuple[int, ...]]]
    right: list[list[tuple[int, ...]]]
    errors: list[float] = field(default_factory=list)

    def values(self, left: int, right: int, split: bool) -> DataFrame:
        """i, j, re at all pivots of the first coordinates, the next one or two, and the pivots of those after them.

        i numbers (pivot, coordinate), j (coordinate, pivot) if split, else the pivot. Coordinates are counted on the executors.
        """
        dims, names = self.f.dims, self.f.columns
        cols = [list(map(int, c)) for c in self.right[right]]
        spark = self.f.spark
        table = spark.createDataFrame([(k, list(map(int, r)), cols) for k, r in enumerate(self.left[left])], "k long, l array<long>, cols array<array<long>>")
        between = dims[left:right]
        table = table.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(between[0] - 1).cast("long")))) if between else table.withColumn("s", F.lit(0).cast("long"))
        i = F.col("k") * (between[0] if between else 1) + F.col("s")
        table = table.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(between[1] - 1).cast("long"))) if split else F.lit(0).cast("long"))
        table = table.select(i.alias("i"), "l", "s", "t", F.posexplode("cols").alias("c", "r"))
        j = F.col("t") * len(cols) + F.col("c")
        at = [*(F.get("l", n) for n in range(left)), *([F.col("s")] if between else []), *([F.col("t")] if split else []), *(F.get("r", n) for n in range(len(dims) - right))]
        points = table.select("i", j.cast("long").alias("j"), *(x.alias(n) for x, n in zip(at, names, strict=True)))
        return self.f.eval(points).select("i", "j", "re")

    def lines(self, k: int, rows: list | None = None, cols: list | None = None) -> DataFrame:
        """i, j, re of bond k's matrix on the listed rows and all columns, or all rows and the listed columns.

        What is listed is numbered by its place in the list; the other side is counted on the executors as in values.
        """
        dims, names, spark = self.f.dims, self.f.columns, self.f.spark
        outer, inner, d = (self.left[k - 1], cols, dims[k - 1]) if rows is None else (self.right[k + 1], rows, dims[k])
        kept = [list(map(int, x)) for x in inner]
        table = spark.createDataFrame([(n, list(map(int, p))) for n, p in enumerate(outer)], "n long, own array<long>")
        table = table.withColumn("kept", F.array(*(F.array(*(F.lit(c) for c in x)).cast("array<long>") for x in kept)))
        table = table.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(d - 1).cast("long")))).select("n", "own", "s", F.posexplode("kept").alias("m", "other"))
        if rows is None:
            place, at = F.col("n") * d + F.col("s"), [*(F.get("own", F.lit(x)) for x in range(k - 1)), F.col("s"), *(F.get("other", F.lit(x)) for x in range(len(dims) - k))]
            i, j = place, F.col("m").cast("long")
        else:
            place, at = F.col("s") * len(outer) + F.col("n"), [*(F.get("other", F.lit(x)) for x in range(k)), F.col("s"), *(F.get("own", F.lit(x)) for x in range(len(dims) - k - 1))]
            i, j = F.col("m").cast("long"), place
        return self.f.eval(table.select(i.alias("i"), j.alias("j"), *(x.alias(n) for x, n in zip(at, names, strict=True)))).select("i", "j", "re")

    def rook(self, k: int, rtol: float, max_rank: int, seed: int = 0, rounds: int = 8) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]], float]:
        """Pivot rows and columns of bond k from few of its lines: rows are chosen on some columns, columns on those rows, in turns.

        Columns are the pivots there are and as many seeded ones; turns end when more columns are offered than pivots come of
        them. Each turn evaluates at most 3 max_rank + 2 lines. The last item is the residual on the columns offered last,
        relative to their largest value.
        """
        dims = self.f.dims
        count_rows, count_cols = len(self.left[k - 1]) * dims[k - 1], dims[k] * len(self.right[k + 1])
        row = lambda i: (*self.left[k - 1][i // dims[k - 1]], i % dims[k - 1])
        col = lambda j: (j // len(self.right[k + 1]), *self.right[k + 1][j % len(self.right[k + 1])])
        rng = np.random.default_rng([seed, k, len(self.right[k])])
        some = lambda n: [col(int(j)) for j in rng.integers(count_cols, size=min(count_cols, n))]
        cols, most = list(self.right[k]), min(max_rank, count_rows, count_cols)
        for _ in range(rounds):
            offered = list(dict.fromkeys([*cols, *some(len(cols) + 2)]))
            i, _, errors = chosen_pivots(self.lines(k, cols=offered), count_rows, len(offered), rtol, max_rank)
            rows, error = [row(x) for x in i] or [row(0)], errors[-1] / (errors[0] or 1.0)
            flipped = self.lines(k, rows=rows).select(F.col("j").alias("i"), F.col("i").alias("j"), "re")
            j, i, _ = chosen_pivots(flipped, count_cols, len(rows), rtol, max_rank)
            rows, cols = [rows[x] for x in i] or rows[:1], [col(x) for x in j] or [col(0)]
            if len(rows) < len(offered) or len(rows) == most:
                break
        return rows, cols, error

    def one_site(self, rtol: float, forward: bool) -> None:
        """Pivots of each bond chosen anew among those of the bond before and one coordinate: nested sets, and no larger ranks."""
        n, dims = len(self.f.dims), self.f.dims
        for k in range(1, n) if forward else range(n - 1, 0, -1):
            if forward:
                rows = [(*r, s) for r in self.left[k - 1] for s in range(dims[k - 1])]
                i, j, _ = chosen_pivots(self.values(k - 1, k, False), len(rows), len(self.right[k]), rtol, len(self.right[k]))
                self.left[k], self.right[k] = [rows[x] for x in i] or rows[:1], [self.right[k][x] for x in j] or self.right[k][:1]
            else:
                cols = [(s, *c) for s in range(dims[k]) for c in self.right[k + 1]]
                flipped = self.lines(k, rows=self.left[k]).select(F.col("j").alias("i"), F.col("i").alias("j"), "re")
                j, i, _ = chosen_pivots(flipped, len(cols), len(self.left[k]), rtol, len(self.left[k]))
                self.left[k], self.right[k] = [self.left[k][x] for x in i] or self.left[k][:1], [cols[x] for x in j] or cols[:1]

    def sweep(self, rtol: float, max_rank: int, forward: bool, search: str = "full") -> float:
        """Two-site updates of all bonds; the largest relative residual. search: whole matrices, or few lines of each (rook)."""
        if search == "rook":
            worst = 0.0
            for k in range(1, len(self.f.dims)) if forward else range(len(self.f.dims) - 1, 0, -1):
                self.left[k], self.right[k], error = self.rook(k, rtol, max_rank, len(self.errors))
                worst = max(worst, error)
            self.errors.append(worst)
            return worst
        if search != "full":
            raise ValueError(f"unknown search {search}")
        n, worst = len(self.f.dims), 0.0
        dims = self.f.dims
        for k in range(1, n) if forward else range(n - 1, 0, -1):
            rows = [(*r, s) for r in self.left[k - 1] for s in range(dims[k - 1])]
            cols = [(s, *c) for s in range(dims[k]) for c in self.right[k + 1]]
            i, j, errors = chosen_pivots(self.values(k - 1, k + 1, True), len(rows), len(cols), rtol, max_rank)
            self.left[k], self.right[k] = [rows[x] for x in i] or rows[:1], [cols[x] for x in j] or cols[:1]
            worst = max(worst, errors[-1] / (errors[0] or 1.0))
        self.errors.append(worst)
        return worst

    def add_global_pivots(self, points: Sequence[tuple[int, ...]]) -> None:
        for p in points:
            for k in range(1, len(self.f.dims)):
                if p[:k] not in self.left[k] and p[k:] not in self.right[k]:
                    self.left[k].append(tuple(p[:k])), self.right[k].append(tuple(p[k:]))

    def to_train(self, sites: Sequence[Index]) -> Network:
        """Cores T_k P_k^-1: values at pivots stay tables; the square P_k of a bond, pivots by pivots, goes to every task."""
        n, spark = len(self.f.dims), self.f.spark
        links = [new_link(len(self.left[k])) for k in range(1, n)]
        cores = []
        for k in range(n):
            around = [*links[max(0, k - 1) : k], sites[k], *links[k : k + 1]]
            d, df = self.f.dims[k], self.values(k, k + 1, False)
            if k < n - 1:
                square = np.zeros((len(self.left[k + 1]), len(self.right[k + 1])))
                for r in self.values(k + 1, k + 1, False).collect():  # max_rank squared at most
                    square[r.i, r.j] = r.re
                df = times_inverse(df, square)
            at = ([(links[k - 1], whole(F.col("i"), d))] if k else []) + [(sites[k], F.pmod(F.col("i"), F.lit(d)))] + ([(links[k], F.col("j"))] if k < n - 1 else [])
            cores.append(Tensor(cut_lineage(df.select(*(c.alias(x.column) for x, c in at), "re")), tuple(x for x, _ in at)).permute(around))
        return train(cores)


def cross_interpolate(spark: SparkSession, function: Function | None, sites: Sequence[Index], rtol: float = 1e-10, max_rank: int = 200, sweeps: int = 8, start: Sequence[int] | None = None, batch: Callable[[DataFrame], DataFrame] | None = None, search: str = "full") -> tuple[Network, CrossInterpolation]:
    """A train for function(x0, x1, ...) by two-site cross interpolation, from a first pivot, until the residual is small.

    search is full, or rook: then a bond's matrix is seen on few of its lines only. Functions here are real; of complex ones
    see treecross.tree_cross_interpolate, which takes chains as well.
    """
    dims = [i.dim for i in sites]
    first = tuple(start or [0] * len(dims))
    f = CachedFunction(spark, function, dims, batch=batch)
    ci = CrossInterpolation(f, [[first[:k]] for k in range(len(dims) + 1)], [[first[k:]] for k in range(len(dims) + 1)])
    last = None
    for k in range(sweeps):
        error = ci.sweep(rtol, max_rank, k % 2 == 0, search)
        ranks = [len(x) for x in ci.left]
        if error <= rtol and ranks == last:
            break
        last = ranks
    return ci.to_train(sites), ci


def elementwise(function: Callable[..., Column], trains: Sequence[Network], sites: Sequence[Index], **how) -> tuple[Network, CrossInterpolation]:
    """A train for function(value of train 1, value of train 2, ...) at each point, by cross interpolation of the values."""
    if any(t.is_complex for net in trains for t in net.tensors.values()):
        raise ValueError("trains of real values are asked for; take real_part and imag_part apart")
    spark = trains[0].tensors[trains[0].root].spark
    names = [f"x{k}" for k in range(len(sites))]

    def batch(points: DataFrame) -> DataFrame:
        numbered = cut_lineage(points.select(*names).withColumn("point", F.monotonically_increasing_id()))
        named = numbered.select("point", *(F.col(n).alias(s.column) for n, s in zip(names, sites, strict=True)))
        out = numbered
        for k, t in enumerate(trains):
            out = out.join(t.evaluate(named).select("point", F.col("re").alias(f"v{k}")), "point")
        return out.select(*names, function(*(F.col(f"v{k}") for k in range(len(trains)))).cast("double").alias("re"))

    return cross_interpolate(spark, None, sites, batch=batch, **how)


def estimate_error(net: Network, ci: CrossInterpolation, sites: Sequence[Index], n_points: int = 200, seed: int = 1) -> float:
    """The largest difference of function and train at seeded random points."""
    names = ci.f.columns
    draw = lambda k, d: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(d)).cast("long")
    points = ci.f.spark.range(n_points).select(F.col("id").alias("point"), *(draw(k, s.dim).alias(n) for k, (n, s) in enumerate(zip(names, sites, strict=True))))
    exact = ci.f.eval_no_cache(points.select(*names).distinct())
    told = net.evaluate(points.select("point", *(F.col(n).alias(s.column) for n, s in zip(names, sites, strict=True))))
    both = points.join(exact, names).join(told.withColumnRenamed("re", "told"), "point")
    return both.agg(F.max(F.abs(F.col("re") - F.col("told")))).first()[0] or 0.0


def global_pivots(net: Network, ci: CrossInterpolation, sites: Sequence[Index], rtol: float, n_points: int = 500, most: int = 5, seed: int = 2) -> list[tuple[int, ...]]:
    """Seeded random points where the train is farthest off, at most `most` beyond the tolerance."""
    names = ci.f.columns
    draw = lambda k, d: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(d)).cast("long")
    points = ci.f.spark.range(n_points).select(F.col("id").alias("point"), *(draw(k, s.dim).alias(n) for k, (n, s) in enumerate(zip(names, sites, strict=True))))
    exact = ci.f.eval_no_cache(points.select(*names).distinct())
    told = net.evaluate(points.select("point", *(F.col(n).alias(s.column) for n, s in zip(names, sites, strict=True))))
    off = points.join(exact, names).join(told.withColumnRenamed("re", "told"), "point").withColumn("off", F.abs(F.col("re") - F.col("told")))
    scale = off.agg(F.max(F.abs("re"))).first()[0] or 1.0
    return [tuple(r[n] for n in names) for r in off.where(F.col("off") > rtol * scale).orderBy(F.desc("off"), *names).limit(most).collect()]


@dataclass(frozen=True)
class QuanticsTrain:
    """A train over bits for a function on a grid of 2^R points in [a, b), most significant bit first."""

    net: Network
    sites: list[Index]
    bounds: tuple[float, float]
    cross: CrossInterpolation

    def evaluate(self, xs: DataFrame) -> DataFrame:
        """point, re for rows of (point, x), x a grid number."""
        r = len(self.sites)
        return self.net.evaluate(xs.select("point", *(F.shiftright("x", r - 1 - k).bitwiseAND(F.lit(1)).cast("long").alias(s.column) for k, s in enumerate(self.sites))))

    def sum(self) -> float:
        return float(self.net.sum())

    def integral(self) -> float:
        return self.sum() * (self.bounds[1] - self.bounds[0]) / (1 << len(self.sites))


def quantics_cross_interpolate(spark: SparkSession, function: Callable[[Column], Column], n_bits: int, bounds: tuple[float, float] = (0.0, 1.0), **how) -> QuanticsTrain:
    """A quantics train of function(x) on 2^n_bits grid points."""
    from ..plans.network import fresh_sites

    sites = fresh_sites([2] * n_bits)
    a, b = bounds

    def at(*bits: Column) -> Column:
        x = F.lit(0).cast("long")
        for k, bit in enumerate(bits):
            x = x + bit * F.lit(1 << (n_bits - 1 - k))
        return function(F.lit(a) + x * ((b - a) / (1 << n_bits)))

    net, ci = cross_interpolate(spark, at, sites, **how)
    return QuanticsTrain(net, sites, bounds, ci)


def integrate(spark: SparkSession, function: Callable[..., Column], n_dims: int, order: int = 8, bounds: tuple[float, float] = (0.0, 1.0), **how) -> float:
    """Integral over a box by Gauss-Legendre nodes on each axis and a train of the values."""
    x, w = np.polynomial.legendre.leggauss(order)
    a, b = bounds
    nodes, weights = ((b - a) * x + (a + b)) / 2, (b - a) * w / 2
    at = F.array(*(F.lit(float(v)) for v in nodes))
    from ..plans.network import fresh_sites

    sites = fresh_sites([order] * n_dims)
    out, _ = cross_interpolate(spark, lambda *xs: function(*(F.get(at, x.cast("int")) for x in xs)), sites, **how)
    for s in sites:
        node = out.find_node(s)
        t = out.tensors[node]
        weighted = t * from_dense(spark, [s], weights.tolist())
        out = Network(out.tensors | {node: weighted})
    return float(out.to_tensor().only())


def chebyshev_nodes(n: int) -> list[float]:
    """n + 1 nodes of the second kind in [0, 1], ascending."""
    return [(1 - math.cos(math.pi * k / n)) / 2 for k in range(n + 1)] if n else [0.5]


def lagrange(nodes: Sequence[float], k: int, x: Column) -> Column:
    """The k-th Lagrange polynomial of the nodes, as a product of factors."""
    out = F.lit(1.0)
    for j, node in enumerate(nodes):
        if j != k:
            out = out * ((x - node) / (nodes[k] - node))
    return out


def interpolate_grid(spark: SparkSession, function: Callable[[float], float], index: Index, order: int, a: float = 0.0, b: float = 1.0):
    """function on the 2^R points of [a, b) by one Chebyshev polynomial; only order + 1 values of function are taken."""
    from ..tensor import from_function

    nodes = chebyshev_nodes(order)
    values = [float(function(a + (b - a) * t)) for t in nodes]

    def at(x: Column) -> Column:
        out = F.lit(0.0)
        for k, v in enumerate(values):
            out = out + F.lit(v) * lagrange(nodes, k, x / index.dim)
        return out

    return from_function(spark, [index], at)
