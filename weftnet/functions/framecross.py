"""Elementwise functions of trains by cross interpolation in frames.

At a bond, a train's values at the pivots of one side, before they are contracted with the other side, are a frame: a small
square of pivots by bond. The values that a bond's update needs are products of two frames and two cores, so no point is ever
contracted along a whole train, and a sweep moves the frames along by one core at a time. Frames and cores, which are bounded
by ranks, are with the driver; the values of a bond, which are their products, are made, mapped and pivoted by Spark in rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..index import Index, new_link
from ..plans.network import Network, train
from ..session import cut_lineage
from ..tensor import Tensor, whole
from .cross import chosen_pivots, times_inverse
from .evaluate import NETWORK_VALUES, dense, evaluate_points


def _cores(net: Network, sites: Sequence[Index]) -> list[np.ndarray]:
    """A real chain's cores along sites: [left bond, site, right bond]."""
    nodes = [net.find_node(s) for s in sites]
    tensors = [net.tensors[n] for n in nodes]
    if any(t.is_complex for t in tensors):
        raise ValueError("trains of real values are asked for")
    if sum(math.prod(i.dim for i in t.indices) for t in tensors) > NETWORK_VALUES:
        raise ValueError("a train's cores are too large to be sent to tasks")
    edges = {frozenset(e): i for e, i in net.edges().items()}
    bonds = [edges[frozenset(p)] for p in zip(nodes, nodes[1:], strict=False)]
    out = []
    for k, (t, s) in enumerate(zip(tensors, sites, strict=True)):
        a = dense(t, [*bonds[max(0, k - 1) : k], s, *bonds[k : k + 1]])
        out.append(a.reshape(1 if not k else bonds[k - 1].dim, s.dim, -1))
    return out


@dataclass
class FrameCross:
    """function of the values of real trains at points, from frames: left[k][t] is pivots by bond of train t before site k,
    right[k][t] bond by pivots from site k on."""

    spark: SparkSession
    function: Callable[..., Column]
    cores: list[list[np.ndarray]]
    left: list[list[np.ndarray]] = field(default_factory=list)
    right: list[list[np.ndarray]] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def begin(self, start: Sequence[int]) -> None:
        """Frames of one pivot each."""
        n = len(self.cores[0])
        one = [np.ones((1, 1)) for _ in self.cores]
        self.left, self.right = [one] + [[] for _ in range(n)], [[] for _ in range(n)] + [one]
        for k in range(n - 1, -1, -1):
            self.right[k] = [c[k][:, start[k], :] @ r for c, r in zip(self.cores, self.right[k + 1], strict=True)]
        for k in range(n):
            self.left[k + 1] = [x @ c[k][:, start[k], :] for c, x in zip(self.cores, self.left[k], strict=True)]

    def ranks(self) -> list[int]:
        return [len(self.left[k][0]) for k in range(1, len(self.cores[0]))]

    def before(self, k: int) -> list[np.ndarray]:
        """Rows (pivot, coordinate of site k) by bond."""
        return [np.tensordot(x, c[k], 1).reshape(-1, c[k].shape[2]) for x, c in zip(self.left[k], self.cores, strict=True)]

    def behind(self, k: int) -> list[np.ndarray]:
        """Bond by columns (coordinate of site k, pivot)."""
        return [np.tensordot(c[k], y, 1).reshape(c[k].shape[0], -1) for y, c in zip(self.right[k + 1], self.cores, strict=True)]

    def values(self, rows: Sequence[np.ndarray], cols: Sequence[np.ndarray]) -> DataFrame:
        """i, j, re: function of the products of rows and columns, made row by row in tasks."""
        names = [f"v{t}" for t in range(len(rows))]
        table = pa.table({"i": pa.array(np.arange(len(rows[0])), pa.int64()), **{n: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for n, x in zip(names, rows, strict=True)}})
        wide = cols[0].shape[1]

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i, j = np.divmod(np.arange(batch.num_rows * wide), wide)
                own = [np.asarray(batch.column(n).flatten()).reshape(batch.num_rows, -1) @ y for n, y in zip(names, cols, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("i"))[i]), pa.array(j, pa.int64()), *(pa.array(x.ravel()) for x in own)], names=["i", "j", *names])

        made = self.spark.createDataFrame(table).mapInArrow(products, "i long, j long, " + ", ".join(f"{n} double" for n in names))
        return made.select("i", "j", self.function(*map(F.col, names)).cast("double").alias("re"))

    def sweep(self, rtol: float, max_rank: int, forward: bool) -> float:
        """Pivots of every bond anew, from the frames on either side of its two sites, a job each; the largest relative residual."""
        n, worst = len(self.cores[0]), 0.0
        for k in range(1, n) if forward else range(n - 1, 0, -1):
            rows, cols = self.before(k - 1), self.behind(k)
            i, j, errors = chosen_pivots(self.values(rows, cols), len(rows[0]), cols[0].shape[1], rtol, max_rank)
            self.left[k], self.right[k] = [x[i or [0]] for x in rows], [y[:, j or [0]] for y in cols]
            worst = max(worst, errors[-1] / (errors[0] or 1.0))
        self.errors.append(worst)
        return worst

    def to_train(self, sites: Sequence[Index]) -> Network:
        """Values at pivots, a site between, times the inverse of the pivots' square."""
        n, cores = len(sites), []
        links = [new_link(r) for r in self.ranks()]
        for k, s in enumerate(sites):
            df = self.values(self.before(k), self.right[k + 1])
            if k < n - 1:
                square = np.zeros((links[k].dim, links[k].dim))
                for r in self.values(self.left[k + 1], self.right[k + 1]).collect():  # max_rank squared at most
                    square[r.i, r.j] = r.re
                df = times_inverse(df, square)
            at = ([(links[k - 1], whole(F.col("i"), s.dim))] if k else []) + [(s, F.pmod(F.col("i"), F.lit(s.dim)))] + ([(links[k], F.col("j"))] if k < n - 1 else [])
            cores.append(Tensor(cut_lineage(df.select(*(c.alias(i.column) for i, c in at), "re")), tuple(i for i, _ in at)))
        return train(cores)


def first_place(function: Callable[..., Column], trains: Sequence[Network], sites: Sequence[Index], n: int = 256, seed: int = 0) -> tuple[int, ...]:
    """Of n seeded points the one where function is largest."""
    spark = trains[0].tensors[trains[0].root].spark
    points = spark.range(n).select(F.col("id").alias("point"), *(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(s.dim)).cast("long").alias(s.column) for k, s in enumerate(sites)))
    found = points
    for k, net in enumerate(trains):
        found = found.join(evaluate_points(net, points).select("point", F.col("re").alias(f"v{k}")), "point")
    r = found.withColumn("size", F.abs(function(*(F.col(f"v{k}") for k in range(len(trains)))))).orderBy(F.desc("size"), "point").first()
    return tuple(r[s.column] for s in sites)


def elementwise_in_frames(function: Callable[..., Column], trains: Sequence[Network], sites: Sequence[Index], rtol: float = 1e-10, max_rank: int = 100, sweeps: int = 8, start: Sequence[int] | None = None) -> tuple[Network, FrameCross]:
    """A train for function(value of train 1, value of train 2, ...) at each point; trains are chains over sites in this order."""
    cross = FrameCross(trains[0].tensors[trains[0].root].spark, function, [_cores(net, sites) for net in trains])
    cross.begin(start or first_place(function, trains, sites))
    last = None
    for k in range(sweeps if len(sites) > 1 else 0):
        error = cross.sweep(rtol, max_rank, k % 2 == 0)
        ranks = cross.ranks()
        if error <= rtol and ranks == last:
            break
        last = ranks
    return cross.to_train(sites), cross
