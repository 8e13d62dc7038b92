"""Numbers for the distinct beginnings of coordinate lists, and trains whose bonds are those numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..index import Index, new_link
from ..session import cut_lineage
from ..tensor import Tensor, whole
from .network import Network, train


def coordinate_code(columns: Sequence[Column], dims: Sequence[int]) -> Column:
    """A list of coordinates as one number that sorts like the list, the first most significant."""
    if math.prod(dims) >= 1 << 62:
        raise ValueError("coordinates need more than 62 bits")
    out = F.lit(0).cast("long")
    for c, d in zip(columns, dims, strict=True):
        out = out * F.lit(d) + c.cast("long")
    return out


def numbered_prefixes(rows: DataFrame, dims: Sequence[int], code: str = "code", depth: str | None = None) -> tuple[DataFrame, list[int]]:
    """rows with `numbers`, whose entry k numbers the row's first k coordinates among all rows' in the order of code, and how many.

    code is a coordinate_code. With depth, only the first depth coordinates of a row count, and rows stand for disjoint regions;
    entry k then numbers the beginnings that reach further than k. Rows are dealt by ranges of code; each task counts where a
    beginning changes, and the driver adds up one line of counts for each task.
    """
    n = len(dims)
    steps = [math.prod(dims[k:]) for k in range(n)]
    dealt = rows.repartitionByRange(code).sortWithinPartitions(code).withColumn("weft_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    last = {r.weft_part: r.last for r in dealt.groupBy("weft_part").agg(F.max(code).alias("last")).collect()}
    parts, before = sorted(last), {}
    for a, b in zip(parts, parts[1:], strict=False):
        before[b] = last[a]
    spark = rows.sparkSession
    ends = spark.createDataFrame([(p, before.get(p)) for p in parts], "weft_part int, weft_before long")
    within = Window.partitionBy("weft_part").orderBy(code)
    seen = dealt.join(F.broadcast(ends), "weft_part").withColumn("weft_before", F.coalesce(F.lag(code).over(within), "weft_before"))

    def new(k: int) -> Column:
        change = F.col("weft_before").isNull() | (whole(F.col(code), steps[k]) != whole(F.col("weft_before"), steps[k]) if k else F.lit(False))
        return (change & (F.col(depth) > k) if depth else change).cast("long")

    flagged = cut_lineage(seen.withColumn("weft_new", F.array(*(new(k) for k in range(n)))).drop("weft_before"))
    counts = {r.weft_part: r.counts for r in flagged.groupBy("weft_part").agg(F.array(*(F.sum(F.get("weft_new", F.lit(k))) for k in range(n))).alias("counts")).collect()}
    total, offsets = [0] * n, []
    for p in parts:
        offsets.append((p, list(total)))
        total = [a + b for a, b in zip(total, counts[p], strict=True)]
    base = spark.createDataFrame(offsets, "weft_part int, weft_base array<long>")
    upto = Window.partitionBy("weft_part").orderBy(code).rowsBetween(Window.unboundedPreceding, 0)
    numbers = F.array(*(F.sum(F.get("weft_new", F.lit(k))).over(upto) + F.get("weft_base", F.lit(k)) - 1 for k in range(n)))
    return cut_lineage(flagged.join(F.broadcast(base), "weft_part").withColumn("numbers", numbers).drop("weft_part", "weft_new", "weft_base")), total


def exact_train(t: Tensor, sites: Sequence[Index]) -> Network:
    """A tensor as a train without any factorization: a bond numbers the stored coordinates to its left.

    No core has more rows than the tensor.
    """
    if len(sites) == 1:
        return train([t])
    dims = [s.dim for s in sites]
    rows = t.df.withColumn("weft_code", coordinate_code([F.col(s.column) for s in sites], dims))
    numbered, total = numbered_prefixes(rows, dims, "weft_code")
    links = [new_link(max(1, total[k])) for k in range(1, len(sites))]
    cores = []
    for k, s in enumerate(sites):
        around = [*links[max(0, k - 1) : k], s, *links[k : k + 1]]
        left = [F.get("numbers", F.lit(k)).alias(links[k - 1].column)] if k else []
        if k == len(sites) - 1:
            cores.append(Tensor(numbered.select(*left, s.column, *t.values), tuple(around), t.is_complex))
        else:
            right = F.get("numbers", F.lit(k + 1)).alias(links[k].column)
            cores.append(Tensor(numbered.select(*left, s.column, right).distinct().withColumn("re", F.lit(1.0)), tuple(around)))
    return train(cores)
