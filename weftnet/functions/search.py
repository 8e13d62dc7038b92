"""Searches over coordinates by many walkers side by side: pivots where a network is off, and first pivots.

A walker is a row. In a round all walkers move along one axis: each is written once for every coordinate there, all are
evaluated, and each walker keeps its best. Points are never on the driver, but for the few that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..index import Index
from ..plans.network import Network
from ..session import cut_lineage
from .evaluate import evaluate_points

Values = Column | tuple[Column, Column]


def _off(points: DataFrame, function: Callable[..., Values], net: Network | None, sites: Sequence[Index]) -> DataFrame:
    """points (point, and a column for each site) with off: how far net is from function there, or the function's size without net."""
    got = function(*(F.col(s.column) for s in sites))
    re, im = got if isinstance(got, tuple) else (got, F.lit(0.0))
    valued = points.withColumns({"f_re": F.coalesce(re.cast("double"), F.lit(0.0)), "f_im": F.coalesce(im.cast("double"), F.lit(0.0))})
    if net is None:
        return valued.withColumn("off", F.sqrt(F.col("f_re") ** 2 + F.col("f_im") ** 2)).drop("f_re", "f_im")
    told = evaluate_points(net, points)
    told = told.select(F.col("point").alias("told_point"), F.col("re").alias("t_re"), F.col("im").alias("t_im") if "im" in told.columns else F.lit(0.0).alias("t_im"))
    both = valued.join(told, F.col("point") == F.col("told_point"))
    return both.withColumn("off", F.sqrt((F.col("f_re") - F.col("t_re")) ** 2 + (F.col("f_im") - F.col("t_im")) ** 2)).drop("f_re", "f_im", "t_re", "t_im", "told_point")


def walk(spark: SparkSession, function: Callable[..., Values], sites: Sequence[Index], net: Network | None = None, walkers: int = 64, sweeps: int = 2, seed: int = 0, start: Sequence[Sequence[int]] = ()) -> DataFrame:
    """walker, a column for each site, off: where each walker has come to, from seeded places (and start) along every axis in turn.

    With net, walkers climb the difference of function and net, else the function's size; ties go to the smallest coordinate.
    """
    names = [s.column for s in sites]
    draw = lambda k, d: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(d)).cast("long")
    now = spark.range(walkers).select(F.col("id").alias("walker"), *(draw(k, s.dim).alias(s.column) for k, s in enumerate(sites)))
    if start:
        more = spark.createDataFrame([(walkers + k, *map(int, p)) for k, p in enumerate(start)], ", ".join(["walker long", *(f"`{n}` long" for n in names)]))
        now = now.unionByName(more)
    for _ in range(sweeps):
        for s in sites:
            each = now.withColumn(s.column, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s.dim - 1).cast("long"))))
            each = each.withColumn("point", F.col("walker") * s.dim + F.col(s.column)).select("point", "walker", *names)
            best = F.max_by(F.struct(*names, "off"), F.struct("off", -F.col(s.column))).alias("best")
            now = _off(each, function, net, sites).groupBy("walker").agg(best).select("walker", *(F.col(f"best.{n}").alias(n) for n in names), F.col("best.off").alias("off"))
            now = cut_lineage(now).drop("off") if s is not sites[-1] or _ < sweeps - 1 else cut_lineage(now)
    return now


def worst_points(net: Network, function: Callable[..., Values], sites: Sequence[Index], most: int = 5, least: float = 0.0, **how) -> list[tuple[int, ...]]:
    """The places, at most `most` of them, where walkers found net farthest off, each beyond least."""
    spark = net.tensors[net.root].spark
    names = [s.column for s in sites]
    found = walk(spark, function, sites, net, **how).groupBy(*names).agg(F.max("off").alias("off")).where(F.col("off") > least)
    return [tuple(r[n] for n in names) for r in found.orderBy(F.desc("off"), *names).limit(most).collect()]


def first_pivot(spark: SparkSession, function: Callable[..., Values], sites: Sequence[Index], **how) -> tuple[int, ...]:
    """Where walkers found the function largest."""
    names = [s.column for s in sites]
    r = walk(spark, function, sites, None, **how).orderBy(F.desc("off"), *names).first()
    return tuple(r[n] for n in names)
