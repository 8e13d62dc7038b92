"""Tensors from the star-schema tables: labels and dates become integer codes by fixed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .index import Index
from .tensor import Tensor, from_table

FIRST_YEAR, N_MONTHS = 1995, 84
FLAGS, STATUSES = ("A", "N", "R"), ("F", "O")
DAYS = 4096

FLAG, STATUS, MONTH = Index("flag", 3), Index("status", 2), Index("month", N_MONTHS)
DAY = Index("day", DAYS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_code(column: str, labels: tuple[str, ...]) -> Column:
    """The place of a label in a fixed list; null for others, which then join nothing."""
    out = F.lit(None).cast("long")
    for k, label in reversed(list(enumerate(labels))):
        out = F.when(F.col(column) == label, F.lit(k).cast("long")).otherwise(out)
    return out


def month_code(column: str) -> Column:
    return (F.year(column) - FIRST_YEAR) * 12 + F.month(column) - 1


def day_code(column: str) -> Column:
    return F.datediff(F.to_date(column), F.lit(f"{FIRST_YEAR}-01-01").cast("date"))


def quantity(spark: SparkSession, sf_dir: str) -> Tensor:
    """Quantity by return flag, line status and month of shipping."""
    rows = table(spark, sf_dir, "lineitem")
    axes = {FLAG: label_code("l_returnflag", FLAGS), STATUS: label_code("l_linestatus", STATUSES), MONTH: month_code("l_shipdate")}
    return from_table(rows, axes, F.col("l_quantity"))


def lines(spark: SparkSession, sf_dir: str) -> Tensor:
    """Number of lines by return flag and month."""
    rows = table(spark, sf_dir, "lineitem")
    return from_table(rows, {FLAG: label_code("l_returnflag", FLAGS), MONTH: month_code("l_shipdate")}, F.lit(1.0))


def daily(spark: SparkSession, sf_dir: str) -> Tensor:
    """Quantity by day of shipping, on a grid of 2^12 days."""
    return from_table(table(spark, sf_dir, "lineitem"), {DAY: day_code("l_shipdate")}, F.col("l_quantity"))
