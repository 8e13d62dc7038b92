"""Queries on small tables whose keys and sums are as large as those of large tables."""

import datetime

import __spark_entry__
import duckdb
import pytest


def both(spark, tmp_path, name, table, rows, schema):
    """Rows of a query and of its SQL; None for the SQL where DuckDB refuses it."""
    df = __spark_entry__.queries()[name]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = df(spark, str(tmp_path))
    try:
        want = con.sql(__spark_entry__.oracle_sql()[name])
        want = sorted(tuple(r[want.columns.index(c)] for c in got.columns) for r in want.fetchall())
    except duckdb.OutOfRangeException:
        want = None
    return sorted(tuple(r) for r in got.collect()), want


def test_quantics_bits_large(spark, tmp_path):
    """Order keys from 2^23 on shift out of 64 bits; keys that differ by 2^20 or 2^24 meet on a point and stay two rows."""
    point = lambda o, c: (((o << 40) + (c << 8) + 1 - 987654321987654321) % (1 << 60), 1)
    orders = [(3, 7), (3 + (1 << 20), 7), (898_261, 1), (8_388_607, 899_999)]
    got, want = both(spark, tmp_path, "quantics_bits_large", "orders", orders, "o_orderkey long, o_custkey long")
    assert got == want == sorted(point(*x) for x in orders)
    orders += [(8_388_608, 0), (8_999_999, 899_999), (3 + (1 << 24), 7), ((1 << 40) - 1, 5), (4, 1 << 55), (8_388_607, (1 << 55) - 1)]
    got, _ = both(spark, tmp_path, "quantics_bits_large", "orders", orders, "o_orderkey long, o_custkey long")
    assert got == sorted(point(*x) for x in orders) and len(got) == 10


@pytest.mark.parametrize("half", [0, 0.5])
def test_outer_product(spark, tmp_path, half):
    """Products of sums that doubles don't hold; sums with halves go to even before they are multiplied."""
    at = datetime.datetime(1996, 3, 1)
    lines = [(q, f, s, at) for q, f, s in [(306_000_001.0, "A", "F"), (153_000_002.0, "N", "O"), (153_000_000.0 + half, "N", "F"), (305_999_993.0, "R", "O")]]
    got, want = both(spark, tmp_path, "outer_product", "lineitem", lines, "l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    flags, statuses = [306_000_001, 306_000_002, 305_999_993], [459_000_002 if half else 459_000_001, 458_999_995]
    assert got == want == [(f, s, x * y) for f, x in enumerate(flags) for s, y in enumerate(statuses)]
    assert any(int(float(x) * float(y)) != x * y for x in flags for y in statuses)
