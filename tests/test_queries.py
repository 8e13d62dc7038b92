"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftnet import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Many small jobs each; test_engine.py, test_networks.py and test_adaptive.py hold what they use against NumPy.
SLOW = {"dmrg_ising", "elementwise_square_root", "quantics_cross_interpolation", "cross_interpolation", "gmres_diagonal", "cross_from_rows_and_columns", "integrate", "contract_zipup", "contract_fit", "growing_cross", "linear_operator_compose",
        "adaptive_interpolation", "tree_cross_interpolation", "adaptive_patches", "rook_interpolation", "walkers_find_a_spike", "elementwise_in_frames", "svd_of_a_large_matrix"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - SLOW))
def test_query(spark, tables, name):
    df = queries.queries()[name](spark, SF)
    expected = tables.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(expected.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(plain(r[expected.columns.index(c)]) for c in names) for r in expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
