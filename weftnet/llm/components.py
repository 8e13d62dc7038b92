"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

#: A key with more rows than both of these is hot: a number, and this fraction of all rows, so that few keys can be.
HOT_ROWS, HOT_KEYS = 256, 100_000
#: Tables with a row for each key that are broadcast whole, so that rows stay where they are.
WHOLE_KEYS = 100_000


def whole_if_few(df: DataFrame, n_rows: int) -> DataFrame:
    """df marked for a broadcast join if it has few rows; n_rows: at least as many as it has."""
    return F.broadcast(df) if n_rows <= WHOLE_KEYS else df


def with_totals(rows: DataFrame, key: str, n_rows: int, most: int | None = None, n_keys: int | None = None, **totals: Column) -> DataFrame:
    """rows with aggregates of their key's rows, without gathering a hot key's rows in one task.

    Aggregates are combined before the shuffle. Few keys get theirs by one broadcast join, in which rows stay where they
    are. Of many, hot ones, at most HOT_KEYS of them, do so; the others by an ordinary join. n_rows, n_keys, most: rows,
    keys and rows of a key at most, the latter two where they are known.
    """
    names = list(totals)
    found = rows.groupBy(key).agg(F.struct(*(c.alias(n) for n, c in totals.items())).alias("totals"), F.count("*").alias("key_rows"))
    if (n_rows if n_keys is None else n_keys) <= WHOLE_KEYS:
        return rows.join(F.broadcast(found.drop("key_rows")), key).select(*rows.columns, *(F.col(f"totals.{n}").alias(n) for n in names))
    bound = max(HOT_ROWS, n_rows // HOT_KEYS)
    if most is not None and most <= bound:
        return rows.join(found.drop("key_rows"), key).select(*rows.columns, *(F.col(f"totals.{n}").alias(n) for n in names))
    hot = F.col("key_rows") > bound
    tagged = rows.join(F.broadcast(found.where(hot).drop("key_rows")), key, "left")
    cold = tagged.where("totals is null").drop("totals").join(found.where(~hot).drop("key_rows"), key)
    return tagged.where("totals is not null").unionByName(cold).select(*rows.columns, *(F.col(f"totals.{n}").alias(n) for n in names))


def _large_star(edges: DataFrame, n: int, n_nodes: int, most: int) -> DataFrame:
    """Links each neighbour above a node to the smallest node around."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.select(F.explode(ends).alias("e")).select("e.*")
    around = with_totals(both, "a", 2 * n, most, n_nodes, m=F.min("b"))
    return around.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, n: int, n_nodes: int, most: int) -> DataFrame:
    """Links each node and its neighbours below to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    each = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
    return with_totals(down, "a", n, most, n_nodes, m=F.min("b")).select(F.explode(each).alias("e")).select("e.*").where("a > b").distinct()


def _shape(edges: DataFrame) -> tuple[bool, int, int, int]:
    """Is each node without a second parent and not both parent and child, so that components are read off? Links, nodes, and the most links at a node."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))
    counts = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    found = counts.agg(F.count_if((F.col("up") > 0) & (F.col("n") > 1)).alias("odd"), F.sum("up").alias("links"), F.count("*").alias("nodes"), F.max("n").alias("most")).first()
    return not found.odd, found.links or 0, found.nodes, found.most or 0


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b: long); root is the smallest node that can be reached.

    Self-links and repeated links do no harm, links with a null end are left out, no links give no rows. Both steps keep
    what hangs together and only ever move links to smaller nodes, until every component is a star.
    """
    whole = cut_lineage(edges.where("a is not null and b is not null").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    nodes = whole.where("a = b").select(F.col("a").alias("node"))
    now = whole.where("a <> b")
    while True:
        done, n, n_nodes, most = _shape(now)
        if done:
            break
        # a node's links to smaller ones are no more after the first step than all its links before
        now = cut_lineage(_small_star(_large_star(now, n, n_nodes, most), n, n_nodes, most))
    # a node that is linked has its root, which is smaller, besides itself
    found = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))
    reached = now.select(F.explode(found).alias("e")).select("e.*").unionByName(nodes.withColumn("root", F.col("node")))
    return reached.groupBy("node").agg(F.min("root").alias("root"))
