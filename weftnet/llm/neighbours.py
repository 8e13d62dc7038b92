"""Approximate nearest neighbours by balanced posting lists.

Equal vectors form a class and are compared once. Centroids are fitted with a penalty on size. Each class lies in the list
of its nearest centroid, and in those of others that are almost as near. The centroids' own neighbour graph is searched in
memory; a query reads the lists whose centroids are not farther than a ratio of the nearest one's distance.

The graph's centroids are bounded, lists are not: a list that is too long gets centroids of its own, fitted on a bounded
sample of it, and its entries move to the lists of these, under the same ratios; so the number of lists grows with the
data, and a list's length doesn't. What can't be split is dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage, stored

#: A fit sees so many vectors and bytes of them at most; the first centroids and their graph are sent to every task and
#: stay below the byte bound.
SAMPLE_ROWS, SAMPLE_BYTES = 40_000, 64 << 20
MOST_CENTROIDS, INDEX_BYTES = 4096, 64 << 20
LIST_ROWS = 256
DEGREE = 24
COPIES, COPY_RATIO = 6, 1.15
QUERY_RATIO = 1.22
BEAM = 64
#: Entries of a list that one task holds; a longer list is split into FAN to MOST_FAN lists of about LIST_ENTRIES entries.
PART_ROWS, LIST_ENTRIES, FAN, MOST_FAN = 4096, 1536, 16, 256
#: Vectors of a list that the fit of its own centroids sees for each of them.
FIT_ROWS = 16
#: A list is split so often at most; what is then still long is only slower.
LEVELS = 6
#: The table of long lists (some 40 bytes each) is broadcast up to this number of rows, and joined by shuffle beyond.
BROADCAST_LISTS = 200_000


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 12, weight: float = 0.05, seed: int = 3) -> np.ndarray:
    """Unit centroids by k-means; a cluster's size beyond the mean makes it less attractive."""
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), k, replace=False))].copy()
    load = np.zeros(k)
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centres.T - weight * load).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sizes = np.bincount(nearest, minlength=k)
        sums = np.stack([np.bincount(nearest, weights=column, minlength=k) for column in sample.T], axis=1)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-12
        centres = np.where(empty[:, None], centres, sums / np.maximum(norms, 1e-12)[:, None])
        if empty.any():
            centres[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        load = sizes * (k / len(sample)) - 1
    return centres


def neighbour_graph(centres: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each centroid its nearest ones, and a few seeded far ones so that the graph hangs together; own number as filler."""
    k = len(centres)
    near = min(degree - 4, k - 1)
    graph = np.repeat(np.arange(k, dtype=np.int32)[:, None], degree, axis=1)
    for i in range(0, k, 1024):
        likeness = centres[i : i + 1024] @ centres.T
        likeness[np.arange(len(likeness)), np.arange(i, i + len(likeness))] = -np.inf
        if near > 0:
            graph[i : i + 1024, :near] = np.argsort(-likeness, axis=1, kind="stable")[:, :near]
    graph[:, degree - 4 : -1] = np.random.default_rng(5).integers(0, k, (k, 3))
    graph[:, -1] = (np.arange(k) + 1) % k
    return graph


def search_graph(queries: np.ndarray, centres: np.ndarray, graph: np.ndarray, beam: int, ratio: float, most: int | None = None, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each unit query the centroids within ratio of the nearest distance, nearest first, with their distances.

    Best-first search with a beam for all queries at once; the beam is doubled for those whose last entry is still within
    the ratio, so that it bounds no result; but most entries are enough if given (at most the beam). The least nearest are
    given whatever their distance.
    """
    out: list = [None] * len(queries)
    todo, k = np.arange(len(queries)), len(centres)
    while len(todo):
        beam = min(max(beam, least), k)
        q = queries[todo]
        rows = np.arange(len(todo))
        starts = np.unique(np.linspace(0, k - 1, min(8, k)).astype(int))
        seen = np.zeros((len(todo), k), bool)
        seen[:, starts] = True
        ids = np.full((len(todo), beam), -1, np.int64)
        likeness = np.full((len(todo), beam), -np.inf)
        opened = np.ones((len(todo), beam), bool)
        n = min(beam, len(starts))
        first = q @ centres[starts].T
        pick = np.argsort(-first, axis=1)[:, :n]
        ids[:, :n], likeness[:, :n], opened[:, :n] = starts[pick], np.take_along_axis(first, pick, 1), False
        while True:
            open_likeness = np.where(opened, -np.inf, likeness)
            best = open_likeness.argmax(axis=1)
            live = open_likeness[rows, best] > -np.inf
            if not live.any():
                break
            at = rows[live]
            opened[at, best[live]] = True
            around = graph[ids[at, best[live]]]
            new = ~seen[at[:, None], around]
            seen[at[:, None], around] = True
            found = np.where(new, np.einsum("nd,njd->nj", q[at], centres[around]), -np.inf)
            order = np.argsort(around, axis=1, kind="stable")  # a centroid named twice counts once
            twice = np.zeros_like(new)
            sorted_ = np.take_along_axis(around, order, 1)
            np.put_along_axis(twice, order, np.concatenate([np.zeros((len(at), 1), bool), sorted_[:, 1:] == sorted_[:, :-1]], axis=1), 1)
            found[twice] = -np.inf
            all_likeness = np.concatenate([likeness[at], found], axis=1)
            top = np.argsort(-all_likeness, axis=1, kind="stable")[:, :beam]
            likeness[at] = np.take_along_axis(all_likeness, top, 1)
            ids[at] = np.take_along_axis(np.concatenate([ids[at], around], axis=1), top, 1)
            opened[at] = np.take_along_axis(np.concatenate([opened[at], found == -np.inf], axis=1), top, 1)
        distance = np.sqrt(np.maximum(2 - 2 * likeness, 0))
        near = (distance <= ratio * distance[:, :1] + 1e-9) & (ids >= 0)
        within = near | ((np.arange(beam) < least) & (ids >= 0))
        short = near[:, -1] & (beam < (k if most is None else min(k, most)))
        for r in np.flatnonzero(~short).tolist():
            out[todo[r]] = (ids[r][within[r]], distance[r][within[r]])
        todo, beam = todo[short], beam * 2
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten()).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def exact_scores(query: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row summed in the same way whatever stands around it, so that ties are ties."""
    return (vectors * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))


ENTRY = "class long, list string, distance double"


def _entries(classes: pa.Array, sizes: list[int], lists: list[str], distances: np.ndarray, vectors: pa.Array) -> pa.RecordBatch:
    take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    return pa.RecordBatch.from_arrays([classes.take(take), pa.array(lists, pa.string()), pa.array(distances, pa.float64()), vectors.take(take)], names=["class", "list", "distance", "vector"])


def _listed(vectors: DataFrame, index, beam: int, ratio: float, most: int | None = None, least: int = 1) -> DataFrame:
    """class, list, distance, vector: one row for each posting list that the search of the graph gives for a vector."""
    kind = vectors.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, graph = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = search_graph(unit(_matrix(part.column("vector"))), centres, graph, beam, ratio, most, least)
                sizes = [len(ids[:most]) for ids, _ in found]
                lists = [str(x) for ids, _ in found for x in ids[:most].tolist()]
                yield _entries(part.column("class"), sizes, lists, np.concatenate([d[:most] for _, d in found]), part.column("vector"))

    return vectors.select("class", "vector").mapInArrow(run, f"{ENTRY}, vector {kind}")


def _small(lists: DataFrame) -> DataFrame:
    """lists, to be broadcast if they are few; they are checkpointed, so that counting is cheap."""
    return F.broadcast(lists) if lists.count() <= BROADCAST_LISTS else lists


def _fit(entries: DataFrame, long: DataFrame) -> DataFrame:
    """list, centres (flat), dim: own centroids of the lists in long (list, fan), each fitted on a bounded sample."""

    def run(table: pa.Table) -> pa.Table:
        sample = unit(_matrix(table.column("vector")))
        fan = min(table.column("fan")[0].as_py(), len(sample))
        return pa.table({"list": [table.column("list")[0].as_py()], "centres": pa.array([balanced_centroids(sample, fan).ravel().tolist()], pa.list_(pa.float64())), "dim": pa.array([sample.shape[1]], pa.int32())})

    by_hash = Window.partitionBy("list").orderBy(F.xxhash64("class"), "class")
    sample = entries.join(_small(long), "list").withColumn("nth", F.row_number().over(by_hash)).where(f"nth <= {FIT_ROWS * MOST_FAN}").where(F.col("nth") <= FIT_ROWS * F.col("fan"))
    return sample.select("list", "fan", "vector").groupBy("list").applyInArrow(run, "list string, centres array<double>, dim int")


def _descend(entries: DataFrame, fitted: DataFrame, parts: DataFrame, ratio: float, most: int | None = None, least: int = 1) -> DataFrame:
    """entries with those of split lists moved to the lists below, as far as these are near enough over all of a vector's lists.

    parts (list, n_parts) deals a split list's entries over tasks, each with the list's centroids.
    """
    kind = entries.schema["vector"].dataType.simpleString()

    def run(rows: pa.Table, below: pa.Table) -> pa.Table:
        if not rows.num_rows or not below.num_rows:
            return pa.Table.from_batches([_entries(pa.array([], pa.int64()), [], [], np.empty(0), rows.column("vector").combine_chunks().slice(0, 0))])
        centres = np.array(below.column("centres")[0].as_py()).reshape(-1, below.column("dim")[0].as_py())
        vectors = rows.column("vector").combine_chunks()
        likeness = unit(_matrix(vectors)) @ centres.T
        distance = np.sqrt(np.maximum(2 - 2 * likeness, 0))
        nth = lambda n: np.partition(distance, n - 1, axis=1)[:, n - 1 : n]
        edge = np.maximum(ratio * nth(1) + 1e-9, nth(min(least, len(centres))))
        row, at = np.nonzero(distance <= (np.minimum(edge, nth(min(most, len(centres)))) if most else edge))
        name = below.column("list")[0].as_py()
        return pa.Table.from_batches([_entries(rows.column("class").combine_chunks(), np.bincount(row, minlength=len(vectors)).tolist(), [f"{name}.{x}" for x in at.tolist()], distance[row, at], vectors)])

    split = _small(parts)
    dealt = entries.join(split, "list").withColumn("part", F.pmod(F.xxhash64("class"), F.col("n_parts")).cast("int")).select("list", "part", "class", "vector")
    below = fitted.join(split, "list").select(F.col("list").alias("list"), F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "centres", "dim")
    moved = dealt.groupBy("list", "part").cogroup(below.groupBy("list", "part")).applyInArrow(run, f"{ENTRY}, vector {kind}")
    every = entries.join(split, "list", "left_anti").select(*moved.columns).unionByName(moved)
    by_class = Window.partitionBy("class")
    every = every.withColumns({"nearest": F.min("distance").over(by_class), "nth": F.row_number().over(by_class.orderBy("distance", "list"))})
    kept = every.where((F.col("distance") <= ratio * F.col("nearest") + 1e-9) | (F.col("nth") <= least))
    return (kept.where(F.col("nth") <= most) if most else kept).select(*moved.columns)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can be compared: an id, and a vector without null or non-finite components, not zero, of the usual length."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector")).where("vec_id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.where(fine)
    usual = v.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return v.where(F.size("vector") == (usual.n if usual else 0))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """class (smallest id), h1, h2, ids (the k + 1 smallest), vector: rows of equal vectors as one.

    A query finds k others at most, so that further ids of a class can't appear. Repeated rows are cut down before the shuffle.
    """
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    first = rows.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1)
    return first.groupBy("h1", "h2").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector"))


def nearest(vectors: DataFrame, queries, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query among the rows (a condition) its k nearest others that the lists hold.

    Ties go to the smaller id. Rows without id or with vectors that are null, zero, not finite or of another length than
    most take no part. A repeated id counts once, by its best score; as a query it stands for the smallest of its vectors.
    Further columns are ignored; an empty table gives no rows. A query that finds fewer than k reads more lists, from near
    to far, until it has k or all candidates that there are.
    """
    spark = vectors.sparkSession
    hashes = {"h1": F.xxhash64(F.lit(1), "vector"), "h2": F.xxhash64(F.lit(2), "vector")}
    rows = stored(usable(vectors).withColumns(hashes), "vectors")
    out = "query_id long, rank int, vec_id long, score double"
    classes = stored(_classes(rows, k), "classes")
    n, n_ids = classes.count(), rows.select("vec_id").distinct().count()
    if not n:
        return spark.range(0).selectExpr("id query_id", "int(id) rank", "id vec_id", "double(id) score")
    dim = classes.select(F.size("vector")).first()[0]
    n_sample = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(n_sample).select("vector").toArrow()
    sample = unit(_matrix(sample.column("vector")))
    n_lists = int(max(1, min(MOST_CENTROIDS, INDEX_BYTES // (8 * dim), len(sample), n // LIST_ROWS)))
    centres = balanced_centroids(sample, n_lists)
    index = spark.sparkContext.broadcast((centres, neighbour_graph(centres)))
    postings = stored(_listed(classes, index, 16, COPY_RATIO, COPIES), "postings")
    splits: list[tuple[DataFrame, DataFrame]] = []
    while True:
        sizes = postings.groupBy("list").agg(F.count("*").alias("n"))
        n_parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
        fan = F.least(F.lit(MOST_FAN), F.greatest(F.lit(FAN), F.ceil(F.col("n") / LIST_ENTRIES))).cast("int")
        long = cut_lineage(sizes.where(F.col("n") > PART_ROWS).select("list", n_parts.alias("n_parts"), fan.alias("fan")))
        if len(splits) == LEVELS or long.isEmpty():
            break
        fitted = stored(_fit(postings, long.select("list", "fan")), "centroids")
        splits.append((fitted, long.select("list", "n_parts")))
        postings = stored(_descend(postings, fitted, long.select("list", "n_parts"), COPY_RATIO, COPIES), "postings")
    parts = long.select("list", "n_parts")
    dealt = postings.join(_small(parts), "list", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
    posted = dealt.join(classes.select("class", "ids"), "class").select("list", F.pmod(F.xxhash64("class"), F.col("n_parts")).cast("int").alias("part"), "ids", F.col("vector"))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min(F.struct("vector", "h1", "h2")).alias("v")).select(F.col("vec_id").alias("query_id"), "v.h1", "v.h2")
    asked = stored(asked.join(classes.select("h1", "h2", "class"), ["h1", "h2"]).select("query_id", "class"), "asked")
    wanted = stored(classes.join(asked.select("class").distinct(), "class").select("class", "vector"), "queries")
    total = min(k + 1, n_ids)  # its own id is among them

    def compare(_, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, matrix = left.column("ids").to_pylist(), _matrix(left.column("vector"))
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            for q, query in zip(right.column("class").to_pylist(), _matrix(right.column("vector")), strict=True):
                scores = exact_scores(query, matrix, norms)
                best: dict[int, float] = {}
                width = k + 1
                while True:  # repeated ids may take places: then more rows are looked at
                    width = min(width, len(scores))
                    edge = -np.partition(-scores, width - 1)[width - 1]
                    near = np.flatnonzero(scores >= edge)
                    for s, i in sorted((-float(scores[r]), i) for r in near.tolist() for i in ids[r]):
                        best.setdefault(i, -s)
                    if len(best) > k or width == len(scores):
                        break
                    width *= 2
                found += [(q, v, s) for v, s in list(best.items())[: k + 1]]
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["class", "vec_id", "score"])

    def ranked(some: DataFrame, least: int) -> DataFrame:
        """class, best (the k + 1 nearest as an array of score and vec_id) from the lists that the classes read."""
        listed = _listed(some, index, BEAM, QUERY_RATIO, least=least)
        for fitted, of in splits:
            listed = _descend(listed, fitted, of, QUERY_RATIO, least=least)
        by = ["list", "part"]
        listed = listed.join(_small(parts), "list", "left").select("list", F.explode(F.sequence(F.lit(0), F.coalesce("n_parts", F.lit(1)) - 1)).alias("part"), "class", F.col("vector").alias("vector"))
        found = posted.groupBy(*by).cogroup(listed.groupBy(*by)).applyInArrow(compare, "class long, vec_id long, score double")
        order = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
        best = found.groupBy("class", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
        return best.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))

    done, least, open_ = [], 1, wanted
    n_all = postings.select("list").distinct().count()
    while True:
        near = stored(ranked(open_, least), "near")
        full = near.where(F.size("best") >= total)
        if least >= n_all:
            done.append(near)
            break
        done.append(full)
        open_ = stored(open_.join(full.select("class"), "class", "left_anti"), "open")
        if open_.isEmpty():
            break
        least *= 16
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    each = asked.join(found, "class").select("query_id", F.posexplode(others).alias("at", "b"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
