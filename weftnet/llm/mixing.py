"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from weights by water filling: the level is found by a few sums over the table of sources. Sources get
seats, each worth one block of words, by highest quotients target / (2 k - 1): sums narrow the quotient of the last seat
down, and only quotients near it are sorted. A source's documents are dealt over shards by a seeded hash; the source's
seats are apportioned to its shards in the same way, which gives integer quotas. In a shard the documents lie end to end in seeded order, cut
into blocks of equal size; a quota takes the whole shard as often as it fits and the rest as evenly spaced blocks from
a seeded start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, bounded_batches, cut_lineage, releasing, word_count

WORDS = re.compile(WORD)

#: Sources up to which their table is broadcast; a larger one is joined by source and one of so many salts.
BROADCAST_SOURCES, SALTS = 100_000, 32
#: Divisors that one pass over the sources tries, and quotients that may be sorted.
TRIES, SORTED = 48, 20_000
BLOCK_WORDS = 256
#: A corpus has so many blocks at least, and its smallest source too, so that small ones are mixed as closely as large ones.
BLOCKS_LEAST = 100_000
SOURCE_BLOCKS_LEAST = 50
SHARD_WORDS = 32_768
MAX_SHARDS = 20_000
MOST = 2
TEXT = "text"


def numbered(sources: DataFrame, name: str = "source") -> DataFrame:
    """sources with source_id, their place in code-point order from 0, null last; ordered in parallel."""
    parts = cut_lineage(sources.orderBy(F.col(name).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    within = parts.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(F.col(name).asc_nulls_last())))
    counts = parts.groupBy("part").count().orderBy("part").toArrow()  # one row for each partition
    n = np.asarray(counts["count"])
    # a list of rows would start Python workers of another kind, which stay beside those that read texts
    offset = F.broadcast(sources.sparkSession.createDataFrame(pa.table({"part": counts["part"], "before": n.cumsum() - n})))
    return within.join(offset, "part").withColumn("source_id", F.col("before") + F.col("nth") - 1).drop("part", "nth", "before")


def water_fill(sources: DataFrame, size: str, weight: str, share: float = 1.5, most: int = MOST) -> DataFrame:
    """sources with target: by weight, share times all sizes in sum, none above most times its source's size.

    Where a target would be above, it stops there and the excess is shared again by weight. What is left over for a unit
    of weight only rises while sources stop, so that it is found when none stops any more.
    """
    total = sources.agg(F.sum(size)).first()[0] or 0
    level = -1.0
    full = F.col(weight) * F.lit(level) >= most * F.col(size)
    while True:
        sums = sources.agg(F.sum(F.when(full, most * F.col(size))).alias("stopped"), F.sum(F.when(~full, F.col(weight))).alias("free")).first()
        now = (share * total - (sums.stopped or 0)) / sums.free if sums.free else level
        if now <= level:
            break
        level = now
        full = F.col(weight) * F.lit(level) >= most * F.col(size)
    return sources.withColumn("target", F.least(F.col(weight) * F.lit(max(level, 0.0)), (most * F.col(size)).cast("double")))


def highest_quotients(items: DataFrame, key: str, votes: str, cap: str, seats: int) -> DataFrame:
    """items with seats, dealt by the highest votes / (2 k - 1), at most cap each; ties go to smaller keys.

    An item's seats at a quotient q are the whole part of (votes / q + 1) / 2. Sums over all items at many quotients at
    once close in on the last seat's; the quotients between are sorted.
    """
    v, c = F.col(votes), F.greatest(F.col(cap), F.lit(0))
    at = lambda q: F.when(v > 0, F.least(c, F.floor((v / F.lit(q) + 1) / 2))).otherwise(0).cast("long")
    known = items.agg(F.sum(F.when(v > 0, c).otherwise(0)).alias("most"), F.max(votes).alias("top"), F.sum(votes).alias("all"), F.count("*").alias("n")).first()
    if not known.top or not known.top > 0 or seats <= 0:
        return items.withColumn("seats", F.lit(0).cast("long"))
    if (known.most or 0) <= seats:
        return items.withColumn("seats", F.when(v > 0, c).otherwise(0).cast("long"))
    high, low = known.top * 2, known.all / (2 * seats + known.n) / 2
    while (items.agg(F.sum(at(low))).first()[0] or 0) < seats:
        low /= 16
    while True:
        step = (high / low) ** (1 / (TRIES + 1))
        tries = sorted({low, high, *(low * step**i for i in range(1, TRIES + 1))})
        given = items.agg(*(F.sum(at(q)).alias(f"s{i}") for i, q in enumerate(tries))).first()
        i = max(i for i, n in enumerate(given) if n >= seats)
        narrower = tries[min(i + 1, len(tries) - 1)]
        done = given[i] - given[min(i + 1, len(tries) - 1)] <= SORTED or (tries[i], narrower) == (low, high)
        low, high = tries[i], narrower
        if done:
            break
    first, last = F.greatest(at(high) - 1, F.lit(0)), F.least(at(low) + 1, F.greatest(c, F.lit(0)))
    sure = cut_lineage(items.withColumn("sure", F.when(v > 0, first).otherwise(0).cast("long")).withColumn("upto", F.when(v > 0, last).otherwise(0).cast("long")))
    left = seats - (sure.agg(F.sum("sure")).first()[0] or 0)
    near = sure.where("upto > sure").select(key, votes, F.explode(F.sequence(F.col("sure") + 1, "upto")).alias("k"))
    won = near.orderBy(F.desc(F.col(votes) / (2 * F.col("k") - 1)), key).limit(left).groupBy(key).agg(F.count("*").alias("won"))
    return sure.join(won, key, "left").withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0))).drop("sure", "upto", "won")


def apportion(items: DataFrame, group: str, item: str, votes: str, seats: str) -> DataFrame:
    """items with a column quota: the seats of each group dealt to its items by highest quotients, ties to smaller items."""
    whole = Window.partitionBy(group)
    ranked = Window.partitionBy(group).orderBy(F.desc("quotient"), item)
    share = lambda n: F.col(votes) * n / F.col("all_votes")
    near = (
        items.withColumns({"all_votes": F.sum(votes).over(whole), "n_items": F.count("*").over(whole)})
        .withColumn("low", F.greatest(F.lit(0), F.floor(share(F.col(seats) - F.col("n_items") / 2) - 1)).cast("long"))
        .withColumn("high", F.ceil(share(F.col(seats) + F.col("n_items") / 2) + 2).cast("long"))
        .withColumn("low_all", F.sum("low").over(whole))
        .withColumn("k", F.explode(F.sequence(F.col("low") + 1, F.greatest("high", F.col("low") + 1))))
        .withColumn("quotient", F.col(votes) / (2 * F.col("k") - 1))
        .withColumn("won", (F.row_number().over(ranked) <= F.col(seats) - F.col("low_all")).cast("long"))
    )
    return near.groupBy(*items.columns).agg((F.first("low") + F.sum("won")).alias("quota"))


def _selected(k: Column) -> Column:
    """Is block k one of the evenly spaced rest_blocks of n_blocks, counted from a seeded start?"""
    step = lambda j: F.floor((j * F.col("rest_blocks") + F.col("start")) / F.col("n_blocks"))
    return step(k + 1) > step(k)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 17, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs; with carry also the row itself as struct row.

    The size is the number of words; sources in code-point order, null last, have the weights in turn, repeating. taken
    counts the words that the mix takes, repeats included, and is never above twice the size. A null or empty text has
    size 0 and gives nothing; a null source is a source of its own; repeated rows are rows like others; an empty table
    gives no rows; further columns are ignored unless carried. Blocks may begin and end within a document. Same seed and
    rows, same result.
    """
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count(docs[TEXT]).alias("size")]
    sized = docs.select(*keys, *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []))
    sized = sized if carry else cut_lineage(sized)
    each = F.array(*(F.lit(float(w)) for w in weights))
    sources = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = cut_lineage(sources.withColumn("weight", F.get(each, (F.col("source_id") % len(weights)).cast("int"))))
    known = sources.agg(F.count("*").alias("n"), F.sum("source_size").alias("all"), F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).alias("least")).first()
    total = known["all"] or 0
    block = max(1, min(BLOCK_WORDS, total // BLOCKS_LEAST, (known.least or 0) // SOURCE_BLOCKS_LEAST))
    n_shards = F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("int")
    sources = cut_lineage(water_fill(sources, "source_size", "weight", share).withColumn("n_shards", n_shards))
    registry = sources.select(F.col("source").alias("mix_source"), "source_id", "source_size", "target", "n_shards")
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if known.n <= BROADCAST_SOURCES:
        placed = sized.join(F.broadcast(registry), same)
    else:
        salted = registry.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = sized.join(salted, same & (F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int") == F.col("mix_salt")))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_shards")).cast("int").alias("shard")
    placed = placed.select("doc_id", "size", *(["row"] if carry else []), "source_id", "source_size", "target", shard)
    cut = (
        placed.groupBy("source_id", "shard").agg(F.sum("size").alias("shard_size"))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("shard_size") / block)).cast("long"))
    )
    cut = cut_lineage(cut)
    blocks = sources.join(cut.groupBy("source_id").agg(F.sum("n_blocks").alias("blocks")), "source_id")
    blocks = cut_lineage(blocks.select("source_id", "source_size", "target", "blocks", (MOST * F.col("blocks")).alias("cap")))
    wanted = blocks.agg(F.sum("target")).first()[0] or 0.0
    seats_of = highest_quotients(blocks, "source_id", "target", "cap", round(wanted / block))
    # a source's blocks are a little larger or smaller than the block: its own seats count in them
    own = F.when(F.col("source_size") > 0, F.least("cap", F.rint(F.col("seats") * block * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(0)
    seats_of = seats_of.select("source_id", own.cast("long").alias("seats"))
    quotas = apportion(cut.join(seats_of, "source_id"), "source_id", "shard", "n_blocks", "seats").select(
        "source_id", "shard", "shard_size", "n_blocks",
        F.expr("quota div n_blocks").alias("epochs"), F.expr("quota % n_blocks").alias("rest_blocks"),
        F.pmod(F.xxhash64(F.lit(seed), "source_id", "shard"), "n_blocks").alias("start"),
    )
    order = Window.partitionBy("source_id", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    at = placed.join(quotas, ["source_id", "shard"]).withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumns({
        "begin": F.col("end") - F.col("size"),
        "first": F.expr("((end - size + 1) * n_blocks - 1) div greatest(shard_size, 1)"),
        "last": F.expr("(end * n_blocks - 1) div greatest(shard_size, 1)"),
    })
    edge = lambda k: F.floor(k * F.col("shard_size") / F.col("n_blocks"))
    words = lambda k: F.least(F.col("end"), edge(k + 1)) - F.greatest(F.col("begin"), edge(k))
    part = F.aggregate(
        F.sequence("first", "last"), F.lit(0).cast("long"),
        lambda sum_, k: sum_ + F.when(_selected(k), words(k)).otherwise(0).cast("long"),
    )
    part = F.when((F.col("size") > 0) & (F.col("rest_blocks") > 0), part).otherwise(F.lit(0)).cast("long")
    out = at.withColumn("taken", F.col("epochs") * F.col("size") + part)
    return out.select("doc_id", "size", "source_size", "target", "taken", *(["row"] if carry else []))


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for m in islice(WORDS.finditer(text), n):
        end = m.end()
    return text[:end]


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of docs: each document as often as it is taken whole, and once more cut after the words taken beyond.

    Columns are those of docs; n_chars, where there is one, follows the text. Documents of which nothing is taken are left out.
    """
    bounded_batches(docs.sparkSession)
    mixed = mix(docs, carry=True, **how).where("taken > 0").select("row", "size", "taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, taken = (np.asarray(batch.column(c)) for c in ("size", "taken"))
            whole, part = taken // size, taken % size
            times = whole + (part > 0)
            take = np.repeat(np.arange(len(size)), times)
            texts = pc.struct_field(batch.column("row"), "text").take(pa.array(take)).to_pylist()
            ends = times.cumsum() - 1
            for i in np.flatnonzero(part).tolist():
                texts[ends[i]] = first_words(texts[ends[i]], int(part[i]))
            row = batch.column("row").take(pa.array(take))
            columns = {f.name: row.field(j) for j, f in enumerate(row.type)} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = mixed.mapInArrow(releasing(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
