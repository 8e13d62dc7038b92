"""Near-duplicate detection by MinHash: universal hash minima, banding, signature checks, components.

Texts with equal shingle sets form a class and are handled once. Classes that share a band of their signatures are
candidates. First each is compared with its bucket's hub, the smallest class in it: if the signatures agree, the full sets
decide, and the links that hold give components by alternating large-star and small-star. Most buckets then lie in one
component and are done. In the others, classes of different components are compared: by signature within the bucket, and
where these agree, by full sets within the groups that agreeing signatures hold together. Links between classes of one
component are never looked at, so that a bucket's main component meets only the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, cut_lineage, slices, stored
from .components import HOT_KEYS, connected, whole_if_few, with_totals

U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


@dataclass(frozen=True)
class Settings:
    """Shingles of words, the share (in percent) of common shingles that makes a link, and the signature's shape.

    With 4 minima in a band and 20 bands a pair at 0.85 is missed with a chance below 1e-6; at 0.8 and 28 bands likewise.
    """

    words: int = 3
    percent: int = 85
    rows: int = 4
    bands: int = 20
    seed: int = 7

    @property
    def minima(self) -> int:
        return self.rows * self.bands


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * ODD[3]
    x = (x ^ (x >> U(29))) * ODD[4]
    return x ^ (x >> U(32))


def shingle_sets(text: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; A-Z count as lower case.

    A text with fewer words than a shingle has its whole sequence as the only one; without words the set is empty.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    flat = split.flatten()
    keep = pc.not_equal(flat, "")
    doc = np.repeat(np.arange(len(split)), np.asarray(split.value_lengths()))[np.asarray(keep)]
    coded = flat.filter(keep).dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), U, len(coded.dictionary))
    word = hashed[np.asarray(coded.indices)]
    ends = np.searchsorted(doc, np.arange(len(split) + 1))
    n = max(0, len(word) - words + 1)
    joined = np.zeros(n, U)
    for k in range(words):
        joined = (joined + word[k : k + n]) * ODD[k]
    joined = _mix(joined)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(word[a:b].tobytes(), seed=b - a)], U))
        else:
            out.append(np.empty(0, U))
    return out


class Hashes:
    """A family of universal functions x -> a x + b mod 2^64 with odd a, of which the high half counts."""

    def __init__(self, n: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def minima(self, members: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), ~U(0))
        for i in range(0, len(members), 2048):
            low = np.minimum(low, (self.a[:, None] * members[None, i : i + 2048] + self.b[:, None]).min(axis=1))
        return (low >> U(32)).astype(np.uint32)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of a signature, different for each band's place."""
    parts = signature.reshape(-1, rows).astype(U)
    key = np.arange(1, len(parts) + 1, dtype=U) * ODD[5]
    for j in range(rows):
        key = _mix(key + parts[:, j] * ODD[6])
    return key.view(np.int64)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class Forest:
    """Union-find over the rows of one unit."""

    def __init__(self, ids: list[int]) -> None:
        self.ids, self.up = ids, list(range(len(ids)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """Each tree as links of its first row with the others, so that few rounds hold trees of several units together."""
        return [(self.ids[r], self.ids[i]) for i in range(len(self.ids)) if (r := self.root(i)) != i]

    def link_where(self, near: np.ndarray) -> None:
        """near[i, j] for the rows of the unit: links, as few as hold them together."""
        left = np.arange(len(near))
        while len(left):  # breadth first from each unvisited row: one link for each row reached
            first, left = left[0], left[1:]
            front = [first]
            while front and len(left):
                i = front.pop()
                hit = near[i, left]
                for j in left[hit].tolist():
                    self.link(i, j)
                    front.append(j)
                left = left[~hit]


def agreeing(signatures: np.ndarray, least: int) -> np.ndarray:
    """Which rows agree in at least so many bytes of their signatures."""
    near = np.zeros((len(signatures), len(signatures)), bool)
    for i in range(0, len(signatures), 64):
        near[i : i + 64] = (signatures[i : i + 64, None, :] == signatures[None, :, :]).sum(axis=2, dtype=np.int32) >= least
    return near


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * common >= percent * union: exact, by products of occurrence matrices."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    code = np.cumsum(times > 1) - 1
    column = code[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        hit = np.zeros((len(sets), min(width, int(column[-1]) + 1 - start)), np.float32)
        hit[row[a:b], column[a:b] - start] = 1
        common += hit @ hit.T
    common = common.astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def _blocks(n: str, size: str, block: int) -> F.Column:
    return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")


def units(rows: DataFrame, block: int, per_pack: int, n_rows: int | None = None) -> DataFrame:
    """rows (key, id, comp, value) dealt into packs of units: pack, alone, key, low, high, id, comp, value.

    Only rows of different comp need to meet. A key with up to block rows and BLOCK_BYTES of values is one unit; small
    units share packs of about per_pack rows and BLOCK_BYTES. A larger key is split: the rows of its main comp (that of
    its smallest id) and the others each into blocks by a hash, and each block of others with each other block is a
    unit and a pack of its own. Main rows don't meet each other, so that what is compared grows with main times others.
    n_rows: rows at most, where that is known and each key has two at least.
    """
    size, n = F.octet_length("value"), rows.count() if n_rows is None else n_rows
    keyed = with_totals(rows, "key", n, n_keys=n if n_rows is None else n // 2, main=F.min_by("comp", "id"), lo=F.min("comp"), hi=F.max("comp"), all_rows=F.count("*"), all_bytes=F.sum(size)).where("lo <> hi")
    keyed = cut_lineage(keyed.withColumn("is_main", F.col("comp") == F.col("main")).drop("main", "lo", "hi"))
    large = _blocks("all_rows", "all_bytes", block) > 1
    known = keyed.agg(F.count_if(~large).alias("n"), F.sum(F.when(~large, size)).alias("bytes"), F.count_if(large).alias("n_large")).first()
    n_packs = max(1, -(-known.n // per_pack), -(-(known.bytes or 0) // BLOCK_BYTES))
    pack = lambda *by: F.pmod(F.xxhash64(*by), F.lit(n_packs))
    zero = F.lit(0).cast("int")
    dealt = keyed.where(~large).select(pack("key").alias("pack"), F.lit(False).alias("alone"), "key", zero.alias("low"), zero.alias("high"), "id", "comp", "value")
    if not known.n_large:
        return dealt
    parts = with_totals(
        keyed.where(large).select("key", "id", "comp", "value", "is_main"), "key", known.n_large,
        n_main=F.count_if("is_main"), n_other=F.count_if(~F.col("is_main")), b_main=F.coalesce(F.sum(F.when(F.col("is_main"), size)), F.lit(0)), b_other=F.coalesce(F.sum(F.when(~F.col("is_main"), size)), F.lit(0)),
    ).withColumns({"mains": F.greatest(F.lit(1), _blocks("n_main", "b_main", block)), "others": F.greatest(F.lit(1), _blocks("n_other", "b_other", block))})
    hashed = F.xxhash64("id", "value", F.lit(1))
    parts = parts.withColumn("mine", F.when(F.col("is_main"), F.col("others") + F.pmod(hashed, "mains")).otherwise(F.pmod(hashed, "others")).cast("int"))
    partners = F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1), F.col("mine")))
    parts = parts.withColumn("other", F.explode(partners))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return dealt.unionByName(parts.select(F.xxhash64("key", low, high).alias("pack"), F.lit(True).alias("alone"), "key", low.alias("low"), high.alias("high"), "id", "comp", "value"))


def linked(dealt: DataFrame, near) -> DataFrame:
    """Links (a, b) that hold together, within each unit, what near(values) finds similar between different comps."""

    def run(table: pa.Table) -> pa.Table:
        frame = table.combine_chunks().sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending"), ("id", "ascending")])
        marks = [np.asarray(frame.column(c).combine_chunks()) for c in ("key", "low", "high")]
        ids, comp = (np.asarray(frame.column(c).combine_chunks()) for c in ("id", "comp"))
        change = np.any([m[1:] != m[:-1] for m in marks], axis=0) if len(ids) > 1 else np.empty(0, bool)
        at = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
        values = frame.column("value")
        pairs: list[tuple[int, int]] = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a > 1:
                forest = Forest(ids[a:b].tolist())
                forest.link_where(near(values.slice(a, b - a).to_pylist()) & (comp[a:b, None] != comp[None, a:b]))
                pairs += forest.stars()
        return pa.Table.from_batches([_edges(pairs)])

    return dealt.groupBy("pack", "alone").applyInArrow(run, "a long, b long")


def agreeing_hubs(signed: DataFrame, least: int, n_rows: int) -> DataFrame:
    """Pairs (hub, id) of a bucket's smallest class and others whose signature agrees with it in so many bytes.

    n_rows: rows of signed, two at least in each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("hub_signature", "signature")]
            near = pa.array((sides[0] == sides[1]).sum(axis=1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("hub").filter(near), batch.column("id").filter(near)], names=["hub", "id"])

    met = with_totals(signed, "bucket", n_rows, n_keys=n_rows // 2, first=F.min(F.struct("id", "signature"))).where("id <> first.id")
    return met.select(F.col("first.id").alias("hub"), F.col("first.signature").alias("hub_signature"), "id", "signature").mapInArrow(run, "hub long, id long").distinct()


def hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, id) whose full sets (id, n_bytes, value) are similar, as links a, b.

    A hub's partners are split into blocks by a hash if they are many, and the hub's own sets go to each block, so that
    the work grows with the number of pairs.
    """
    pairs = whole_if_few(pairs, n_pairs := pairs.count())
    sized = sets.select("id", "n_bytes").join(pairs, "id").groupBy("hub").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    sized = cut_lineage(sized)
    known = sized.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    n, size = known.n or 0, known.bytes or 0
    blocks = F.greatest(F.ceil(F.col("n") / max(SET_BLOCK, n // HOT_KEYS)), F.ceil(F.col("bytes") / max(BLOCK_BYTES, size // HOT_KEYS))).cast("int")
    hot = sized.select("hub", blocks.alias("n_blocks")).where("n_blocks > 1")  # at most 2 * HOT_KEYS
    n_packs = max(1, -(-n // SET_BLOCK), -(-size // BLOCK_BYTES))

    def placed(rows: DataFrame, block) -> DataFrame:
        some = rows.join(F.broadcast(hot), "hub", "left").withColumn("block", block(F.coalesce("n_blocks", F.lit(1))))
        alone = F.col("n_blocks").isNotNull()
        unit = F.xxhash64("hub", "block")
        return some.select(F.when(alone, unit).otherwise(F.pmod(unit, F.lit(n_packs))).alias("pack"), alone.alias("alone"), *(F.col(c).alias(c) for c in ("hub", "id", "value")))

    values = sets.select("id", "value")
    left = placed(values.join(pairs, "id"), lambda k: F.pmod(F.xxhash64("id", F.lit(2)), k).cast("int"))
    hubs = values.withColumnRenamed("id", "hub").join(whole_if_few(sized.select("hub"), n_pairs), "hub").withColumn("id", F.col("hub"))
    right = placed(hubs, lambda k: F.explode(F.sequence(F.lit(0), k - 1)))

    def run(others: pa.Table, hubs: pa.Table) -> pa.Table:
        of: dict[int, list[np.ndarray]] = {}
        for hub, value in zip(hubs.column("hub").to_pylist(), hubs.column("value").to_pylist(), strict=True):
            of.setdefault(hub, []).append(np.frombuffer(value, U))
        pairs = []
        for hub, i, value in zip(*(others.column(c).to_pylist() for c in ("hub", "id", "value")), strict=True):
            mine = np.frombuffer(value, U)
            for theirs in of.get(hub, []):
                at = np.searchsorted(theirs, mine)
                common = int((theirs[np.minimum(at, len(theirs) - 1)] == mine).sum()) if len(theirs) else 0
                if 100 * common >= percent * (len(mine) + len(theirs) - common):
                    pairs.append((hub, i))
                    break
        return pa.Table.from_batches([_edges(pairs)])

    return left.groupBy("pack", "alone").cogroup(right.groupBy("pack", "alone")).applyInArrow(run, "a long, b long")


def sketch(docs: DataFrame, how: Settings) -> DataFrame:
    """doc_id, n_shingles, print (of the shingle set; null if empty), signature (a byte of each minimum), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Hashes(how.minima, how.seed)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, prints, signatures, bands = [], [], [], []
                for members in shingle_sets(part.column("text"), how.words):
                    sizes.append(len(members))
                    if not len(members):
                        prints.append(None), signatures.append(None), bands.append(None)
                        continue
                    low = family.minima(members)
                    prints.append(xxhash.xxh3_128_digest(members.tobytes()))
                    signatures.append(low.astype(np.uint8).tobytes())
                    bands.append(band_keys(low, how.rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "print", "signature", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, signature binary, bands array<long>")


#: Rows of a bucket, and documents of a candidate group, that are compared at once.
BUCKET_BLOCK, SET_BLOCK = 1024, 1024
#: Signatures or full sets of a block, and of the small units that share a pack.
BLOCK_BYTES = 32 << 20
#: Candidates up to which their ids are broadcast to pick out texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: How far an estimate from the signature may lie below the threshold: over five standard deviations.
SLACK = 25


def near_duplicates(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (is it the document's own id).

    Two documents are linked if their shingle sets have the asked share in common; every link that holds is confirmed on
    full sets. Texts without words, nulls included, link with nothing. Rows with a null doc_id link with nothing, have a null
    component and are kept. Rows that share a doc_id and have words are one document with several texts: all lie in one
    component. Texts of any length are read whole; further columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    sketches = stored(sketch(docs, how), "sketch")
    known = sketches.where("print is not null and doc_id is not null")
    classes = stored(known.groupBy("print").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("signature", "bands"), "doc_id").alias("s")).select("id", "print", "s.*"), "classes")
    rows = classes.select(F.explode(F.array_distinct("bands")).alias("bucket"), "id")
    shared = cut_lineage(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    signed = stored(rows.join(whole_if_few(shared, shared.count()), "bucket").join(classes.select("id", "signature"), "id").select("bucket", "id", "signature"), "signed")
    least = -(-how.minima * (how.percent - SLACK) // 100)
    words, percent = how.words, how.percent

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                members = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                sizes = pa.array(list(map(len, members)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, pa.array(members, pa.binary())], names=["id", "n_bytes", "value"])

    candidates = cut_lineage(signed.select("id").distinct())
    n_ids = candidates.count()
    some = F.broadcast(candidates) if n_ids <= BROADCAST_IDS else candidates
    repeated = cut_lineage(known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("print").alias("least"), F.max("print").alias("most")).where("n > 1").select("doc_id", (F.col("least") != F.col("most")).alias("several")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(some, "id", "left_semi")
    if not (once := repeated.isEmpty()):
        texts = texts.dropDuplicates(["id", "text"])
    full = stored(texts.mapInArrow(sets, "id long, n_bytes long, value binary").where("n_bytes > 0"), "sets")
    n_signed = signed.count()
    pairs = cut_lineage(agreeing_hubs(signed, least, n_signed))
    found, n_nodes = hub_links(pairs, full, percent), n_ids
    if not once:
        several = repeated.where("several").select("doc_id")
        same = cut_lineage(known.select("doc_id", "print").distinct().join(several, "doc_id", "left_semi").join(classes.select("print", "id"), "print").select(F.col("id").alias("a"), F.col("doc_id").alias("b")))
        found, n_nodes = found.unionByName(same), n_ids + 2 * same.count()
    links = cut_lineage(connected(found))
    component = whole_if_few(links.select(F.col("node").alias("id"), F.col("root").alias("comp")), n_nodes)
    placed = signed.join(component, "id", "left").select(F.col("bucket").alias("key"), "id", F.coalesce("comp", "id").alias("comp"), F.col("signature").alias("value"))
    by_signature = lambda values: agreeing(np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1), least)
    maybe = cut_lineage(linked(units(placed, BUCKET_BLOCK, 4000, n_signed), by_signature))
    if not maybe.isEmpty():
        groups = whole_if_few(cut_lineage(connected(maybe)).select(F.col("node").alias("id"), F.col("root").alias("key")), n_ids)
        grouped = full.join(groups, "id").join(component, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"), "value")
        by_sets = lambda values: similar([np.frombuffer(v, U) for v in values], percent)
        more = linked(units(grouped, SET_BLOCK, 1000, full.count()), by_sets)
        links = connected(more.unionByName(links.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    member = classes.select("print", "id").join(whole_if_few(links.withColumnRenamed("node", "id"), n_nodes), "id", "left").select("print", F.coalesce("root", "id").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "print").join(member, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, how: Settings = Settings(words=5, percent=80, bands=28)) -> DataFrame:
    """docs without those that another document of their component stands for, and without repeated rows.

    Null ids and texts without words stay; see near_duplicates for ties. Columns may have any names.
    """
    gone = near_duplicates(docs, how).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])
