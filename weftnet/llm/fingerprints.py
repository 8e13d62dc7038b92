"""Document fingerprints: quartile bucket digests and their bounded difference.

The triplets of bytes within windows of five are hashed into buckets; a digest holds, for each bucket, the quartile of the
buckets that its count lies in, and in front the length and how the quartiles lie to each other. Equal texts have equal
digests, and digests of similar texts differ in few buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, stored

BUCKETS = 256
#: Places of a triplet's second and third byte behind its first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: What a bucket adds to the difference of two digests, by the distance of its quartiles.
STEPS = np.array([0, 1, 2, 6])
#: Difference in length (eighths of a doubling) that counts at most, and the difference at which likeness is 0: what unrelated
#: quartiles differ by on average (26 / 16 a bucket) and the header's share.
LENGTH_STEPS, UNLIKE = 16, 26 * BUCKETS // 16 + 32
#: Bytes that are counted at once.
BLOCK = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the triplets of data."""
    counts = np.zeros(BUCKETS, np.int64)
    every = np.frombuffer(data, np.uint8)
    for at in range(0, len(every), BLOCK):
        b = every[at : at + BLOCK + 4].astype(np.uint32)
        for kind, (i, j) in enumerate(TRIPLETS):
            n = min(BLOCK, len(b) - j)  # triplets that begin in this block
            if n > 0:
                x = (b[:n] << 16 | b[i : i + n] << 8 | b[j : j + n]) + np.uint32(kind << 24)
                counts += np.bincount(x * np.uint32(2654435761) >> 24, minlength=BUCKETS)
    return counts


def digest(text: str) -> bytes:
    """Length, quartile ratios and two bits a bucket."""
    data = text.encode()
    counts, n = bucket_counts(data), len(data)
    ranked = np.sort(counts)
    low, mid, high = (int(ranked[k * BUCKETS // 4 - 1]) for k in (1, 2, 3))
    e = n.bit_length() - 1
    length = n if n < 8 else 8 * (e - 2) + (n >> (e - 3) & 7)
    ratios = (low * 15 // high << 4 | mid * 15 // high) if high else 0
    q = ((counts > low).astype(np.uint8) + (counts > mid) + (counts > high)).reshape(-1, 4)
    return bytes([min(length, 255), ratios]) + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes()


def difference(a: bytes, b: bytes) -> int:
    """Steps between two digests: of their buckets, of their lengths up to LENGTH_STEPS, and of their quartile ratios."""
    x, y = (np.frombuffer(d, np.uint8, offset=2).astype(np.int64) for d in (a, b))
    steps = sum(int(STEPS[np.abs((x >> s & 3) - (y >> s & 3))].sum()) for s in (0, 2, 4, 6))
    return steps + min(abs(a[0] - b[0]), LENGTH_STEPS) + abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 from UNLIKE steps on."""
    return max(0.0, 1 - difference(a, b) / UNLIKE)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many characters from the beginning of the following text, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_DONE, _HEAD, _TAIL = range(3)
_OUT = pa.schema([
    ("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
])


def _judged(doc_id: int | None, text: str, own: bytes, following: str, other: bytes) -> tuple:
    new = edited(text, following)
    print_ = own if new == text else digest(new)
    return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), print_.hex(), likeness(own, print_), likeness(own, other))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each judged with the row behind it; the first and the last are handed on with their texts."""
    part = TaskContext.get().partitionId()
    last = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = last[2] if last and last[1] == text else digest(text)
            if last is None:
                rows.append((part, _HEAD, doc_id, None, None, own.hex(), None, None, None, text))
            else:
                rows.append((part, _DONE, *_judged(*last, text, own), None))
            last = (doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "kind": _TAIL, "doc_id": last[0], "fingerprint": last[2].hex(), "text": last[1]}], schema=_OUT)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each partition, judged with the first of the next."""
    for batch in batches:
        rows = [_judged(r["doc_id"], r["text"], bytes.fromhex(r["fingerprint"]), r["next_text"], bytes.fromhex(r["next_fingerprint"])) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_OUT)[2:9], strict=True)], schema=pa.schema(list(_OUT)[2:9]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs its digest, that of its edited text, and how like it is to the latter and to the next row.

    Rows follow each other by falling doc_id, null last, ties by a hash of the text; the first row follows the last. Texts
    are shuffled once: they are dealt by ranges of that order, so that each task walks through one stretch and holds two
    texts at a time, and only the stretches' ends, two rows a task, are joined. A null text is empty; an empty text has the
    digest of nothing; repeated rows follow each other and are like; texts of any length are counted whole, block by
    block; further columns are ignored; a single row follows itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that are equal in all respects are told apart, so that very many of them are more than one range
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]
    dealt = rows.repartitionByRange(*order, F.col("row")).sortWithinPartitions(*order, F.col("text")).select("doc_id", "text")
    walked = stored(dealt.mapInArrow(_walk, f"part int, kind int, {_FIELDS}, text string"), "fingerprints")
    parts = sorted(r.part for r in walked.where(F.col("kind") == _HEAD).select("part").collect())  # one for each task that had rows
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    tails = walked.where(F.col("kind") == _TAIL).select("part", "doc_id", "text", "fingerprint").join(following, "part")
    heads = walked.where(F.col("kind") == _HEAD).select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = tails.join(heads, "next").mapInArrow(_ends, _FIELDS)
    return walked.where(F.col("kind") == _DONE).select(*ends.columns).unionByName(ends)
