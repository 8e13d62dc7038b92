"""Removal of long repeated byte strings with suffix arrays built by induced sorting.

A whole corpus has no shard in which all copies of a string meet, so each window of `length` bytes is dealt by an anchor:
the smallest hash of its k-byte pieces, which is the same wherever the window stands. Runs of windows with one anchor are
segments. Segments with an anchor found once hold no repeat. Of equal segments all but the earliest are repeats as a
whole. Only where an anchor has different segments are their texts needed: these are gathered by anchor into shards,
whose suffix arrays and permuted common prefixes show the windows that start earlier elsewhere.

An anchor with very many segments, as at the edges of a passage that a third of all documents share, would fill a shard by
itself. Such anchors are found first, by counting a seeded share of all entries; their windows are dealt one by one, by a hash of the whole
window, and the smallest place of each is found by reducing within document buckets and then within parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, stored
from .suffixes import induced_sort, permuted_common_prefixes

U = np.uint64
LENGTH = 100
PIECE = 32
#: Bytes of text in a bucket of documents, for a part of anchors, and in a suffix-array shard.
BUCKET_BYTES, PART_BYTES, SHARD_BYTES = 8 << 20, 16 << 20, 2 << 20
#: Entries of one anchor beyond which its windows are dealt one by one; both ways give the same results, so about this many
#: will do, and one entry in COUNTED is counted. Hot anchors up to which their list goes to every task; beyond, it is joined.
MANY, COUNTED, HOT_ANCHORS = 10_000, 64, 200_000
#: What a task reads of a shuffle.
TASK_BYTES = 64 << 20
#: Text that is hashed at once, and text after which a task hands on what it has found.
CHUNK, HELD = 1 << 20, 8 << 20
NO_ID = np.iinfo(np.int64).max


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ U(salt)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


BYTE = np.random.default_rng(100).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each piece of width bytes (a power of two), by doubling."""
    out, size, base = BYTE[data], 1, 0x9E3779B97F4A7C15
    while size < width:
        out = out[:-size] * U(base) + out[size:]
        base, size = base * base % (1 << 64), 2 * size
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of each run of width neighbours."""
    out, size = values, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - size : width - size + n])


def anchors(data: np.ndarray, piece: int = PIECE, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each window of LENGTH bytes the smallest hash of its pieces, and whether it is that of the window's first piece."""
    if len(data) < LENGTH:
        return np.empty(0, U), np.empty(0, bool)
    values = _mix(_rolling(data, piece), salt)
    least = _least(values, LENGTH - piece + 1)
    return least, values[: len(least)] == least


def runs_of(values: np.ndarray, leaves: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of windows with the same anchor at the same (leftmost) place, broken at breaks too."""
    change = np.flatnonzero((values[1:] != values[:-1]) | leaves[:-1]) + 1
    starts = np.unique(np.concatenate([[0], change, breaks])).astype(np.int64)
    return starts, np.diff(np.concatenate([starts, [len(values)]]))


def segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, start, windows, anchor and hash of the segments of documents that lie end to end in data."""
    window, leaves = anchors(data)
    first = np.flatnonzero(ends - begins >= LENGTH)
    empty = np.empty(0, np.int64)
    if not len(first):
        return empty, empty, empty, empty.astype(U), empty.astype(U)
    # windows that cross documents get values of their own, and their runs are left out
    start, size = runs_of(window, leaves, np.concatenate([begins[begins < len(window)], np.maximum(ends - LENGTH + 1, 0)[ends - LENGTH + 1 < len(window)]]))
    doc = np.searchsorted(begins, start, side="right") - 1
    inside = start + size - 1 + LENGTH <= ends[doc]
    start, size, doc = start[inside], size[inside], doc[inside]
    long = _rolling(data, 64)
    last = start + size + LENGTH - 1 - 64
    print_ = ((_mix(long[start]) * U(3) + long[(start + last) // 2]) * U(0x9FB21C651E98DF25) + long[last]) * U(5) + size.astype(U)
    return doc, start - begins[doc], size, window[start], _mix(print_)


FIELDS = (("anchor", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("mark", "<u8"), ("start", "<i4"), ("size", "<i4"))
PLACES = FIELDS[2:]


def _packed(keys: np.ndarray, columns: dict[str, np.ndarray], kind: int, fields: tuple = FIELDS) -> list[dict]:
    """One row for each key that occurs: its entries' columns as bytes."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    out = []
    for a, b in zip(at, [*at[1:], len(keys)], strict=True):
        out.append({"kind": kind, "key": int(keys[a]), "n_bytes": int((columns["size"][order[a:b]] + LENGTH).sum())} | {n: columns[n][order[a:b]].astype(t).tobytes() if n in columns else b"" for n, t in fields})
    return out


def _unpacked(table: pa.Table, fields: tuple = FIELDS) -> dict[str, np.ndarray]:
    return {n: np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in fields}


SCHEMA = "kind int, key long, n_bytes long, " + ", ".join(f"{n} binary" for n, _ in FIELDS)
ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n_bytes", pa.int64()), *((n, pa.binary()) for n, _ in FIELDS)])
SEGMENT, REPEAT, REQUEST, COUNT, WINDOW = 0, 1, 2, 3, 4


def _buckets(doc: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each document (id and text hash), as Spark's pmod(xxhash64(id, hash), n) gives it."""
    if not len(doc):
        return np.empty(0, np.int64)
    order = np.lexsort((row, doc))
    d, r = doc[order].astype(np.int64), row[order].astype(np.int64)
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])
    out = []
    for one, text in zip(d[new].tolist(), r[new].tolist(), strict=True):
        seed = xxhash.xxh64_intdigest(one.to_bytes(8, "little", signed=True), seed=42)
        h = xxhash.xxh64_intdigest(text.to_bytes(8, "little", signed=True), seed=seed)
        out.append((h - (1 << 64) if h >> 63 else h) % n)
    at = np.empty(len(doc), np.int64)
    at[order] = np.array(out, np.int64)[np.cumsum(new) - 1]
    return at


def _joined(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Runs of windows, those that touch within a document joined."""
    order = np.lexsort((columns["start"], columns["mark"], columns["row"], columns["doc"]))
    doc, row, mark, start, size = (columns[n][order] for n in ("doc", "row", "mark", "start", "size"))
    if not len(doc):
        return {"doc": doc, "row": row, "mark": mark, "start": start, "size": size}
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + size[:-1])])
    return {"doc": doc[new], "row": row[new], "mark": mark[new], "start": start[new], "size": np.add.reduceat(size, np.flatnonzero(new))}


def _later(order: np.ndarray, same: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For entries sorted by group and place: does an entry of its group (same: as the one before) lie at an earlier place?"""
    first = np.flatnonzero(~same)
    head = np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    d, s = doc[order], start[order]
    return (d != d[head]) | (s != s[head])


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _row_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each text, to tell rows with the same id apart: 32 as Spark's xxhash64 gives them, and 64 of another seed."""
    texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.array([xxhash.xxh64_intdigest(t, seed=42) & 0xFFFFFFFF for t in texts], np.uint32), np.array([xxhash.xxh64_intdigest(t, seed=7) for t in texts], np.uint64)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column, NO_ID))


def _split(docs: DataFrame, n_parts: int, n_buckets: int) -> DataFrame:
    """Segments by part of their anchors; repeats within what a task holds are already told, by bucket; some entries counted."""
    share = _counted()

    def hand_on(held: list[tuple]) -> pa.Table:
        columns = {n: np.concatenate([h[i] for h in held]) for i, (n, _) in enumerate(FIELDS)} if held else {n: np.empty(0, t) for n, t in FIELDS}
        order = np.lexsort((columns["start"], columns["doc"], columns["print"], columns["anchor"]))
        a, p = columns["anchor"][order], columns["print"][order]
        same = np.concatenate([[False], (a[1:] == a[:-1]) & (p[1:] == p[:-1])]) if len(order) else np.empty(0, bool)
        later = _later(order, same, columns["doc"], columns["start"])
        repeats = _joined({n: columns[n][order[later]] for n, _ in PLACES})
        kept = {n: c[np.sort(order[~later])] for n, c in columns.items()}
        rows = _packed((_mix(kept["anchor"], 1) % U(n_parts)).astype(np.int64), kept, SEGMENT) + _packed(_buckets(repeats["doc"], repeats["row"], n_buckets), repeats, REPEAT)
        drawn = _mix(kept["print"] ^ _mix(kept["doc"].astype(np.uint64), 5) ^ kept["mark"] ^ kept["start"].astype(np.uint64), 6) % U(share) == 0
        anchor, times = np.unique(kept["anchor"][drawn], return_counts=True)
        rows += _packed((_mix(anchor, 1) % U(n_parts)).astype(np.int64), {"anchor": anchor, "size": times}, COUNT)
        return pa.Table.from_pylist(rows, schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = _ids(batch.column("doc_id"))
            data, offsets = _text_bytes(batch.column("text"))
            rows, marks = _row_hashes(data, offsets)
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
                doc, start, n, anchor, print_ = segments(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a])
                held.append((anchor, print_, ids[a:b][doc], rows[a:b][doc], marks[a:b][doc], start, n))
                size += int(offsets[b] - offsets[a])
                a = b
                if size >= HELD:
                    yield from hand_on(held).to_batches()
                    held, size = [], 0
        yield from hand_on(held).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _counted() -> int:
    """One entry in how many is counted: fewer where MANY is small, as in tests."""
    return max(1, min(COUNTED, MANY // 128))


def _hot(counts: DataFrame) -> DataFrame:
    """kind, key, hot, n: for each part that has some, its anchors with more entries than MANY (about, where a share is counted)."""
    share = _counted()
    least = MANY if share == 1 else MANY // (2 * share)

    def run(table: pa.Table) -> pa.Table:
        c = _unpacked(table, (FIELDS[0], FIELDS[-1]))
        anchor, at = np.unique(c["anchor"], return_inverse=True)
        hot = anchor[np.bincount(at, weights=c["size"]) > least]
        found = [{"kind": SEGMENT, "key": table.column("key")[0].as_py(), "hot": hot.astype("<u8").tobytes(), "n": len(hot)}] if len(hot) else []
        return pa.Table.from_pylist(found, schema=pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("hot", pa.binary()), ("n", pa.int64())]))

    return counts.groupBy("key").applyInArrow(run, "kind int, key long, hot binary, n long")


def _apart(split: DataFrame, hot: DataFrame, n_buckets: int) -> DataFrame:
    """split, with segments of its part's hot anchors (sorted) taken out and asked for, by bucket; a mark in print tells them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = r.pop("hot")
                known = np.frombuffer(own or b"", "<u8")
                anchor = np.frombuffer(r["anchor"], "<u8")
                out = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor if own else np.zeros(len(anchor), bool)
                if not out.any():
                    rows.append(r)
                    continue
                c = {n: np.frombuffer(r[n], t) for n, t in FIELDS}
                asked = {n: x[out] for n, x in c.items()}
                asked["print"] = np.ones(out.sum(), np.uint64)
                rows += _packed(np.full((~out).sum(), r["key"]), {n: x[~out] for n, x in c.items()}, SEGMENT)
                rows += _packed(_buckets(asked["doc"], asked["row"], n_buckets), asked, REQUEST)
            yield from pa.Table.from_pylist(rows, schema=ARROW).to_batches()

    return split.join(hot, ["kind", "key"], "left").select(*split.columns, "hot").mapInArrow(run, SCHEMA)


def _compare(split: DataFrame, n_buckets: int) -> DataFrame:
    """By bucket: repeats as a whole, and requests for the texts of different segments with one anchor."""

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows or table.column("kind")[0].as_py() != SEGMENT:
            return table
        c = _unpacked(table)
        order = np.argsort(c["anchor"], kind="stable")
        a = c["anchor"][order]
        twice = np.zeros(len(a), bool)
        twice[1:] = a[1:] == a[:-1]
        twice[:-1] |= twice[1:]
        c = {n: x[order[twice]] for n, x in c.items()}
        order = np.lexsort((c["start"], c["doc"], c["print"], c["anchor"]))
        a, p = c["anchor"][order], c["print"][order]
        new_anchor = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.empty(0, bool)
        new = new_anchor | np.concatenate([[True], p[1:] != p[:-1]]) if len(a) else new_anchor
        later = _later(order, ~new, c["doc"], c["start"])
        group = np.cumsum(new_anchor) - 1
        kinds = np.bincount(group, weights=new).astype(np.int64)[group] if len(a) else np.empty(0, np.int64)
        asked = new & (kinds > 1)
        repeats = _joined({n: c[n][order[later]] for n, _ in PLACES})
        requests = {n: c[n][order[asked]] for n, _ in FIELDS}
        requests["print"] = np.zeros(asked.sum(), np.uint64)
        rows = _packed(_buckets(repeats["doc"], repeats["row"], n_buckets), repeats, REPEAT) + _packed(_buckets(requests["doc"], requests["row"], n_buckets), requests, REQUEST)
        return pa.Table.from_pylist(rows, schema=ARROW)

    return split.groupBy("kind", "key").applyInArrow(run, SCHEMA)


def _windows(data: np.ndarray, at: np.ndarray, c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The windows of segments (at: where they start in data) one by one, told by two hashes of 64 bits."""
    sizes = c["size"].astype(np.int64)
    long = _rolling(data, 64)
    i = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(i)) - np.repeat(sizes.cumsum() - sizes, sizes)
    head, tail = long[at[i] + nth], long[at[i] + nth + LENGTH - 64]
    hashes = {"anchor": _mix(head * U(3) + tail, 11), "print": _mix(head * U(5) + tail * U(0x9FB21C651E98DF25), 12)}
    return hashes | {"doc": c["doc"][i], "row": c["row"][i], "mark": c["mark"][i], "start": c["start"][i].astype(np.int64) + nth, "size": np.ones(len(i), np.int64)}


def _least_place(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Of entries with equal anchor and print the one at the smallest place, and runs of the others."""
    order = np.lexsort((c["start"], c["doc"], c["print"], c["anchor"]))
    a, p = c["anchor"][order], c["print"][order]
    same = np.concatenate([[False], (a[1:] == a[:-1]) & (p[1:] == p[:-1])]) if len(order) else np.empty(0, bool)
    later = _later(order, same, c["doc"], c["start"])
    return {n: x[order[~later]] for n, x in c.items()}, _joined({n: c[n][order[later]] for n, _ in PLACES})


def _gather(bucketed: DataFrame, requests: DataFrame, n_shards: int, n_parts: int, n_buckets: int) -> DataFrame:
    """The texts of requested segments, by shard of their anchors; windows of hot anchors, by part, with repeats within a bucket told."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        c = _unpacked(asked)
        ids = _ids(docs.column("doc_id").combine_chunks())
        data, offsets = _text_bytes(docs.column("text"))
        place = {k: i for i, k in enumerate(zip(ids.tolist(), *(x.tolist() for x in _row_hashes(data, offsets)), strict=True))} if asked.num_rows else {}
        doc = np.array([place[k] for k in zip(c["doc"].tolist(), c["row"].tolist(), c["mark"].tolist(), strict=True)], np.int64)
        at = offsets[doc] + c["start"] if len(doc) else np.empty(0, np.int64)
        hot = c["print"] > 0
        cold = {n: x[~hot] for n, x in c.items()} | {"print": at[~hot]}
        rows = _packed((_mix(cold["anchor"], 2) % U(n_shards)).astype(np.int64), cold, REQUEST)
        for r in rows:
            begins, sizes = np.frombuffer(r["print"], "<u8").astype(np.int64), np.frombuffer(r["size"], "<i4")
            r["print"] = b"".join(data[b : b + n + LENGTH - 1].tobytes() for b, n in zip(begins.tolist(), sizes.tolist(), strict=True))
        if hot.any():
            first, later = _least_place(_windows(data, at[hot], {n: x[hot] for n, x in c.items()}))
            rows += _packed((_mix(first["anchor"], 4) % U(n_parts)).astype(np.int64), first, WINDOW) + _packed(_buckets(later["doc"], later["row"], n_buckets), later, REPEAT)
        return pa.Table.from_pylist(rows, schema=ARROW)

    asked = requests.select(F.col("key").alias("bucket"), *(n for n, _ in FIELDS))
    return bucketed.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, SCHEMA)


def shard_repeats(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segment and window (both as numbers) of each window that starts earlier in another segment of the shard."""
    order = np.lexsort((start, doc, anchor))
    lengths = size[order].astype(np.int64) + LENGTH - 1
    text = np.frombuffer(b"\0".join(texts[i] for i in order.tolist()) + b"\0\0", np.uint8).astype(np.int64) + 2
    begins = np.concatenate([[0], (lengths + 1).cumsum()[:-1]])
    text[begins + lengths] = 1  # between segments; bytes are 2 and above
    text[-1] = 0
    array = induced_sort(text, 258)
    prefix = permuted_common_prefixes(text, array, begins, LENGTH)
    segment = np.searchsorted(begins, array, side="right") - 1
    offset = array - begins[segment]
    group = np.cumsum(prefix[array] < LENGTH)
    whole = offset < size[order][segment]
    group, segment, offset, array = group[whole], segment[whole], offset[whole], array[whole]
    by = np.lexsort((array, group))
    segment, offset = order[segment[by]], offset[by]
    same = np.concatenate([[False], group[by][1:] == group[by][:-1]])
    later = _later(np.arange(len(by)), same, doc[segment], start[segment] + offset)
    return segment[later], offset[later]


def _sort_shards(gathered: DataFrame, n_buckets: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py() if table.num_rows else REPEAT
        if kind == REPEAT:
            return table
        if kind == WINDOW:
            _, found = _least_place(_unpacked(table))
            return pa.Table.from_pylist(_packed(_buckets(found["doc"], found["row"], n_buckets), found, REPEAT), schema=ARROW)
        c = _unpacked(table, (FIELDS[0], *PLACES))
        ends = (c["size"].astype(np.int64) + LENGTH - 1).cumsum()
        data = b"".join(table.column("print").to_pylist())
        texts = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        segment, offset = shard_repeats(c["anchor"], c["doc"], c["start"], c["size"], texts)
        found = _joined({"doc": c["doc"][segment], "row": c["row"][segment], "mark": c["mark"][segment], "start": c["start"][segment] + offset, "size": np.ones(len(segment), np.int64)})
        return pa.Table.from_pylist(_packed(_buckets(found["doc"], found["row"], n_buckets), found, REPEAT), schema=ARROW)

    return gathered.groupBy("kind", "key").applyInArrow(run, SCHEMA)


def covered(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a window that starts in one of the runs."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + sizes - 1 + LENGTH, n), -1)
    return steps.cumsum()[:n] > 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(bucketed: DataFrame, repeats: DataFrame, carry: bool = False) -> DataFrame:
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        c = _unpacked(found, PLACES)
        data, offsets = _text_bytes(docs.column("text"))
        column = docs.column("doc_id").combine_chunks()
        by: dict[tuple[int, int, int], list[int]] = {}
        for i, k in enumerate(zip(c["doc"].tolist(), c["row"].tolist(), c["mark"].tolist(), strict=True)):
            by.setdefault(k, []).append(i)
        out = []
        for i, (doc_id, *key) in enumerate(zip(column.to_pylist(), _ids(column).tolist(), *(x.tolist() for x in _row_hashes(data, offsets)), strict=True)):
            text, hits = data[offsets[i] : offsets[i + 1]], by.get(tuple(key))
            removed = spans = 0
            if hits:
                gone = covered(len(text), c["start"][hits].astype(np.int64), c["size"][hits].astype(np.int64))
                removed, spans = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                text = text[~gone]
            out.append((doc_id, int(offsets[i + 1] - offsets[i]), removed, spans, hashlib.sha256(text.tobytes()).hexdigest()))
        names = [x.split()[0] for x in OUT.split(", ")]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=names)

    return bucketed.groupBy("bucket").cogroup(repeats.select(F.col("key").alias("bucket"), *(n for n, _ in PLACES)).groupBy("bucket")).applyInArrow(run, OUT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a document with a smaller id, or further left
    in the same. Texts are judged as UTF-8 bytes of the input; null texts are empty; matches never cross documents. A null
    id counts as the largest there is, 2^63 - 1. Rows that share an id count as one document, whose places are compared by start; equal rows
    get equal results. Texts of any length are read whole; further columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    bounded_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets, n_parts = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // PART_BYTES))

    def dealt(rows: DataFrame, size: int, *by: str) -> DataFrame:
        """rows shuffled by key into as many tasks as their size asks for."""
        return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)), *by)

    text = F.coalesce("text", F.lit(""))
    row = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))
    bucket = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), row), F.lit(n_buckets))
    bucketed = dealt(docs.select("doc_id", "text", bucket.alias("bucket")), total, "bucket")
    split = stored(_split(docs, n_parts, n_buckets), "segments")
    hot = stored(_hot(split.where(F.col("kind") == COUNT)), "hot-anchors")
    n_hot = hot.agg(F.sum("n")).first()[0] or 0
    split = split.where(F.col("kind") != COUNT)
    if n_hot:
        split = _apart(split, (F.broadcast(hot) if n_hot <= HOT_ANCHORS else hot).drop("n"), n_buckets)
    told = stored(_compare(dealt(split, total, "kind", "key"), n_buckets), "repeats")
    requests, repeats = told.where(F.col("kind") == REQUEST), told.where(F.col("kind") == REPEAT)
    asked = requests.agg(F.sum("n_bytes")).first()[0] or 0
    gathered = _gather(bucketed, dealt(requests, total, "key"), max(1, -(-asked // SHARD_BYTES)), max(1, -(-8 * asked // PART_BYTES)), n_buckets)
    more = _sort_shards(dealt(gathered, 4 * asked, "kind", "key"), n_buckets)
    return _remove(bucketed, dealt(repeats.unionByName(more), total, "key"))
