"""Conversation structure repair: cheapest edits that make turns alternate, by dynamic programming over time-major tensors.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant turns. Conversations
are bucketed by length; the costs of all conversations of a bucket are updated turn by turn from the end, kept, and then
followed from the beginning, each time taking the least letter that stays on a cheapest path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import SLICE_BYTES, bounded_batches, stored

#: States are what the last turn was: none yet, system, user, assistant; FOLLOW is the state after a turn that is put in.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = np.array([USER, USER, ASSISTANT, USER])
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: KEPT[state, initial] is the state after keeping a turn whose role begins so (0: another letter), or -1.
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 40
END = np.array([0, 2 * INSERT, INSERT, 0])  # inserts that close a conversation

#: A row's code: its role's initial in two bits, and flags; rows to drop only show that their conversation exists.
BLANK, COPY, CUT, NO_TURN, GONE = 4, 8, 16, 32, 64
#: Rows of a conversation that are handed on together; one with more is worked on in pieces. Cells of a bucket's tensors.
PIECE, CELLS = 4096, 1 << 20


def _buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of conversations of similar length, so many that their tensors have CELLS cells at most, one at least."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        low = lengths[order[start]]
        while stop < len(order) and lengths[order[stop]] <= max(4, low + low // 4) and (stop - start + 1) * (lengths[order[stop]] + 1) <= CELLS:
            stop += 1
        yield order[start:stop]
        start = stop


def cheapest(codes: list[np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """Cost and audit of each conversation: least cost, then least letters (Delete, Insert, Keep, Rerole)."""
    cost, audits = np.zeros(len(codes), np.int64), [""] * len(codes)
    for own in _buckets(np.array([len(c) for c in codes], np.int64)):
        n, most = len(own), max(len(codes[i]) for i in own)
        length = np.array([len(codes[i]) for i in own])
        code = np.zeros((most, n), np.int64)  # time first
        for k, i in enumerate(own):
            code[: len(codes[i]), k] = codes[i]
        initial, must, cut = code & 3, (code & (BLANK | COPY)) > 0, np.where(code & CUT, TRUNCATED, 0)
        back = np.empty((most + 1, n, 4), np.int64)  # costs from a turn and state to the end
        back[most] = END
        for t in range(most - 1, -1, -1):
            now = back[t + 1]
            to = KEPT[:, initial[t]].T
            keep = np.where(to < 0, NEVER, np.take_along_axis(now, np.maximum(to, 0), 1))
            stay = np.where(must[t][:, None], NEVER, np.minimum(keep, REROLE + now[:, FOLLOW]) + cut[t][:, None])
            row = np.minimum(DELETE + now, stay)
            row = np.minimum(row, np.minimum(INSERT + row[:, FOLLOW], 2 * INSERT + row[:, FOLLOW[FOLLOW]]))
            back[t] = np.where((t < length)[:, None], row, END)
        cost[own] = back[0, :, NONE]
        letters = np.zeros((most + 1, 3, n), np.uint8)
        each, state = np.arange(n), np.full(n, NONE)
        for t in range(most + 1):
            open_ = np.ones(n, bool)
            for slot in range(3):
                cost_here = back[t, each, state]
                going = open_ & (t < length)
                delete = going & (DELETE + back[min(t + 1, most), each, state] == cost_here)
                insert = open_ & ~delete & (t <= length) & (INSERT + back[t, each, FOLLOW[state]] == cost_here)
                rest = going & ~delete & ~insert
                to = KEPT[state, initial[min(t, most - 1)]] if most else np.full(n, -1)
                keep = rest & (to >= 0) & ~must[min(t, most - 1)] if most else rest
                if keep.any():
                    keep &= back[t + 1, each, np.maximum(to, 0)] + cut[t] == cost_here
                rerole = rest & ~keep
                letters[t, slot] = np.select([delete, insert, keep, rerole], [68, 73, 75, 82], 0)
                state = np.where(insert | rerole, FOLLOW[state], np.where(keep, to, state))
                open_ = insert
                if not open_.any():
                    break
        flat = letters.transpose(2, 0, 1).reshape(n, -1)
        for k, i in enumerate(own):
            audits[i] = flat[k][flat[k] > 0].tobytes().decode("ascii")
    return cost, audits


def measured(codes: np.ndarray, turns: np.ndarray) -> tuple[int, int, int, int, int]:
    """gaps, blank, duplicate, truncated, illegal of one conversation's rows in order."""
    known = turns[(codes & NO_TURN) == 0]
    gaps = int(known[-1]) - int(known[0]) - int(np.count_nonzero(np.diff(known))) if len(known) else 0
    pair = (codes[:-1] & 3) * 4 + (codes[1:] & 3)
    legal = np.isin(pair, (SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER))
    return (min(gaps, (1 << 63) - 1), *(int(np.count_nonzero(codes & bit)) for bit in (BLANK, COPY, CUT)), int(np.count_nonzero(~legal)))


def repaired(codes: Iterable[int], lines: Iterable[tuple[str, str]], audit: str, state: int = NONE) -> Iterator[tuple[int, str]]:
    """State and `role:text` of each turn that stays; lines: role and text of the rows that need not be deleted."""
    codes, lines = iter(codes), iter(lines)
    for letter in audit:
        if letter == "I":
            state = int(FOLLOW[state])
            yield state, f"{NAMES[state]}:"
            continue
        code = next(codes)
        role, text = ("", "") if code & (BLANK | COPY) else next(lines)
        if letter == "K":
            state = int(KEPT[state, code & 3])
            yield state, f"{role}:{text}"
        elif letter == "R":
            state = int(FOLLOW[state])
            yield state, f"{NAMES[state]}:{text}"


@dataclass
class _Rows:
    """Rows of one conversation as they come."""

    conv_id: int | None
    codes: list[int] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    size: int = 0

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.codes, np.uint8), np.array(self.turns, np.int64)


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIELDS = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_PIECE = [("part", pa.int32()), ("at", pa.int64()), ("codes", pa.binary()), ("turns", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
_WALKED = pa.schema([*_FIELDS, *_PIECE])


def _solved(whole: list[_Rows]) -> pa.RecordBatch:
    arrays = [r.arrays() for r in whole]
    cost, audits = cheapest([c for c, _ in arrays])
    rows = []
    for r, (codes, turns), c, audit in zip(whole, arrays, cost, audits, strict=True):
        text = "\n".join(line for _, line in repaired(r.codes, zip(r.roles, r.texts, strict=True), audit))
        rows.append((r.conv_id, *measured(codes, turns), int(c), audit, hashlib.sha256(text.encode()).hexdigest(), *[None] * len(_PIECE)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _WALKED, strict=True)], schema=_WALKED)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition: results of those that lie in it, pieces of the first, the last and the long ones."""
    part, at = TaskContext.get().partitionId(), 0
    done: list[_Rows] = []
    held = 0
    now: _Rows | None = None
    edge = True  # may have begun in another partition, or has left pieces already

    def piece(r: _Rows) -> pa.RecordBatch:
        nonlocal at
        at += 1
        codes, turns = r.arrays()
        row = {"conv_id": r.conv_id, "part": part, "at": at, "codes": codes.tobytes(), "turns": turns.tobytes(), "roles": r.roles, "texts": r.texts}
        return pa.RecordBatch.from_pylist([row], schema=_WALKED)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "code", "copies"))
        for conv_id, turn, role, text, code, copies in zip(*columns, strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    if edge:
                        yield piece(now)
                    else:
                        done.append(now)
                        held += now.size
                        if held > SLICE_BYTES or len(done) >= PIECE:
                            yield _solved(done)
                            done, held = [], 0
                    edge = False
                now = _Rows(conv_id)
            if code & GONE:
                continue
            for _ in range(copies):
                now.codes.append(code)
                now.turns.append(turn or 0)
                now.size += 16
                if not code & (BLANK | COPY):
                    now.roles.append(role)
                    now.texts.append(text)
                    now.size += len(text)
                    code = code & ~CUT | COPY  # further copies
                if len(now.codes) >= PIECE or now.size > SLICE_BYTES:
                    yield piece(now)
                    now, edge = _Rows(conv_id), True
    if done:
        yield _solved(done)
    if now is not None:
        yield piece(now)


def _gathered(key: tuple, batch: pa.Table) -> pa.Table:
    """One conversation's pieces, without texts: a row for each piece with its edits, and one (at 0) for the whole."""
    batch = batch.sort_by([("part", "ascending"), ("at", "ascending")])
    codes = [np.frombuffer(x, np.uint8) for x in batch.column("codes").to_pylist()]
    turns = [np.frombuffer(x, np.int64) for x in batch.column("turns").to_pylist()]
    every = np.concatenate(codes)
    (cost,), (audit,) = cheapest([every])
    letters = np.frombuffer(audit.encode(), np.uint8)
    ends = np.flatnonzero(letters != ord("I")) + 1  # of each row's letters
    cuts = [0, *(int(ends[k - 1]) if k else 0 for k in np.cumsum([len(c) for c in codes])[:-1]), len(audit)]
    rows, state = [], NONE
    for p, a, own, start, stop in zip(batch.column("part").to_pylist(), batch.column("at").to_pylist(), codes, cuts[:-1], cuts[1:], strict=True):
        rows.append({"part": p, "at": a, "state": state, "audit": audit[start:stop]})
        for state, _ in repaired(own.tolist(), iter(lambda: ("", ""), None), audit[start:stop], state):  # noqa: B007, B020
            pass
    whole = dict(zip(("gaps", "blank", "duplicate", "truncated", "illegal"), measured(every, np.concatenate(turns)), strict=True))
    rows.append({"conv_id": batch.column("conv_id")[0].as_py(), "at": 0, "audit": audit, "cost": int(cost), **whole})
    return pa.Table.from_pylist(rows, schema=pa.schema([*_FIELDS[:8], ("part", pa.int32()), ("at", pa.int64()), ("state", pa.int32())]))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            made = [line for _, line in repaired(r["codes"], zip(r["roles"], r["texts"], strict=True), r["edits"], r["state"])]
            rows.append({"conv_id": r["conv_id"], "part": r["part"], "at": r["at"], "n": len(made), "text": "\n".join(made)})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("text", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's pieces, which come in order; holds one batch at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    started, conv_id, known, began = False, None, hashlib.sha256(), False
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if started and r["conv_id"] != conv_id:
                rows.append({"conv_id": conv_id, "repaired_sha256": known.hexdigest()})
                known, began = hashlib.sha256(), False
            started, conv_id = True, r["conv_id"]
            if r["n"]:
                known.update(("\n" if began else "").encode() + r["text"].encode())
                began = True
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if started:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "repaired_sha256": known.hexdigest()}], schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, gone: the rows as the test damages them, by a hash of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"), (F.col("kind") == 0).alias("gone"),
    )


def _coded(rows: DataFrame) -> DataFrame:
    """Equal rows counted, each with its code; a row is a copy if an earlier turn has its role and text."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    flag = lambda bit, when: F.when(when, bit).otherwise(0)
    initial: Column = F.coalesce(*(F.when(F.left("role", F.lit(1)) == c, k) for k, c in ((SYSTEM, "s"), (USER, "u"), (ASSISTANT, "a"))), F.lit(0))
    each = rows.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.sum("copies").alias("copies")).select(
        "*", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")).alias("place"), (bare == "").alias("blank"),
        (initial + flag(BLANK, bare == "") + flag(CUT, ~F.right(bare, F.lit(1)).isin(".", "!", "?") & (bare != "")) + flag(NO_TURN, F.col("turn").isNull()) + flag(GONE, F.col("gone"))).alias("code"),
        F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role"), "role", "text"), 256).alias("mark"),
    )
    said = each.where(~F.col("gone") & ~F.col("blank")).groupBy("mark").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("mark", "first")
    late = F.coalesce(F.col("place") > F.col("first"), F.lit(False)) & ~F.col("blank") & ~F.col("gone")
    return each.join(said, "mark", "left").select("conv_id", "turn", "role", "text", F.when(late, F.col("code").bitwiseAND(F.lit(127 - CUT)).bitwiseOR(F.lit(COPY))).otherwise(F.col("code")).alias("code"), "copies")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text, copies, gone): faults, cost, audit, hash of the repair.

    Rows are taken by turn, null first, those of one turn by role and text; gone rows only name their conversation, and copies
    says how often a row stands there. Null ids form a conversation of their own; a conversation without rows has zeros, no
    edits and the hash of nothing. Roles may be any text, those beginning with s, u or a count as system, user, assistant.

    Rows are dealt by ranges of that order, so a conversation of any length is spread over tasks. What lies within one task is
    repaired there; of conversations that reach over a task's ends or have over PIECE rows, codes (a byte a row) are gathered,
    and their texts pass one task as a stream of pieces, since a hash of the whole is asked for.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    order = ["conv_id", "turn", "role"]
    dealt = _coded(rows).repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    pieces = "part int, at long, codes binary, turns binary, roles array<string>, texts array<string>"
    walked = stored(dealt.mapInArrow(_walk, f"{_RESULT}, {pieces}"), "structure")
    whole = walked.where("at is null").select(*(n for n, _ in _FIELDS))
    open_ = walked.where("at is not null")
    solved = open_.select("conv_id", "part", "at", "codes", "turns").groupBy("conv_id").applyInArrow(_gathered, f"{_RESULT.rpartition(',')[0]}, part int, at long, state int")
    solved = stored(solved, "structure-pieces")
    edits = solved.where("at > 0").select("part", "at", "state", F.col("audit").alias("edits"))
    texts = open_.select("conv_id", "part", "at", "codes", "roles", "texts").join(edits, ["part", "at"])
    made = texts.mapInArrow(_lines, "conv_id long, part int, at long, n long, text string")
    hashes = made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    ends = solved.where("at = 0").drop("part", "at", "state")
    hashes = hashes.withColumnRenamed("conv_id", "id")
    return whole.unionByName(ends.join(hashes, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id"))
