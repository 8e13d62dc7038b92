"""Packing token sequences by non-negative least squares over the histogram of lengths.

Each input partition packs what it reads, in runs of bounded size, so that nothing is shuffled and a lost task is simply
run again. A document's full windows become sequences of their own. For the rests the histogram of lengths is known; the
columns of a sparse matrix are shallow combinations, of one or two lengths repeated a few times, that fill a window exactly
(or a power of two, which needs no padding); non-negative least squares, solved to a tolerance, gives how often to use
each; the counts are rounded. What is then left is packed greedily end to end, and cut where a window is full. At the end of a partition the last window is
cut at powers of two where padding would be larger than a threshold.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, releasing, slices

WINDOW = 4096
END = 2
#: Tokens that one run holds before it packs them (2 bytes each where the vocabulary allows).
RUN_TOKENS = 4 << 20
#: Text that is tokenized at once.
TOKENIZED_BYTES = 2 << 20
#: Words whose ids a Python worker remembers.
MEMO_WORDS = 300_000
#: Characters that are sure to end a piece of letters for the tokenizer, so that head and tail have ids of their own.
HEAD_TAIL = r"^(?P<head>[A-Za-z0-9À-ÖØ-öø-ÿ]+)(?P<tail>[.,#%&*$|]*)$"
LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _byte_characters() -> dict[int, str]:
    """For str.translate: letters above ASCII as the characters that stand for their UTF-8 bytes in byte-level BPE.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    shown = [chr(b) if b in printable else chr(next(others)) for b in range(256)]
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


BYTE_CHARACTERS = _byte_characters()


class WordIds:
    """Ids of texts by a tokenizer that never joins across white space: each distinct word is encoded once.

    Words of letters alone go straight to the model. The others are encoded together through the whole tokenizer, with a
    special token between them as a mark.
    """

    def __init__(self, path: str, mark: str = "<|endoftext|>") -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark, self.mark_id = mark, self.tokenizer.token_to_id(mark)
        self.memo: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        """An empty memo; row 0 is the empty word."""
        self.memo = {"": 0}
        self.flat, self.ends = [np.empty(0, np.uint16)], [0]

    def encode_each(self, words: list[str]) -> list[np.ndarray]:
        one = lambda text: np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
        out: list[np.ndarray] = []
        for i in range(0, len(words), 1024):
            part = words[i : i + 1024]
            if any("<|" in w for w in part):
                out += [one(w) for w in part]
                continue
            ids = one(f" {self.mark} ".join(part))
            out += [x if k == 0 else x[1:] for k, x in enumerate(np.split(ids, np.flatnonzero(ids == self.mark_id)))]
        return out

    def rows(self, words: pa.Array) -> np.ndarray:
        """The row of each word in the memo, encoding those that are new."""
        listed = words.to_pylist()
        new = [w for w in listed if w not in self.memo]
        other = [w for w in new if not LETTERS.fullmatch(w)]
        known = dict(zip(other, self.encode_each(other), strict=True))
        memo, ends, flat, tokenize = self.memo, self.ends, [], self.model.tokenize
        end = ends[-1]
        for w in new:
            if w in known:
                ids = known[w].tolist()
            else:
                ids = [t.id for t in tokenize(w if w.isascii() else w.translate(BYTE_CHARACTERS))]
            memo[w] = len(ends)
            flat += ids
            end += len(ids)
            ends.append(end)
        self.flat.append(np.array(flat, np.uint16))
        return np.fromiter(map(memo.__getitem__, listed), np.int64, len(listed))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has. White space as the tokenizer sees it splits words."""
        if len(self.memo) > MEMO_WORDS:
            self.reset()
        words = pc.ascii_split_whitespace(text)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        parts = pc.extract_regex(distinct, HEAD_TAIL)
        head = pc.coalesce(pc.struct_field(parts, "head"), distinct)
        tail = pc.fill_null(pc.struct_field(parts, "tail"), "")
        plain = pc.is_valid(parts)
        head = pc.if_else(plain, pc.utf8_lower(head), head).dictionary_encode()
        tail = tail.dictionary_encode()
        head_row = self.rows(head.dictionary)[np.asarray(head.indices)]
        tail_row = self.rows(tail.dictionary)[np.asarray(tail.indices)]
        flat, ends = np.concatenate(self.flat), np.array(self.ends, np.int64)
        self.flat, self.ends = [flat], self.ends
        begins = np.concatenate([[0], ends[:-1]])
        use = np.stack([head_row, tail_row], axis=1)[np.asarray(coded.indices)].ravel()
        size = (ends - begins)[use]
        upto = size.cumsum()
        total = int(upto[-1]) if len(upto) else 0
        at = np.arange(total) + np.repeat(begins[use] - (upto - size), size)
        per_text = np.concatenate([[0], upto])[2 * np.concatenate([[0], np.asarray(words.value_lengths()).cumsum()]).astype(np.int64)]
        return flat[at], np.diff(per_text)


#: A combination holds so many documents at most, of two lengths at most.
SHALLOW = 4
#: Least squares is solved until no count, moved alone, would move by more than this.
TOLERANCE = 0.02


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """All shallow combinations of lengths at hand that fill a window (or half or a quarter of it) exactly.

    A row for each: i, j, how often i, how often j; i and j are places in lengths, and j is used 0 times where one length
    is enough. Every combination of i < j documents whose numbers the histogram allows is listed.
    """
    place = np.full(window + 1, -1, np.int64)
    place[lengths] = np.arange(len(lengths))
    nth = np.arange(len(lengths))
    out = [np.empty((0, 4), np.int64)]
    for goal in (window, window // 2, window // 4):
        for a in range(1, SHALLOW + 1):
            alone = nth[(lengths * a == goal) & (counts >= a)]
            out.append(np.stack([alone, alone, np.full(len(alone), a), np.zeros(len(alone), np.int64)], axis=1))
            for b in range(1, SHALLOW - a + 1):
                rest = goal - a * lengths
                i = nth[(rest > 0) & (rest % b == 0) & (counts >= a)]
                j = place[rest[i] // b]
                fits = (j > i) & (counts[j] >= b)
                i, j = i[fits], j[fits]
                out.append(np.stack([i, j, np.full(len(i), a), np.full(len(i), b)], axis=1))
    return np.concatenate(out)


def non_negative_least_squares(columns: np.ndarray, counts: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, where A[l, c] is how often column c uses length l, two entries at most.

    Accelerated projected gradients, started again whenever they turn back. Done when no variable, moved alone to where
    it fits best, would move by more than the tolerance.
    """
    i, j, a, b = columns.T
    down = lambda x: np.bincount(i, a * x, len(counts)) + np.bincount(j, b * x, len(counts))
    up = lambda r: a * r[i] + b * r[j]
    y = counts.astype(np.float64)
    scale = np.maximum(up(down(np.ones(len(columns)))), 1.0)  # row sums of A'A: as a diagonal they majorise it
    x = ahead = np.zeros(len(columns))
    pace, rounds = 1.0, 0
    while True:
        new = np.maximum(ahead - up(down(ahead) - y) / scale, 0)
        if ((ahead - new) * (new - x)).sum() > 0:
            pace = 1.0
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, x, pace, rounds = new + (pace - 1) / following * (new - x), new, following, rounds + 1
        if rounds % 8 == 0 and np.abs(np.maximum(x - up(down(x) - y) / (a * a + b * b), 0) - x).max() < tolerance:
            return x


def plan(rests: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Groups of documents whose rests fill a window or a power of two exactly, and the documents left over.

    Solved counts are rounded to the nearest; the largest come first, and a column is used while its lengths last.
    """
    lengths, place = np.unique(rests, return_inverse=True)
    counts = np.bincount(place, minlength=len(lengths))
    columns = combinations(lengths, counts, window)
    groups: list[list[int]] = []
    queue: list[list[int]] = [[] for _ in lengths]
    for d, k in enumerate(place.tolist()):
        queue[k].append(d)
    if len(columns):
        solved = non_negative_least_squares(columns, counts)
        times = np.floor(solved + 0.5).astype(np.int64)
        used = np.flatnonzero(times)
        for c in used[np.argsort(-solved[used], kind="stable")].tolist():
            i, j, a, b = columns[c].tolist()
            for _ in range(min(int(times[c]), len(queue[i]) // a, len(queue[j]) // b if b else len(rests))):
                groups.append([queue[i].pop() for _ in range(a)] + [queue[j].pop() for _ in range(b)])
    return groups, sorted(d for q in queue for d in q)


class Packer:
    """Packs the runs of one partition; what a run leaves open goes into the next."""

    def __init__(self, window: int, first_sequence: int, least_fill: float) -> None:
        self.window, self.next, self.least_fill = window, first_sequence, least_fill
        self.rows: dict[str, list] = defaultdict(list)
        self.open: list[tuple] = []  # pieces of the window that is being filled: doc, start, total, ids
        self.filled = 0

    def piece(self, doc, start: int, total: int, ids: np.ndarray, sequence: int, offset: int) -> None:
        row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)
        for name, value in zip(COLUMNS, row, strict=True):
            self.rows[name].append(value)

    def sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.piece(doc, start, total, ids, self.next, offset)
            offset += len(ids)
        self.next += 1

    def stream(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        """Appends to the open window, cutting where it is full."""
        while len(ids):
            part = ids[: self.window - self.filled]
            self.open.append((doc, start, total, part))
            self.filled += len(part)
            start, ids = start + len(part), ids[len(part) :]
            if self.filled == self.window:
                self.sequence(self.open)
                self.open, self.filled = [], 0

    def run(self, docs: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = sizes.cumsum()
        begins = ends - sizes
        full = sizes // self.window * self.window
        for d in np.flatnonzero(full).tolist():
            for start in range(0, int(full[d]), self.window):
                self.sequence([(docs[d], start, int(sizes[d]), ids[begins[d] + start : begins[d] + start + self.window])])
        rest = np.flatnonzero(sizes > full)
        rest_of = lambda k: (docs[d := int(rest[k])], int(full[d]), int(sizes[d]), ids[begins[d] + full[d] : ends[d]])
        groups, left = plan((sizes - full)[rest], self.window)
        for group in groups:
            self.sequence([rest_of(k) for k in group])
        for k in left:
            self.stream(*rest_of(k))

    def close(self) -> None:
        """The last window: padded if nearly full, else cut into powers of two, the last part padded if it is small."""
        while self.filled:
            size = self.window if self.filled >= self.least_fill * self.window else 1 << (self.filled.bit_length() - 1)
            if size >= self.filled:
                self.sequence(self.open)
                self.open, self.filled = [], 0
                return
            taken, rest, need = [], [], size
            for doc, start, total, ids in self.open:
                if need:
                    taken.append((doc, start, total, ids[:need]))
                if len(ids) > need:
                    rest.append((doc, start + need, total, ids[need:]))
                need = max(0, need - len(ids))
            self.sequence(taken)
            self.open, self.filled = rest, self.filled - size

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.rows[c], pa.int64()) for c in COLUMNS], names=list(COLUMNS))
        self.rows.clear()
        return out


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_tokenizers: dict[str, WordIds] = {}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END, run_tokens: int = RUN_TOKENS, least_fill: float = 0.97) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer is the path of a word-level BPE file (white space never inside a token), present on every executor.
    Null texts count as empty and give one piece with the end id alone; repeated rows are packed each, under the same
    doc_id; null ids stay null; further columns are ignored; an empty table gives no rows. Texts of any length are
    tokenized whole. Sequence ids are unique: the partition's number times 2^33 plus a counter.
    """

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordIds(tokenizer)
        words = _tokenizers[tokenizer]
        packer = Packer(window, TaskContext.get().partitionId() << 33, least_fill)
        docs_held: list = []
        ids_held, sizes_held, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs_held, ids_held, sizes_held, held
            if docs_held:
                packer.run(docs_held, np.concatenate(ids_held), np.concatenate(sizes_held))
            docs_held, ids_held, sizes_held, held = [], [], [], 0
            return packer.batch()

        for batch in batches:
            for part in slices(batch, "text", TOKENIZED_BYTES):
                ids, sizes = words.encode(pc.fill_null(part.column("text"), ""))
                ends = sizes.cumsum()
                ids_held.append(np.insert(ids, ends, end_id))
                sizes_held.append(sizes + 1)
                docs_held += part.column("doc_id").to_pylist()
                held += len(ids_held[-1])
                if held >= run_tokens:
                    yield flush()
        yield flush()
        packer.close()
        yield packer.batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), ", ".join(f"{c} long" for c in COLUMNS))
