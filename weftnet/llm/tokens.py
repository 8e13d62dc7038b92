"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces need not be built to be counted. The vocabulary is a trie; each node has a failure
link (where to go on when no edge fits) and the number of pieces that taking that link emits. A word then costs one
step for each byte plus at most as many links. The automaton runs over all distinct words of a batch at once, one byte
position after another, and the counts are summed back by document.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

ROOT, INNER = 0, 1
#: What sentencepiece puts before a word.
MARK = "▁"


@dataclass
class Automaton:
    """step[node, byte] is the child or -1; fail[node] the failure link or -1; popped[node] the pieces it emits.

    Node 0 starts a word unless start says otherwise, node 1 stands after a piece (where continuations begin).
    """

    step: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    start: int = ROOT

    def counts(self, words: pa.Array) -> np.ndarray:
        """Pieces of each word; a word that the vocabulary can't spell counts as one unknown piece."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
        start, size = offsets[:-1], np.diff(offsets)
        order = np.argsort(-size, kind="stable")  # words that are still going on lie in front
        start, size = start[order], size[order]
        node, count = np.full(len(size), self.start, np.int32), np.zeros(len(size), np.int64)
        dead = np.zeros(len(size), bool)
        live = len(size)
        for at in range(int(size[0]) if len(size) else 0):
            while live and size[live - 1] <= at:
                live = int(np.searchsorted(-size, -at, side="left"))
            byte = data[start[:live] + at]
            now = node[:live]
            to = self.step[now, byte]
            stuck = np.flatnonzero((to < 0) & ~dead[:live])
            while len(stuck):
                here = node[stuck]
                link = self.fail[here]
                ended = link < 0
                dead[stuck[ended]] = True
                stuck, here, link = stuck[~ended], here[~ended], link[~ended]
                count[stuck] += self.popped[here]
                node[stuck] = link
                got = self.step[link, byte[stuck]]
                to[stuck] = got
                stuck = stuck[got < 0]
            node[:live] = np.where(dead[:live], node[:live], to)
        going = np.flatnonzero(~dead)  # the end of the word: follow links until a piece boundary
        while len(going):
            here = node[going]
            done = (here == INNER) | (here == ROOT)
            going, here = going[~done], here[~done]
            link = self.fail[here]
            ended = link < 0
            dead[going[ended]] = True
            going, here, link = going[~ended], here[~ended], link[~ended]
            count[going] += self.popped[here]
            node[going] = link
        count[dead] = 1
        out = np.empty_like(count)
        out[order] = count
        return out


def build(starts: Iterable[bytes], inner: Iterable[bytes]) -> Automaton:
    """starts: pieces that begin a word; inner: pieces that go on within one. Links are set breadth first."""
    children: list[dict[int, int]] = [{}, {}]
    whole = [False, False]
    for root, pieces in ((ROOT, starts), (INNER, inner)):
        for piece in pieces:
            node = root
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    whole.append(False)
                node = children[node][byte]
            if node > INNER:
                whole[node] = True
    fail = np.full(len(children), -1, np.int32)
    popped = np.zeros(len(children), np.int64)
    queue = [ROOT, INNER]
    for node in queue:
        for byte, child in children[node].items():
            if whole[child]:
                fail[child], popped[child] = INNER, 1
            else:
                link, emitted = fail[node], popped[node]
                while link >= 0 and byte not in children[link]:
                    emitted += popped[link]
                    link = fail[link]
                if link >= 0:
                    fail[child], popped[child] = children[link][byte], emitted
            queue.append(child)
    step = np.full((len(children), 256), -1, np.int32)
    for node, edges in enumerate(children):
        if edges:
            step[node, list(edges)] = list(edges.values())
    return Automaton(step, fail, popped)


def sentencepiece_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model with their marks, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def sentencepiece_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word pieces from a sentencepiece model: pieces marked as word starts, and all others as continuations."""
    starts, inner = [], []
    for piece in sentencepiece_pieces(path):
        if piece.startswith(MARK):
            starts.append(piece[1:].encode())
        else:
            inner.append(piece.encode())
    return [p for p in starts if p], [p for p in inner if p]


def spelling(pieces: Iterable[bytes]) -> Automaton:
    """The automaton that matches the mark and the word over all pieces; bytes that no piece covers are pieces themselves.

    One trie holds the pieces with their marks, and a word starts at the node behind the mark, so that the bare mark is
    a piece like others and every word has a spelling. Pieces are whole characters, so a single byte is only taken of a
    character that no piece begins with.
    """
    automaton = build((), [*pieces, *(bytes([b]) for b in range(256))])
    node = INNER
    for byte in MARK.encode():
        node = int(automaton.step[node, byte])
    return replace(automaton, start=node)


_loaded: dict[tuple[str, bool], Automaton] = {}


def load(path: str, spelled: bool = False) -> Automaton:
    """The automaton of a vocabulary file, built once in each Python worker (about 100,000 nodes)."""
    if (path, spelled) not in _loaded:
        _loaded[path, spelled] = spelling(p.encode() for p in sentencepiece_pieces(path)) if spelled else build(*sentencepiece_vocabulary(path))
    return _loaded[path, spelled]


def count_tokens(docs: DataFrame, vocabulary: str, spelled: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs: greedy longest-match pieces of its words.

    vocabulary is the path of a sentencepiece model, present on every executor. Words are runs of characters other than
    ASCII white space. Null and empty texts count 0; repeated rows are counted each; further columns are ignored; an
    empty table gives no rows. If spelled, the mark and the word are matched over the full vocabulary, bytes included, so
    that every word has its pieces; otherwise only marked pieces begin words, and one they can't spell counts as one piece.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = load(vocabulary, spelled)
        text = pc.fill_null(batch.column("text"), "")
        words = pc.ascii_split_whitespace(text)
        flat = words.flatten()
        coded = flat.dictionary_encode()
        real = np.asarray(pc.binary_length(coded.dictionary)) > 0  # splitting leaves empty strings at the ends
        lengths = automaton.counts(coded.dictionary)
        at = np.asarray(coded.indices)
        ends = np.asarray(words.value_lengths()).cumsum()
        totals = []
        for each in (real.astype(np.int64), np.where(real, lengths, 0)):
            sums = np.concatenate([[0], each[at].cumsum()])
            totals.append(np.diff(sums[np.concatenate([[0], ends]).astype(np.int64)]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in totals)], names=["doc_id", "n_words", "n_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_words long, n_tokens long")
