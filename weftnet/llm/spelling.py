"""Spelling variants: words within one edit of each other, found by Aho-Corasick automata over halves of words.

One edit leaves a word's first or its second half whole, at the beginning or at the end of the other word. Automaton shards
hold the halves of every word; every word is scanned by the shards in which its own beginning and end can lie, matches are
held against offset and length, and what remains is verified. Where very many words share a half, the rest of the word is
halved again, so that no group is compared pair by pair.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, cut_lineage, stored

#: Letters of a word.
LETTER = "[A-Za-zÀ-ÿ]"
#: Keys (six a word) in a shard; words of one segment above which the segment is made longer before rows are dealt.
SHARD, HOT = 20_000, 50_000
#: Pairs of a group from which on its words are halved again, and pairs that are verified at once.
LEAF, PAIRS = 1024, 1 << 18
#: A word with this many times the occurrences of a near word is that word's form.
TIMES = 10
#: Stands for no prefix length.
NOWHERE = 1 << 30


def word_counts(docs: DataFrame, damage: int | None = None, shortest: int = 7) -> DataFrame:
    """word, n: the lower-cased (A-Z only) runs of letters of docs with at least shortest characters, and their occurrences.

    With damage, a run loses a letter where damage divides the CRC-32 of `doc_id:run`, the one at that number modulo its length; a
    null id counts as an empty one. Words are combined in each task before they are shuffled. Null and empty texts have no
    words; repeated rows count each; further columns are ignored; an empty table gives no rows.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    if damage:
        low = low.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        low = low.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("word")).alias("word"))
    return low.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))


def _segment(a: Column, b: Column) -> Column:
    """The beginning of a and the end of b characters of a word."""
    return F.concat(F.substr("word", F.lit(1), a), F.lit(" "), F.when(b > 0, F.right("word", b)).otherwise(""))


def _keys(words: DataFrame) -> DataFrame:
    """word, n, L, a, b, skip: segments by which a word meets words of length L, its own among them.

    Such a word w keeps its first a and its last b characters in the other; pairs that agree in at least skip first characters
    are found by another key. Keys that hold over HOT words are cut: the part between the segments is halved, and one half joined
    to either.
    """
    length = F.length("word")
    each = [F.struct((length + d).alias("L"), *(x.alias(c) for c, x in zip(("a", "b", "skip"), of((length + d)), strict=True)))
            for d in (-1, 0, 1) for of in (lambda m: (F.floor(m / 2).cast("int"), F.lit(0), F.lit(NOWHERE)), lambda m: (F.lit(0), m - F.floor(m / 2).cast("int"), F.floor(m / 2).cast("int")))]
    rows = words.select("word", "n", F.explode(F.array(*each)).alias("k")).select("word", "n", "k.*").where("L > 1")
    key = F.xxhash64("L", "a", "b", _segment(F.col("a"), F.col("b")))
    gap = F.col("L") - F.col("a") - F.col("b")
    while True:
        own = rows.where((length == F.col("L")) & (gap > 1))
        hot = own.groupBy(key.alias("key")).count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
        hot = cut_lineage(hot)
        if hot.isEmpty():
            return rows.withColumn("key", key)
        tagged = rows.withColumn("key", key).join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)) & (gap > 1))
        c = F.floor(gap / 2).cast("int")
        longer = F.struct(F.col("L"), (F.col("a") + c).alias("a"), F.col("b"), F.col("skip"))
        later = F.struct(F.col("L"), F.col("a"), (F.col("b") + gap - c).alias("b"), F.least("skip", F.col("a") + c).alias("skip"))
        cut = tagged.where("hot").select("word", "n", F.explode(F.array(longer, later)).alias("k")).select("word", "n", "k.*")
        rows = cut_lineage(tagged.where("not hot").select("word", "n", "L", "a", "b", "skip").unionByName(cut))


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words from the left and from the right, padded with 0, and lengths."""
    width = max(map(len, words))
    left, right = (np.array([pad(w, width, "\0") for w in words], f"<U{width}").view(np.uint32).reshape(-1, width) for pad in (str.ljust, str.rjust))
    if left.max(initial=0) < 256:
        left, right = left.astype(np.uint8), right.astype(np.uint8)
    return left, right, np.array([len(w) for w in words])


def _agreed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many columns agree from the first on."""
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def _hashed(cells: np.ndarray) -> np.ndarray:
    out = np.full(len(cells), 1469598103934665603, np.uint64)
    for k in range(cells.shape[1]):
        out = (out ^ cells[:, k].astype(np.uint64)) * np.uint64(1099511628211)
    return out


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal rows, 0 up, and the place of one row of each."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, (c[order][1:] != c[order][:-1] for c in columns))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _pairs(words: list[str], row: np.ndarray, group: np.ndarray, L: np.ndarray, a: np.ndarray, b: np.ndarray, skip: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (v, w), numbers of words: rows of a group (whose L, a, b, skip are given) with its words of length L.

    Groups with over LEAF pairs are halved until they have less or one character is left, and then verified.
    """
    left, right, length = _matrices(words)
    width = left.shape[1]
    while len(row):
        own = length[row] == L[group]
        n, m = np.bincount(group, minlength=len(L)), np.bincount(group[own], minlength=len(L))
        gap = L - a - b
        halve = (n * m > LEAF) & (gap > 1)
        leaf = ~halve[group] & (m[group] > 0)
        v, g = row[leaf], group[leaf]
        order = np.argsort(group[own], kind="stable")
        ws, first = row[own][order], np.cumsum(m) - m
        ends = np.cumsum(m[g])
        start = 0
        while start < len(v):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
            many = m[g[start:stop]]
            x = np.repeat(v[start:stop], many)
            inner = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
            y = ws[np.repeat(first[g[start:stop]], many) + inner]
            most, least = np.maximum(length[x], length[y]), np.minimum(length[x], length[y])
            front = np.minimum(_agreed(left[x], left[y]), least)
            keep = (x != y) & (front < np.repeat(skip[g[start:stop]], many))
            x, y, front, most, least = x[keep], y[keep], front[keep], most[keep], least[keep]
            back = np.minimum(_agreed(right[x][:, ::-1], right[y][:, ::-1]), least)
            near = front + back >= most - 1
            if near.any():
                yield x[near], y[near]
            start = stop
        on = halve[group]
        row, group = row[on], group[on]
        if not len(row):
            return
        c = gap // 2
        one, two = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
        for shape in {(int(a[k]), int(b[k]), int(gap[k])) for k in np.unique(group)}:
            k = np.flatnonzero((a[group] == shape[0]) & (b[group] == shape[1]) & (gap[group] == shape[2]))
            half, stop = shape[2] // 2, width - shape[1]
            one[k] = _hashed(left[row[k], shape[0] : shape[0] + half])
            two[k] = _hashed(right[row[k], stop - (shape[2] - half) : stop])
        branch = np.repeat(np.array([0, 1]), len(row))
        row, parent, seen = np.concatenate([row, row]), np.concatenate([group, group]), np.concatenate([one, two])
        group, at = _numbered(seen, branch, parent)
        old, later = parent[at], branch[at] == 1
        L, a, b, skip = (
            L[old], np.where(later, a[old], a[old] + c[old]), np.where(later, b[old] + gap[old] - c[old], b[old]), np.where(later, np.minimum(skip[old], a[old] + c[old]), skip[old])
        )


def _matched(words: list[str], row: np.ndarray, L: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers of the segments at its word's beginning (a characters) and end (b), -1 where none is known.

    The automaton holds the segments of the words that have the row's length themselves; every word is scanned by it once.
    """
    automaton = ahocorasick.Automaton()
    known: dict[str, int] = {}
    for i, l_, p, q in zip(row.tolist(), L.tolist(), a.tolist(), b.tolist(), strict=True):
        word = words[i]
        if len(word) == l_:
            for s in (word[:p], word[l_ - q :]):
                if s and s not in known:
                    automaton.add_word(s, (len(known), len(s)))
                    known[s] = len(known)
    width = max(map(len, words)) + 2
    found: tuple[list[int], list[int]] = ([], [])
    ids: tuple[list[int], list[int]] = ([], [])
    if known:
        automaton.make_automaton()
        for i, word in enumerate(words):
            last = len(word) - 1
            for end, (number, size) in automaton.iter(word):
                if end == size - 1:
                    found[0].append(i * width + size)
                    ids[0].append(number)
                if end == last:
                    found[1].append(i * width + size)
                    ids[1].append(number)
    out = []
    for sizes, keys, numbers in ((a, found[0], ids[0]), (b, found[1], ids[1])):
        keys, numbers = np.array([*keys, 1 << 62]), np.array([*numbers, -1])
        order = np.argsort(keys)
        want = row * width + sizes
        at = order[np.searchsorted(keys, want, sorter=order)]
        out.append(np.where(sizes == 0, -2, np.where(keys[at] == want, numbers[at], -1)))
    return out[0], out[1]


def _shard(table: pa.Table) -> pa.Table:
    """For each word of a shard the near words found here: how many, and the one with most occurrences, least if tied."""
    coded = table.column("word").combine_chunks().dictionary_encode()
    words = coded.dictionary.to_pylist()
    row = np.asarray(coded.indices).astype(np.int64)
    L, a, b, skip, n = (table.column(c).to_numpy().astype(np.int64) for c in ("L", "a", "b", "skip", "n"))
    times = np.zeros(len(words), np.int64)
    times[row] = n
    rank = np.asarray(pc.rank(coded.dictionary, sort_keys="ascending", tiebreaker="first")).astype(np.int64)
    prefix, suffix = _matched(words, row, L, a, b)
    met = (prefix != -1) & (suffix != -1)
    vs, ws = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    band = np.frexp(L)[1]  # words of very different lengths in matrices of their own
    for k in np.unique(band[met]):
        mine = np.flatnonzero(met & (band == k))
        used, local = np.unique(row[mine], return_inverse=True)
        group, at = _numbered(suffix[mine], prefix[mine], skip[mine], b[mine], a[mine], L[mine])
        for v, w in _pairs([words[i] for i in used], local, group, *(x[mine][at] for x in (L, a, b, skip))):
            vs.append(used[v])
            ws.append(used[w])
    v, w = np.concatenate(vs), np.concatenate(ws)
    order = np.lexsort((rank[w], -times[w], v))
    v, w = v[order], w[order]
    head = np.flatnonzero(np.diff(v, prepend=-1))
    count = np.diff(np.append(head, len(v)))
    take = lambda i: coded.dictionary.take(pa.array(i))
    return pa.table({"word": take(v[head]), "n_near": pa.array(count, pa.int64()), "near_n": pa.array(times[w[head]], pa.int64()), "near": take(w[head])})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near: of each word (word, n; distinct) with near words how many it has, and the most frequent one.

    Near is one inserted, deleted or replaced character; ties go to the least word in code-point order. Words have at least two
    characters; shorter and null ones are near none.
    """
    spark = words.sparkSession
    bounded_batches(spark)
    keys = _keys(words.where(F.length("word") > 1))
    shards = max(1, 6 * words.count() // SHARD)
    rows = keys.select(F.pmod("key", F.lit(shards)).alias("shard"), "word", "n", "L", "a", "b", "skip")
    found = rows.groupBy("shard").applyInArrow(_shard, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain that begins with each word's form (word, form); steps double every round."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = cut_lineage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def variants(counts: DataFrame, least: int = 2) -> DataFrame:
    """Words (word, n) with at least least occurrences, each with its form and root: word, form, root, n, n_near, form_n.

    The form is the near word with most occurrences (ties: least in code-point order) if it has TIMES those of the word; the
    root is the last of the chain of forms, or the word. Null words and counts are left out; an empty table gives no rows.
    """
    words = stored(counts.where((F.col("n") >= least) & F.col("word").isNotNull()).select("word", "n"), "spelling-words")
    near = stored(near_words(words), "spelling-near")
    joined = words.join(near, "word", "left").withColumn("formed", F.coalesce(F.col("near_n") >= TIMES * F.col("n"), F.lit(False)))
    ended = roots(joined.where("formed").select("word", F.col("near").alias("form")))
    form = lambda c: F.when(F.col("formed"), F.col(c))
    return joined.join(ended, "word", "left").select(
        "word", form("near").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form("near_n").alias("form_n")
    )
