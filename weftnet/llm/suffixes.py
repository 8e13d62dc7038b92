"""Suffix arrays of shards by induced sorting, and their permuted common prefixes.

induced_sort classifies suffixes, sorts the leftmost-smaller substrings, names them, recurses on the names and induces the
whole array. A text of bytes is induced one character bucket at a time with NumPy, its substrings likewise, so that a step
costs some tens of nanoseconds for each suffix. Below, where almost every name has a bucket of its own, the substrings are
ranked character by character with NumPy, and the array is induced entry by entry.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last suffix (an end below all else) counts as such."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    if len(differs):
        up = text[differs] < text[differs + 1]
        runs = np.diff(np.concatenate([[-1], differs]))
        smaller[: differs[-1] + 1] = np.repeat(up, runs)
        smaller[differs[-1] + 1 : -1] = False
    return smaller


def _placed(text: np.ndarray, order: np.ndarray, ends: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """An array with sorted leftmost-smaller suffixes at the tails of their buckets and free elsewhere, and their numbers."""
    out = np.full(len(text), free, np.int64)
    first_of = np.bincount(text[order], minlength=len(ends))
    out[np.repeat(ends - first_of, first_of) + np.arange(len(order)) - np.repeat(first_of.cumsum() - first_of, first_of)] = order
    return out, first_of


def _induce_by_entry(text: np.ndarray, smaller: np.ndarray, order: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The array induced from sorted leftmost-smaller suffixes, one entry after another."""
    n = len(text)
    ends = counts.cumsum()
    # the bucket to which an entry sends the suffix before it: -1 if that is of the other kind, or if there is none
    before = np.concatenate([[-1], text[:-1], [-1]])
    kind = np.concatenate([[False], smaller[:-1], [False]])
    larger = np.where(kind, -1, before).tolist()
    small = np.where(kind, before, -1).tolist()
    out = _placed(text, order, ends, n)[0].tolist()
    head = (ends - counts).tolist()
    for j in out:  # reads what it has just written further on
        c = larger[j]
        if c >= 0:
            h = head[c]
            out[h] = j - 1
            head[c] = h + 1
    tail = ends.tolist()
    for j in reversed(out):
        c = small[j]
        if c >= 0:
            h = tail[c] - 1
            out[h] = j - 1
            tail[c] = h
    return np.array(out, np.int64)


def _ranked_substrings(text: np.ndarray, smaller: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings at starts (ascending), equal ones alike: ties are broken character by character.

    Of equal characters one that begins a larger suffix comes first, so that equal substrings are equally long.
    """
    lengths = np.diff(np.concatenate([starts, [len(text) - 1]])) + 1
    keys = 2 * text + smaller
    base, k = int(keys.max()) + 1, 0
    rank, tied = np.zeros(len(starts), np.int64), np.arange(len(starts))
    while len(tied):  # rank is the number of smaller substrings, as far as the first k characters tell
        told = rank[tied] * base + keys[starts[tied] + k]
        order = np.argsort(told, kind="stable")
        tied, told = tied[order], told[order]
        new = np.concatenate([[True], told[1:] != told[:-1]])
        group = rank[tied]
        begin = np.concatenate([[True], group[1:] != group[:-1]])
        nth = np.arange(len(tied)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
        rank[tied] = group + nth[new][np.cumsum(new) - 1]
        k += 1
        sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(tied)]]))
        tied = tied[np.repeat(sizes > 1, sizes) & (lengths[tied] > k)]
    return rank


def _spread(text: np.ndarray, found: np.ndarray, head: np.ndarray, out: np.ndarray, step: int) -> None:
    """Puts found, in order, at the heads (step 1) or tails (step -1) of the buckets of their characters."""
    chars = text[found]
    order = np.argsort(chars, kind="stable")
    found, chars = found[order], chars[order]
    first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(chars)]]))
    within = np.arange(len(chars)) - np.repeat(first, sizes)
    used = chars[first]
    if step > 0:
        out[np.repeat(head[used], sizes) + within] = found
        head[used] += sizes
    else:
        out[np.repeat(head[used], sizes) - 1 - within] = found
        head[used] -= sizes


def _induce_by_bucket(text: np.ndarray, smaller: np.ndarray, order: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same with whole buckets: what a bucket induces lies in later buckets, or in itself for a run of its character."""
    n = len(text)
    ends = counts.cumsum()
    out, first_of = _placed(text, order, ends, -1)  # sorted suffixes are grouped by first character
    head = ends - counts
    for c in np.flatnonzero(counts).tolist():
        at, low = int(ends[c] - counts[c]), int(ends[c] - first_of[c])
        while at < head[c]:  # larger suffixes at the front of the bucket
            stop = int(head[c])
            found = out[at:stop] - 1
            found = found[found >= 0]
            found = found[~smaller[found]]
            if len(found):
                _spread(text, found, head, out, 1)
            at = stop
        found = out[low : ends[c]] - 1
        found = found[found >= 0]
        found = found[~smaller[found]]
        if len(found):
            _spread(text, found, head, out, 1)
    tail = ends.copy()
    for c in np.flatnonzero(counts)[::-1].tolist():
        at = int(ends[c])
        while at > tail[c]:
            stop = int(tail[c])
            found = out[stop:at][::-1] - 1
            found = found[found >= 0]
            found = found[smaller[found]]
            if len(found):
                _spread(text, found, tail, out, -1)
            at = stop
        found = out[ends[c] - counts[c] : tail[c]][::-1] - 1
        found = found[found >= 0]
        found = found[smaller[found]]
        if len(found):
            _spread(text, found, tail, out, -1)
    return out


def _same_substrings(text: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For neighbours in order: is the leftmost-smaller substring equal to the one before it? starts: all, ascending."""
    nth = np.zeros(len(text), np.int64)
    nth[starts] = np.arange(len(starts))
    lengths = np.diff(np.concatenate([starts, [len(text) - 1]])) + 1
    a, b = order[:-1], order[1:]
    size = lengths[nth[b]]
    same = np.concatenate([[False], lengths[nth[a]] == size])
    going = np.flatnonzero(same[1:])
    k = 0
    while len(going):
        going = going[size[going] > k]
        differs = text[a[going] + k] != text[b[going] + k]
        same[going[differs] + 1] = False
        going = going[~differs]
        k += 1
    return same


def induced_sort(text: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array of text, integers below alphabet whose last one is 0 and found nowhere else."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _types(text)
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(text, minlength=alphabet)
    if alphabet <= 512:
        induce = _induce_by_bucket
        found = induce(text, smaller, starts[np.argsort(text[starts], kind="stable")], counts)
        is_start = np.zeros(n, bool)
        is_start[starts] = True
        found = found[is_start[found]]
        names = np.cumsum(~_same_substrings(text, found, starts)) - 1
    else:
        induce = _induce_by_entry
        rank = _ranked_substrings(text, smaller, starts)
        order = np.argsort(rank, kind="stable")
        found, rank = starts[order], rank[order]
        names = np.cumsum(np.concatenate([[True], rank[1:] != rank[:-1]])) - 1 if len(rank) else rank
    if len(names) and names[-1] + 1 < len(found):
        name_of = np.zeros(n, np.int64)
        name_of[found] = names
        found = starts[induced_sort(name_of[starts], int(names[-1]) + 1)]
    return induce(text, smaller, found, counts)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray, begins: np.ndarray, limit: int) -> np.ndarray:
    """For each position the common prefix, up to limit, with the suffix before it in the array.

    A position keeps all but one of its left neighbour's common prefix, so the texts between begins are walked from left
    to right, all of them at once.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    prefix = np.zeros(n, np.int64)
    sizes = np.diff(np.concatenate([begins, [n]]))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    held = np.zeros(len(begins), np.int64)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -k, side="left"))
        at = begins[:live] + k
        other = before[at]
        now = np.where(other < 0, 0, np.maximum(held[:live] - 1, 0))
        going = np.flatnonzero(other >= 0)
        while len(going):
            x, y = at[going] + now[going], other[going] + now[going]
            ok = (now[going] < limit) & (x < n) & (y < n)
            going, x, y = going[ok], x[ok], y[ok]
            equal = text[x] == text[y]
            going = going[equal]
            now[going] += 1
        held[:live] = now
        prefix[at] = now
    return prefix
