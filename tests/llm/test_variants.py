"""Spelling variants, structure repair and fingerprints against brute force: nulls, ties, repeated rows, long and empty inputs."""

import hashlib
import heapq
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from weftnet.llm import chat, fingerprints, spelling, structure
from weftnet.llm.structure import BLANK, COPY, CUT

SPACES = " \t\n\x0b\x0c\r"


def letters(text):
    return text[:1] if text[:1] in "sua" else ""


def slow_repair(rows):
    """rows: role, text, fault. Cheapest edits by best-first search over cost and audit."""
    seen, heap = set(), [(0, "", 0, "", ())]
    while True:
        cost, audit, t, last, out = heapq.heappop(heap)
        if (t, last) in seen:
            continue
        seen.add((t, last))
        if t == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(out)
        put = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[put]
        heapq.heappush(heap, (cost + 3, audit + "I", t, put, (*out, f"{name}:")))
        if t < len(rows):
            role, text, fault = rows[t]
            heapq.heappush(heap, (cost + 4, audit + "D", t + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", t + 1, put, (*out, f"{name}:{text}")))
                if letters(role) == put or (letters(role), last) == ("s", ""):
                    heapq.heappush(heap, (cost + more, audit + "K", t + 1, letters(role), (*out, f"{role}:{text}")))


def slow_structure(rows):
    """All that repair returns, for rows (conv_id, turn, role, text) as they are before the damage."""
    of = {}
    for conv_id, turn, role, text in rows:
        own = of.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv_id, own in of.items():
        judged, said = [], set()
        for *_, role, text in sorted(own):
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in said else "truncated" if bare[-1] not in ".!?" else ""
            said.add((role, text))
            judged.append((role, text, fault))
        turns = sorted(t for known, t, *_ in own if known)
        gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
        faults = Counter(f for *_, f in judged)
        illegal = sum(letters(a[0]) + letters(b[0]) not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, text = slow_repair(judged)
        out[conv_id] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_cheapest_edits():
    rnd = random.Random(3)
    flags = {"": 0, "blank": BLANK, "duplicate": COPY, "truncated": CUT}
    cases = [
        [(rnd.choice(["user", "assistant", "system", "x", "user", "assistant"]), f"t{j}", rnd.choice(["", "", "", *flags])) for j in range(rnd.choice([0, 1, 2, 3, 5, 8, 13, 30]))]
        for _ in range(600)
    ]
    codes = [np.array([{"s": 1, "u": 2, "a": 3}.get(r[0][0], 0) + flags[r[2]] for r in rows], np.uint8) for rows in cases]
    cost, audits = structure.cheapest(codes)
    for rows, own, c, audit in zip(cases, codes, cost, audits, strict=True):
        stay = [(role, text) for role, text, fault in rows if fault not in ("blank", "duplicate")]
        assert (c, audit, "\n".join(line for _, line in structure.repaired(own.tolist(), stay, audit))) == slow_repair(rows)


@pytest.mark.parametrize("piece", [4096, 5])
def test_structure_odd_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(structure, "PIECE", piece)
    rnd = random.Random(1)
    texts = [None, "", " \n", "a.", "b", "c!", "c?", "d\n", "e. \t", "é"]
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, *range(-2, 6)]), rnd.choice([None, "user", "assistant", "system", "", "x", "umpire"]), rnd.choice(texts)) for _ in range(150)]
    rows += rows[:20]
    rows += [(9, t, ("user", "assistant")[t % 2], f"{t % 40}.") for t in range(300)]  # one holds more than a third of all rows
    rows += [(k, k % 7, rnd.choice(["user", "assistant"]), "w" * (5000 if k == 50 else 3) + ".") for k in range(20, 120)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, code int, place string")
    got = structure.repair(structure.damaged(df)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == slow_structure(rows) and len(got) == len({r[0] for r in rows})


def test_structure_extremes(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert structure.repair(structure.damaged(spark.createDataFrame([], schema))).isEmpty()
    (gone,) = [t for t in range(60) if zlib.crc32(f"5:{t}".encode()) % 20 == 0][:1]
    rows = [(5, gone, "user", "a."), (6, None, None, None)]
    assert {r.conv_id: tuple(r)[1:] for r in structure.repair(structure.damaged(spark.createDataFrame(rows, schema))).collect()} == slow_structure(rows)


def slow_words(rows, damage=31, shortest=7):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                out[run] += 1
    return out


def slow_variants(counts, alphabet):
    out = {}
    for word, n in counts.items():
        around = {word[:i] + c + word[j:] for i in range(len(word) + 1) for c in ("", *alphabet) for j in (i, i + 1) if j <= len(word)} - {word}
        near = sorted((-counts[x], x) for x in around if x in counts)
        best = near[0] if near and -near[0][0] >= 10 * n else (None, None)
        out[word] = [best[1], n, len(near), best[0] and -best[0]]
    for word, row in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


@pytest.mark.parametrize(("hot", "leaf", "shard"), [(50_000, 1024, 20_000), (3, 16, 100)])
def test_variants(spark, monkeypatch, hot, leaf, shard):
    for name, value in (("HOT", hot), ("LEAF", leaf), ("SHARD", shard)):
        monkeypatch.setattr(spelling, name, value)
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(2, 11))) for _ in range(700)} | {"ab" * 60, "ab" * 60 + "é", "ab" * 59 + "a", "a", "é"}
    words |= {"aaaabbbb" + "".join(rnd.choice("abé") for _ in range(4)) for _ in range(200)}  # many share their first half
    counts = {w: rnd.choice([2, 2, 3, 25, 260, 26]) for w in sorted(words)}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 5, "x"), ("aaaabbbbbbbbb", 1, "x")], "word string, n long, shard string")
    got = spelling.variants(df).collect()
    expected = slow_variants({w: n for w, n in counts.items() if len(w) > 1}, "abé") | {w: (None, w, counts[w], 0, None) for w in ("a", "é")}
    assert {r.word: tuple(r)[1:] for r in got} == expected and len(got) == len(counts)


def test_word_counts(spark):
    rnd = random.Random(6)
    runs = ["".join(rnd.choice("ABcdéß×Ā日") for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    rows = [(None if i == 3 else i, rnd.choice(" 1.\n").join(rnd.choices(runs, k=40))) for i in range(40)] + [(50, None), (51, ""), (52, "Long" * 3000), (4, "Abcdefg abcdefg"), (4, "Abcdefg abcdefg")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.word_counts(df, damage=31).collect()} == slow_words(rows)
    assert spelling.variants(spelling.word_counts(df.limit(0), damage=31)).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_fingerprints(spark, monkeypatch, n):
    rnd = random.Random(n)
    texts = [None, "", "a", "ab", "日本語", "é" * 50_000] + ["".join(rnd.choice("abcé日 ") for _ in range(rnd.randint(0, 400))) for _ in range(n)]
    rows = [(None if i % 9 == 5 else i % 50, texts[i]) for i in range(n)]
    rows += rows[:10] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars int, mark string").repartition(5)
    got = fingerprints.fingerprints(df).collect()
    assert len(got) == len(rows)
    order = {(r.doc_id, r.text): r.mark for r in df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS mark").collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), order[r]))
    expected = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        k = len(text) // 3
        new = text[: len(text) - k] + following[:k]
        own, other, next_ = (fingerprints.digest(t) for t in (text, new, following))
        expected.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), other.hex(), fingerprints.likeness(own, other), fingerprints.likeness(own, next_)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_digest(monkeypatch):
    rnd = random.Random(2)
    data = bytes(rnd.randrange(256) for _ in range(1000))
    slow = np.zeros(256, np.int64)
    for at in range(len(data)):
        for kind, (i, j) in enumerate(fingerprints.TRIPLETS):
            if at + j < len(data):
                slow[(((kind << 24) + (data[at] << 16) + (data[at + i] << 8) + data[at + j]) * 2654435761 % 2**32) >> 24] += 1
    for block in (1 << 20, 7):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        assert (fingerprints.bucket_counts(data) == slow).all()
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    other = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    own = fingerprints.digest(text)
    assert fingerprints.likeness(own, own) == 1 and fingerprints.difference(own, fingerprints.digest("")) >= 0
    assert 1 > fingerprints.likeness(own, fingerprints.digest(text[:-90] + "x" * 90)) > fingerprints.likeness(own, fingerprints.digest(other)) >= 0


def test_streamed_events_fold_back(spark):
    rnd = random.Random(8)
    texts = [None, "", "a", "日本", "<|im_end|>\n\\", "é" * 501]
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, *range(4)]), rnd.choice([None, "user", "assistant", "x\ny"]), rnd.choice(texts), 7, "z") for _ in range(60)]
    turns = spark.createDataFrame(rows + rows[:5], "conv_id long, turn long, role string, text string, seq int, kind string")
    log = chat.streamed(turns)
    assert log.count() == 6 * len(rows + rows[:5]) and {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    plain, through = (sorted(chat.format_chats(turns, of).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0)) for of in (chat.events_of, chat.streamed))
    assert plain == through
    assert chat.format_chats(turns.limit(0), chat.streamed).isEmpty()


@pytest.mark.parametrize("name", ["op11_spelling", "op12_structure", "op13_fingerprints"])
def test_queries_against_sql(spark, name):
    import os

    import duckdb

    from weftnet.llm import queries

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, expected = queries.queries()[name](spark, folder), con.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    rows = Counter(tuple(r[c] for c in names) for r in got.collect())
    assert rows == Counter(tuple(r[expected.columns.index(c)] for c in names) for r in expected.fetchall()) and rows
