"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftnet.llm import chat, components, mixing, neardup, neighbours, packing, personal, quality, queries, repeats, suffixes, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def random_texts(n, seed=1, vocabulary=400):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéßİ日.,1") for _ in range(rnd.randint(1, 8))) for _ in range(vocabulary)]
    return [rnd.choice(" \n\t").join(rnd.choices(words, k=rnd.randint(0, 300))) for _ in range(n)]


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(random_texts(60, 3))
    texts = [None, "", " \n ", "one", "one two", long, long, "same same same", "same same same", *random_texts(30, 4)]
    rows = [(None if i == 3 else i, t, None, None if i % 7 == 0 else f"s{i % 3}", None, 1, 2, "x") for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1]]
    return spark.createDataFrame(rows, DOCS + ", size int, taken int, bucket string")


def test_mix_targets_and_reruns(spark):
    docs = documents(spark, random_texts(400, 9))
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(docs_text(docs)[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]
        by[r.doc_id % 5].append(r)
    assert abs(sum(r[0].target for r in by.values()) - 1.5 * total) < 1e-6 * total
    for own in by.values():
        taken, size = sum(r.taken for r in own), sum(r["size"] for r in own)
        assert own[0].source_size == size and abs(taken - own[0].target) <= max(60, 0.01 * own[0].target)


def docs_text(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def slow_quotients(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(seats):
        free = [i for i, v in enumerate(votes) if v and out[i] < caps[i]]
        out[max(free, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))] += 1
    return out


def slow_fill(sizes, weights, share=1.5, most=2):
    targets, free = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n}
    while free:
        level = (share * sum(sizes) - sum(t for i, t in enumerate(targets) if i not in free)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] >= most * sizes[i]}
        targets = [most * sizes[i] if i in over else level * weights[i] if i in free else t for i, t in enumerate(targets)]
        if not over:
            break
        free -= over
    return targets


def test_water_fill_and_quotients(spark, monkeypatch):
    rnd = random.Random(5)
    cases = [([10, 10], [5, 2]), ([0, 4], [5, 2]), ([], []), ([0, 0], [5, 2])]
    cases += [([rnd.choice([0, 3, 70, 900]) for _ in range(n)], [rnd.choice([5, 2, 1]) for _ in range(n)]) for n in (9, 40)]
    for sizes, weights in cases:
        table = spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "i int, size long, weight double")
        got = [r.target for r in mixing.water_fill(table, "size", "weight").orderBy("i").collect()]
        assert got == pytest.approx(slow_fill(sizes, weights))
    for many in (mixing.SORTED, 1):
        monkeypatch.setattr(mixing, "SORTED", many)
        for _ in range(3):
            votes = [rnd.choice([0.0, 1.0, 7.0, 30.0, 31.5, 400.0]) for _ in range(rnd.randint(1, 12))]
            caps = [rnd.randint(0, 60) for _ in votes]
            seats = rnd.randint(0, sum(c for c, v in zip(caps, votes, strict=True) if v))
            table = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(votes, caps, strict=True))], "i int, votes double, cap long")
            got = [r.seats for r in mixing.highest_quotients(table, "i", "votes", "cap", seats).orderBy("i").collect()]
            assert got == slow_quotients(votes, seats, caps), (votes, seats, caps)


@pytest.mark.parametrize("broadcast", [100_000, 10])
def test_mix_many_sources(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    n = 100_000
    docs = spark.range(3 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % n != 7, F.format_string("s%06d", F.col("id") % n)).alias("source"), F.repeat(F.lit("w "), (1 + F.col("id") % 40).cast("int")).alias("text"))
    start = time.perf_counter()
    out = mixing.mix(docs).groupBy((F.col("doc_id") % n).alias("s")).agg(F.sum("size").alias("size"), F.first("source_size").alias("known"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert time.perf_counter() - start < 60
    assert len(out) == n and all(r.known == r["size"] and r.over <= 0 and abs(r.taken - r.target) <= 2 for r in out)
    sizes = {r.s: r["size"] for r in out}
    order = [i for i in range(n) if i != 7] + [7]
    expected = slow_fill([sizes[i] for i in order], [(5, 2, 1)[k % 3] for k in range(n)])
    got = {r.s: r.target for r in out}
    assert [got[i] for i in order] == pytest.approx(expected)


def test_apportion_is_sainte_lague(spark):
    rnd = random.Random(8)
    rows, expected = [], {}
    for g in range(6):
        votes, seats = [rnd.choice([1, 2, 3, 50]) for _ in range(rnd.randint(1, 9))], rnd.randint(0, 90)
        rows += [(g, i, v, seats) for i, v in enumerate(votes)]
        expected |= {(g, i): n for i, n in enumerate(slow_quotients(votes, seats, [10**6] * len(votes)))}
    out = mixing.apportion(spark.createDataFrame(rows, "g int, i int, v long, seats long"), "g", "i", "v", "seats").collect()
    assert {(r.g, r.i): r.quota for r in out} == expected


def test_mix_odd_rows(spark, odd):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert mixing.mix(odd.limit(0)).count() == 0
    rows = mixing.mixed_rows(odd.select(*[c.split()[0] for c in DOCS.split(", ")]))
    assert sum(len(WORD.findall(r.text)) for r in rows.collect()) == sum(r.taken for r in out)


PLANTED = "Call Anna +1 (663) 555-6869 or mail a.b@mail.example.com, host 10.0.0.256 and 8.8.8.8; card 4539 5787 6362 1486 now"


def plain_spans(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 16 <= len(digits) <= 19 and luhn(digits) else []
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_plain_expressions():
    rnd = random.Random(2)
    for _ in range(4000):
        text = "".join(rnd.choice("a@.1 2-+(0)%é٣") for _ in range(rnd.randint(0, 40)))
        assert personal.base_spans(text) == plain_spans(text), text
    assert [k for k, *_ in personal.base_spans(PLANTED)] == ["email", "ip", "card", "phone"]
    assert personal.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []


def test_context_reveals_identifiers(spark):
    texts = [f"filler words contact: user{i}@mail.example.com today" for i in range(8)]
    texts += ["please contact: QX-77812-ZB today", "the number 123456 stands elsewhere", "again qx-77812-zb without context", None]
    rows = {r.doc_id: r for r in personal.report(documents(spark, texts)).collect()}
    assert rows[8].spans == "id:16:27" and rows[10].spans == "id:6:17" and rows[9].spans == "" and rows[11].spans == ""
    assert rows[0].n_email == 1 and rows[0].base_sha256 == hashlib.sha256(rows[0].spans.encode()).hexdigest()
    clean = {r.doc_id: r for r in personal.masked(documents(spark, texts)).collect()}
    assert clean[8].text == "please contact: [ID] today" and clean[0].text.startswith("filler words contact: [EMAIL]")
    assert clean[8].n_chars == len(clean[8].text) and clean[9].text == texts[9] and clean[11].text is None


def test_context_goes_on_until_it_settles(spark):
    texts = [f"pone u{chr(97 + i)}@mail.example" for i in range(26)] + [f"pone aaaaa{1000 + j}" for j in range(3)]
    for word, known, new, times in (("ptwo", "aaaaa", "bbbbb", 10), ("pthree", "bbbbb", "ccccc", 20), ("pfour", "ccccc", "ddddd", 40), ("pfive", "ddddd", "eeeee", 80)):
        texts += [f"{word} {known}{1000 + j}" for j in range(3)] * times + [f"{word} {new}{1000 + j}" for j in range(3)]
    texts.append("nothing fffff1000")
    rows = {r.doc_id: r.found for r in personal.find(documents(spark, texts)).collect()}
    assert all(bool(rows[i]) == ("@" not in t and "fffff" not in t) for i, t in enumerate(texts))


def plain_bootstrap(texts):
    """Found forms by brute force: every pattern of every word, round after round."""
    totals, near, seeds = Counter(), defaultdict(Counter), set()
    for t in texts:
        totals.update(w.lower() for w in (t or "").split())
        for m in personal.mentions(t or "", personal.base_spans(t or "")):
            if m["seed"]:
                seeds.add(m["form"])
            for side in ("left", "right"):
                if m[side]:
                    near[side, m[side]][m["form"]] += 1
    forms = {f for c in near.values() for f in c}
    score = {f: float(f in seeds) for f in forms}
    while True:
        told = defaultdict(list)
        for (_, word), c in near.items():
            known = {f: n for f, n in c.items() if score[f] >= 0.6}
            hits = sum(n * score[f] for f, n in known.items())
            if len(known) >= 3 and hits / max(totals[word], hits) >= 0.6:
                for f in c:
                    told[f].append(hits / max(totals[word], hits))
        new = {f: 1.0 if f in seeds else 1 - float(np.prod([max(1 - x, 1e-6) for x in told[f]])) for f in forms}
        settled = not any(new[f] >= 0.6 > score[f] for f in forms) and max((new[f] - score[f] for f in forms), default=0) <= 1e-3
        score = new
        if settled:
            return {f for f in forms if f not in seeds and score[f] >= 0.6}


def test_bootstrap_equals_brute_force(spark):
    rnd = random.Random(23)
    texts = [None, ""]
    data = {
        "mail": lambda: f"u{rnd.randrange(30)}@m.example" if rnd.random() < 0.85 else f"AB-XY-{rnd.randrange(12)}",
        "id:": lambda: f"AB-XY-{rnd.randrange(12)}" if rnd.random() < 0.9 else f"030 {rnd.randrange(6):04d} 77",
        "(see": lambda: rnd.choice(["8.8.8.8", "word", f"{rnd.randrange(40):06d}"]),
        "host": lambda: rnd.choice(["8.8.8.8", "9.9.9.9", "7.7.7.7", "AB-XY-3", "030 0001 77"]),
        "lorem": lambda: rnd.choice(["ipsum", "dolor", "123456"]),
    }
    for _ in range(160):
        words = [f"{m} {data[m]()}{rnd.choice(['', ',', ' fin'])}" for m in rnd.choices(list(data), k=rnd.randint(0, 9))]
        texts.append(rnd.choice([" ", "  ", "\n"]).join(words))
    expected, rows = plain_bootstrap(texts), {r.doc_id: r for r in personal.find(documents(spark, texts)).collect()}
    got = {texts[i][s["start"] : s["end"]].lower() for i, r in rows.items() for s in r.found}
    assert got == expected and expected
    for i, t in enumerate(texts):
        known = [(m["start"], m["end"]) for m in personal.mentions(t or "", personal.base_spans(t or "")) if not m["seed"] and m["form"] in expected]
        assert sorted((s["start"], s["end"]) for s in rows[i].found) == sorted(known)


def test_context_is_whole_words_and_groups():
    long = "w" * 5000
    text = f"{long} 030 1234567, {long}X (555 12 34) AB-XY-12\n12 34 56 78 9"
    base = personal.base_spans(text)
    got = {(text[m["start"] : m["end"]], m["left"], m["right"]) for m in personal.mentions(text, base)}
    assert got == {("030 1234567", long, (long + "X").lower()), ("555 12 34", (long + "X").lower(), "ab-xy-12"), ("AB-XY-12", "34)", "12"), ("12 34 56 78 9", "ab-xy-12", None)}
    for hostile in ("(1" * 300_000, "1 " * 300_000, "a@b.c," * 100_000, "!" * 300_000 + " 123456 " + "!" * 300_000, "12(" * 200_000 + " 5"):
        start = time.perf_counter()
        personal.mentions(hostile, personal.base_spans(hostile))
        assert time.perf_counter() - start < 8


def test_masking_keeps_any_columns(spark):
    rows = [(1, "mail a@b.example now", 1, "s", 2, 3, 4), (1, "mail a@b.example now", 1, "s", 2, 3, 4), (None, "a@b.example", 5, None, 6, 7, 8), (None, None, 5, None, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, text_hash string, weft_hash int, weft_id int, row int")
    got = sorted(map(tuple, personal.masked(docs).collect()), key=str)
    assert got == sorted([(r[0], r[1] and r[1].replace("a@b.example", "[EMAIL]"), *r[2:]) for r in rows], key=str)


def test_personal_odd_rows(spark, odd):
    assert personal.report(odd).count() == odd.count() and personal.report(odd.limit(0)).count() == 0
    assert sorted(map(str, personal.masked(odd).collect())) == sorted(map(str, odd.withColumn("n_chars", F.length("text").cast("long")).collect()))


def test_chat_round_trip(spark):
    rnd = random.Random(4)
    alphabet = ["<|im_end|>\n", "<|im_start|>", "\\", "|", "<", "<|", "\n", "a", "é", "<|nl|>", "assistant"]
    text = lambda: "".join(rnd.choices(alphabet, k=rnd.randint(0, 12)))
    rows = [(c, t, rnd.choice(["user", "assistant", text(), None]), rnd.choice([text(), None])) for c in range(40) for t in range(rnd.randint(1, 6))]
    rows += [(99, 0, "user", "x"), (99, 0, "user", "x"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    expected = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        expected[c].append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == expected
    assert {r.conv_id: r.loss for r in out} == {c: "".join(x for r, x in ts if r == "assistant") for c, ts in expected.items()}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_of_long_texts_and_odd_columns(spark):
    long = "<|im_end|>\n\\ é " * 60_000
    rows = [(1, 0, "user", "hi", 7, "x", 1, "p"), (1, 1, "assistant", long, 7, "x", 1, "p"), (2, 0, "assistant", None, 7, None, 1, "p"), (2, 0, "assistant", None, 7, None, 1, "p")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int, kind string, copy int, formatted string")
    out = {r.conv_id: r for r in chat.format_chats(turns).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "hi"), ("assistant", long)] and out[1].loss == long
    assert [tuple(t) for t in out[2].turns] == [("assistant", "")] * 2 and out[2].loss == ""
    log = spark.createDataFrame([(1, 0, 0, "delta", None, None, "y")], "conv_id long, seq long, turn long, kind string, role string, text string, log string")
    assert [tuple(r) for r in chat.fold(log).collect()] == [(1, 0, "", "")] and chat.fold(log.limit(0)).count() == 0


def test_chat_folds_events(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "He"), (1, 2, 1, "delta", None, "llo"), (1, 3, 2, "message", "user", "bye"),
        (1, 4, 1, "regenerate", None, ""), (1, 5, 1, "delta", None, "Hey"), (1, 6, 0, "edit", None, "hi!"), (1, 7, 2, "message", "user", "more"),
        (2, 0, 0, "message", "user", "a"), (2, 1, 1, "message", "user", "b"), (2, 2, 1, "delete", None, None), (3, 0, 1, "message", "user", "x"), (3, 1, 0, "regenerate", "assistant", "y"),
    ]
    out = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in out] == [(1, 0, "user", "hi!"), (1, 1, "assistant", "Hey"), (1, 2, "user", "more"), (2, 0, "user", "a"), (3, 0, "assistant", "y")]


def test_warc_links_and_text(spark):
    page = '<html><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- <a href="/no"> --><p>One<br>two &#233;&lt;<a href="/x?a=1&amp;b=2">l</a></p><p>three  <b>x</b></p></body>'
    pages = spark.createDataFrame([(1, "http://a.example/", page), (2, None, None), (1, "http://a.example/", page), (3, "u", "<p>open <script>never")], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 8 and warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    for r in rows:
        data = r.block.encode()
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers and f"Content-Length: {len(data)}\r\n" in r.headers
        assert r.block_digest == warc.digest(data) and r.content_length == len(data)
    one = {r.record_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].block == "One\ntwo é<l\nthree x" and one["conversion"].source_digest == warc.digest(page.encode())
    assert "outlink: /x?a=1&b=2 a/@href\r\n" in one["metadata"].block and "/no" not in one["metadata"].block and "title: A & B\r\n" in one["metadata"].block
    assert "source-http-content-type: text/html; charset=utf-8\r\n" in one["metadata"].block
    assert [r.block for r in rows if r.page_id == 3 and r.record_type == "conversion"] == ["open"]


def random_page(rnd):
    """A page put together piece by piece, with what it should show and link to."""
    page, shown, found = "", "", []
    word = lambda: "".join(rnd.choices("abcxyzé", k=rnd.randint(1, 6)))
    for _ in range(rnd.randint(0, 40)):
        w, spaces = word(), rnd.choice(["", " ", " \n "])
        kind = rnd.randrange(9)
        if kind == 0:
            page, shown = page + f"{w}{spaces}", shown + w + spaces
        elif kind == 1:
            tag = rnd.choice(["p", "DIV", "br", "li", "h2"])
            page, shown = page + f"<{rnd.choice(['', '/'])}{tag}{rnd.choice(['', ' id=x', '/'])}>", shown + "\n"
        elif kind == 2:
            page += f"<!-- {w} <p> <a href=no> -->"
        elif kind == 3:
            tag = rnd.choice(["script", "Style", "template", "noscript"])
            page += f"<{tag} type='a>b'>{w} < \"</p> <a href=no></{tag.upper()}{rnd.choice(['', ' '])}>"
        elif kind == 4:
            quote = rnd.choice(["'", '"', ""])
            page, shown = page + f"<a title=\"x > y\" HREF = {quote}/{w}?a&amp;b{quote}>{w}</a>", shown + w
            found.append((f"/{w}?a&b", "a/@href"))
        elif kind == 5:
            page += f"<img alt='>' src='{w}.png' src='no' href>"
            found.append((f"{w}.png", "img/@src"))
        elif kind == 6:
            page, shown = page + f"{w} &lt;&amp; 1 < 2", shown + f"{w} <& 1 < 2"
        elif kind == 7:
            page += f"<b class={w}><i></i ><!doctype {w}><?xml {w}?>"
        else:
            page, shown = page + f"<td data-href='{w}'>" + w, f"{shown} {w}"
    lines = (re.sub("[ \t\r\f\v]+", " ", x).strip() for x in shown.split("\n"))
    return page, "\n".join(x for x in lines if x), found


def test_warc_table_cells_stand_apart():
    assert warc.plain_text("<table><tr><td>12</td><td>345</td></tr><tr><th>a</th><TD>b<td>c") == "12 345\na b c"


def test_warc_reads_pages_that_are_known():
    rnd = random.Random(14)
    for _ in range(400):
        page, shown, found = random_page(rnd)
        assert warc.read_page(page) == (shown, None, found), page
        for cut in (rnd.randrange(len(page) + 1), len(page)):  # what is open at the end ends there
            warc.read_page(page[:cut] + "<title>a")


def test_warc_is_linear(spark):
    hostile = ["<a " * 350_000, "<a href=\"" * 100_000, "<!--" * 250_000, "</script " * 110_000, "<" * 1_000_000, "<a a=\"'" * 120_000, ("<a" + " " * 1000) * 1000, "<p =/=/" * 140_000]
    for page in hostile:
        start = time.perf_counter()
        warc.read_page(page)
        assert time.perf_counter() - start < 5
    pages = spark.createDataFrame([(i, None, p, "x", 1) for i, p in enumerate(hostile[:2])], "page_id long, url string, html string, headers string, part int")
    assert warc.derivatives(warc.responses(pages)).count() == 4


def plain_components(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in sets}
    find = lambda x: x if up[x] == x else find(up[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, monkeypatch):
    rnd = random.Random(7)
    base = [t.split() for t in random_texts(12, 11)]
    texts = [None, "", "one two", "One TWO", "x"]
    for words in base:
        for _ in range(12):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
                if copy:
                    copy[rnd.randrange(len(copy))] = f"w{rnd.randrange(9)}"
            texts.append(" ".join(copy))
    docs = documents(spark, texts)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(neardup, "SET_BLOCK", 5)
    for how in (neardup.Settings(), neardup.Settings(words=5, percent=80, bands=28)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, how).collect()}
        assert got == plain_components(list(enumerate(texts)), how.words, how.percent)
    kept = neardup.one_of_each(docs, neardup.Settings()).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, c) in plain_components(list(enumerate(texts)), 3, 85).items() if i == c)


def test_near_duplicate_units_are_bounded(spark, monkeypatch):
    many = [(1, i, i, b"x" * 8) for i in range(200)]
    mostly = [(2, i, 1000 if i < 1180 else i, b"x" * 8) for i in range(1000, 1200)]
    rows = spark.createDataFrame(many + mostly + [(k, 2000 + 2 * k + i, 2000 + 2 * k + i, b"y" * 8) for k in range(3, 40) for i in (0, 1)] + [(99, 5000 + i, 5000, b"z" * 8) for i in range(50)], "key long, id long, comp long, value binary")
    packs = defaultdict(lambda: defaultdict(set))
    for r in neardup.units(rows, 10, 100).collect():
        packs[r.pack, r["alone"]][r.key, r.low, r.high].add((r.id, r.comp))
    assert all(len(of) == 1 for of in packs.values() if any(key < 3 for key, _, _ in of))
    assert max(len(ids) for of in packs.values() for ids in of.values()) < 60
    met = {(a, b) for of in packs.values() for ids in of.values() for a, x in ids for b, y in ids if x != y}
    by = defaultdict(list)
    for r in rows.collect():
        by[r.key].append((r.id, r.comp))
    expected = {(a, b) for ids in by.values() for a, x in ids for b, y in ids if x != y}
    assert met == expected
    dealt = Counter(key for of in packs.values() for (key, _, _), ids in of.items() for _ in ids)
    assert dealt[99] == 0 and dealt[2] < 180 * 4 + 20 * 25 and dealt[1] > 200 * 10  # a main component meets only the others
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 80)
    by_bytes = neardup.units(rows, 1000, 1000).where("key = 1").groupBy("pack").count()
    assert by_bytes.count() > 100 and by_bytes.agg(F.max("count")).first()[0] < 60


def test_near_duplicates_of_repeated_ids(spark):
    base = [f"w{i}" for i in range(80)]
    other = [f"v{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i:]])) for i in range(20)]
    rows += [(7, rows[7][1])] * 60
    rows += [(103, "a b c d e"), (105, "a b c d e"), (105, " ".join(other)), (107, " ".join(other)), (106, ""), (105, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id < 100} == {0}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id >= 100 and r.n_shingles} == {(103, 103), (105, 103), (107, 103)}
    assert {(r.doc_id, r.component_id) for r in got if not r.n_shingles} == {(106, 106), (105, 105)}


@pytest.mark.parametrize("hot", [2, 1024])
def test_near_duplicates_in_hot_buckets(spark, monkeypatch, hot):
    """Buckets with several components of different texts, split into blocks; hubs and nodes with many rows."""
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 6)
    monkeypatch.setattr(neardup, "SET_BLOCK", 4)
    monkeypatch.setattr(components, "HOT_ROWS", hot)
    rnd = random.Random(31)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for group in range(5):  # groups differ by more than the threshold allows, and share many bands all the same
        own = list(base)
        own[3 + 9 * group : 6 + 9 * group] = [f"g{group}a", f"g{group}b", f"g{group}c"]
        for _ in range(14):
            copy = list(own)
            copy[rnd.randrange(50, 60)] = f"n{rnd.randrange(4)}"
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == plain_components(list(enumerate(texts)), 3, 85)


def test_near_duplicates_of_few_rows_take_few_tasks(spark):
    """Small steps over many shuffle partitions: an empty partition is a task, too, so joins and shuffles are counted by tasks."""
    rnd = random.Random(8)
    texts = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rnd.choice([1, 2])):
                copy[rnd.randrange(60)] = f"n{rnd.randrange(4)}"
            texts.append(" ".join(copy))
    docs, partitions, was = documents(spark, texts).coalesce(1), 24, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.sparkContext.setJobGroup("few", "near duplicates of few rows")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == plain_components(list(enumerate(texts)), 3, 85)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds}
    ran = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert ran < 80 * partitions


@pytest.mark.parametrize("whole", [0, 100_000])
def test_near_duplicates_by_either_join(spark, monkeypatch, whole):
    """Few keys are broadcast whole; of many, hot ones, and the others are joined by shuffle. Repeated ids and texts besides."""
    for name, value in (("WHOLE_KEYS", whole), ("HOT_ROWS", 4)):
        monkeypatch.setattr(components, name, value)
    for name, value in (("BUCKET_BLOCK", 6), ("SET_BLOCK", 4)):
        monkeypatch.setattr(neardup, name, value)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for group in range(4):
        own = list(base)
        own[3 + 9 * group : 6 + 9 * group] = [f"g{group}a", f"g{group}b", f"g{group}c"]
        rows += [(20 * group + i, " ".join([*own[:50], f"n{i % 7}", *own[51:]])) for i in range(12)]
    plain = plain_components(rows, 3, 85)
    rows += [rows[5]] * 3
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain
    edges = [(i, i + 1) for i in range(30)] + [(50, 60 + i) for i in range(20)] + [(7, 7), (500, 500), (None, 3)]
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {50: 50, 500: 500} | {60 + i: 50 for i in range(20)}


def test_near_duplicates_odd_rows(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and neardup.near_duplicates(odd.limit(0)).count() == 0
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (6, 8)} == {6: 5, 8: 7}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(50)] + [(7, 7), (None, 3), (500, 500)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e if None not in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in (e for e in edges if None not in e):
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {x: find(x) for x in up}


def test_ledger_and_ablation(spark, odd):
    assert quality.measure("a b c a b c\nx\nx\n- #y 1...") == (11, 15, 1, 1, 6, 4, 1, 1, 1, 9)
    assert quality.measure(None) == (0,) * 10
    entries = quality.ledger(odd)
    assert entries.count() == odd.count() and quality.ledger(odd.limit(0)).count() == 0
    rows = quality.apply_policy(entries, "v1").collect()
    used = [r for r in quality.RULES if quality.policy_mask("v1") >> r.bit & 1]
    told = {r.rule: r for r in quality.ablation(entries, "v1").collect()}
    for rule in used:
        others = quality.policy_mask("v1") & ~(1 << rule.bit)
        assert told[rule.name].n_failed == sum(r.fail_bits >> rule.bit & 1 for r in rows)
        assert told[rule.name].n_only == sum(r.fail_bits & quality.policy_mask("v1") == 1 << rule.bit for r in rows)
        assert told[rule.name].n_kept_without == sum(r.fail_bits & others == 0 for r in rows)
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)


def test_quality_spares_long_texts_and_scripts_without_spaces(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(5000)]
    texts = [" ".join(rnd.choices(words, k=1_000_010)), "\n".join("".join(rnd.choices("日本語文章漢字仮名", k=40)) for _ in range(60)), "\n".join("".join(rnd.choices("abcdefgh", k=40)) for _ in range(60))]
    got = {r.doc_id: (r.kept, r.fail_bits) for r in quality.apply_policy(quality.ledger(documents(spark, texts)), "v1").collect()}
    assert got == {0: (True, 4), 1: (True, 0), 2: (False, 16)}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 8)).astype(np.float32)
    vectors[1000:1900] = vectors[1000]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(None, rows[0][1], 1), (5000, None, 1), (5050, [0.0] * 8, 1), (5100, [float("nan")] * 8, 1), (5150, [1.0, None] * 4, 1), (5200, [1.0], 1), rows[50], rows[2999]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect()
    x = vectors.astype(np.float64)
    norms, hit = np.sqrt((x * x).sum(axis=1)), 0
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 3000, 50))
    for q, found in by.items():
        scores = (x * x[q]).sum(axis=1) / (norms * norms[q])
        best = [i for i in np.lexsort((np.arange(3000), -scores)).tolist() if i != q][:5]
        hit += len(set(best) & {v for v, _ in found})
        assert len(found) == 5 and found == sorted(found, key=lambda f: (-f[1], f[0])) and all(s == scores[v] for v, s in found)
    assert hit >= 0.9 * 5 * len(by) and [v for v, _ in by[1050]] == [1000, 1001, 1002, 1003, 1004]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).count() == 2


def test_nearest_neighbours_beyond_a_small_list(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = np.concatenate([[[-1, 0.1, 0, 0]], [[0, 0, -1, 0.2]] * 3, rng.normal(size=(696, 4)) * 0.05 + [1, 0, 0, 0]]).astype(np.float32)
    monkeypatch.setattr(neighbours, "balanced_centroids", lambda sample, k: neighbours.unit(vectors[[0, 1, 300][:k]].astype(np.float64)))
    monkeypatch.setattr(neighbours, "LIST_ROWS", 200)
    monkeypatch.setattr(neighbours, "PART_ROWS", 300)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(table, F.col("vec_id") % 100 < 2).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [i for i in range(700) if i % 100 < 2]
    x = vectors.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1) / (norms * norms[q])
        best = [i for i in np.lexsort((np.arange(700), -scores)).tolist() if i != q][:5]
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(s == scores[v] for _, v, s in found)
        assert q > 1 or [v for _, v, _ in found] == best


@pytest.mark.parametrize("n", [3000, 9000])
def test_nearest_neighbours_in_split_lists(spark, monkeypatch, n):
    """Lists that are split twice and more, a hot vector, repeated ids, and columns that clash."""
    monkeypatch.setattr(neighbours, "MOST_CENTROIDS", 3)
    monkeypatch.setattr(neighbours, "PART_ROWS", 150)
    monkeypatch.setattr(neighbours, "LIST_ENTRIES", 60)
    monkeypatch.setattr(neighbours, "FAN", 8)
    monkeypatch.setattr(neighbours, "MOST_FAN", 16)
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(60, 12))[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, 12))).astype(np.float32)
    vectors[rng.permutation(n)[: n // 3]] = vectors[0]
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(vectors)]
    rows += [(50, vectors[0].tolist(), "a", 1), rows[100], rows[100]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string, part int")
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    x = vectors.astype(np.float64)
    norms, hit = np.sqrt((x * x).sum(axis=1)), 0
    assert sorted(got) == list(range(0, n, 50))
    for q, found in got.items():
        assert len(found) == 5 and len({v for v, _ in found}) == 5 and q not in dict(found)
        own = min(vectors[50].tolist(), vectors[0].tolist()) if q == 50 else x[q]
        scores = (x * own).sum(axis=1) / (norms * np.sqrt((np.array(own) ** 2).sum()))
        scores[50] = max(scores[50], (x[0] * own).sum() / (norms[0] * np.sqrt((np.array(own) ** 2).sum())))
        best = [i for i in np.lexsort((np.arange(n), -scores)).tolist() if i != q][:5]
        assert np.allclose([s for _, s in found], [scores[v] for v, _ in found])
        hit += len(set(best) & {v for v, _ in found})
    assert hit >= 0.9 * 5 * len(got), hit / 5 / len(got)


def test_token_counts_are_greedy(spark, odd):
    automaton = tokens.build([b"a", b"ab", b"abcd", b"b"], [b"c", b"b", b"ab", b"d", b"cda"])
    for word, n in {"abcd": 1, "abc": 2, "abcda": 2 + 0, "abab": 2, "x": 1, "ax": 1, "bcd": 3, "bcda": 2, "abb": 2}.items():
        got = automaton.counts(pa.array([word]))[0]
        at, pieces, vocabulary = 0, 0, [b"a", b"ab", b"abcd", b"b"]
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k].encode() in vocabulary), 0)
            if not size:
                pieces = 1
                break
            at, pieces, vocabulary = at + size, pieces + 1, [b"c", b"b", b"ab", b"d", b"cda"]
        assert got == pieces, (word, n)
    path = public_tokenizers.path("piece_bpe_32k.model")
    starts, inner = map(set, tokens.sentencepiece_vocabulary(path))
    texts = docs_text(documents(spark, random_texts(40, 6)))

    def greedy(word):
        at, n, vocabulary = 0, 0, starts
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), 0)
            if not size:
                return 1
            at, n, vocabulary = at + size, n + 1, inner
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.count_tokens(documents(spark, list(texts.values())), path).collect()}
    assert got == {i: (len(t.encode().split()), sum(map(greedy, t.encode().split()))) for i, t in texts.items()}
    assert tokens.count_tokens(odd, path).count() == odd.count() and tokens.count_tokens(odd.limit(0), path).count() == 0


def test_token_counts_spell_every_word(spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}

    def greedy(word):
        at, n, marked = 0, 0, "▁" + word
        while at < len(marked):
            size = next((k for k in range(min(64, len(marked) - at), 0, -1) if marked[at : at + k] in pieces), 0)
            n += 1 if size else len(marked[at].encode())  # byte pieces
            at += size or 1
        return n

    fixed = {"4380881557741609": 17, "172.242.194.228": 16, "ñción": 3, "": 0}
    odd_words = ["▁", "▁▁the", "a▁the", "日本語の文章", "Привет,мир", "𐍈𐍈", "\x01x", "ßaß", "2024-01-31", "éa1"]
    texts = [*fixed, None, *odd_words, " ".join(odd_words), *random_texts(30, 8)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in queries.op8_tokens(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(fixed))] == list(fixed.values())
    assert got == {i: sum(map(greedy, WORD.findall(t or ""))) for i, t in enumerate(texts)}


def test_induced_sort():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0)
        expected = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert all(suffixes.induced_sort(text, alphabet).tolist() == expected for alphabet in (8, 600))
        prefix = suffixes.permuted_common_prefixes(text, np.array(expected), np.array([0]), 5)
        for a, b in zip(expected, expected[1:], strict=False):
            common = next((k for k in range(6) if k == 5 or text[a + k : a + k + 1].tolist() != text[b + k : b + k + 1].tolist()), 5)
            assert prefix[b] == common


def plain_removal(rows):
    """By brute force: {(id, text): (bytes, removed, spans, digest)}; places are compared by id and start."""
    first = {}
    rows = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in rows:
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(None if i == float("inf") else i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("many", [10_000, 1])
def test_repeats(spark, odd, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4096)
    rnd = random.Random(6)
    shared = random_texts(6, 21)
    texts = ["a" * 500, "ab" * 300, "x" + "a" * 120, None, "", "é" * 90]
    for t in random_texts(40, 20):
        p = rnd.choice(shared)
        a = rnd.randrange(len(p) + 1)
        texts.append(t + p[a : a + rnd.randrange(400)] + t[: rnd.randrange(300)])
    docs = documents(spark, texts)
    got = Counter(tuple(r) for r in repeats.remove_repeats(docs).collect())
    assert got == plain_removal(enumerate(texts))
    got = Counter(tuple(r) for r in repeats.remove_repeats(odd).collect())
    assert got == plain_removal([(r.doc_id, r.text) for r in odd.collect()])
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


def test_repeats_of_null_ids_with_one_hash(spark):
    """Rows without an id whose texts agree in 32 bits of hash, and one with the largest id there is."""
    import xxhash

    seen = {}
    for i in range(2_000_000):
        text = f"{i:0>110}"
        h = xxhash.xxh64_intdigest(text, seed=42) & 0xFFFFFFFF
        if h in seen:
            break
        seen[h] = text
    rows = [(None, text + "x" * 40), (None, seen[h]), (None, text), (2**63 - 1, "y" * 250), (None, "y" * 250), (3, text[:105] + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in repeats.remove_repeats(docs).collect())
    assert sum(got.values()) == len(rows) and {k[0] for k in got} == {None, 2**63 - 1, 3}
    largest = lambda i: 2**63 - 1 if i is None else i  # noqa: E731  what a null id counts as
    assert Counter((largest(k[0]), *k[1:]) for k in got.elements()) == plain_removal([(largest(i), t) for i, t in rows])


def test_repeats_find_hot_anchors_seen_once_a_task(spark, monkeypatch):
    """A passage between different surroundings, one segment of an anchor in each hand-on."""
    monkeypatch.setattr(repeats, "MANY", 20)
    monkeypatch.setattr(repeats, "HELD", 1)
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(180)
    texts = [word(150) + passage + word(150) for _ in range(120)]
    docs = documents(spark, texts)
    split = repeats._split(docs.select("doc_id", "text"), 3, 2)
    assert repeats._hot(split.where(F.col("kind") == repeats.COUNT)).agg(F.sum("n")).first()[0] >= 2
    for many in (200_000, 0):  # the list of hot anchors sent to all tasks, and joined
        monkeypatch.setattr(repeats, "HOT_ANCHORS", many)
        assert Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == plain_removal(enumerate(texts))


def test_packing_round_trip(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = packing.WordIds(path).tokenizer
    docs = documents(spark, [*random_texts(200, 30), None, "", "<|endoftext|> It's <|startoftext|>x", " ".join(random_texts(60, 31))])
    rows = packing.pack(docs, path, run_tokens=4000).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in docs_text(docs).items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 4096 - at)
    assert padding < 0.02 * total
    assert {r.doc_id for r in packing.pack(odd, path).collect()} == {r.doc_id for r in odd.select("doc_id").collect()}
    assert packing.pack(odd.limit(0), path).count() == 0


def test_packing_combinations_and_least_squares():
    rng = np.random.default_rng(4)
    for window in (16, 64):
        for _ in range(20):
            lengths = np.sort(rng.choice(np.arange(1, window), rng.integers(1, 12), replace=False))
            counts = rng.integers(1, 6, len(lengths))
            columns = packing.combinations(lengths, counts, window)
            got = sorted(tuple(sorted([int(lengths[i])] * int(a) + [int(lengths[j])] * int(b))) for i, j, a, b in columns)
            have = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
            shallow = {c for n in range(1, 5) for c in combinations_with_replacement(lengths.tolist(), n)}
            assert got == sorted(c for c in shallow if sum(c) in (window, window // 2, window // 4) and len(set(c)) < 3 and all(c.count(x) <= have[x] for x in c))
            if not len(columns):
                continue
            x = packing.non_negative_least_squares(columns, counts, 1e-7)
            matrix = np.zeros((len(lengths), len(columns)))
            np.add.at(matrix, (columns[:, 0], np.arange(len(columns))), columns[:, 2])
            np.add.at(matrix, (columns[:, 1], np.arange(len(columns))), columns[:, 3])
            gradient = matrix.T @ (matrix @ x - counts)  # optimal: no slope where x > 0, none downwards where x = 0
            assert (x >= 0).all() and gradient.min() > -1e-4 and np.abs(gradient * (x > 1e-3)).max() < 1e-4
            rests = np.repeat(lengths, counts)
            groups, left = packing.plan(rests, window)
            assert sorted(d for g in [*groups, left] for d in g) == list(range(len(rests)))
            assert all(rests[g].sum() in (window, window // 2, window // 4) for g in groups)
    assert packing.plan(np.empty(0, np.int64), 64) == ([], [])


def test_word_ids_equal_the_tokenizer():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(1)
    alphabet = "abcXYZ éÉßİıΣςσ'’.,#|<>endoftext̸́=日本1２ \n\t \u0085…-_$&*%ǅÀÖ×÷ÿ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(2000)] + ["<|endoftext|>x", "it's we'll 'S", "a\x1cb", "".join(map(chr, range(32, 600)))]
    ids, sizes = words.encode(pa.array(texts))
    parts = np.split(ids, sizes.cumsum()[:-1])
    assert all(p.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids for p, t in zip(parts, texts, strict=True))
