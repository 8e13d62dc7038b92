"""Personal data by bootstrapped contextual extraction.

Fixed rules find e-mail and IP addresses, card and phone numbers; these are the seeds. The words left and right of seeds
are lexical patterns. Spark scores the graph of patterns and instances in rounds: a pattern's confidence is the share of
all its occurrences in the corpus that stand next to known instances, an instance's is that at least one of its trusted
patterns is right. Instances above a threshold become known and support further patterns. Found ones get kind id.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, cut_lineage, releasing, slices, stored

KINDS = ("email", "ip", "card", "phone", "id")
#: The fixed rules, each in a form that reads a text once.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]++((?:\.[0-9]+){3})?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
GAP = re.compile(r"[\x20\x09-\x0D]")
SPACES = frozenset(" \t\n\v\f\r")
EDGES = "\"'()[]{}<>.,;:!?*#&%$|=`"
#: A token that context may reveal has so many characters and digits at least.
LEAST_LENGTH, LEAST_DIGITS = 6, 2
#: So may numbers written in groups, with so many digits in all; a line break ends them.
GROUPED = re.compile(r"(?<![^\s\"'\[{<:;,=])[+(]?[0-9][0-9()./-]*+(?:\x20[0-9(][0-9()./-]*+)++")
LEAST_GROUPED = 6

#: Rounds end when no form crosses the threshold any more and no score rises by more than this.
SETTLED = 1e-3
LEAST_SUPPORT = 3
PATTERN_CONFIDENCE = 0.6
INSTANCE_CONFIDENCE = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain from left to right: each @ with a domain takes all local characters before it that are free."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        s = m.start()
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        if s < m.start():
            out.append((s, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the fixed rules find, by kind and then start; offsets in code points."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in NUMBERS.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if 16 <= len(m[0]) <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _words_around(text: str, start: int, end: int) -> tuple[str | None, str | None]:
    """The whole words before and after a span, in lower case; none where letters or digits are glued to it."""
    left = right = None
    s = start
    while s and text[s - 1] not in SPACES and not text[s - 1].isalnum():
        s -= 1
    while s and text[s - 1] in SPACES:
        s -= 1
        left = s
    if left:
        reach, words = 32, [""]
        while len(words) < 2 and reach < left:  # a longer word is looked for in twice the distance
            reach *= 2
            words = GAP.split(text[max(0, left - reach) : left])
        left = (words if reach > 32 else GAP.split(text[:left]))[-1].lower()
    n, e = len(text), end
    while e < n and text[e] not in SPACES and not text[e].isalnum():
        e += 1
    while e < n and text[e] in SPACES:
        e += 1
        right = e
    if right is not None and right < n:
        gap = GAP.search(text, right)
        right = text[right : gap.start() if gap else n].lower()
    return left or None, right if isinstance(right, str) else None


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds, and other tokens or groups of numbers that might be identifiers, with the words around them."""
    out = []
    for _, s, e in base:
        left, right = _words_around(text, s, e)
        out.append({"start": s, "end": e, "form": text[s:e].lower(), "seed": True, "left": left, "right": right})
    spans = []
    for m in GROUPED.finditer(text):
        core = m[0].rstrip("()./-")
        opens = core.startswith("(") and ")" not in core
        if sum(map(str.isdigit, core)) >= LEAST_GROUPED:
            spans.append((m.start() + opens, m.start() + len(core)))
    at, grouped = 0, iter([*spans, (len(text) + 1, 0)])
    next_start, next_end = next(grouped)
    while m := DIGIT.search(text, at):
        s, gap = m.start(), GAP.search(text, m.start())
        e = gap.start() if gap else len(text)
        at_end = e
        while s > at and text[s - 1] not in SPACES:
            s -= 1
        at = at_end
        while next_end and next_end <= s:
            next_start, next_end = next(grouped)
        if next_start < e:
            continue  # part of a group
        core = text[s:e].strip(EDGES)
        if len(core) >= LEAST_LENGTH and len(DIGIT.findall(core)) >= LEAST_DIGITS:
            s += len(text[s:e]) - len(text[s:e].lstrip(EDGES))
            spans.append((s, s + len(core)))
    taken = sorted((s, e) for _, s, e in base)
    reach = [0, *accumulate((e for _, e in taken), max)]
    for s, e in sorted(spans):
        if reach[bisect_left(taken, (e,))] > s:
            continue  # a base span that starts before e ends after s
        left, right = _words_around(text, s, e)
        out.append({"start": s, "end": e, "form": text[s:e].lower(), "seed": False, "left": left, "right": right})
    return out


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("form", pa.string()), ("seed", pa.bool_()), ("left", pa.string()), ("right", pa.string())])
SCANNED = "row long, doc_id long, text_hash long, base array<struct<kind:int,start:int,end:int>>, mentions array<struct<start:int,end:int,form:string,seed:boolean,left:string,right:string>>, words array<long>, counts array<long>"


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document, and for each run of text a row (doc_id and row null) with its words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                seen = [mentions(t, b) if b or DIGIT.search(t) else [] for t, b in zip(texts, base, strict=True)]
                spans = [[{"kind": KINDS.index(k), "start": s, "end": e} for k, s, e in b] for b in base]
                counts: Counter = Counter()
                coded = pc.value_counts(pc.ascii_split_whitespace(pc.fill_null(part.column("text"), "")).flatten())
                for word, n in zip(coded.field("values").to_pylist(), coded.field("counts").to_pylist(), strict=True):
                    counts[word_hash(word.lower())] += n
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*range(row, row + n), None], pa.int64()),
                        pa.array([*part.column("doc_id").to_pylist(), None], pa.int64()),
                        pa.array([*map(text_hash, texts), None], pa.int64()),
                        pa.array([*spans, None], pa.list_(SPAN)),
                        pa.array([*seen, None], pa.list_(MENTION)),
                        pa.array([*[None] * n, list(counts)], pa.list_(pa.int64())),
                        pa.array([*[None] * n, list(counts.values())], pa.list_(pa.int64())),
                    ],
                    names=["row", "doc_id", "text_hash", "base", "mentions", "words", "counts"],
                )
                row += n

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def _bootstrap(found: DataFrame, totals: DataFrame, rounds: int | None) -> DataFrame:
    """Instances (form, score) that patterns reveal, besides the seeds. Scores only rise from round to round, so that rounds end."""
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("word")) for side in ("left", "right"))))
    each = found.select("form", "seed", sides.alias("p")).where("p.word is not null").select("form", "seed", "p.*")
    edges = each.groupBy("side", "word", "form").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    # a word whose instances, if all were known, would be too few or too small a share of it can never be a pattern
    words = edges.groupBy("side", "word").agg(F.sum("n").alias("most"), F.count("*").alias("forms")).where(F.col("forms") >= LEAST_SUPPORT)
    hashed = words.select("word").distinct().mapInArrow(_with_hash, "word string, hash long")
    words = words.join(hashed.join(totals, "hash").select("word", "total"), "word").where(F.col("most") >= PATTERN_CONFIDENCE * F.greatest("total", "most"))
    edges = cut_lineage(edges.join(words.select("side", "word", "total"), ["side", "word"]))
    scores = cut_lineage(edges.groupBy("form").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double")))
    while rounds is None or rounds > 0:
        known = edges.drop("seed").join(scores.where(F.col("score") >= INSTANCE_CONFIDENCE), "form")
        patterns = (
            known.groupBy("side", "word").agg(F.count("*").alias("support"), F.sum(F.col("n") * F.col("score")).alias("hits"), F.max("total").alias("total"))
            .where(F.col("support") >= LEAST_SUPPORT).select("side", "word", (F.col("hits") / F.greatest("total", "hits")).alias("confidence"))
            .where(F.col("confidence") >= PATTERN_CONFIDENCE)
        )
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
        told = edges.select("side", "word", "form").join(patterns, ["side", "word"]).groupBy("form").agg((1 - F.exp(doubt)).alias("told"))
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("told", F.lit(0.0)))
        scores = cut_lineage(scores.join(told, "form", "left").select("form", "seed", score.alias("score"), F.col("score").alias("before")))
        crossed = F.count_if((F.col("score") >= INSTANCE_CONFIDENCE) & (F.col("before") < INSTANCE_CONFIDENCE))
        moved = scores.agg(crossed.alias("crossed"), F.max(F.col("score") - F.col("before")).alias("most")).first()
        rounds = rounds and rounds - 1
        if not moved.crossed and (moved.most or 0) <= SETTLED:
            break
    return scores.where(~F.col("seed") & (F.col("score") >= INSTANCE_CONFIDENCE)).select("form", "score")


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([word_hash(w) for w in batch.column(0).to_pylist()], pa.int64())], names=["word", "hash"])


def find(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, text_hash, base and found (arrays of kind, start, end) for each row of docs.

    Null texts are empty; rows of any number and with null or repeated ids are read each by itself; further columns are
    ignored; an empty table gives no rows; texts of any length are read whole, and so are the words around a span. Found
    spans are tokens with two digits or more or numbers written in groups; names without digits are never found. They never
    overlap base spans. Rounds go on until scores settle unless given.
    """
    bounded_batches(docs.sparkSession)
    scanned = stored(scan(docs), "scanned")
    rows = scanned.where("row is not null")
    totals = scanned.where("row is null").select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("hash")).agg(F.sum("w.counts").alias("total"))
    each = rows.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    revealed = _bootstrap(each, totals, rounds).select("form")
    span = F.struct(F.lit(KINDS.index("id")).alias("kind"), "start", "end")
    more = each.where("not seed").join(revealed, "form").groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("found"))
    return rows.select("row", "doc_id", "text_hash", "base").join(more, "row", "left").select("doc_id", "text_hash", "base", F.coalesce("found", F.filter("base", lambda _: F.lit(False))).alias("found"))


def span_text(spans) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 of the base spans and all spans, written kind:start:end."""
    spans = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, KINDS[:4]), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text(F.concat("base", "found")).alias("spans"))


def mask(text: str, spans: list) -> str:
    """The text with each span replaced by its kind; overlapping spans count as one, of the first's kind."""
    out, at, end = [], 0, -1
    for k, s, e in sorted(((s["kind"], s["start"], s["end"]) for s in spans), key=lambda x: (x[1], -x[2])):
        if s < end:
            at = end = max(end, e)
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = end = e
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with all personal data replaced in text, and n_chars set to the new length; rows stay as they are otherwise.

    Null and empty texts stay; repeated rows and rows without an id are masked each; columns may have any names; an empty
    table gives no rows.
    """
    found = find(docs).where(F.size("base") + F.size("found") > 0).select("doc_id", "text_hash", F.concat("base", "found").alias("spans"))
    found = found.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    kind = rows.schema["row"].dataType
    hashed = rows.mapInArrow(releasing(_hash_texts), StructType([StructField("row", kind), StructField("row_hash", LongType())]))
    wide = hashed.join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash")), "left")
    out = wide.select("row", "spans").mapInArrow(releasing(_mask_texts), StructType([StructField("row", kind)])).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.struct_field(batch.column("row"), "text").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([text_hash(t or "") for t in texts], pa.int64())], names=["row", "row_hash"])


def _mask_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column("row")
        texts = [mask(t, s) if t and s else t for t, s in zip(pc.struct_field(row, "text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        columns = [pa.array(texts, f.type) if f.name == "text" else pc.struct_field(row, f.name) for f in row.type]
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(row.type))], names=["row"])
