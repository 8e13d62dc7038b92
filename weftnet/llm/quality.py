"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps one bit for each failed rule together with the
measurements, so that a policy (a named set of rules) is a bitwise AND, and so that what each rule costs (ablation) is
counted from the ledger without going back to the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, map_arrow, releasing

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_digits", "n_letters")
SYMBOLS = b"#*$%&|<>"
DIGITS, LETTERS = b"0123456789", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BULLETS = ("-", "*", "•")
ELLIPSES = ("...", "…")


@dataclass(frozen=True)
class Rule:
    """fails is SQL over the measurements; exact integer arithmetic, no division."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "too_many_words", "n_words > 1000000"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words and 2 * n_letters > word_chars"),
    Rule(5, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(6, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(7, "bullets", "100 * n_bullet_lines > 90 * n_lines"),
    Rule(8, "ellipses", "100 * n_ellipsis_lines > 30 * n_lines"),
    Rule(9, "digits", "100 * n_digits > 50 * word_chars"),
)

#: Policies by version; "base" holds the two rules that every other version contains. Length alone rejects nothing in v1:
#: too_many_words is only noted. long_words (n_letters: ASCII letters) spares scripts that write no spaces.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES if r.name != "too_many_words"),
    "strict": tuple(r.name for r in RULES),
    "lenient": ("too_few_words", "repeated_windows", "symbols"),
}


def policy_mask(version: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[version])


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words) - 2
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if n < 2 or len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i : i + 3] = b"\1\1\1"
            hit[j : j + 3] = b"\1\1\1"
    return sum(hit)


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split on ASCII white space only
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols, digits, letters = (len(data) - len(data.translate(None, c)) for c in (SYMBOLS, DIGITS, LETTERS))
    seen: set[str] = set()
    repeated = lines = bullets = ellipses = 0
    for line in text.split("\n"):
        bare = line.strip(" \t\v\f\r")
        if bare:
            lines += 1
            repeated += line in seen
            seen.add(line)
            bullets += bare.startswith(BULLETS)
            ellipses += bare.endswith(ELLIPSES)
    return len(words), len(text) - spaces, symbols, repeated, _repeat_words(words), lines, bullets, ellipses, digits, letters


def _measure_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [measure(t) for t in batch.column("text").to_pylist()]
    columns = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
    arrays = [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *MEASURES])


def fail_bits() -> Column:
    """One bit for each rule that fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the measurements and fail_bits.

    Only doc_id and text are read, so further columns don't matter. A null text has no words; repeated rows and null
    ids give as many ledger rows; an empty table gives an empty ledger. Whole texts of any length are measured.
    """
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _measure_batch, schema).withColumn("fail_bits", fail_bits())


def passes(version: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version))) == 0


def apply_policy(entries: DataFrame, version: str) -> DataFrame:
    """The ledger with the verdict of a policy as column kept."""
    return entries.withColumn("kept", passes(version))


def ablation(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy keeps without it.

    The ledger is first counted by mask (at most 2^rules rows whatever the corpus), then by rule.
    """
    mask = policy_mask(version)
    masks = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("mask")).agg(F.count("*").alias("n"))
    used = [r for r in RULES if mask >> r.bit & 1]
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in used)))
    some = masks.select("mask", "n", rules.alias("r")).select("mask", "n", "r.*")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return some.groupBy("rule").agg(
        total(F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("mask") == F.col("bit")).alias("n_only"),
        total(F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def keep(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The rows of docs that a policy keeps, with their own columns.

    The texts pass through Python once and come back beside their measurements, so that no join on ids is needed and
    repeated or null ids do no harm.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    schema = StructType([StructField("row", rows.schema["row"].dataType), *(StructField(m, LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measured = [measure(t) for t in pc.struct_field(batch.column("row"), "text").to_pylist()]
            columns = list(zip(*measured, strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, pa.int64()) for c in columns)], names=["row", *MEASURES])

    return rows.mapInArrow(releasing(run), schema).withColumn("fail_bits", fail_bits()).where(passes(version)).select("row.*")
