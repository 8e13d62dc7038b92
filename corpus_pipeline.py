"""From raw documents to packed training sequences: rules, near copies, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has kept, and returns documents again
(doc_id, text, lang, source, n_chars); the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftnet.llm import mixing, neardup, packing, personal, quality
from weftnet.llm.common import settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1.

    A null or empty text has too few words and goes; texts of any length are measured whole; repeated rows and rows without
    an id are judged each; columns of any names are kept; an empty table stays empty.
    """
    return quality.keep(docs, "v1")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 5-word shingles at a similarity of 0.8 or more.

    Rows without an id or without words are linked with nothing and stay; of repeated rows one stays; columns of any names are
    kept; an empty table stays empty.
    """
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars to match.

    Null and empty texts stay as they are; rows without an id and repeated rows are masked each; columns of any names are kept;
    an empty table stays empty.
    """
    return personal.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: left out, once, in part, or up to twice.

    Documents without words have nothing to take and go; a null source is a source; ties in the seeded order go by id and
    size; columns of any names are kept; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; a document that the mix repeats is packed each time.

    A null or empty text is one piece with the end id; null ids stay null; texts of any length are cut at windows; an empty
    table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packed),
]

#: Linking, mixing and tokenizing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again by the next, and what
    it stored on the way is removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
