"""The corpus pipeline on a small fixture: each stage against what brute force says, and the chain as a whole."""

import random
import re
from pathlib import Path
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, WORD, plain_components, plain_spans, random_texts

import corpus_pipeline
from weftnet.llm import mixing, packing, quality


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(12)
    texts = [" ".join(rnd.choices([f"word{k}" for k in range(3000)], k=rnd.randint(60, 200))) for _ in range(60)]
    texts += [t.replace("word1", "word2", 1) for t in texts[:10]] + texts[:5]
    texts += [None, "", "short", "#### " * 80, texts[7] + " mail me@mail.example.com or +1 (663) 555-6869"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    stage = dict(corpus_pipeline.STAGES)
    held = {r.doc_id: r for r in docs.collect()}

    kept = stage["quality rules"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    for r in docs.collect():
        m = dict(zip(quality.MEASURES, quality.measure(r.text), strict=True))
        bad = m["n_words"] < 50 or 100 * m["n_symbols"] > 10 * m["n_words"] or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        assert (r.doc_id in {x.doc_id for x in kept.collect()}) == (not bad)

    single = stage["near copies"](spark, kept, sf_dir)
    expected = plain_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)

    masked = stage["personal data"](spark, single, sf_dir)
    assert masked.columns == docs.columns and masked.count() == single.count()
    for r in masked.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(held[r.doc_id].text):
            assert r.text == held[r.doc_id].text

    mixed = stage["source mix"](spark, masked, sf_dir)
    sizes = {r.source: 0 for r in masked.collect()}
    for r in masked.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    assert mixed.columns == docs.columns
    assert abs(sum(len(WORD.findall(r.text)) for r in mixed.collect()) - 1.5 * sum(sizes.values())) < 0.02 * sum(sizes.values())

    tokenizer = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    pieces = stage["packing"](spark, mixed, sf_dir).collect()
    assert sum(r.length for r in pieces) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == list(packing.COLUMNS) and out.count() > 0
    at = {}
    for r in sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length


def test_stages_with_odd_rows(spark, sf_dir):
    """Null ids, texts and sources, repeated rows, no rows, and columns with names that stages use themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    for name in ("row", "spans", "kept", "size", "taken", "fail_bits", "n_words", "text_hash"):
        docs = docs.withColumn(name, F.lit(1))
    odd = docs.withColumns({"doc_id": F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")), "source": F.when(F.col("doc_id") % 2 > 0, F.col("source"))})
    odd = odd.unionByName(odd.limit(2)).unionByName(odd.limit(1).withColumn("text", F.lit(None).cast("string")))
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf_dir)
            assert out.columns == docs.columns and (out.count() > 0) == (rows is odd)
        pieces = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
        assert (pieces.count() > 0) == (rows is odd)


def own_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.parametrize("name", ["quality rules", "personal data", "source mix", "packing"])
def test_stages_give_memory_back(spark, sf_dir, monkeypatch, name):
    """What a stage's last pass over texts has freed doesn't stay in Arrow's pool, as its Python worker goes on to the next stage."""
    passes = []
    kind = type(spark.range(0))
    through = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: (passes.append((self, f)), through(self, f, *a, **b))[1])
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 400").withColumn("text", F.repeat(F.concat("text", F.lit("\n")), 400))
    dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    rows, run = passes[-1]
    batches = rows.toArrow().to_batches()
    assert sum(b.nbytes for b in batches) > 20e6
    pool = pa.default_memory_pool()
    pool.release_unused()
    n = sum(len(out) for out in run(iter(batches)))
    held = own_mb()
    pool.release_unused()
    assert n and held - own_mb() < 8


def test_mix_starts_no_workers_of_another_kind(spark, monkeypatch):
    """Python workers of RDDs are others than those of DataFrames, and would stay beside them."""

    def refused(self, *_, **__):
        raise AssertionError("an RDD with a Python function")

    sources = spark.range(40).selectExpr("cast(id as string) as source").repartition(4)
    monkeypatch.setattr("pyspark.core.rdd.PipelinedRDD.__init__", refused)
    found = {r.source: r.source_id for r in mixing.numbered(sources).collect()}
    assert found == {s: i for i, s in enumerate(sorted(map(str, range(40))))}
    assert mixing.numbered(sources.limit(0)).count() == 0
