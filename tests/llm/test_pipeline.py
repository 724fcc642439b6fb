"""The pipeline on the smallest tables: what each stage keeps, and that stages agree with their operators."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import words
from trailnote.llm import bpe, minhash, passages, toxicity
from trailnote.llm.common import landed, table


def test_stages_keep_columns_and_take_effect(spark, data):
    docs = table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = landed(stage(spark, docs, data), f"test-{name}")
        assert out.schema == docs.schema, name
        assert 0 < out.count()
        if name == "minhash_near_dedup":
            assert minhash.near_duplicates(out).filter("NOT kept").count() == 0
        if name == "repeated_passages":
            assert passages.repeated_passages(out).filter("similarity = 1").count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    want = bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_toxic_documents_go(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    rejected = {r.doc_id for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).filter("rejected").select("doc_id").collect()}
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == {r.doc_id for r in docs.collect()} - rejected


def test_run_gives_a_row_for_each_copy(spark, data):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) for _ in range(2))
    assert a == b and len(a) > 0


def tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, unlike rows of one doc_id, and columns with the stages' own names."""
    rng = random.Random(43)
    base, long = " ".join(words(rng, 80)), " ".join(words(rng, 60_000))
    rows = [(1, base, "a"), (2, base, "a"), (2, base, "a"), (3, None, None), (4, "", "b"), (5, " \n", "b"), (None, base, "a"), (None, None, None), (6, long, "a"), (7, "short text", "b"), (7, "short text", "c"), (8, "other words " + long, "b")]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("row", "rejected", "digest", "cut", "spans", "copy", "rate", "id", "sig", "a.b", "least"))])
    folder = tables(spark, tmp_path, docs, [(1, 1, 0), (7, 0, 1), (None, 1, 1), (99, 0, 1)])
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = landed(stage(spark, kept, folder), f"edge-{name}")
        assert kept.columns == docs.columns, name
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        if name == "minhash_near_dedup":
            assert sorted(x for x in ids if x) == [1, 3, 4, 5, 6, 7, 7] and ids.count(None) == 2
    assert corpus_pipeline.run(spark, folder).count() >= 0


@pytest.mark.parametrize("empty", ["documents", "labels", "both"])
def test_stages_on_empty_tables(spark, data, tmp_path, empty):
    docs = table(spark, data, "documents")
    labels = [] if empty != "documents" else [(r.doc_id, r.quality, r.toxic) for r in table(spark, data, "labels").collect()]
    folder = tables(spark, tmp_path, docs.limit(0) if empty != "labels" else docs.filter("doc_id < 40"), labels)
    got = corpus_pipeline.run(spark, folder)
    assert (got.count() == 0) == (empty != "labels") and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
