"""The pipeline against plain versions of its stages."""

import math

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.test_llm import brute_components
from tidewarden.llm import jaccard
from tidewarden.llm.queries import BYTE_BPE


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    (_, first), (_, second), (_, third), (_, fourth) = corpus_pipeline.STAGES
    good = first(spark, docs, SMALL).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and 0 < len(kept) < docs.count()
    assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) > 0.85
    one = second(spark, good, SMALL).cache()
    want = brute_components([(r["doc_id"], r["text"]) for r in good.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(want.values()))
    mixed = third(spark, one, SMALL)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(want.values())
    assert math.isclose(mixed.count(), one.count(), rel_tol=0.5)
    t = Tokenizer.from_file(BYTE_BPE)
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    out = fourth(spark, mixed, SMALL).collect()
    assert len(out) == mixed.count() and all(r["round_trip"] for r in out)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in out[:80])


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, and an empty table, through every stage."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "src0", 1, "c1"), (1, text, "en", "src0", 1, "c1"), (1, "another text with the same id and some words", "en", "src0", 1, "c2"), (2, text, None, None, None, "c3"), (3, None, "en", "src1", 0, "c4"), (4, "", "en", "src1", 0, "c5"), (None, text, "en", "src2", 5, "c6"), (6, "word " * 50_000, "en", "src2", 5, "c7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy string")
    (_, first), (_, second), (_, third), (_, fourth) = corpus_pipeline.STAGES
    good = first(spark, docs, SMALL)
    assert good.columns == docs.columns and set(good.collect()) <= set(docs.collect())
    one = second(spark, docs, SMALL)
    assert sorted(r["copy"] for r in one.collect()) == ["c1", "c2", "c4", "c5", "c6", "c7"]
    mixed = third(spark, docs, SMALL)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(docs.collect())
    assert all(r["round_trip"] for r in fourth(spark, docs, SMALL).collect()) and fourth(spark, docs, SMALL).count() == len(rows)
    empty = docs.where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, SMALL)
        assert out.count() == 0 and (k == 3 or out.columns == docs.columns)


def test_repeated_rows_with_columns_that_have_no_order(spark):
    rows = [(1, "one two three four five", {"a": 2}), (1, "one two three four five", {"a": 1}), (2, "six", {"b": 1})]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    assert sorted((r["doc_id"], r["m"]) for r in jaccard.keep_one(df).collect()) == [(1, {"a": 1}), (2, {"b": 1})]
