"""The n-gram classifier's counts against HashingTF."""

import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewarden.operators import learn
from tidewarden.plans.stream_queries import m1_toxicity_report

ODD = [None, "", " \t\n", "a", "a b", "  Ab\x0bcd ", "naïve Ünïcode 漢字かな交じり mixed漢x 😀 😀😀x", "İıſK ΑΣ", "x" * 70, "\x85 \xa0nbsp"]


@pytest.mark.parametrize("features", [1 << 16, 1000, 1 << 18])
def test_counts_are_those_of_hashing_tf(spark, features, monkeypatch):
    monkeypatch.setattr(learn, "_SLICE", 64)
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(30).collect()]
    df = spark.createDataFrame(list(enumerate(ODD + texts)), "i int, text string")
    grams = df.select("i", F.coalesce(learn.padded_ngrams(F.col("text")), F.array().cast("array<string>")).alias("grams"))
    want = {r["i"]: r["tf"] for r in HashingTF(inputCol="grams", outputCol="tf", numFeatures=features).transform(grams).collect()}
    got = learn.with_counts(df, features=features).collect()
    assert {r["i"]: r["tf"] for r in got} == want
    assert all(r["known"] == (want[r["i"]].numNonzeros() > 0) for r in got)


def test_fit_and_predict_from_texts(spark):
    df = spark.createDataFrame([(i, "good day friend" if i % 2 else "bad nasty thing", i % 2) for i in range(40)] + [(40, " ", 0)], "i int, text string, y int")
    out = learn.predict(df, learn.fit(df, "y")).collect()
    assert out[0].asDict().keys() == {"i", "text", "y", "confidence", "predicted"}
    assert all(r["predicted"] == (r["y"] if r["i"] < 40 else -1) for r in out)


def test_report_makes_no_ngram_objects(spark):
    """Texts are hashed once, before the steps that read them again and again."""
    plan = m1_toxicity_report(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "lambda" not in plan


def test_model_is_that_of_spark_ml(spark):
    """Weights, confidences and odd rows against IDF, Normalizer and LogisticRegression."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").select("doc_id", "text", F.col("quality").alias("y"))
    odd = spark.createDataFrame([(-i, t, i % 2) for i, t in enumerate([*ODD, "aaa " * 70_000], 1)], "doc_id long, text string, y int")
    d = d.unionByName(odd).localCheckpoint()
    share = d.agg(F.avg("y")).first()[0]
    rows = learn.with_counts(d).select("doc_id", "tf", F.col("y").cast("double").alias("label"), F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)).alias("weight"))
    want = Pipeline(stages=[IDF(inputCol="tf", outputCol="idf", minDocFreq=2), Normalizer(inputCol="idf", outputCol="features"), LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40)]).fit(rows)
    got = learn.fit(d.unionByName(d.select("doc_id", "text", F.lit(None).cast("int").alias("y"))), "y")  # no label, nothing to learn
    assert np.allclose(got.idf, want.stages[0].idf.toArray(), rtol=1e-12)
    assert np.allclose(got.coefficients, want.stages[2].coefficients.toArray(), rtol=1e-4, atol=1e-4) and abs(got.intercept - want.stages[2].intercept) < 1e-4
    p = {r["doc_id"]: r["p"] for r in want.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("p")).collect()}
    for r in learn.predict(d, got).collect():
        assert r["predicted"] == (-1 if r["confidence"] is None else int(r["confidence"] >= 0.5))
        assert (not (r["text"] or "").strip(" \t\n") if r["confidence"] is None else abs(r["confidence"] - p[r["doc_id"]]) < 1e-4)


@pytest.mark.parametrize(("labels", "want"), [([1, 1], {1}), ([0, 0], {0}), ([None, None], {1}), ([], set())])
def test_one_class_only(spark, labels, want):
    df = spark.createDataFrame([(f"some text {i}", y) for i, y in enumerate(labels)], "text string, y int")
    assert {r["predicted"] for r in learn.predict(df, learn.fit(df, "y")).collect()} == want


def test_fit_caches_nothing(spark):
    """The rows of the table are read again by each step; none is held in the executors' memory."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", (F.col("doc_id") % 2).cast("int").alias("y"))
    known, seen, over = set(spark.sparkContext._jsc.getPersistentRDDs()), set(), threading.Event()

    def watch():
        while not over.wait(0.02):
            seen.update(spark.sparkContext._jsc.getPersistentRDDs())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        learn.fit(df, "y")
    finally:
        over.set()
        watcher.join()
    assert not seen - known
