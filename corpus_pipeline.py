"""Corpus pipeline: filter by quality, drop near copies, mix sources, tokenise.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; ``run`` writes each stage's rows as Parquet in the shared folder
and reads them again. The last stage returns the tokens; the others return the
columns of ``documents``, and further columns, whatever their names, with the
values they had. SQL can't express the trees and the tokenizer, so ORACLE_SQL is
None and the tests compare with a plain version.

Defined results: null and empty texts are scored, have no near copies, are mixed
like others and have no tokens. Rows of one id whose texts aren't near copies
stay apart; of rows equal in id and text one is kept; rows without id are kept.
Empty tables go through all stages. Very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.session import staged
from tidewarden.llm import bpe, jaccard, mixing, quality
from tidewarden.llm.queries import BYTE_BPE, MIX_WEIGHTS

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees score 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return quality.keep_quality(docs, labels, learn_from=~held_out)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-gram Jaccard 0.75 or more."""
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, shuffled."""
    return mixing.mixed_rows(docs, MIX_WEIGHTS, other_weight=1.0)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether decoding them gives the text back."""
    encoded = bpe.bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), BYTE_BPE)
    return encoded.select("doc_id", "lang", "source", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), "round_trip")


STAGES = [("quality classifier", quality_stage), ("near duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
