"""Rendezvous hashing of stable record keys over weighted shards.

Every shard gets a score for every key, ``weight / -ln(u)`` with ``u`` hashed
from key and shard; the highest score takes the row. A shard's score doesn't
depend on the other shards, so one more shard only takes rows into itself and
one less only gives its own rows away. DataFrame functions only, no join or
shuffle but for the slot numbers.

Slots number the rows of a shard from 0 without gaps. Rows are numbered inside
``stripes`` of each shard and the stripes' counts (shards x stripes rows, a
fixed bound) are summed up, so no task holds a whole shard.

Defined results: a null key is the empty key; equal keys go to one shard; null
texts have size 1 and the checksum of no bytes; an empty table gives an empty
table. Other columns are dropped by ``shard_slots`` and kept by ``assign_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a shard that are numbered on their own.
STRIPES = 64


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def _fraction(text: Column) -> Column:
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous_shard(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard (0 to len(weights) - 1) of a key; ties go to the smaller shard."""
    scores = [
        F.struct((F.lit(float(w)) / -F.ln(_fraction(F.concat_ws("|", F.lit(seed), F.lit(str(s)), _key(key))))).alias("score"), F.lit(-s).alias("shard"))
        for s, w in enumerate(weights)
    ]
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def assign_shards(df: DataFrame, weights: Sequence[float], key_col: str = "doc_id", seed: str = "shard", out_col: str = "shard") -> DataFrame:
    """Add the shard of each row."""
    return df.withColumn(out_col, rendezvous_shard(F.col(key_col), weights, seed))


def shard_slots(df: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, key_col: str = "doc_id", text_col: str = "text", seed: str = "shard", stripes: int = STRIPES) -> DataFrame:
    """``key_col, size, text_crc32, shard, slot, grown_shard`` for each row.

    ``grown_shard`` is the shard with one more shard of weight ``grown_weight``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stripe = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("stripe"), _key(F.col(key_col)))), 1, 6), 16, 10).cast("int"), F.lit(stripes))
    rows = df.select(
        F.col(key_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous_shard(F.col(key_col), weights, seed).alias("shard"),
        rendezvous_shard(F.col(key_col), [*weights, grown_weight], seed).alias("grown_shard"),
        stripe.alias("_stripe"),
    )
    counts = rows.groupBy("shard", "_stripe").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "_stripe", F.coalesce(before, F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_stripe").orderBy(key_col, "text_crc32", "size")
    return (
        rows.withColumn("_nth", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "_stripe"])
        .select(key_col, "size", "text_crc32", "shard", (F.col("_start") + F.col("_nth")).cast("long").alias("slot"), "grown_shard")
    )
