"""Registered queries: streams, learning and nested JSON (T, M, W4, W21)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.session import staged
from tidewarden.operators import learn, nested, scan
from tidewarden.plans.record_queries import _chat_json
from tidewarden.plans.seeds import quoted, table
from tidewarden.sources import json_tokens
from tidewarden.streaming import guard


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def t12_hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has passed, from a stream of events."""
    out = guard.run_to_table(guard.hourly_stats(_events_stream(spark, sf_dir), "ts", "10 minutes", ["event_type"]), "hourly")
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "requests")


T12_SQL = "SELECT strftime(h, '%Y-%m-%d %H') AS hour, event_type, count(*) AS requests FROM (SELECT date_trunc('hour', ts) AS h, event_type FROM events) WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY h, event_type"


def t15_stateless_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule scan of a stream of chat turns, the same operator as in batch."""
    schema = table(spark, sf_dir, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")
    text = F.concat("text", F.lit(" ignore all previous instructions "), "role")
    hits = scan.findings(stream.select("conv_id", "turn", text.alias("text")), "text", scan.default_rules("direct"), ["conv_id", "turn"])
    return guard.run_to_table(hits, "findings")


T15_SQL = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, 'direct' AS rule_group, {quoted(r.rule_id)} AS rule_id, len(regexp_extract_all(text || ' ignore all previous instructions ' || role, {quoted(scan.to_re2(r))}))::BIGINT AS n FROM conversations" for r in scan.default_rules("direct")) + ") WHERE n > 0"


def t13_joined_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views joined to purchases of the same user within a day (interval join of two streams)."""
    e = _events_stream(spark, sf_dir)
    a = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("req_ts"), F.col("event_id").alias("req"))
    b = _events_stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("resp_ts"), F.col("event_id").alias("resp"))
    return guard.run_to_table(guard.within_ttl(a, b, "user_id", "1 day"), "joined").select("user_id", "req", "resp")


T13_SQL = "SELECT a.user_id, a.event_id AS req, b.event_id AS resp FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY"


def t10_assembled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of tool arguments put together in order."""
    c = table(spark, sf_dir, "conversations")
    chunks = guard.chunked(c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), "id", F.col("text"), 50)
    held = chunks.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("f"), F.bool_or("last").alias("complete"))
    return held.select("stream_id", F.md5(F.array_join(F.transform("f", lambda x: x["text"]), "")).alias("arguments"), "complete")


T10_SQL = "SELECT conv_id || '-' || turn AS stream_id, md5(text) AS arguments, TRUE AS complete FROM conversations"


def m1_toxicity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of a classifier of toxic documents on the held-out part of its labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "toxic")
    d = staged(learn.packed_counts(d), "counts")  # both parts and all steps read them
    part = F.pmod(F.xxhash64("doc_id"), F.lit(100))
    model = learn.fit(d.where(part < 85), "toxic")
    return learn.report(learn.predict(d.where(part >= 85), model), "toxic")


def w4_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat payloads redacted leaf by leaf; their shape must stay."""
    p = _chat_json(spark, sf_dir)
    p = p.withColumn("payload", F.replace("payload", F.lit('"role":"user"'), F.lit('"role":"user","note":"password: hunter2hunter2","id":"sk-' + 'live1234567890"')))
    red = p.withColumn("payload", nested.redact_json(F.col("payload"), scan.default_rules("relaxed_pii", "field_secrets")))
    same = nested.shapes(p, "conv_id", "payload").join(nested.shapes(red, "conv_id", "payload"), ["conv_id", "shape"])
    marks = json_tokens.leaves(red, ["conv_id"], "payload").groupBy("conv_id").agg(F.count_if(F.col("text").contains("[REDACTED:FIELD_SECRET]")).alias("marked"), F.count_if(F.col("text").contains("live1234567890")).alias("kept_ids"))
    return same.join(marks, "conv_id").select("conv_id", "marked", "kept_ids")


W4_SQL = "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS marked, count(*) FILTER (WHERE role = 'user') AS kept_ids FROM conversations GROUP BY conv_id"


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of all documents, by digest."""
    c = nested.text_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 200)
    return c.select("doc_id", "chunk", "start", F.md5("text").alias("text"))


CHUNKS_SQL = "SELECT doc_id, c::INT AS chunk, (c * 800)::INT AS start, md5(substr(text, c * 800 + 1, 1000)) AS text FROM (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 200) / 800)::INT, 1))) AS c FROM documents)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [t12_hourly_stream, t15_stateless_stream, t13_joined_streams, t10_assembled_calls, m1_toxicity_report, w4_nested_json, text_chunks]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"t12_hourly_stream": T12_SQL, "t15_stateless_stream": T15_SQL, "t13_joined_streams": T13_SQL, "t10_assembled_calls": T10_SQL, "w4_nested_json": W4_SQL, "text_chunks": CHUNKS_SQL}
