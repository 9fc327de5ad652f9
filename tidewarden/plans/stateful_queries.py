"""Registered queries: streams with state.

The chunks of a stream lie in different files and micro-batches, mostly not in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewarden.functions.session import staged
from tidewarden.operators import scan
from tidewarden.plans.rewrite_queries import _VALUES
from tidewarden.plans.scan_queries import any_sql
from tidewarden.plans.seeds import MESSAGES_SQL, messages, quoted, table
from tidewarden.streaming import calls, exact, guard, timed
from tidewarden.streaming.ordered import run_ordered


def _as_stream(chunks: DataFrame, name: str, then: DataFrame | None = None) -> DataFrame:
    """The rows as a stream of at least two micro-batches; rows of one ``seq`` lie in one file, ``then`` comes last."""
    held = staged(chunks.repartition("seq"), name)
    files = held.inputFiles()
    path = files[0].rsplit("/", 1)[0]
    if then is not None:
        then.write.mode("append").parquet(path)  # newer files are read later
    return held.sparkSession.readStream.schema(held.schema).option("maxFilesPerTrigger", -(-len(files) // 2)).parquet(path)


def _chunks(spark: SparkSession, sf_dir: str, size: int, name: str) -> DataFrame:
    """Each conversation's turns as one text in chunks of ``size`` characters."""
    turns = F.sort_array(F.collect_list(F.struct("msg_idx", "content")))
    texts = messages(spark, sf_dir).groupBy("request_id").agg(F.array_join(F.transform(turns, lambda t: t["content"]), " ").alias("text"))
    return _as_stream(guard.chunked(texts, "request_id", F.col("text"), size), name)


_TEXTS_SQL = f"(SELECT request_id::VARCHAR AS stream_id, string_agg(content, ' ' ORDER BY msg_idx) AS text FROM {MESSAGES_SQL} GROUP BY request_id)"


def _by_stream(frames: DataFrame, *more: Column) -> DataFrame:
    """The frames of each stream joined in order, as a digest, with ``more`` aggregates."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda f: f["text"]), "")
    return frames.groupBy("stream_id").agg(F.md5(whole).alias("text"), *more)


def _counted(*outcomes: str) -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in outcomes]


_T3 = ("leak", "direct")
_T3_SIZE = 240


def t3_guarded_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of conversations behind the guard with its default bounds: frames by outcome and the text that came out."""
    out = guard.run_to_table(guard.release_guarded(_chunks(spark, sf_dir, _T3_SIZE, "chunks"), scan.default_rules(*_T3)), "released")
    return _by_stream(out, *_counted("released", "sanitized", "flushed"))


def _replaced_sql(text: str, rules: list[scan.Rule], mark: str) -> str:
    for r in rules:
        text = f"regexp_replace({text}, {quoted(scan.to_re2(r))}, {quoted(mark)}, 'g')"
    return text


def _any_rule_sql(text: str, rules: list[scan.Rule]) -> str:
    return " OR ".join(f"regexp_matches({text}, {quoted(scan.to_re2(r))})" for r in rules)


def _t3_sql() -> str:
    rules, n, held = scan.default_rules(*_T3), _T3_SIZE, guard.HELD
    return f"""WITH m AS (SELECT stream_id, text AS content, greatest(ceil(length(text) / {n})::INT, 1) AS n FROM {_TEXTS_SQL} t),
p AS (SELECT *, unnest(range(n)) AS k FROM m),
f AS (SELECT stream_id, min(k) AS k FROM p WHERE (k < {guard.FIRST_PROBES} OR (k + 1) % {guard.PROBE_STEP} = 0 OR k = n - 1)
  AND ({_any_rule_sql(f"right(left(content, (k + 1) * {n}), {guard.WINDOW})", rules)}) GROUP BY stream_id)
SELECT stream_id, md5(CASE WHEN k IS NULL THEN content ELSE left(content, greatest(k - {held}, 0) * {n}) || {_replaced_sql(f"substr(content, greatest(k - {held}, 0) * {n} + 1, (k + 1 - greatest(k - {held}, 0)) * {n})", rules, "[REDACTED:stream]")} END) AS text,
  greatest(coalesce(k, n - 1) + CASE WHEN k IS NULL THEN 1 ELSE 0 END - {held}, 0)::BIGINT AS released, (k IS NOT NULL)::BIGINT AS sanitized, CASE WHEN k IS NULL THEN least(n, {held}) ELSE 0 END::BIGINT AS flushed
FROM m LEFT JOIN f USING (stream_id)"""


_T4, _T4_SIZE, _T4_BUDGET, _T4_WINDOW = "field_secrets", 100, 2000, 256


def t4_stream_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams whose first 2,000 characters are looked at in a window of 256; what passed behind them (T4)."""
    probe = guard.HeadProbe(scan.default_rules(_T4), budget=_T4_BUDGET, window=_T4_WINDOW)
    out = guard.run_to_table(run_ordered(_chunks(spark, sf_dir, _T4_SIZE, "heads"), probe), "heads-out")
    return _by_stream(out, *_counted("released", "sanitized", "passed"))


def _t4_sql() -> str:
    rules, n, budget = scan.default_rules(_T4), _T4_SIZE, _T4_BUDGET
    return f"""WITH d AS (SELECT stream_id, text AS t, greatest(ceil(length(text) / {n})::INT, 1) AS n FROM {_TEXTS_SQL} s),
p AS (SELECT *, unnest(range(n)) AS k FROM d),
f AS (SELECT stream_id, min(k) AS k FROM p WHERE k * {n} < {budget} AND ({_any_rule_sql(f"right(left(t, least((k + 1) * {n}, {budget})), {_T4_WINDOW})", rules)}) GROUP BY stream_id),
e AS (SELECT stream_id, t, n, k, least(n - 1, {-(-budget // n) - 1}) AS e FROM d LEFT JOIN f USING (stream_id))
SELECT stream_id, md5(CASE WHEN k IS NULL THEN t ELSE {_replaced_sql(f"left(t, (k + 1) * {n})", rules, "[REDACTED:command]")} || substr(t, (k + 1) * {n} + 1) END) AS text,
  CASE WHEN k IS NULL THEN e + 1 ELSE 0 END::BIGINT AS released, (k IS NOT NULL)::BIGINT AS sanitized, (n - 1 - coalesce(k, e))::BIGINT AS passed FROM e"""


def t5_exact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed values replaced in conversations that come in chunks of 60 characters, over whose borders many values go (T5)."""
    out = guard.run_to_table(run_ordered(_chunks(spark, sf_dir, 60, "exact"), exact.ExactValues(_VALUES)), "exact-out")
    return _by_stream(out, F.sum("count").alias("replaced"))


T5_SQL = f"""WITH t AS (SELECT stream_id, text FROM {_TEXTS_SQL} s)
SELECT stream_id, md5(replace(replace(replace(text, 'abcdefgh12345678', '[REDACTED:EXACT]'), 'sessionvalue1234', '[REDACTED:EXACT]'), 'hunter2hunter2', '[REDACTED:EXACT]')) AS text,
  ((length(text) - length(replace(text, 'abcdefgh12345678', ''))) / 16 + (length(text) - length(replace(text, 'sessionvalue1234', ''))) / 16 + (length(text) - length(replace(text, 'hunter2hunter2', ''))) / 14)::BIGINT AS replaced FROM t"""


def t11_stream_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the streams of conversations end: by done mark, by a protocol's last event, with a finish reason alone, or broken off; those without a last chunk are closed by an event-time timer."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    n = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    kind = F.pmod("conv_id", F.lit(5))
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    body = c.select("conv_id", F.col("turn").alias("seq"), delta.alias("text"), F.lit(False).alias("end"))
    final = F.when(kind == 0, "[DONE]").when(kind == 1, '{"type": "message_stop"}').when(kind == 2, '{"choices": [{"delta": {}, "finish_reason": "length"}]}').otherwise("{broken")
    ends = n.select("conv_id", F.col("n").alias("seq"), final.alias("text"), F.lit(True).alias("end"))
    # kinds 2 and 4 never say that they are over: the clock, a last event an hour later than all others, closes them
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("seq", F.lit(60)))
    rows = body.unionByName(ends).select(F.col("conv_id").cast("string").alias("stream_id"), "seq", "text", (F.col("end") & ~kind.isin(2, 4)).alias("last"), at.alias("ts"))
    clock = spark.sql("SELECT 'clock' AS stream_id, 0L AS seq, '[DONE]' AS text, TRUE AS last, timestamp_seconds(1700003600) AS ts")
    stream = _as_stream(rows, "events", then=clock)
    out = guard.run_to_table(run_ordered(stream, guard.StreamEnds(window=300, silence_ms=60_000, event_time=True), late="10 minutes"), "ends")
    return out.where("stream_id <> 'clock'").select("stream_id", "end_reason", "frames", F.md5("replay").alias("replay"))


T11_SQL = f"""WITH c AS (SELECT conv_id, max(turn) + 2 AS frames, trim(right(string_agg(text, '' ORDER BY turn), 300), ' \t\n\r') AS w FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS stream_id, CASE conv_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'done' WHEN 2 THEN 'terminal_without_done:length' ELSE 'early_end' END AS end_reason, frames::BIGINT AS frames,
  CASE WHEN conv_id % 5 = 2 THEN md5(w) WHEN conv_id % 5 > 2 THEN md5(CASE WHEN w = '' THEN '' ELSE w || chr(10) || chr(10) END || {quoted(guard.NOTICE)}) END AS replay FROM c"""


_T17 = "field_secrets"


def t17_streamed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a stream of fragments of one call for each turn, in turns, put together and cleaned whole."""
    size = 50
    m = messages(spark, sf_dir).select("request_id", "msg_idx", F.to_json(F.struct(F.col("content").alias("q"))).alias("a"))
    pieces = m.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.length("a") / size).cast("int") - 1)))
    call = F.struct(F.col("msg_idx").alias("index"), F.struct(F.when(F.col("k") == 0, F.concat(F.lit("t"), F.col("msg_idx").cast("string"))).alias("name"), F.substring("a", F.col("k") * size + 1, F.lit(size)).alias("arguments")).alias("function"))
    event = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(call).alias("tool_calls")).alias("delta"))).alias("choices")))
    in_turn = Window.partitionBy("request_id").orderBy("k", "msg_idx")  # fragments of the calls alternate
    n = F.count(F.lit(1)).over(Window.partitionBy("request_id"))
    rows = pieces.withColumns({"seq": (F.row_number().over(in_turn) - 1).cast("long"), "n": n})
    chunks = rows.select(F.col("request_id").cast("string").alias("stream_id"), "seq", event.alias("text"), (F.col("seq") == F.col("n") - 1).alias("last"))
    out = guard.run_to_table(run_ordered(_as_stream(chunks, "calls"), calls.ToolCalls(scan.default_rules(_T17))), "calls-out")
    arguments = F.get_json_object("event", "$.choices[0].delta.tool_calls[0].function.arguments")
    return out.select("stream_id", "index", "name", F.md5("arguments").alias("arguments"), "outcome", (arguments == F.col("arguments")).alias("valid"))


def _t17_sql() -> str:
    rules = scan.default_rules(_T17)
    hit, clean = _any_rule_sql("a", rules), _replaced_sql("a", rules, "[REDACTED:command]")
    return f"""WITH a AS (SELECT *, to_json({{'q': content}})::VARCHAR AS a FROM {MESSAGES_SQL} t), c AS (SELECT *, {hit} AS hit, {clean} AS clean FROM a)
SELECT request_id::VARCHAR AS stream_id, msg_idx AS index, 't' || msg_idx AS name, md5(CASE WHEN NOT hit THEN a WHEN json_valid(clean) THEN clean ELSE '"[REDACTED:command]"' END) AS arguments,
  CASE WHEN NOT hit THEN 'clean' WHEN json_valid(clean) THEN 'cleaned' ELSE 'replaced' END AS outcome, TRUE AS valid FROM c"""


#: A last event long after all others, so that the watermark passes these.
_CLOCK = "SELECT 'clock' AS key, timestamp'2030-01-01' AS ts, 0L AS id, "


def t7_rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed and rejected events of each user (two in ten hours), taken in order of time."""
    e = table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS key", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS id", "event_type AS kind")
    stream = _as_stream(e.withColumn("seq", F.col("id") % 4), "limits", then=spark.sql(_CLOCK + "'' AS kind, 0L AS seq"))
    out = guard.run_to_table(timed.run_timed(stream.drop("seq"), timed.RateLimit(2, 36_000), late="60 days"), "limited")
    return out.groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected"))


_DELAYS = [60, 1800, 1801, 86_401, 60]


def t8_mapping_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of requests, each with two responses of an age of a minute to a day: what is restored (T8, J1, W14 in a stream)."""
    m = messages(spark, sf_dir).where("msg_idx = 0")
    k, start = F.pmod("request_id", F.lit(5)), F.pmod("request_id", F.lit(1000))
    held = F.create_map(F.lit("{{KEPT_A_1}}"), F.concat(F.lit("v"), F.col("request_id").cast("string")))
    asked = F.array(F.when(k == 4, "{{KEPT_A_2}}").otherwise("{{KEPT_A_1}}"))
    bad = scan.group_hit(F.col("content"), F.lower("content"), scan.default_rules("exfiltration"))
    delay = F.element_at(F.array(*map(F.lit, _DELAYS)), (k + 1).cast("int"))

    def event(i: int, seconds: Column, kind: str, names: Column, found: Column) -> Column:
        return F.struct(F.lit(i).cast("long").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + seconds).alias("ts"), F.lit(kind).alias("kind"), names.alias("names"), found.alias("found"))

    none, nothing = F.lit(None).cast("map<string,string>"), F.lit(None).cast("array<string>")
    events = F.array(event(0, start, "mapping", held, nothing), event(1, start + delay, "response", none, asked), event(2, start + delay + 10, "response", none, asked))
    rows = m.select(F.col("request_id").cast("string").alias("key"), bad.alias("suspicious"), F.inline(events)).select("key", "ts", "id", "kind", "names", "found", "suspicious")
    clock = spark.sql(_CLOCK + "'' AS kind, CAST(NULL AS MAP<STRING,STRING>) AS names, CAST(NULL AS ARRAY<STRING>) AS found, FALSE AS suspicious, 0L AS seq")
    stream = _as_stream(rows.withColumn("seq", F.col("id")), "mappings", then=clock)
    out = guard.run_to_table(timed.run_timed(stream.drop("seq"), timed.MappingStore(), late="60 days"), "mappings-out")
    return out.where("key <> 'clock'").select("key", "id", "outcome", F.array_join("restored", ",").alias("restored"))


T8_SQL = f"""WITH m AS (SELECT request_id, request_id % 5 AS k, {any_sql("exfiltration", "content")} AS bad FROM {MESSAGES_SQL} t WHERE msg_idx = 0)
SELECT request_id::VARCHAR AS key, id::BIGINT AS id, CASE WHEN id = 2 OR k = 3 THEN 'missing' WHEN k = 2 THEN 'stale_mapping' WHEN k = 4 THEN 'partial_restore' WHEN bad THEN 'exfiltration' ELSE 'restored' END AS outcome,
  CASE WHEN id = 1 AND k < 2 AND NOT bad THEN 'v' || request_id END AS restored FROM m, (VALUES (1), (2)) v(id)"""


def t9_pending_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by user that events set; two hours after "executing" they are pending again, a day after their last event they are dropped."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(F.lit("pending"), F.lit("executing"), F.lit("done")), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), status.alias("status"), F.lit(86_400_000).cast("long").alias("kept"))
    stream = _as_stream(rows.withColumn("seq", F.col("id") % 4), "pending", then=spark.sql(_CLOCK + "'' AS status, CAST(NULL AS BIGINT) AS kept, 0L AS seq"))
    return guard.run_to_table(timed.run_timed(stream.drop("seq"), timed.PendingStore(7200), late="60 days"), "pending-out")


T9_SQL = """WITH e AS (SELECT user_id::VARCHAR AS key, (epoch_us(ts) // 1000) AS "at", (['pending', 'executing', 'done'])[event_id % 3 + 1] AS status, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS next FROM events)
SELECT key, "at", status, 'set' AS why FROM e
UNION ALL SELECT key, "at" + 7200000, 'pending', 'recovered' FROM e WHERE status = 'executing' AND (next IS NULL OR next >= "at" + 7200000)
UNION ALL SELECT key, "at" + 86400000, 'dropped', 'retention' FROM e WHERE next IS NULL OR next >= "at" + 86400000"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [t3_guarded_release, t4_stream_heads, t5_exact_stream, t11_stream_ends, t7_rate_limits, t8_mapping_state, t9_pending_state, t17_streamed_calls]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"t3_guarded_release": _t3_sql(), "t4_stream_heads": _t4_sql(), "t5_exact_stream": T5_SQL, "t11_stream_ends": T11_SQL, "t8_mapping_state": T8_SQL, "t9_pending_state": T9_SQL, "t17_streamed_calls": _t17_sql()}
