"""Registered queries: JSON bodies cleaned in place, kept fields, slim payloads, responses, contexts, stages, a live pack."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions import patterns as fixed
from tidewarden.functions.session import shared_dir
from tidewarden.operators import nested, scan, stages
from tidewarden.plans.rewrite_queries import _nested
from tidewarden.plans.scan_queries import any_sql
from tidewarden.plans.seeds import DOCUMENTS_SQL, documents, quoted, seeded, seeded_sql, table
from tidewarden.sources import json_tokens, responses, rules
from tidewarden.streaming import live_rules

_MARK, _BLOCKED = "[cleaned]", "[blocked-call]"
_TURNS_SQL = f"(SELECT conv_id, turn, conv_id + turn AS k, {seeded_sql('text', '(conv_id + turn)')} AS text FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("conv_id") + F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("k"), seeded(F.col("text"), key).alias("text"))


def _by_key(choices: list[Column]) -> Column:
    return F.element_at(F.array(*choices), (F.pmod("k", F.lit(len(choices))) + 1).cast("int"))


def _struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _bodies(text: Column) -> list[Column]:
    """Bodies of the three vendor shapes, each with the text in its places."""
    args = F.to_json(_struct(cmd=text))
    call = _struct(id=F.lit("c1"), function=_struct(name=F.lit("run"), arguments=args))
    chat = _struct(id=F.lit("r"), choices=F.array(_struct(index=F.lit(0), message=_struct(content=text, tool_calls=F.array(call)))), usage=_struct(total=F.lit(3)))
    item = "struct<type:string,content:array<struct<type:string,text:string>>,name:string,arguments:string,action:struct<cmd:array<string>>,summary:string>"
    listed = [
        _struct(type=F.lit("message"), content=F.array(_struct(type=F.lit("output_text"), text=text))),
        _struct(type=F.lit("function_call"), name=F.lit("run"), arguments=args),
        _struct(type=F.lit("bash"), action=_struct(cmd=F.array(text))),
        _struct(type=F.lit("reasoning"), summary=text),
    ]
    output = F.array(*[F.from_json(F.to_json(x), item) for x in listed])
    blocks = F.to_json(_struct(content=F.array(F.from_json(F.to_json(_struct(type=F.lit("text"), text=text)), "struct<type:string,text:string,input:struct<q:string>>"), F.from_json(F.to_json(_struct(type=F.lit("tool_use"), input=_struct(q=text))), "struct<type:string,text:string,input:struct<q:string>>"))))
    return [F.to_json(chat), F.to_json(_struct(output=output)), blocks]


def w19_clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three vendor shapes cleaned in place, dangerous calls replaced; bodies stay JSON of the same shape."""
    d = _turns(spark, sf_dir).withColumn("body", _by_key(_bodies(F.col("text"))))
    clean = nested.clean_body(F.col("body"), scan.default_rules("markup", "uri"), scan.default_rules("web_commands"), _MARK, _BLOCKED)
    d = d.select("conv_id", "turn", "body", clean.alias("clean"))
    at = lambda *paths: F.md5(F.coalesce(*[F.get_json_object("clean", p) for p in paths]))
    paths = lambda c: F.transform(json_tokens.json_tokens(F.col(c)), lambda t: t["path"])
    return d.select(
        "conv_id",
        "turn",
        at("$.choices[0].message.content", "$.output[0].content[0].text", "$.content[0].text").alias("content"),
        F.coalesce(F.get_json_object("clean", "$.choices[0].message.tool_calls[0].function.name"), F.get_json_object("clean", "$.output[1].name")).alias("name"),
        at("$.choices[0].message.tool_calls[0].function.arguments", "$.output[1].arguments").alias("arguments"),
        at("$.output[2].action.cmd[0]").alias("action"),
        at("$.output[3].summary", "$.content[1].input.q").alias("other"),
        (paths("body") == paths("clean")).alias("same_shape"),
    )


_CLEAN = [("markup", _MARK), ("uri", _MARK)]
W19_SQL = f"""WITH t AS (SELECT *, to_json({{'cmd': text}})::VARCHAR AS args FROM {_TURNS_SQL}), h AS (SELECT *, {any_sql("web_commands", "('run ' || args)")} AS bad, {any_sql("web_commands")} AS acted FROM t)
SELECT conv_id, turn, md5({_nested("text", _CLEAN)}) AS content, CASE WHEN k % 3 < 2 THEN CASE WHEN bad THEN '{_BLOCKED}' ELSE 'run' END END AS name,
  CASE WHEN k % 3 < 2 THEN md5(CASE WHEN bad THEN '{{"_blocked": "{_BLOCKED}"}}' ELSE {_nested("args", _CLEAN)} END) END AS arguments,
  CASE WHEN k % 3 = 1 THEN md5(CASE WHEN acted THEN '{_BLOCKED}' ELSE {_nested("text", _CLEAN)} END) END AS action, CASE WHEN k % 3 > 0 THEN md5(text) END AS other, TRUE AS same_shape FROM h"""


def w15_clean_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of any kind cleaned: JSON by leaf, other texts whole, binary ones not; script rules only where a sure shape occurs."""
    d = _turns(spark, sf_dir)
    body = _by_key([F.to_json(_struct(a=_struct(b=F.array(F.col("text"), F.lit("x"))), n=F.lit(1))), F.col("text"), F.col("text"), F.concat(F.lit("{"), F.col("text"))])
    clean = nested.clean_response(body, F.pmod("k", F.lit(4)) != 2, nested.gated_rules(scan.default_rules("web_commands")), _MARK)
    return d.select("conv_id", "turn", "k", clean.alias("clean")).select("conv_id", "turn", F.md5(F.when(F.pmod("k", F.lit(4)) == 0, F.get_json_object("clean", "$.a.b[0]")).otherwise(F.col("clean"))).alias("text"))


def _w15_sql() -> str:
    sure = " OR ".join(f"regexp_matches(x, {quoted('(?i)' + p)})" for p in fixed.SURE_SCRIPTS)
    out = "SELECT * FROM g"
    for r in scan.default_rules("web_commands"):
        new = f"regexp_replace(text, {quoted(scan.to_re2(r))}, '{_MARK}', 'g')"
        new = f"CASE WHEN sure THEN {new} ELSE text END" if "xss" in r.rule_id else new
        out = f"SELECT * REPLACE ({new} AS text) FROM ({out})"
    return f"""WITH t AS (SELECT conv_id, turn, k, CASE WHEN k % 4 = 3 THEN '{{' || text ELSE text END AS x FROM {_TURNS_SQL}),
g AS (SELECT *, x AS text, ({sure}) AS sure FROM t)
SELECT conv_id, turn, md5(CASE WHEN k % 4 = 2 THEN x ELSE text END) AS text FROM ({out})"""


_SECRET = " password: hunter2hunter2"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _turns(spark, sf_dir).withColumn("t", F.concat("text", F.lit(_SECRET)))
    block = "struct<type:string,source:struct<url:string>,image_url:struct<url:string>>"
    blocks = [_struct(type=F.lit("image"), source=_struct(url=F.col("t"))), _struct(type=F.lit("other"), source=_struct(url=F.col("t"))), _struct(type=F.lit("input_image"), image_url=_struct(url=F.col("t")))]
    body = _struct(id=F.col("t"), note=F.col("t"), x_signature=F.col("t"), content=F.array(*[F.from_json(F.to_json(b), block) for b in blocks]))
    return d.select("conv_id", "turn", F.to_json(body).alias("payload"))


def p22_p23_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads redacted: identities, signatures and locators of media stay, notes and other sources don't."""
    d = _fields(spark, sf_dir).withColumn("payload", nested.redact_json(F.col("payload"), scan.default_rules("field_secrets")))
    paths = {"own_id": "$.id", "note": "$.note", "signature": "$.x_signature", "media": "$.content[0].source.url", "source": "$.content[1].source.url", "image": "$.content[2].image_url.url"}
    return d.select("conv_id", "turn", *[F.md5(F.get_json_object("payload", p)).alias(k) for k, p in paths.items()])


def _field_marks() -> str:
    text = "t"
    for r in scan.default_rules("field_secrets"):
        text = f"regexp_replace({text}, {quoted(scan.to_re2(r))}, '[REDACTED:{r.rule_id}]', 'g')"
    return text


_FIELDS_SQL = f"(SELECT *, text || '{_SECRET}' AS t FROM {_TURNS_SQL})"
P22_SQL = f"SELECT conv_id, turn, md5(t) AS own_id, md5(r) AS note, md5(t) AS signature, md5(t) AS media, md5(r) AS source, md5(t) AS image FROM (SELECT *, {_field_marks()} AS r FROM {_FIELDS_SQL})"


def p23_field_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by leaf and field: locators of media are scanned too."""
    hits = nested.json_hits(_fields(spark, sf_dir), ["conv_id", "turn"], "payload", scan.default_rules("field_secrets"))
    return hits.select("conv_id", "turn", "path", "field", "rule_id", "n")


P23_SQL = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT conv_id, turn, path, field, {quoted(r.rule_id)} AS rule_id, len(regexp_extract_all(t, {quoted(scan.to_re2(r))}))::BIGINT AS n FROM {_FIELDS_SQL}, (VALUES ('$.note', 'note'), ('$.content[0].source.url', 'url'), ('$.content[1].source.url', 'url'), ('$.content[2].image_url.url', 'url')) v(path, field)"
    for r in scan.default_rules("field_secrets")
) + ") WHERE n > 0"


def p12_slim_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without the parameters of their tools."""
    tools = F.array(_struct(name=F.lit("f"), parameters=_struct(q=F.array(F.col("text"), F.lit("}")))))
    listed = F.array(_struct(content=F.col("text"), parameters=F.col("text")), _struct(content=F.lit("c, }"), parameters=F.lit("p")))
    d = _turns(spark, sf_dir).withColumn("payload", F.to_json(_struct(model=F.lit("m"), tools=tools, messages=listed)))
    return d.select("conv_id", "turn", F.md5(json_tokens.slimmed(F.col("payload"))).alias("slim"))


P12_SQL = f"SELECT conv_id, turn, md5(to_json({{'model': 'm', 'tools': []::VARCHAR[], 'messages': [{{'content': text}}, {{'content': 'c, }}'}}]}})::VARCHAR) AS slim FROM {_TURNS_SQL}"


def d9_p20_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages with errors by row, under three filter modes: the redaction takes no text over 4,000 characters, the guard none with direction marks."""
    redaction = stages.Stage("redaction", lambda t: stages.attempt(F.regexp_replace(t, r"\d", "#"), F.when(F.length(t) > 4000, F.lit("too_long"))), critical=False, redacts=True)
    guard = stages.Stage("guard", lambda t: stages.attempt(F.replace(t, F.lit("ignore"), F.lit("[removed]")), F.when(t.contains("‮"), F.lit("direction"))))
    mode = F.element_at(F.array(F.lit(""), F.lit(stages.REDACT), F.lit(stages.PASSTHROUGH), F.lit("")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    out = stages.run_stages(documents(spark, sf_dir), "text", [redaction, guard], mode, forward=True)
    return out.select("doc_id", F.md5("text").alias("text"), "disposition", F.array_join("actions", ",").alias("actions"), F.array_join("reasons", ",").alias("reasons"))


D9_SQL = f"""WITH t AS (SELECT doc_id, text, doc_id % 4 AS m, doc_id % 4 <> 2 AND length(text) > 4000 AS long, doc_id % 4 IN (0, 3) AND contains(text, '‮') AS bad FROM {DOCUMENTS_SQL}),
r AS (SELECT *, CASE WHEN m <> 2 AND NOT long THEN regexp_replace(text, '[0-9]', '#', 'g') ELSE text END AS red FROM t)
SELECT doc_id, md5(CASE WHEN m IN (0, 3) AND NOT bad THEN replace(red, 'ignore', '[removed]') ELSE red END) AS text, CASE WHEN bad THEN 'block' ELSE 'allow' END AS disposition,
  concat_ws(',', CASE WHEN long THEN 'request_pipeline:degraded:redaction' END, CASE WHEN bad THEN 'request_pipeline:error:guard' END) AS actions, CASE WHEN bad THEN 'request_filter_error' ELSE '' END AS reasons FROM r"""


def t14_live_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of chat turns scanned by a pack that is looked at in each micro-batch."""
    base = f"{shared_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    rules.rules_table(spark, "direct").write.parquet(f"{base}/pack")
    schema = table(spark, sf_dir, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")
    turns = stream.select("conv_id", "turn", seeded(F.col("text"), F.col("conv_id") + F.col("turn")).alias("text"))
    live_rules.scan_live(turns, "text", ["conv_id", "turn"], f"{base}/pack", f"{base}/out", f"{base}/state").awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    return found.select("conv_id", "turn", "rule_id", "n", F.col("pack_version").isNotNull().alias("versioned"))


T14_SQL = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, {quoted(r.rule_id)} AS rule_id, len(regexp_extract_all(text, {quoted(scan.to_re2(r))}))::BIGINT AS n, TRUE AS versioned FROM {_TURNS_SQL}" for r in scan.default_rules("direct")) + ") WHERE n > 0"


def s7_responses_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of answers with output items, in eight shapes: text, message, call, action, choices, error, status, no JSON."""
    d = _turns(spark, sf_dir)
    t = F.col("text")
    shapes = [
        _struct(output_text=t, output=F.lit("x")),
        _struct(output=F.array(_struct(type=F.lit("message"), content=F.array(_struct(type=F.lit("output_text"), text=t), _struct(type=F.lit("x"), text=F.lit("{}")))))),
        _struct(output_text=F.lit(""), output=F.array(_struct(type=F.lit("function_call"), name=F.lit("f"), arguments=t))),
        _struct(output=F.array(_struct(type=F.lit("bash"), action=_struct(cmd=F.substring(F.regexp_replace(t, "[^a-z]", ""), 1, 300))))),
        _struct(choices=F.array(_struct(message=_struct(content=F.array(_struct(text=t), _struct(text=F.lit("!"))))))),
        _struct(status=F.lit("failed"), error=_struct(code=F.substring(F.regexp_replace(t, "[^a-z]", ""), 1, 400))),
        _struct(instructions=t, output=F.array(F.lit(1))),
    ]
    body = _by_key([*[F.to_json(s) for s in shapes], F.concat(F.lit("plain "), t)])
    d = d.select("conv_id", "turn", body.alias("body"))
    return d.select("conv_id", "turn", F.md5(responses.responses_output_text(F.col("body"))).alias("text"))


S7_RESPONSES_SQL = f"""SELECT conv_id, turn, md5(CASE k % 8 WHEN 0 THEN text WHEN 1 THEN text || '{{}}' WHEN 2 THEN '[function_call:f(' || left(text, 200) || ')]' WHEN 3 THEN '[bash:' || left('{{"cmd":"' || left(a, 300) || '"}}', 200) || ']' WHEN 4 THEN text || '!'
  WHEN 5 THEN '[status=failed error=' || left('{{"code":"' || left(a, 400) || '"}}', 300) || ']' WHEN 6 THEN '[status=unknown]' ELSE 'plain ' || text END) AS text FROM (SELECT *, regexp_replace(text, '[^a-z]', '', 'g') AS a FROM {_TURNS_SQL})"""


def p11_hit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit of a literal with what stands around it."""
    shown = scan.hit_context(F.col("text"), "(?i)instructions")
    return documents(spark, sf_dir).select("doc_id", F.posexplode(shown).alias("hit", "context")).select("doc_id", "hit", F.md5("context").alias("context"))


P11_SQL = f"""WITH p AS (SELECT doc_id, text, length(text) AS n, regexp_split_to_array(text, '(?i)instructions') AS parts FROM {DOCUMENTS_SQL}),
h AS (SELECT doc_id, text, n, hit, (list_sum(list_transform(parts[1:hit + 1], lambda x: length(x))) + 12 * hit)::BIGINT AS s FROM (SELECT *, unnest(range(len(parts) - 1)) AS hit FROM p)),
w AS (SELECT *, greatest(s - 40, 0) AS l, least(s + 52, n) AS r FROM h)
SELECT doc_id, hit::INT AS hit, md5(regexp_replace(CASE WHEN l > 0 THEN '…' ELSE '' END || substr(text, l + 1, r - l) || CASE WHEN r < n THEN '…' ELSE '' END, '^\\s+|\\s+$', '', 'g')) AS context FROM w"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [w19_clean_bodies, w15_clean_responses, p22_p23_fields, p23_field_hits, p12_slim_payloads, d9_p20_stages, t14_live_rules, s7_responses_texts, p11_hit_context]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"w19_clean_bodies": W19_SQL, "w15_clean_responses": _w15_sql(), "p22_p23_fields": P22_SQL, "p23_field_hits": P23_SQL, "p12_slim_payloads": P12_SQL, "d9_p20_stages": D9_SQL, "t14_live_rules": T14_SQL, "s7_responses_texts": S7_RESPONSES_SQL, "p11_hit_context": P11_SQL}
