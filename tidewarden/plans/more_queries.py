"""Registered queries: packs, stream reasons, blends and limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.session import staged
from tidewarden.operators import decide, normalize, rewrite, scan
from tidewarden.plans.record_queries import S1_SQL, _chat_json, encrypted
from tidewarden.plans.rewrite_queries import _d3_sql, injection_scores
from tidewarden.plans.scan_queries import _RUNS, any_sql, flag_query, hit_sql
from tidewarden.plans.seeds import DOCUMENTS_SQL, documents, quoted
from tidewarden.sources import payloads, rules

_OWN = [("direct", "own_rule", 0, r"closing\s+words", False), ("direct", "broken", 1, "(unclosed", False)]


def s14_overlaid_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan with a pack whose group ``direct`` a user's table replaces; a broken regex is left out."""
    pack = rules.overlay(rules.rules_table(spark, "direct", "markup"), spark.createDataFrame(_OWN, rules.SCHEMA))
    good, _ = rules.load_rules(pack)
    return scan.findings(documents(spark, sf_dir), "text", good, ["doc_id"])


S14_SQL = f"""WITH t AS MATERIALIZED {DOCUMENTS_SQL} SELECT doc_id, 'direct' AS rule_group, 'own_rule' AS rule_id, len(regexp_extract_all(text, '(?i)closing\\s+words'))::BIGINT AS n FROM t WHERE regexp_matches(text, '(?i)closing\\s+words')
UNION ALL """ + " UNION ALL ".join(f"SELECT doc_id, 'markup', '{r.rule_id}', len(regexp_extract_all(text, {quoted(scan.to_re2(r))}))::BIGINT FROM t WHERE {hit_sql(r)}" for r in scan.default_rules("markup"))


def d11_block_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each text would stop a stream, with the reason's text."""
    groups = {"command": scan.default_rules("commands"), "leak": scan.default_rules("system_leak"), "privilege": scan.default_rules("privilege"), "tool": scan.default_rules("dangerous_parameters")}
    d = scan.group_flags(documents(spark, sf_dir).select("doc_id", "text"), "text", groups)
    tags = F.array_compact(F.array(F.when(F.col("command"), F.lit("response_anomaly_high_risk_command")), F.when(F.col("privilege"), F.lit("response_privilege_abuse")), F.when(F.col("tool"), F.lit("tool_call_violation"))))
    actions = F.array_compact(F.array(F.when(F.col("tool"), F.lit("tool_call_guard:dangerous_param:block"))))
    disposition = F.when(F.col("leak"), "block").otherwise("allow")
    reason = decide.block_reason(tags, actions, disposition, F.lit(None).cast("string"), F.lit(False), F.when(F.col("doc_id") % 50 == 0, 0.95).otherwise(F.lit(0.1)))
    return scan.settled(d.select("doc_id", reason.alias("reason"))).where("reason is not null").select("doc_id", "reason", decide.reason_text(F.col("reason")).alias("why"))


_WHY = " ".join(f"WHEN reason = '{k}' THEN {quoted(v)}" for k, v in decide.REASON_TEXTS.items())
D11_SQL = f"""WITH t AS MATERIALIZED {DOCUMENTS_SQL}, r AS (SELECT doc_id, CASE WHEN {any_sql("commands")} THEN 'response_high_risk_command' WHEN {any_sql("system_leak")} THEN 'response_blocked'
  WHEN {any_sql("dangerous_parameters")} THEN 'response_tool_call_violation' WHEN {any_sql("privilege")} THEN 'response_privilege_abuse' WHEN doc_id % 50 = 0 THEN 'response_high_risk' END AS reason FROM t)
SELECT doc_id, reason, CASE {_WHY} ELSE reason END AS why FROM r WHERE reason IS NOT NULL"""


def d14_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray-zone documents scored again by classes and a confidence from their ids."""
    f = flag_query("r39_semantic_classes", spark, sf_dir)
    confidence = F.lit(0.5) + F.pmod("doc_id", F.lit(10)) / 20
    label = F.when(F.col("doc_id") % 3 == 0, "safe").when(F.col("doc_id") % 3 == 1, "injection").otherwise("unknown")
    second = f.select("doc_id", decide.blended_risk({k: F.col(k) for k in decide.CLASS_RISK}, F.col("discussion"), label, confidence).alias("semantic"))
    first = injection_scores(spark, sf_dir).withColumnRenamed("score", "risk")
    return decide.escalated(first, "doc_id", second)


D14_SQL = f"""WITH f AS (SELECT doc_id, {any_sql("direct")} AS injection, ({any_sql("system_exfil")} OR {any_sql("leak")}) AS leaking, {any_sql("privilege")} AS privileged, {any_sql("discussion_request")} AS discussion,
  0.5 + (doc_id % 10) / 20.0::DOUBLE AS c, CASE doc_id % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'injection' ELSE 'unknown' END AS l FROM {DOCUMENTS_SQL} t),
a AS (SELECT *, (l = 'injection' AND c >= 0.85) AS sure FROM f),
b AS (SELECT *, greatest(CASE WHEN sure THEN 0.55 + (c - 0.85) * 2 ELSE 0 END, CASE WHEN injection THEN 0.76 ELSE 0 END, CASE WHEN leaking THEN 0.9 ELSE 0 END, CASE WHEN privileged THEN 0.86 ELSE 0 END)::DOUBLE AS r, sure::INT + injection::INT + leaking::INT + privileged::INT AS k FROM a),
s AS (SELECT doc_id, CASE WHEN l = 'safe' AND c >= 0.88 THEN 0.0 ELSE round((CASE WHEN k >= 2 THEN least(1.0, r + 0.06) ELSE r END) * (CASE WHEN k > 0 AND discussion THEN 0.72 ELSE 1 END) * (CASE WHEN l = 'safe' AND c >= 0.7 THEN 0.75 ELSE 1 END), 6) END AS semantic FROM b),
d AS ({_d3_sql("")})
SELECT doc_id, CASE WHEN score > 0.25 AND score < 0.75 THEN greatest(score, semantic) ELSE score END AS risk FROM d JOIN s USING (doc_id)"""


def p25_w20_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as function names, and the values of a map of each text replaced by marks."""
    d = documents(spark, sf_dir)
    held = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    marked = F.transform_values(held, lambda k, v: F.when(v.isNotNull(), F.lit("[VALUE]")))
    return d.select("doc_id", F.md5(rules.function_name(F.col("text"))).alias("name"), F.array_join(F.array_sort(F.map_values(marked)), ",").alias("marks"))


P25_SQL = f"SELECT doc_id, md5(regexp_replace(text, '[^a-zA-Z0-9_-]', '_', 'g')) AS name, '[VALUE],[VALUE]' AS marks FROM {DOCUMENTS_SQL} t"


def w1_w14_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of requests (four documents each) with the values of all personal-data rules replaced by numbered placeholders of their request, and restored."""
    rules_of = scan.default_rules("pii")
    d = documents(spark, sf_dir).select((F.expr("doc_id div 4")).alias("request_id"), "doc_id", "text")
    pieces = staged(rewrite.with_pieces(d, "text", rules_of), "pieces")
    mapping = staged(rewrite.placeholder_map(pieces, "request_id", "doc_id", rules_of), "placeholders")
    hidden = staged(rewrite.pseudonymised(pieces, mapping, "request_id", "doc_id", "text"), "hidden")
    back = rewrite.restored(hidden, mapping, "request_id", "doc_id", "text", once=False, most=1 << 30).select("doc_id", F.md5("text").alias("restored"))
    return hidden.join(back, "doc_id").select("doc_id", F.md5("text").alias("hidden"), F.size(rewrite.placeholders_in(F.col("text"))).alias("placeholders"), "restored")


_K, _C, _V = "chr(57344)", "chr(57345)", "chr(57346)"


def _pieces_sql() -> str:
    """``p`` (request_id, doc_id, text, kinds and values of the pieces), rule by rule as in the operator."""
    steps = [f"f0 AS MATERIALIZED (SELECT doc_id // 4 AS request_id, doc_id, text, [text] AS parts FROM {DOCUMENTS_SQL} t)"]
    rules_of = [("LITERAL", rewrite.placeholder_pattern("KEPT")), *((r.rule_id, scan.to_re2(r)) for r in scan.default_rules("pii"))]
    for k, (kind, regex) in enumerate(rules_of):
        new = f"{_C} || {_K} || '{kind}' || {_V} || '\\0' || {_C}"
        hit, marked = f"regexp_matches(text, {quoted(regex)})", f"regexp_replace(p, {quoted(regex)}, {new}, 'g')"
        if kind in _RUNS:  # look-around: runs of characters that match as a whole
            run, whole, has = _RUNS[kind]
            own = f"regexp_full_match(x, {quoted(whole)})" + (f" AND regexp_matches(x, {quoted(has)})" if has else "")
            hit = f"len(list_filter(regexp_extract_all(text, {quoted(run)}), lambda x: {own})) > 0"
            most = 18 if kind == "CN_ID" else 99
            marked = f"array_to_string(list_transform(string_split(regexp_replace(p, {quoted(run)}, {_C} || '\\0' || {_C}, 'g'), {_C}), lambda x: CASE WHEN {own} THEN {_C} || {_K} || '{kind}' || {_V} || x[1:{most}] || {_C} || x[{most + 1}:] ELSE x END), '')"
        steps.append(f"f{k + 1} AS MATERIALIZED (SELECT request_id, doc_id, text, CASE WHEN {hit} THEN flatten(list_transform(parts, lambda p: CASE WHEN starts_with(p, {_K}) THEN [p] ELSE string_split({marked}, {_C}) END)) ELSE parts END AS parts FROM f{k})")
    kinds = "[" + ", ".join(quoted(k) for k, _ in rules_of) + "]"
    steps.append(
        f"""p AS MATERIALIZED (SELECT request_id, doc_id, i, CASE WHEN starts_with(x, {_K}) THEN x[2:strpos(x, {_V}) - 1] END AS kind, CASE WHEN starts_with(x, {_K}) THEN x[strpos(x, {_V}) + 1:] ELSE x END AS value
  FROM (SELECT request_id, doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM f{len(rules_of)}))"""
    )
    steps.append(f"v AS (SELECT request_id, value, min({{'o': doc_id, 'r': list_position({kinds}, kind), 'i': i, 'k': kind}}) AS f FROM p WHERE kind IS NOT NULL GROUP BY ALL)")
    steps.append("m AS (SELECT request_id, value, '{{KEPT_' || translate(upper(md5(request_id::VARCHAR)[1:12]), '0123456789', 'GHIJKLMNOP') || '_' || f.k || '_' || row_number() OVER (PARTITION BY request_id ORDER BY f) || '}}' AS name FROM v)")
    return ",\n".join(steps)


W1_W14_SQL = f"""WITH {_pieces_sql()},
h AS (SELECT doc_id, string_agg(CASE WHEN kind IS NULL THEN p.value ELSE name END, '' ORDER BY i) AS hidden, count(name) AS n FROM p LEFT JOIN m ON p.request_id = m.request_id AND p.value = m.value AND p.kind IS NOT NULL GROUP BY doc_id)
SELECT doc_id, md5(hidden) AS hidden, n::INT AS placeholders, md5(text) AS restored FROM h JOIN f0 USING (doc_id)"""


def w22_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encrypted with a key column and read back."""
    return encrypted(spark, sf_dir).withColumn("value", F.md5("value"))


W22_WHOLE_SQL = "SELECT doc_id, md5(text) AS value, FALSE AS plain FROM documents"


def s6_whole_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole text leaves of nested payloads, with their paths."""
    return payloads.json_leaves(_chat_json(spark, sf_dir), "conv_id", "payload", depth=4).select("conv_id", "path", F.md5("text").alias("text"))


S6_WHOLE_SQL = f"""SELECT conv_id, '$.model' AS path, md5('m') AS text FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
SELECT conv_id, '$.messages[' || msg_idx || '].' || k AS path, md5(CASE WHEN k = 'role' THEN role ELSE content END) AS text FROM ({S1_SQL}), (VALUES ('role'), ('content')) v(k)"""


def p25_p4_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as function names, and masked."""
    return documents(spark, sf_dir).select("doc_id", F.md5(rules.function_name(F.col("text"))).alias("name"), F.md5(normalize.masked(F.col("text"))).alias("masked"))


P25_P4_SQL = f"""SELECT doc_id, md5(regexp_replace(text, '[^a-zA-Z0-9_-]', '_', 'g')) AS name,
  md5(CASE WHEN n >= 10 THEN m[1:3] || repeat('*', n - 5) || m[-2:] WHEN n = 0 THEN '' WHEN n = 1 THEN '*' WHEN n <= 4 THEN m[1] || repeat('*', n - 2) || m[-1] ELSE m[1:2] || repeat('*', n - 4) || m[-2:] END) AS masked
FROM (SELECT *, length(m) AS n FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS m FROM {DOCUMENTS_SQL} t))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [s14_overlaid_pack, d11_block_reasons, d14_blended, p25_w20_names, w1_w14_round_trip, w22_whole_texts, s6_whole_leaves, p25_p4_whole_texts]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"s14_overlaid_pack": S14_SQL, "d11_block_reasons": D11_SQL, "d14_blended": D14_SQL, "p25_w20_names": P25_SQL, "w1_w14_round_trip": W1_W14_SQL, "w22_whole_texts": W22_WHOLE_SQL, "s6_whole_leaves": S6_WHOLE_SQL, "p25_p4_whole_texts": P25_P4_SQL}
