"""Registered queries: text preparation, rewrites and scores (P, W, D)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions import patterns as fixed
from tidewarden.operators import detect, normalize, rewrite, scan, score
from tidewarden.plans.scan_queries import R13_SQL, R15_SQL, any_sql
from tidewarden.plans.seeds import DOCUMENTS_SQL, MESSAGES_SQL, SAMPLES, documents, messages, quoted, table

_HIDDEN = normalize.INVISIBLE + normalize.BIDI
_D = f"WITH t AS MATERIALIZED {DOCUMENTS_SQL} "


def p1_p3_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, detection and condensed forms."""
    t = documents(spark, sf_dir).select("doc_id", normalize.clean_form(F.col("text")).alias("clean"), normalize.detection_form(F.col("text")).alias("detection"))
    return t.select("doc_id", F.md5("clean").alias("clean"), F.md5("detection").alias("detection"), F.length(normalize.condensed(F.col("detection"))).alias("condensed"))


P1_SQL = _D + f"""SELECT doc_id, md5(clean) AS clean, md5(d) AS detection, length(regexp_replace(d, '[^\\pL\\pN\\pM]+', '', 'g'))::INT AS condensed
FROM (SELECT doc_id, clean, trim(regexp_replace(lower(clean), '\\s+', ' ', 'g')) AS d FROM (SELECT doc_id, regexp_replace(text, '[{_HIDDEN}]', '', 'g') AS clean FROM t))"""


def p4_p11_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps, masks, deformed forms and excerpts."""
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.md5(normalize.capped(t, 1000)).alias("capped"), F.md5(normalize.masked(t)).alias("masked"),
        F.md5(normalize.deformed(t)).alias("deformed"), F.md5(normalize.deformed_words(t)).alias("deformed_words"), normalize.excerpt(t, 60).alias("excerpt"),
        normalize.looks_like_base64(t).alias("binary"),
    )


P4_SQL = _D + """SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN left(text, 1000) || ' [TRUNCATED]' ELSE text END) AS capped,
  md5(CASE WHEN n >= 10 THEN m[1:3] || repeat('*', n - 5) || m[-2:] WHEN n = 0 THEN '' WHEN n = 1 THEN '*' WHEN n <= 4 THEN m[1] || repeat('*', n - 2) || m[-1] ELSE m[1:2] || repeat('*', n - 4) || m[-2:] END) AS masked,
  md5(regexp_replace(regexp_replace(text, '((?s).{3})', '\\1-', 'g'), CASE WHEN length(text) % 3 = 0 THEN '-$' ELSE '$x' END, '')) AS deformed,
  md5(regexp_replace(regexp_replace(text, '(\\S{3})', '\\1' || chr(1), 'g'), chr(1) || '(\\s|$)', '\\1', 'g').replace(chr(1), '-')) AS deformed_words,
  CASE WHEN length(f) > 60 THEN left(f, 60) || '... [' || length(f) || ' chars]' ELSE f END AS excerpt,
  coalesce(length(text) >= 256 AND (length(left(text, 512)) - length(regexp_replace(left(text, 512), '[A-Za-z0-9+/=\\n\\r]', '', 'g'))) / length(left(text, 512)) > 0.92, FALSE) AS binary
FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS m, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n, regexp_replace(text, '\\s+', ' ', 'g') AS f FROM t)"""


def p5_runtime_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without runtime log lines (one is put between the lines of every text)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n  System: [tool] Exec completed\n")).alias("text"))
    return d.select("doc_id", F.md5(normalize.without_lines(F.col("text"), normalize.RUNTIME_LINE)).alias("text"), F.lit(True).alias("checked"))


P5_SQL = "SELECT doc_id, md5(text) AS text, TRUE AS checked FROM documents"

_RULES = scan.default_rules("relaxed_pii", "field_secrets")


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.redact(documents(spark, sf_dir), "text", _RULES)


def w2_redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with secrets marked, and how many rules replaced something."""
    return redacted(spark, sf_dir).select("doc_id", F.md5("text").alias("text"), F.size("hits").alias("rules_hit"))


def _redacted_sql(rules: list[scan.Rule], source: str = "t", text: str = "text") -> str:
    """The fold of replacements as nested queries, one for each rule."""
    sql = f"SELECT *, 0 AS hit FROM {source}"
    for r in rules:
        rx = quoted(scan.to_re2(r))
        sql = f"SELECT * REPLACE (regexp_replace({text}, {rx}, '[REDACTED:{r.rule_id}]', 'g') AS {text}, hit + regexp_matches({text}, {rx})::INT AS hit) FROM ({sql})"
    return sql


W2_SQL = _D + f"SELECT doc_id, md5(text) AS text, hit AS rules_hit FROM ({_redacted_sql(_RULES)})"


def w2_all_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after all personal-data rules in order."""
    return rewrite.redact(documents(spark, sf_dir), "text", scan.default_rules("pii", "field_secrets")).select("doc_id", F.length("text").alias("n"), F.transform("hits", lambda h: h["pattern"]).alias("patterns"))


def w5_hits_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by pattern, role of text (source) and pattern, summed (also A10)."""
    hits = redacted(spark, sf_dir).select("source", F.explode_outer("hits").alias("h")).where("h is not null").select("source", F.col("h.pattern").alias("pattern"), F.col("h.count").alias("count"))
    return rewrite.merge_hits(hits, ["source", "pattern"])


def _w5_sql() -> str:
    sql, parts = "SELECT * FROM t", []
    for r in _RULES:
        rx = quoted(scan.to_re2(r))
        parts.append(f"SELECT source, '{r.rule_id}' AS pattern, len(regexp_extract_all(text, {rx})) AS n FROM ({sql})")
        sql = f"SELECT * REPLACE (regexp_replace(text, {rx}, '[REDACTED:{r.rule_id}]', 'g') AS text) FROM ({sql})"
    return _D + f"SELECT source, pattern, sum(n)::BIGINT AS count FROM ({' UNION ALL '.join(parts)}) WHERE n > 0 GROUP BY ALL"


def w6_whitelisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction that leaves the values of whitelisted keys alone."""
    kept = r"(?i)\bapi_key\s*[:=]\s*\S{1,2048}|" + rewrite.MARKER
    out = rewrite.redact(documents(spark, sf_dir), "text", scan.default_rules("field_secrets"), protected=kept)
    return out.select("doc_id", F.md5("text").alias("text"))


W6_SQL = _D + f"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, {quoted(scan.to_re2(scan.default_rules('field_secrets')[0]).replace('api[_-]?key|', 'api-key|apikey|'))}, '[REDACTED:FIELD_SECRET]', 'g'),
  {quoted(scan.to_re2(scan.default_rules('field_secrets')[1]))}, '[REDACTED:AUTH_BEARER]', 'g')) AS text FROM t"""

_VALUES = ["hunter2hunter2", "sessionvalue1234", "abcdefgh12345678", "too short"]


def w8_exact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed values replaced, longest first, with the number of replacements."""
    text, count = rewrite.replace_values(F.col("text"), _VALUES)
    return documents(spark, sf_dir).select("doc_id", F.md5(text).alias("text"), count.alias("replaced"))


W8_SQL = _D + """SELECT doc_id, md5(replace(replace(replace(text, 'abcdefgh12345678', '[REDACTED:EXACT]'), 'sessionvalue1234', '[REDACTED:EXACT]'), 'hunter2hunter2', '[REDACTED:EXACT]')) AS text,
  ((length(text) - length(replace(text, 'abcdefgh12345678', ''))) / 16 + (length(text) - length(replace(text, 'sessionvalue1234', ''))) / 16 + (length(text) - length(replace(text, 'hunter2hunter2', ''))) / 14)::INT AS replaced FROM t"""


def w8_value_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a value table (the first words of all benchmark items) replaced by a join."""
    values = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"(\S+)", 1).alias("value")).where("length(value) >= 5")
    return rewrite.replace_value_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", values, "doc_id").select("doc_id", F.md5("text").alias("text"))


W8_TABLE_SQL = """WITH v AS (SELECT list(DISTINCT x) AS l FROM (SELECT regexp_extract(text, '(\\S+)', 1) AS x FROM benchmark) WHERE length(x) >= 5)
SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '\\S+|\\s'), lambda w: CASE WHEN list_contains(l, w) THEN '[REDACTED:EXACT]' ELSE w END), '')) AS text FROM documents, v"""


def w9_w10_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System prompts as fingerprints, untrusted content between marks."""
    trust = spark.createDataFrame([(k, t, m) for k, (t, m) in fixed.SOURCE_TRUST.items()], "source string, trusted boolean, risk_multiplier double")
    m = messages(spark, sf_dir).withColumn("role", F.when(F.col("msg_idx") == 0, "system").otherwise(F.col("role"))).join(F.broadcast(trust), "source", "left")
    untrusted = ~F.coalesce("trusted", ~F.col("source").isin(*fixed.UNTRUSTED_SOURCES))
    content = rewrite.isolated(rewrite.fingerprint(F.col("role"), F.col("content")), untrusted)
    return m.select("request_id", "msg_idx", content.alias("content"), untrusted.alias("untrusted"), F.coalesce("risk_multiplier", F.lit(1.0)).alias("risk_multiplier"))


W9_SQL = f"""WITH trust(source, trusted, risk_multiplier) AS (VALUES {", ".join(f"('{k}', {t}, {m}::DOUBLE)" for k, (t, m) in fixed.SOURCE_TRUST.items())})
SELECT request_id, msg_idx, CASE WHEN untrusted THEN '[UNTRUSTED_CONTENT_START]' || chr(10) || c || chr(10) || '[UNTRUSTED_CONTENT_END]' ELSE c END AS content, untrusted, risk_multiplier
FROM (SELECT request_id, msg_idx, CASE WHEN msg_idx = 0 OR role = 'system' THEN '[SYSTEM_PROMPT_PROTECTED]::' || left(sha256(content), 16) ELSE content END AS c,
  NOT coalesce(trusted, NOT list_contains([{", ".join(quoted(s) for s in fixed.UNTRUSTED_SOURCES)}], m.source)) AS untrusted, coalesce(risk_multiplier, 1.0) AS risk_multiplier
  FROM {MESSAGES_SQL} m LEFT JOIN trust ON m.source = trust.source)"""


def w11_clean_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with attack shapes marked and cut to 4,000 characters."""
    rules = {g: scan.default_rules(g) for g in ("web_commands", "encoded", "shape")}
    return documents(spark, sf_dir).select("doc_id", F.md5(rewrite.clean_request(F.col("text"), rules)).alias("text"))


def _nested(text: str, groups: list[tuple[str, str]]) -> str:
    for g, mark in groups:
        for r in scan.default_rules(g):
            text = f"regexp_replace({text}, {quoted(scan.to_re2(r))}, '{mark}', 'g')"
    return text


W11_SQL = _D + f"""SELECT doc_id, md5(CASE WHEN length(x) > 4000 THEN left(x, 4000) || ' [TRUNCATED]' ELSE x END) AS text
FROM (SELECT doc_id, regexp_replace({_nested("text", [("web_commands", "[REDACTED:command]"), ("encoded", "[REDACTED:encoded-payload]"), ("shape", "[REDACTED:shape-anomaly]")])}, '[{_HIDDEN}]', '', 'g') AS x FROM t)"""

_OUTPUT = ["http_framing", "encoded", "uri", "markup", "spam_noise"]


def w12_clean_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs cleaned by class; texts with odd ids count as risky."""
    rules = {g: scan.default_rules(g) for g in _OUTPUT}
    d = scan.group_flags(documents(spark, sf_dir).select("doc_id", "text"), "text", rules)
    cleaned = rewrite.clean_output(F.col("text"), F.col("doc_id") % 2 == 1, {g: F.col(g) for g in _OUTPUT}, rules)
    return d.select("doc_id", F.md5(cleaned).alias("text"), (cleaned != F.col("text")).alias("sanitized"))


def _w12_sql() -> str:
    marks = {"http_framing": "[REDACTED:command]", "encoded": "[REDACTED:encoded-payload]", "uri": "[unsafe-uri-removed]", "markup": "[unsafe-tag-removed]", "spam_noise": "[spam-content-removed]"}
    flags = ", ".join(f"{any_sql(g, 'raw')} AS f_{g}" for g in _OUTPUT)
    sql = f"SELECT *, {flags} FROM (SELECT doc_id, text, text AS raw FROM t)"
    should = "(doc_id % 2 = 1 OR f_http_framing OR f_uri OR f_markup OR f_spam_noise)"
    for g, mark in marks.items():
        gate = f"f_{g} AND doc_id % 2 = 1" if g == "encoded" else f"(f_{g} OR doc_id % 2 = 1)"
        sql = f"SELECT * REPLACE (CASE WHEN {should} AND {gate} THEN {_nested('text', [(g, mark)])} ELSE text END AS text) FROM ({sql})"
    return _D + f"SELECT doc_id, md5(text) AS text, text <> raw AS sanitized FROM ({sql})"


def w16_w18_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit regions with their surroundings, merged and deformed; the hits themselves marked with dashes."""
    rx = "(?di)" + "|".join(f"(?:{r.regex})" for r in scan.default_rules("privilege", "commands") if not r.regex.startswith("(?"))
    t = F.col("text")
    d = documents(spark, sf_dir).select("doc_id", "text", scan.match_spans(t, rx).alias("s"))
    d = d.withColumns({"merged": scan.merge_spans(rewrite.widened(F.col("s"), t)), "own": scan.merge_spans(F.col("s"))})
    return d.select("doc_id", F.size("s").alias("hits"), F.size("merged").alias("regions"), F.md5(rewrite.mark_spans(t, F.col("merged"), normalize.deformed_words)).alias("fragments"), F.md5(rewrite.mark_spans(t, F.col("own"), lambda x: F.concat(F.lit("--"), x, F.lit("--")))).alias("marked"))


def _signals() -> dict[str, list[scan.Rule]]:
    return {k: scan.default_rules(k) for k in ("direct", "system_exfil", "html_markdown", "remote_content", "remote_content_instruction", "indirect_injection", "tool_call_injection")} | {"discussion": scan.default_rules("discussion_injection", "quoted")}


#: Shapes that are signals, or that a text must contain for one.
_SHAPES = {k: [scan.Rule("shapes", k, regex, True)] for k, regex in {"unicode_invisible": f"[{normalize.INVISIBLE}]", "unicode_bidi": f"[{normalize.BIDI}]", "typo_shape": detect.TYPO_SHAPES, "decodable": detect.DECODABLE}.items()}


def injection_signals(df: DataFrame, most: int | None = None) -> DataFrame:
    """Boolean columns of all injection signals for ``text``; with ``most``, only so many first tokens of a kind are decoded."""
    spam = {f"spam_{i}": [r] for i, r in enumerate(scan.default_rules("spam_noise"))}
    d = scan.group_flags(df, "text", _signals() | spam | _SHAPES)
    t = F.col("text")
    found = d.withColumns({
        "spam_noise": sum((F.col(s).cast("int") for s in spam), F.lit(0)) >= 2,
        "typoglycemia": F.col("typo_shape") & (F.size(detect.typo_words(t)) > 0), "obfuscated": F.col("decodable") & F.coalesce(detect.decoded_attack(t, most), F.lit(False)),
    })
    return found.drop(*spam, "typo_shape", "decodable")


def injection_scores(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Injection score of every document, with the discussion factor."""
    d = injection_signals(documents(spark, sf_dir).select("doc_id", "text"), most)
    return d.select("doc_id", score.injection_score({s: F.col(s) for s in fixed.SIGNALS}, F.col("discussion")).alias("score"))


def d3_injection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``injection_scores`` from the first decodable tokens of each text, as in the SQL."""
    return injection_scores(spark, sf_dir, detect.FIRST_TOKENS)


def d5_anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly score of every document."""
    t = F.col("text")
    points = {
        "repetition_ratio": detect.repetition_ratio(t) >= 0.55, "max_run_length": detect.longest_run(t) >= 80, "repeated_line": detect.most_repeated_line(t) >= 40,
        **detect.encoded_payloads(t), "invisible_chars": normalize.hidden_count(t, normalize.INVISIBLE) >= 6, "bidi_control": normalize.hidden_count(t, normalize.BIDI) > 0,
    }
    d = scan.group_flags(documents(spark, sf_dir).select("doc_id", "text"), "text", {"high_risk_command": scan.default_rules("commands")})
    d = d.withColumns(points)
    return d.select("doc_id", score.anomaly_score({p: F.col(p) for p in fixed.POINTS}).alias("score"), *points, "high_risk_command")


def d6_action_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least risk by document from the actions of its categories."""
    actions = spark.createDataFrame([(s, c, a) for (s, c), a in fixed.ACTIONS.items()], "stage string, category string, action string").where("stage = 'injection_detector'")
    d = injection_signals(documents(spark, sf_dir).select("doc_id", "text"), detect.FIRST_TOKENS)
    found = d.select("doc_id", "discussion", F.explode(F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in fixed.SIGNALS]))).alias("category"))
    joined = found.join(F.broadcast(actions), "category", "left").withColumn("floor", score.action_floor(F.coalesce("action", F.lit("none")), F.col("discussion")))
    return joined.groupBy("doc_id").agg(F.max("floor").alias("risk"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def _signals_sql(first: str = "[1:8]") -> str:
    lower = "lower(text)"
    cols = [f"{any_sql(k)} AS {k}" for k in _signals() if k != "discussion"]
    cols.append(f"({any_sql('discussion_injection')} OR {any_sql('quoted')}) AS discussion")
    cols.append("(" + " + ".join(f"regexp_matches(text, {quoted(scan.to_re2(r))})::INT" for r in scan.default_rules("spam_noise")) + ") >= 2 AS spam_noise")
    cols.append("(" + " OR ".join(f"contains(text, {quoted(c)})" for c in normalize.INVISIBLE) + ") AS unicode_invisible")
    cols.append("(" + " OR ".join(f"contains(text, {quoted(c)})" for c in normalize.BIDI) + ") AS unicode_bidi")
    keys = ", ".join(quoted(detect._python_key(w)) for w in fixed.TYPO_TARGETS)
    words = ", ".join(quoted(w) for w in fixed.TYPO_TARGETS)
    cols.append(f"len(list_filter(regexp_extract_all({lower}, '\\b[a-z]{{4,}}\\b'), lambda w: NOT list_contains([{words}], w) AND list_contains([{keys}], w[1] || array_to_string(list_sort(string_split(w[2:-2], '')), '') || w[-1]))) > 0 AS typoglycemia")
    decoded = quoted("|".join(fixed.DECODED_KEYWORDS))
    cols.append(
        f"""coalesce(len(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/]{{24,}}={{0,2}}'){first}, lambda x: length(x) % 4 = 0 AND regexp_matches(lower(coalesce(TRY(decode(from_base64(x))), '')), {decoded}))) > 0
  OR len(list_filter(regexp_extract_all(text, '\\b[0-9a-fA-F]{{32,}}\\b'){first}, lambda x: length(x) % 2 = 0 AND regexp_matches(lower(coalesce(TRY(decode(unhex(x))), '')), {decoded}))) > 0
  OR (regexp_matches(text, '%[0-9A-Fa-f]{{2}}') AND regexp_matches(lower(coalesce(TRY(url_decode(text)), '')), {decoded})), FALSE) AS obfuscated"""
    )
    return f"SELECT doc_id, {', '.join(cols)} FROM t"


def _d3_sql(first: str = "[1:8]") -> str:
    raw = []
    for bucket, weight in score.INJECTION_WEIGHTS.items():
        rest = " * ".join(f"CASE WHEN {s} THEN {1 - v / 10} ELSE 1.0 END::DOUBLE" for s, (b, v) in fixed.SIGNALS.items() if b == bucket)
        raw.append(f"{weight}::DOUBLE * (1.0 - {rest})")
    fixed_class = " OR ".join(score.NON_REDUCIBLE)
    return _D + f"""SELECT doc_id, CASE WHEN discussion AND NOT ({fixed_class}) THEN round(s * {score.MITIGATION}, 6) ELSE s END AS score
FROM (SELECT *, round(1.0 - exp(-2.0 * ({" + ".join(raw)})), 6) AS s FROM ({_signals_sql(first)}))"""


def _d6_sql() -> str:
    parts = []
    for s in fixed.SIGNALS:
        action = fixed.ACTIONS.get(("injection_detector", s))
        floor = {"block": (0.95, 0.58), "review": (0.85, 0.58), "downgrade": (0.82, 0.58)}.get(action, (0.0, 0.0))
        parts.append(f"SELECT doc_id, '{s}' AS category, CASE WHEN discussion THEN {floor[1]} ELSE {floor[0]} END::DOUBLE AS floor FROM f WHERE {s}")
    return _D + f", f AS MATERIALIZED ({_signals_sql()}) SELECT doc_id, max(floor) AS risk, string_agg(category, ',' ORDER BY category) AS categories FROM ({' UNION ALL '.join(parts)}) GROUP BY doc_id"


def _d5_sql() -> str:
    points = {b: " + ".join(f"CASE WHEN {p} THEN {v} ELSE 0 END" for p, (k, v) in fixed.POINTS.items() if k == b) for b in score.ANOMALY_WEIGHTS}
    raw = " + ".join(f"{w}::DOUBLE * least(1.0, ({points[b]})::DOUBLE / {score.ANOMALY_MOST[b]}::DOUBLE)" for b, w in score.ANOMALY_WEIGHTS.items())
    return f"""WITH a AS ({R15_SQL}), h AS ({R13_SQL}), c AS (SELECT doc_id, {any_sql("commands")} AS high_risk_command FROM {DOCUMENTS_SQL} t), f AS (
  SELECT a.doc_id, ratio >= 0.55 AS repetition_ratio, longest_run >= 80 AS max_run_length, line_count >= 40 AS repeated_line, base64_payload, hex_payload, url_encoded_payload,
    invisible >= 6 AS invisible_chars, bidi > 0 AS bidi_control, high_risk_command FROM a JOIN h USING (doc_id) JOIN c USING (doc_id))
SELECT *, round(1.0 - exp(-2.0 * ({raw})), 6) AS score FROM f"""


def d16_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over the review threshold of each security level."""
    s = injection_scores(spark, sf_dir)
    counts = [F.count_if(F.col("score") >= score.level_threshold(0.40, level)).alias(level) for level in score.LEVEL_FACTORS]
    return s.agg(*counts, F.count(F.lit(1)).alias("docs"))


def d17_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of the messages."""
    m = messages(spark, sf_dir)
    return m.select("request_id", "msg_idx", score.stable_id(F.col("role"), F.col("msg_idx")).alias("stable_id"))


D17_SQL = f"""SELECT request_id, msg_idx, sha256('{{"p0":"' || role || '","p1":' || msg_idx || '}}') AS stable_id FROM {MESSAGES_SQL} m"""


def noisy_or_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or of document scores by source (user-defined aggregate form)."""
    d = documents(spark, sf_dir).select("source", (F.pmod("doc_id", F.lit(10)) / 40).alias("severity"))
    return d.groupBy("source").agg(F.round(score.noisy_or_rows(F.col("severity")), 6).alias("score"))


NOISY_SQL = "SELECT source, round(1 - exp(sum(ln(1 - (doc_id % 10) / 40.0::DOUBLE))), 6) AS score FROM documents GROUP BY source"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_p3_normal_forms, p4_p11_excerpts, p5_runtime_lines, w2_redacted_texts, w2_all_pii, w5_hits_by_pattern, w6_whitelisted, w8_exact_values, w8_value_table, w9_w10_messages, w11_clean_requests, w12_clean_outputs, w16_w18_spans, d3_injection_score, d5_anomaly_score, d6_action_floors, d16_levels, d17_stable_ids, noisy_or_by_source]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    assert len(SAMPLES) > 1
    d16 = f"SELECT count(*) FILTER (WHERE score >= {score.level_threshold(0.4, 'high')}) AS high, count(*) FILTER (WHERE score >= {score.level_threshold(0.4, 'medium')}) AS medium, count(*) FILTER (WHERE score >= {score.level_threshold(0.4, 'low')}) AS low, count(*) AS docs FROM ({_d3_sql('')})"
    return {
        "p1_p3_normal_forms": P1_SQL, "p4_p11_excerpts": P4_SQL, "p5_runtime_lines": P5_SQL, "w2_redacted_texts": W2_SQL, "w5_hits_by_pattern": _w5_sql(), "w6_whitelisted": W6_SQL, "w8_exact_values": W8_SQL,
        "w8_value_table": W8_TABLE_SQL, "w9_w10_messages": W9_SQL, "w11_clean_requests": W11_SQL, "w12_clean_outputs": _w12_sql(), "d3_injection_score": _d3_sql(), "d5_anomaly_score": _d5_sql(), "d6_action_floors": _d6_sql(), "d16_levels": d16,
        "d17_stable_ids": D17_SQL, "noisy_or_by_source": NOISY_SQL,
    }
