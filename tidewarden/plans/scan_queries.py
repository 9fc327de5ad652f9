"""Registered queries: rule scans and detectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions import patterns as fixed
from tidewarden.operators import detect, normalize, scan
from tidewarden.plans.seeds import DOCUMENTS_SQL, documents, quoted, table

#: Scans that list each rule's hits: query name, rule groups, input table.
SCANS: dict[str, tuple[list[str], str]] = {
    "r1_pii": (["pii"], "documents"),
    "r2_field_secrets": (["field_secrets"], "documents"),
    "r3_injection": (["direct", "system_exfil"], "documents"),
    "r4_active_markup": (["html_markdown"], "pages"),
    "r5_remote_indirect": (["remote_content", "indirect_injection", "remote_content_instruction"], "documents"),
    "r6_tool_forgery": (["tool_call_injection"], "documents"),
    "r14_discussion": (["discussion_injection", "quoted"], "documents"),
    "r19_commands": (["commands"], "documents"),
    "r20_strong_intent": (["strong_intent"], "documents"),
    "r21_leaks": (["leak"], "documents"),
    "r22_shapes": (["shape", "web_commands", "encoded"], "documents"),
    "r23_rag_ingestion": (["rag_ingestion"], "documents"),
    "r24_rag_retrieval": (["rag_retrieval"], "documents"),
    "r26_privilege": (["privilege", "discussion_privilege"], "documents"),
    "r31_untrusted": (["untrusted"], "documents"),
    "r32_output": (["system_leak", "markup", "uri", "http_framing", "encoded"], "documents"),
    "r34_lures": (["lures", "restored_secrets"], "documents"),
    "r35_exfiltration": (["exfiltration"], "documents"),
}


def _input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "pages":
        return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return documents(spark, sf_dir)


def scan_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by row and rule."""
    groups, source = SCANS[name]
    return scan.findings(_input(spark, sf_dir, source), "text", scan.default_rules(*groups), ["doc_id"])


def _sql_input(name: str) -> str:
    return "(SELECT page_id AS doc_id, html AS text FROM pages)" if name == "pages" else DOCUMENTS_SQL


#: Rules with look-around: the same matches from runs of characters.
_RUNS = {
    "CN_MOBILE": (r"[0-9]+", r"1[3-9][0-9]{9}", None),
    "CN_ID": (r"[0-9]+[Xx]?", r"[0-9]{17}[Xx]|[0-9]{18}[Xx]?", None),
    "CRYPTO_SOL_ADDR": (r"\b[1-9A-HJ-NP-Za-km-z]{32,44}\b", r".*", "[G-HJ-NP-Zg-hj-km-z]"),
}


def matches_sql(rule: scan.Rule, text: str = "text") -> str:
    """All matches of a rule as a SQL list."""
    if rule.rule_id in _RUNS:
        run, whole, has = _RUNS[rule.rule_id]
        more = f" AND regexp_matches(x, {quoted(has)})" if has else ""
        return f"list_filter(regexp_extract_all({text}, {quoted(run)}), lambda x: regexp_full_match(x, {quoted(whole)}){more})"
    return f"regexp_extract_all({text}, {quoted(scan.to_re2(rule))})"


def hit_sql(rule: scan.Rule, text: str = "text") -> str:
    if rule.rule_id in _RUNS:
        return f"len({matches_sql(rule, text)}) > 0"
    return f"regexp_matches({text}, {quoted(scan.to_re2(rule))})"


def any_sql(group: str, text: str = "text") -> str:
    return "(" + " OR ".join(hit_sql(r, text) for r in scan.default_rules(group)) + ")"


def scan_sql(name: str) -> str:
    groups, source = SCANS[name]
    parts = [f"SELECT doc_id, {quoted(r.group)} AS rule_group, {quoted(r.rule_id)} AS rule_id, len({matches_sql(r)})::BIGINT AS n FROM t" for r in scan.default_rules(*groups)]
    return f"WITH t AS MATERIALIZED {_sql_input(source)} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


def r7_spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two spam classes or more."""
    hits = scan.scan(documents(spark, sf_dir), "text", scan.default_rules("spam_noise"))
    return hits.select("doc_id", F.size("hits").alias("classes"), (F.size("hits") >= 2).alias("spam"))


R7_SQL = f"""SELECT doc_id, ({" + ".join(f"{hit_sql(r)}::INT" for r in scan.default_rules("spam_noise"))}) AS classes,
  ({" + ".join(f"{hit_sql(r)}::INT" for r in scan.default_rules("spam_noise"))}) >= 2 AS spam FROM {DOCUMENTS_SQL} t"""

#: A rare-script sample, by doc_id, for R8 and R9.
_SCRIPTS = [chr(0x0531) + chr(0x0532) + chr(0x10D0) + chr(0x10D1) + "x", chr(0x0A85) + chr(0x0A86) + " " + chr(0x0531) + chr(0x0532) + " " + chr(0x10D0), "plain"]


def r8_r9_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare scripts by text, and words that mix two of them."""
    d = table(spark, sf_dir, "documents")
    more = F.element_at(F.array(*[F.lit(s) for s in _SCRIPTS]), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    text = F.concat("text", F.lit(" "), more)
    return d.select("doc_id", text.alias("t")).select("doc_id", detect.script_count(F.col("t")).alias("scripts"), (detect.script_count(F.col("t")) >= 3).alias("diverse"), F.size(detect.mixed_script_words(F.col("t"))).alias("mixed_words"))


_S8 = f"text || ' ' || ([{', '.join(quoted(s) for s in _SCRIPTS)}])[doc_id % 3 + 1]"
_COUNT8 = " + ".join(f"regexp_matches({{0}}, '\\p{{{{{s}}}}}')::INT" for s in detect.RARE_SCRIPTS)
R8_SQL = f"""SELECT doc_id, ({_COUNT8.format('t')}) AS scripts, ({_COUNT8.format('t')}) >= 3 AS diverse,
  len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) >= 4 AND regexp_matches(w, '[^\\x00-\\x{{024F}}]') AND ({_COUNT8.format('w')}) >= 2))::INT AS mixed_words
FROM (SELECT doc_id, {_S8} AS t FROM documents)"""


def r10_obfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obfuscation markers in the detection form or its condensed form."""
    d = documents(spark, sf_dir).select("doc_id", normalize.detection_form(F.col("text")).alias("t"))
    return d.select("doc_id", detect.obfuscated_marker(F.col("t"), normalize.condensed(F.col("t"))).alias("obfuscated"))


R10_SQL = f"""SELECT doc_id, {" OR ".join(f"contains(t, {quoted(m)}) OR contains(c, {quoted(m)})" for m in fixed.OBFUSCATED)} AS obfuscated
FROM (SELECT doc_id, t, regexp_replace(t, '[^\\pL\\pN]+', '', 'g') AS c FROM (SELECT doc_id, lower(regexp_replace(text, '[{normalize.INVISIBLE}{normalize.BIDI}]', '', 'g')) AS t FROM {DOCUMENTS_SQL} d))"""


def r11_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that base64, hex or percent decoding shows."""
    d = scan.group_flags(documents(spark, sf_dir), "text", {"decodable": [scan.Rule("shapes", "decodable", detect.DECODABLE, True)]})
    return d.select("doc_id", (F.col("decodable") & F.coalesce(detect.decoded_attack(F.col("text"), detect.FIRST_TOKENS), F.lit(False))).alias("decoded_attack"))


_KEYWORDS = quoted("|".join(fixed.DECODED_KEYWORDS))
R11_SQL = f"""SELECT doc_id, coalesce(
  len(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/]{{24,}}={{0,2}}')[1:8], lambda x: length(x) % 4 = 0 AND regexp_matches(lower(coalesce(TRY(decode(from_base64(x))), '')), {_KEYWORDS}))) > 0
  OR len(list_filter(regexp_extract_all(text, '\\b[0-9a-fA-F]{{32,}}\\b')[1:8], lambda x: length(x) % 2 = 0 AND regexp_matches(lower(coalesce(TRY(decode(unhex(x))), '')), {_KEYWORDS}))) > 0
  OR (regexp_matches(text, '%[0-9A-Fa-f]{{2}}') AND regexp_matches(lower(coalesce(TRY(url_decode(text)), '')), {_KEYWORDS})), FALSE) AS decoded_attack
FROM {DOCUMENTS_SQL} t"""


def r12_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets written with their inner letters in another order."""
    d = scan.group_flags(documents(spark, sf_dir), "text", {"typo_shape": [scan.Rule("shapes", "typo_shape", detect.TYPO_SHAPES, True)]})
    words = F.when(F.col("typo_shape") | F.col("text").isNull(), F.array_join(F.array_sort(detect.typo_words(F.col("text"))), " "))
    return d.select("doc_id", words.otherwise("").alias("typos"))


R12_SQL = f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '\\b[a-z]{{4,}}\\b'),
  lambda w: NOT list_contains([{", ".join(quoted(w) for w in fixed.TYPO_TARGETS)}], w)
    AND list_contains([{", ".join(quoted(detect._python_key(w)) for w in fixed.TYPO_TARGETS)}], w[1] || array_to_string(list_sort(string_split(w[2:-2], '')), '') || w[-1])))), ' ') AS typos
FROM {DOCUMENTS_SQL} t"""


def r13_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible and direction-changing code points: occurrences and kinds."""
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", normalize.hidden_count(t, normalize.INVISIBLE).alias("invisible"), normalize.hidden_kinds(t, normalize.INVISIBLE).alias("invisible_kinds"),
        normalize.hidden_count(t, normalize.BIDI).alias("bidi"), normalize.hidden_kinds(t, normalize.BIDI).alias("bidi_kinds"),
    )


def _kinds_sql(chars: str) -> str:
    return " + ".join(f"contains(text, {quoted(c)})::INT" for c in chars)


R13_SQL = f"""SELECT doc_id, (length(text) - length(regexp_replace(text, '[{normalize.INVISIBLE}]', '', 'g')))::INT AS invisible, {_kinds_sql(normalize.INVISIBLE)} AS invisible_kinds,
  (length(text) - length(regexp_replace(text, '[{normalize.BIDI}]', '', 'g')))::INT AS bidi, {_kinds_sql(normalize.BIDI)} AS bidi_kinds FROM {DOCUMENTS_SQL} t"""


def r15_r18_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition and encoded payloads."""
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.round(detect.repetition_ratio(t), 6).alias("ratio"), detect.longest_run(t).alias("longest_run"), detect.most_repeated_line(t).alias("line_count"),
        *[c.alias(k) for k, c in detect.encoded_payloads(t).items()],
    )


R15_SQL = f"""
WITH t AS MATERIALIZED {DOCUMENTS_SQL}, chars AS (
  SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM t
), ratio AS (
  SELECT doc_id, max(n) / sum(n) AS ratio FROM (SELECT doc_id, c, count(*) AS n FROM chars WHERE NOT regexp_matches(c, '^\\s$') GROUP BY ALL) GROUP BY doc_id
), runs AS (
  SELECT doc_id, max(n)::INT AS longest_run FROM (
    SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS k FROM chars) GROUP BY doc_id, c, k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, max(n)::INT AS line_count FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM t) WHERE line <> '' GROUP BY ALL) GROUP BY doc_id
)
SELECT doc_id, round(ratio, 6) AS ratio, longest_run, line_count,
  len(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/]{{80,}}={{0,2}}'), lambda x: length(x) >= 200 AND length(x) % 4 = 0)) > 0 AS base64_payload,
  regexp_matches(text, '\\b[0-9a-fA-F]{{300,}}\\b') AS hex_payload, len(regexp_extract_all(text, '%[0-9A-Fa-f]{{2}}')) >= 12 AS url_encoded_payload
FROM t JOIN ratio USING (doc_id) JOIN runs USING (doc_id) JOIN lines USING (doc_id)"""


def r17_lines_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that most documents share, with their documents and occurrences."""
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    by_doc = lines.groupBy("line", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).where("docs > 1")


R17_SQL = f"""SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS n
FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM {DOCUMENTS_SQL} t) WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) > 1"""

#: Grouped flags: query name, flags by name (any rule of these groups).
FLAGS: dict[str, dict[str, list[str]]] = {
    "r33_force_block": {"force_block": ["http_framing"]},
    "r36_generic_commands": {"command": ["web_commands"], "critical": ["http_framing"]},
    "r37_critical": {"critical": ["http_framing", "privilege", "commands"]},
    "r38_preview": {"previewed": ["direct", "system_exfil", "html_markdown", "remote_content", "indirect_injection", "remote_content_instruction", "tool_call_injection", "spam_noise", "privilege", "commands", "web_commands", "system_leak", "markup", "uri", "leak"]},
    "r39_semantic_classes": {"injection": ["direct"], "leaking": ["system_exfil", "leak"], "privileged": ["privilege"], "discussion": ["discussion_request"]},
}


def flag_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {k: scan.default_rules(*g) for k, g in FLAGS[name].items()}
    return scan.group_flags(documents(spark, sf_dir).select("doc_id", "text"), "text", groups).drop("text")


def flag_sql(name: str) -> str:
    flags = ", ".join(f"({' OR '.join(any_sql(g) for g in groups)}) AS {k}" for k, groups in FLAGS[name].items())
    return f"WITH t AS MATERIALIZED {DOCUMENTS_SQL} SELECT doc_id, {flags} FROM t"


def r38_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of secrets in a text, as rows."""
    d = documents(spark, sf_dir)
    parts = []
    for rule in scan.default_rules("relaxed_pii"):
        hits = scan.with_lowered(d, "text").where(scan.rule_hit(F.col("text"), F.col("_lower"), rule))
        parts.append(hits.select("doc_id", F.lit(rule.rule_id).alias("rule_id"), F.explode(scan.match_spans(F.col("text"), rule.java)).alias("s")).select("doc_id", "rule_id", "s.start", "s.end", F.col("s.value").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def a11_hits_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule hits by source, language and rule, with subtotals."""
    rules = scan.default_rules("pii", "field_secrets", "leak")
    hits = scan.findings(documents(spark, sf_dir), "text", rules, ["doc_id", "source", "lang"])
    return hits.rollup("rule_group", "rule_id", "lang").agg(F.sum("n").alias("hits"), F.count_distinct("doc_id").alias("docs"))


def a11_sql() -> str:
    parts = [f"SELECT doc_id, lang, {quoted(r.group)} AS rule_group, {quoted(r.rule_id)} AS rule_id, len({matches_sql(r)})::BIGINT AS n FROM t" for r in scan.default_rules("pii", "field_secrets", "leak")]
    return f"WITH t AS MATERIALIZED {DOCUMENTS_SQL} SELECT rule_group, rule_id, lang, sum(n)::BIGINT AS hits, count(DISTINCT doc_id) AS docs FROM ({' UNION ALL '.join(parts)}) WHERE n > 0 GROUP BY ROLLUP (rule_group, rule_id, lang)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [r7_spam, r8_r9_scripts, r10_obfuscated, r11_decoded, r12_typos, r13_hidden, r15_r18_anomalies, r17_lines_exploded, r38_spans, a11_hits_by_source]
    return {n: partial(scan_query, n) for n in SCANS} | {n: partial(flag_query, n) for n in FLAGS} | {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    own = {"r7_spam": R7_SQL, "r8_r9_scripts": R8_SQL, "r10_obfuscated": R10_SQL, "r11_decoded": R11_SQL, "r12_typos": R12_SQL, "r13_hidden": R13_SQL, "r15_r18_anomalies": R15_SQL, "r17_lines_exploded": R17_SQL, "a11_hits_by_source": a11_sql()}
    return {n: scan_sql(n) for n in SCANS} | {n: flag_sql(n) for n in FLAGS} | own
