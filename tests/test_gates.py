"""Gates let every match of their rule pass."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewarden.operators import gates, rewrite, scan
from tidewarden.plans.seeds import SAMPLES

ODD = ["", "İSK-" + "a" * 12, "\u212aEY: x" * 3, "é" + "name: Zoë Ü", "ＡＢ 账户号 = abcd-1234", "护照：护照 : A1234567", "a\x0b:\x0bb name\x0b=\x0bbob", "x\u2028y\x85z", "😀 name:😀😀😀", "1" * 200, "T" * 40, "(4)15-555 2671", "10.1.2.3.4"]


@pytest.mark.parametrize("group", scan.group_names())
def test_no_gate_stops_a_match(spark, group):
    """Each rule alone on pieces of texts, against its regex without any gate."""
    rules = scan.default_rules(group)
    docs = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    texts = [*ODD, *SAMPLES, *(s.upper() for s in SAMPLES), *docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    flags = df.select("i", *[F.coalesce(F.col("text").rlike(r.java), F.lit(False)).alias(f"f{k}") for k, r in enumerate(rules)]).collect()
    want = {(r["i"], rules[k].rule_id) for r in flags for k in range(len(rules)) if r[f"f{k}"]}
    found = scan.findings(df, "text", rules, ["i"])
    assert {(r["i"], r["rule_id"]) for r in found.collect()} == want
    assert {r["i"] for r in scan.group_flags(df, "text", {"g": rules}).where("g").collect()} == {i for i, _ in want}


@pytest.mark.parametrize(("regex", "text"), [("[^A-Z]b", "ab"), ("(?x) a b", "ab"), (r"\W\d", "\u212a1"), ("(a)\\1", "aa"), ("É", "É"), ("a*", ""), ("(?s)a.b", "a\nb"), ("x{100}", "x" * 100)])
def test_gates_of_odd_regexes(spark, regex, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert scan.group_flags(df, "text", {"g": [scan.Rule("own", "own", regex, True)]}).first()["g"]


@pytest.mark.parametrize("regex", ["[[a]b]x", "[a-z&&[^b]]x", r"\Qa.b\E", "(?x) a b", "a*", r"(a)\1", "(unclosed"])
def test_no_gate_where_parsers_differ(regex):
    assert gates.gate(regex) is None


def test_personal_data_rules_have_gates():
    """Every regex is tried on few texts only, also those without a literal."""
    assert all(gates.gate(r.regex) for r in scan.default_rules("pii", "field_secrets"))


def test_regexes_run_behind_gates(spark):
    df = spark.createDataFrame([(1, "mail me@example.org")], "doc_id int, text string")
    rules = scan.default_rules("pii")
    for out in (scan.findings(df, "text", rules, ["doc_id"]), scan.group_flags(df, "text", {"g": rules})):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan and "Contains(_lower" not in plan


def test_signals_are_looked_for_behind_gates(spark):
    """Typing errors and decoded texts are looked for where some shape of them is, with the same results."""
    from tidewarden.operators import detect, normalize
    from tidewarden.plans.rewrite_queries import injection_signals

    texts = [*ODD, *SAMPLES, "éignroe x", "IGNROE", "ignroee", "sytsem_ x", "%", "%4", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = injection_signals(df)
    t, spam = F.col("text"), [F.col("text").rlike(r.java).cast("int") for r in scan.default_rules("spam_noise")]
    words = F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)), lambda w: F.lit(False) | detect._typo_key(w).isin(*map(detect._python_key, detect.fixed.TYPO_TARGETS)) & ~w.isin(*detect.fixed.TYPO_TARGETS))
    plain = {
        "spam_noise": sum(spam, F.lit(0)) >= 2, "unicode_invisible": normalize.hidden_kinds(t, normalize.INVISIBLE) > 0, "unicode_bidi": normalize.hidden_kinds(t, normalize.BIDI) > 0,
        "typoglycemia": F.size(words) > 0, "obfuscated": detect.decoded_attack(t),
    }
    got, want = (sorted(tuple(bool(x) if k else x for k, x in enumerate(r)) for r in d.collect()) for d in (out.select("i", *plain), df.select("i", *[c.alias(k) for k, c in plain.items()])))
    assert got == want
    plan = out.select("typoglycemia", "obfuscated").drop("text")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan


@pytest.mark.parametrize("protected", [rewrite.MARKER, r"(?i)\bname\s*[:=]\s*\S+"])
def test_redaction_tries_rules_behind_gates(spark, protected):
    """The same texts and hits as a fold of all rules, also where a rule hits only what another one left."""
    rules = scan.default_rules("pii", "field_secrets")
    texts = [*ODD, *SAMPLES, "ab@x.coT" + "1" * 9 + "415-555-2671", "123-45-6789AKIA" + "A" * 16, "éT" + "x" * 33, "name: 415-555-2671 [REDACTED:SSN] 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    parts = rewrite.pieces(F.col("text"), protected)
    for r in rules:
        parts = rewrite.rewrite_pieces(parts, r.java, f"[REDACTED:{r.rule_id}]")
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.col("text").rlike(r.java)
    want = {r["i"]: r["x"] for r in df.select("i", F.when(hit, rewrite.joined(parts)).otherwise(F.col("text")).alias("x")).collect()}
    out = rewrite.redact(df, "text", rules, protected=protected)
    got = out.collect()
    assert {r["i"]: r["text"] for r in got} == want
    new = {r["i"]: [(x.rule_id, n) for x in rules if (n := want[r["i"]].count(f"[REDACTED:{x.rule_id}]") - texts[r["i"]].count(f"[REDACTED:{x.rule_id}]")) > 0] for r in got}
    assert {r["i"]: [(h["pattern"], h["count"]) for h in r["hits"]] for r in got} == new
    assert "ArrowEvalPython" in out._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_are_cut_behind_gates(spark):
    rules = scan.default_rules("pii")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, *SAMPLES, None])], "i int, text string")
    out = rewrite.with_pieces(df, "text", rules)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Contains(_lower" not in plan
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.col("text").rlike(r.java)
    want = {r["i"]: r["h"] for r in df.select("i", F.coalesce(hit, F.lit(False)).alias("h")).collect()}
    for r in out.collect():
        assert (r["_pieces"] is not None) == want[r["i"]]
        assert r["_pieces"] is None or "".join(p["value"] for p in r["_pieces"]) == r["text"]
