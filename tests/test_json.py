"""JSON rewrites, stages with errors by row and live rule packs."""

import json
import random
import time

from pyspark.sql import functions as F

from tidewarden.operators import nested, stages
from tidewarden.operators.scan import Rule
from tidewarden.sources import json_tokens as jt
from tidewarden.sources import responses
from tidewarden.streaming import live_rules

WORD = [Rule("g", "WORD", "secret")]


def random_value(rnd, depth=0):
    k = rnd.randrange(7 if depth < 5 else 4)
    if k == 0:
        return rnd.choice(["a", "x y", 'q"u', "b\\", "é\n", '{"a":1}', "[1,2]", "a:", "", "null", ":"])
    if k == 1:
        return rnd.choice([1, -2.5, True, None, 1e30])
    if k in (2, 3):
        return "a secret"
    if k in (4, 5):
        return {rnd.choice(["a", "b", "c d", "e.f", "tools", "parameters", "id", 'g"h']): random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def rewritten(x):
    if isinstance(x, dict):
        return {k: rewritten(v) for k, v in x.items()}
    return [rewritten(v) for v in x] if isinstance(x, list) else x.replace("secret", '[X"]') if isinstance(x, str) else x


def slim(x):
    if isinstance(x, dict):
        return {k: [] if k == "tools" else slim(v) for k, v in x.items() if k != "parameters"}
    return [slim(v) for v in x] if isinstance(x, list) else x


def leaf_texts(x):
    if isinstance(x, dict):
        x = list(x.values())
    if isinstance(x, list):
        return [t for v in x for t in leaf_texts(v)]
    return [] if x is None else [x if isinstance(x, str) else json.dumps(x)]


def test_random_json_is_rewritten_slimmed_and_listed(spark):
    rnd = random.Random(7)
    docs = [json.dumps(random_value(rnd), indent=rnd.choice([None, 1, "\t"]), ensure_ascii=rnd.random() < 0.5) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, j string")
    out = df.select("j", jt.rewritten(F.col("j"), lambda p, x: F.replace(x, F.lit("secret"), F.lit('[X"]'))).alias("r"), jt.slimmed(F.col("j")).alias("s")).collect()
    for row in out:
        assert json.loads(row["r"]) == rewritten(json.loads(row["j"]))
        assert json.loads(row["s"]) == slim(json.loads(row["j"]))
    listed = {}
    for row in jt.leaves(df, ["i"], "j").collect():
        listed.setdefault(row["i"], []).append(row["text"])
    assert [listed.get(i, []) for i in range(len(docs))] == [leaf_texts(json.loads(d)) for d in docs]


def test_what_is_not_changed_stays_byte_by_byte(spark):
    docs = ['{ "a" : 1.50, "b":[ "x\\u0041" , null ] }', "[]", '"secret"', "", "no json", '{"a":1', None, '{"n": 12345678901234567890}']
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    got = [r[0] for r in df.select(nested.redact_json(F.col("j"), WORD)).collect()]
    assert got == [docs[0], "[]", '"[REDACTED:WORD]"', None, None, None, None, docs[7]]


def test_paths_of_odd_keys_differ(spark):
    df = spark.createDataFrame([(1, '{"a.b":"x","a":{"b":"y"},"c":[["z"],{"d e":"w"}]}')], "i int, j string")
    rows = {r["path"]: r["text"] for r in jt.leaves(df, ["i"], "j").collect()}
    assert rows == {'$["a.b"]': "x", "$.a.b": "y", "$.c[0][0]": "z", '$.c[1]["d e"]': "w"}


def test_many_tokens_are_blocks_in_order(spark):
    big = json.dumps([{"a": f"secret {i}"} for i in range(1500)])
    df = spark.createDataFrame([(1, big)], "i int, j string")
    assert json.loads(df.select(jt.rewritten(F.col("j"), lambda p, x: F.replace(x, F.lit("secret"), F.lit("s")))).first()[0]) == [{"a": f"s {i}"} for i in range(1500)]
    assert [r["path"] for r in jt.leaves(df, ["i"], "j").collect()] == [f"$[{i}].a" for i in range(1500)]


def test_kept_fields_and_media(spark):
    body = {"id": "secret", "call_id": "secret", "data_iv": "secret", "Hmac": "secret", "note": ["secret", {"text": "secret"}], "content": [{"type": "file", "source": {"uri": "secret"}}, {"type": "x", "source": {"uri": "secret"}}], "image_url": "secret", "url": "secret"}
    df = spark.createDataFrame([(1, json.dumps(body))], "i int, j string")
    got = json.loads(df.select(nested.redact_json(F.col("j"), WORD)).first()[0])
    mark = "[REDACTED:WORD]"
    assert got == body | {"note": [mark, {"text": mark}], "content": [body["content"][0], {"type": "x", "source": {"uri": mark}}], "url": mark}
    hits = {(r["path"], r["field"]) for r in nested.json_hits(df, ["i"], "j", WORD).collect()}
    assert hits == {("$.note[0]", "note"), ("$.note[1].text", "text"), ("$.content[0].source.uri", "uri"), ("$.content[1].source.uri", "uri"), ("$.image_url", "image_url"), ("$.url", "url")}


def clean(spark, body, rules=WORD):
    df = spark.createDataFrame([(json.dumps(body),)], "j string")
    return json.loads(df.select(nested.clean_body(F.col("j"), rules, [Rule("d", "RM", r"rm -rf")], "[c]", "[no]")).first()[0])


def test_bodies_of_three_shapes(spark):
    calls = [{"function": {"name": "secret", "arguments": '{"a": "secret"}'}, "id": "secret"}, {"function": {"name": "sh", "arguments": '{"a": "rm -rf /"}'}}]
    chat = {"id": "secret", "choices": [{"message": {"content": [{"text": "secret"}], "tool_calls": calls}}, "secret"]}
    got = clean(spark, chat)
    assert got["id"] == "secret" and got["choices"][1] == "secret" and got["choices"][0]["message"]["content"] == [{"text": "[c]"}]
    first, second = got["choices"][0]["message"]["tool_calls"]
    assert first == {"function": {"name": "[c]", "arguments": '{"a": "[c]"}'}, "id": "secret"}
    assert second["function"]["name"] == "[no]" and json.loads(second["function"]["arguments"]) == {"_blocked": "[no]"}
    items = [
        {"type": "message", "content": [{"text": "secret", "more": "secret"}, {"refusal": "secret"}, "secret"]},
        {"type": "function_call", "name": "sh", "arguments": "rm -rf secret"},
        {"type": "bash", "action": {"command": ["ls", "rm -rf x"], "n": 3}},
        {"type": "computer_call", "action": "secret"},
        {"type": "reasoning", "summary": "secret"},
        {"summary": "secret", "other": "secret"},
    ]
    got = clean(spark, {"output_text": "secret", "output": items, "instructions": "secret"})
    assert got == {
        "output_text": "[c]",
        "output": [
            {"type": "message", "content": [{"text": "[c]", "more": "secret"}, {"refusal": "[c]"}, "[c]"]},
            {"type": "function_call", "name": "[no]", "arguments": '{"_blocked": "[no]"}'},
            {"type": "bash", "action": {"command": ["[no]", "[no]"], "n": 3}},
            {"type": "computer_call", "action": "[c]"},
            {"type": "reasoning", "summary": "secret"},
            {"summary": "[c]", "other": "secret"},
        ],
        "instructions": "secret",
    }
    assert clean(spark, {"content": [{"text": "secret", "input": "secret"}, "secret"]}) == {"content": [{"text": "[c]", "input": "secret"}, "[c]"]}
    assert clean(spark, {"content": "secret"}) == {"content": "[c]"}


def test_arguments_stay_json(spark):
    """A rule that eats the closing quote would break the arguments as a whole."""
    eats = [Rule("g", "EATS", r'secret"?')]
    args = json.dumps({"a": "my secret", "b": 'say "secret"'})
    got = clean(spark, {"output": [{"type": "function_call", "name": "f", "arguments": args}]}, eats)
    assert json.loads(got["output"][0]["arguments"]) == {"a": "my [c]", "b": 'say "[c]'}
    got = clean(spark, {"output": [{"type": "function_call", "name": "f", "arguments": "plain secret"}]}, eats)
    assert got["output"][0]["arguments"] == "plain [c]"


def test_gates_of_responses(spark):
    rules = [Rule("g", f"r{i}", f"w{i:02d}") for i in range(30)] + [Rule("g", "web_xss", "<script")]
    texts = ["".join(f"w{i:02d} " for i in range(30)), "w29 <script>", "</script><script> w29"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(nested.clean_response_text(F.col("t"), rules, "#")).collect()]
    assert got == ["# " * 24 + "".join(f"w{i:02d} " for i in range(24, 30)), "# <script>", "</script>#> #"]
    assert [r.rule_id for r in nested.gated_rules([*rules, Rule("g", "web_http_obs_fold_header", "x")], obvious_only=True)] == ["web_http_obs_fold_header"]


def poisoned(text: str) -> str:
    if "poison" in text:
        raise ValueError(text)
    return text.upper()


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "id int, text string, mode string")
    soft = stages.Stage("redaction", stages.isolated(poisoned), critical=options.pop("critical", False), redacts=True)
    hard = stages.Stage("guard", lambda t: stages.attempt(F.concat(t, F.lit("!")), F.when(t.contains("BAD"), "bad")))
    out = stages.run_stages(df, "text", [soft, hard], F.col("mode"), **options)
    return {r["id"]: (r["text"], r["disposition"], r["actions"], r["reasons"]) for r in out.collect()}, [tuple(r) for r in stages.rejects(out, ["id"]).collect()]


def test_a_poisoned_row_blocks_itself_alone(spark):
    rows = [(1, "a", None), (2, "poison", None), (3, "bad", None), (4, None, None), (5, "bad", "redact"), (6, "poison bad", "passthrough")]
    got, bad = run(spark, rows, forward=True)
    assert got == {
        1: ("A!", "allow", [], []),
        2: ("poison!", "allow", ["request_pipeline:degraded:redaction"], []),
        3: ("BAD", "block", ["request_pipeline:error:guard"], ["request_filter_error"]),
        4: (None, "allow", [], []),
        5: ("BAD", "allow", [], []),
        6: ("poison bad", "allow", [], []),
    }
    assert sorted(bad) == [(2, "redaction", "ValueError"), (3, "guard", "bad")]
    for options in ({}, {"forward": True, "critical": True}, {"forward": True, "phase": "response"}):
        phase = options.get("phase", "request")
        got, _ = run(spark, rows, **options)
        assert got[2] == ("poison", "block", [f"{phase}_pipeline:error:redaction"], [f"{phase}_filter_error"]) and got[1][0] == "A!"


def write_pack(spark, path, regex):
    spark.createDataFrame([("g", "own", 0, regex, False)], "rule_group string, rule_id string, ord int, regex string, case_sensitive boolean").write.mode("overwrite").parquet(path)


def test_pack_swapped_between_micro_batches(spark, tmp_path):
    pack, source = str(tmp_path / "pack"), str(tmp_path / "in")
    write_pack(spark, pack, "apple")
    held = live_rules.LivePack(spark, pack).refresh()
    first = held.version
    assert held.refresh().version == first
    for number, regex in enumerate(["apple", "pear"]):
        if number:
            time.sleep(0.01)
            write_pack(spark, pack, regex)
        spark.createDataFrame([(number, "apple pear pear")], "id int, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id int, text string").parquet(source)
        live_rules.scan_live(stream, "text", ["id"], pack, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = {r["id"]: (r["n"], r["pack_version"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[0] == (1, first) and rows[1][0] == 2 and rows[1][1] > first
    assert held.refresh().rules[0].regex == "pear" and held.version == rows[1][1]
    write_pack(spark, pack, "(broken")
    assert held.refresh().rules[0].regex == "pear"


def test_texts_of_answers_with_items(spark):
    cases = [
        ({"output_text": "", "output": [{"type": "message", "content": [{"text": "a"}, "b", 3]}, "c"]}, "abc"),
        ({"output": {"summary": "s", "content": ""}}, "s"),
        ({"choices": [{"message": {"content": [{"text": "deep"}]}}]}, "deep"),
        ({"output": [{"type": "function_call", "arguments": "x" * 300}]}, f"[function_call:?({'x' * 200})]"),
        ({"output": [{"type": "bash"}], "text": "later"}, "[bash:{}]"),
        ({"status": "failed", "error": {"code": 1}}, '[status=failed error={"code":1}]'),
        ({"instructions": "long", "output": None, "error": None}, "[status=unknown]"),
        ("no json", "no json"),
        (None, None),
    ]
    df = spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, (b, _) in enumerate(cases)], "i int, j string")
    got = {r["i"]: r["t"] for r in df.select("i", responses.responses_output_text(F.col("j")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [t for _, t in cases]
