"""Stateful operators on streams: shuffled micro-batches, chunk borders, timers."""

import json
import random
import time
import uuid

import pytest

from tidewarden.functions.session import shared_dir
from tidewarden.operators import scan
from tidewarden.streaming import calls, exact, guard, ordered
from tidewarden.streaming.ordered import run_ordered

CHUNKS = "stream_id string, seq long, text string, last boolean"
VALUES = ["aaaaaaaaaa", "abcabcabcabc", "bcabcabcab12", "x" * 15, "hello world value", "x" * 15, " short "]


def folder(spark, batches, schema=CHUNKS):
    """A stream of which each list of rows is one micro-batch."""
    path = f"{shared_dir(spark)}/in-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def outcome(spark, batches, operator):
    return guard.run_to_table(run_ordered(folder(spark, batches), operator), "out").orderBy("stream_id", "seq").collect()


def in_one_piece(text, finder):
    for v in finder.values:
        text = text.replace(v, "[M]")
    return text


def test_exact_values_settle_as_in_the_whole_text():
    finder = exact.ValueFinder(VALUES)
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice([*VALUES, "a", "b", "c", "abc", "x", "12", "hello ", "bcabcabc"]) for _ in range(rng.randrange(12)))
        pending, out, at, final = "", "", 0, False
        while not final:
            n = rng.randrange(1, 9)
            piece, at = text[at : at + n], at + n
            final = at >= len(text)
            held = pending + piece
            found, cut = finder.settle(held, final)
            start = 0
            for a, b in found:
                out += held[start:a] + "[M]"
                start = b
            out, pending = out + held[start:cut], held[cut:]
            assert len(pending) <= sum(map(len, finder.values))
        assert (out, pending) == (in_one_piece(text, finder), "")
    endless = ""
    for _ in range(500):  # a match of every place with the next: the state stays short
        _, cut = finder.settle(endless + "aaa", False)
        endless = (endless + "aaa")[cut:]
        assert len(endless) < 30


def test_exact_values_in_shuffled_micro_batches(spark):
    rng = random.Random(2)
    texts = {f"s{k}": "".join(rng.choice([*VALUES, "é", "\x1e\x1f", "ab", "👍"]) for _ in range(8)) for k in range(5)}
    chunks = []
    for k, t in texts.items():
        cuts = [0, *sorted(rng.sample(range(1, len(t)), 12)), len(t)]
        chunks += [(k, i, t[a:b], i == 12) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    chunks += [(k, 13, "behind the end", False) for k in texts] + [(None, 0, "no stream", True), ("n", None, "no place", False), ("e", 0, None, True)]
    rng.shuffle(chunks)
    out = outcome(spark, [chunks[i::4] for i in range(4)], exact.ExactValues(VALUES, mark="[M]"))
    finder = exact.ValueFinder(VALUES)
    assert {k: "".join(r["text"] for r in out if r["stream_id"] == k) for k in texts} == {k: in_one_piece(t, finder) for k, t in texts.items()}
    assert {r["stream_id"] for r in out} == set(texts)


def test_guard_keeps_all_frames_when_the_end_comes_first(spark):
    rows = [("a", 0, "AAA", False), ("a", 1, "B\x1eB\x1f", False), ("a", 2, "CCC", True), ("s", 0, "prefix password: hun", False), ("s", 1, "ter2hunter2 suffix", True)]
    for order in ([2, 0, 1, 4, 3], [4, 2, 3, 1, 0]):
        out = outcome(spark, [[rows[i]] for i in order], guard.Guard(scan.default_rules("field_secrets")))
        assert [tuple(r) for r in out] == [("a", 0, "AAA", "flushed"), ("a", 1, "B\x1eB\x1f", "flushed"), ("a", 2, "CCC", "flushed"), ("s", 0, "prefix [REDACTED:stream] suffix", "sanitized")]


def plain_guard(texts, operator):
    """Frames by the default bounds, written down once more."""
    out, held, window = [], [], ""
    for i, t in enumerate(texts):
        held.append((i, t))
        window = (window + t)[-operator.window :]
        last = i + 1 == len(texts)
        if (i < 4 or i % 4 == 3 or last) and operator.hit(window):
            return [*out, (held[0][0], operator.cleaned("".join(x for _, x in held)), "sanitized")]
        while len(held) > operator.held:
            out.append((*held.pop(0), "released"))
    return out + [(*h, "flushed") for h in held]


def test_guard_bounds():
    rules = scan.default_rules("field_secrets")
    rng = random.Random(3)
    hits = 0
    for _ in range(300):
        n = rng.randrange(1, 30)
        texts = [rng.choice(["word ", "", "x" * 50]) for _ in range(n)]
        texts[rng.randrange(n)] += "password: hun"
        texts[rng.randrange(n)] += "ter2hunter2hunter2 "
        operator = guard.Guard(rules, held=rng.choice([0, 1, 8]), window=rng.choice([20, 8000]))
        own, out = operator.start(), []
        for i, t in enumerate(texts):
            own, rows, ended = operator.take(own, i, t, i + 1 == n)
            out += rows
            assert len(own[2]) <= operator.held and len(own[0]) <= operator.window
            if ended:
                break
        assert out == plain_guard(texts, operator)
        hits += out[-1][2] == "sanitized"
    assert 20 < hits < 280


def test_head_probe_on_both_sides_of_the_budget():
    secret = "password: hunter2hunter2"
    for before, want in ((0, "sanitized"), (70, "sanitized"), (90, "passed"), (200, "passed")):
        operator = guard.HeadProbe(scan.default_rules("field_secrets"), budget=100, window=64)
        text = "-" * before + " " + secret + " and more" + "." * 40
        own, out = operator.start(), []
        for i in range(0, len(text), 7):
            own, rows, ended = operator.take(own, i // 7, text[i : i + 7], i + 7 >= len(text))
            out += rows
        whole = "".join(r[1] for r in out)
        assert (secret in whole) == (want == "passed") and ("[REDACTED:command]" in whole) == (want == "sanitized") and ended
        if want == "passed":
            assert whole == text and {r[2] for r in out} == {"released", "passed"}


@pytest.mark.parametrize(
    ("events", "want"),
    [
        (['{"choices":[{"delta":{"content":"a"}}]}', "[DONE]", "late"], ("done", 2, None)),
        (['{"type":"response.output_text.delta","delta":"a"}', '{"type":"response.completed"}'], ("done", 2, None)),
        (['{"choices":[{"delta":{"content":" a"}}]}', '{"choices":[{"delta":{"content":"b "},"finish_reason":"stop"}]}'], ("terminal_without_done:stop", 2, "ab")),
        (['{"delta":{"text":"a"}}', "no json", "[1]", '{"choices":[]}'], ("early_end", 4, f"a\n\n{guard.NOTICE}")),
        ([""], ("early_end", 1, guard.NOTICE)),
    ],
)
def test_stream_ends(events, want):
    operator = guard.StreamEnds()
    own = operator.start()
    for i, e in enumerate(events):
        own, rows, ended = operator.take(own, i, e, i + 1 == len(events))
        if ended:
            break
    assert rows == [want]


def test_silent_streams_are_closed_by_processing_time(spark):
    """What is held comes out by the timer; what lies behind a gap doesn't; a later chunk is void."""
    stream = folder(spark, [[("quiet", 0, "AAA", False), ("quiet", 2, "behind a gap", False), ("over", 0, "x", True)]])
    base = f"{shared_dir(spark)}/silent-{uuid.uuid4().hex}"
    out = run_ordered(stream, guard.Guard(scan.default_rules("field_secrets"), silence_ms=2000))
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{base}-state").trigger(processingTime="500 milliseconds").start(base)
    try:
        until = time.time() + 90
        while time.time() < until:
            rows = spark.read.schema(out.schema).parquet(base).collect() if query.lastProgress else []
            if len(rows) >= 2:
                break
            time.sleep(1)
        assert sorted(map(tuple, rows)) == [("over", 0, "x", "flushed"), ("quiet", 0, "AAA", "flushed")]
        while query.lastProgress["stateOperators"][0]["numRowsTotal"] > 0 and time.time() < until:
            time.sleep(1)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # the marks are gone too
    finally:
        query.stop()


def test_early_chunks_wait_in_few_rows(spark):
    """Chunks behind a gap are rows of the store by block, not by chunk; a gap that closes late gives every chunk once."""
    n = 3 * ordered.BLOCK + 5
    rows = [("s", i, f"{i},", i + 1 == n) for i in range(n)]
    batches = [rows[2::2], [("s", 4, "again", False), *rows[5::4]], [rows[1], ("s", 2, "again", False)], [rows[0], *rows[3::4]]]
    base = f"{shared_dir(spark)}/few-{uuid.uuid4().hex}"
    query = run_ordered(folder(spark, batches), guard.HeadProbe([], budget=0)).writeStream.format("parquet").option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start(base)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 5 and held[-1] == 1  # the mark of the end
    assert "".join(r["text"] for r in spark.read.parquet(base).orderBy("seq").collect()) == "".join(r[2] for r in rows)


def fragment(index, arguments, name=None):
    return json.dumps({"choices": [{"delta": {"tool_calls": [{"index": index, "function": {"name": name, "arguments": arguments}}]}}]})


def test_call_fragments_in_shuffled_micro_batches(spark):
    rules = scan.default_rules("field_secrets")
    events = [fragment(0, '{"a": "pass', "first"), fragment(1, "no json password: hun", "second"), "no json", "[]", '{"choices": []}', fragment(0, 'word: hunter2'), fragment(1, "ter2hunter2"), fragment(0, 'hunter2"}'), fragment(2, '{"password=hunter2hunter2:1}'), fragment(3, '{"x": 1}', "plain"), fragment(4, '["password: hunter2hunter2', "open"), fragment(5, '{"token":1, "password":hunter2hunter2}'), "[DONE]"]
    rows = [("s", i, e, i + 1 == len(events)) for i, e in enumerate(events)]
    random.Random(5).shuffle(rows)
    out = guard.run_to_table(run_ordered(folder(spark, [rows[::2], rows[1::2]]), calls.ToolCalls(rules)), "calls").orderBy("index").collect()
    got = {r["index"]: (r["name"], r["arguments"], r["outcome"]) for r in out}
    assert got[0] == ("first", '{"a": "[REDACTED:command]"}', "cleaned") and got[1] == ("second", "no json [REDACTED:command]", "cleaned") and got[3] == ("plain", '{"x": 1}', "clean")
    for r in out:
        call = json.loads(r["event"])["choices"][0]["delta"]["tool_calls"][0]
        assert (call["index"], call["function"]["arguments"]) == (r["index"], r["arguments"])
    operator = calls.ToolCalls(rules, mark='"')
    assert operator._whole(0, "n", '{"a": "password: hunter2hunter2"}')[2:4] == ('"\\""', "replaced")
