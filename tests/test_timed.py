"""Machines in event time: shuffled micro-batches against plain loops, and an empty store at the end."""

import datetime as dt
import random
import uuid

import pytest

from tidewarden.functions.session import shared_dir
from tidewarden.streaming import timed

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def ms(seconds):
    return int(BASE.timestamp() * 1000) + seconds * 1000


def run(spark, machine, events, schema, batches=3):
    """Rows of the machine and rows left in the store; a clock far ahead comes last."""
    path = f"{shared_dir(spark)}/timed-{uuid.uuid4().hex}"
    width = len(spark.createDataFrame([], schema).columns) - 3
    rows = [(k, BASE + dt.timedelta(seconds=s) if s is not None else None, *rest) for k, s, *rest in events]
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], schema).coalesce(1).write.mode("append").parquet(path)
    clock = spark.createDataFrame([("clock", BASE + dt.timedelta(days=400), 0, *[None] * width)], schema)
    clock.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = timed.run_timed(stream, machine, late="30 days")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(f"{path}-out")
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{path}-out").collect()), left


def test_rate_limit(spark):
    rng = random.Random(4)
    events = [(f"k{rng.randrange(4)}", rng.randrange(600), i, "x") for i in range(150)]
    want, held = [], {}
    for k, s, i, _ in sorted(events, key=lambda e: (e[1], e[2])):
        held[k] = [x for x in held.get(k, []) if x > s - 60]
        want.append((k, i, len(held[k]) < 3))
        if len(held[k]) < 3:
            held[k].append(s)
    got, left = run(spark, timed.RateLimit(3, 60), events + [(None, 5, 1, "x"), ("k0", None, 2, "x")], "key string, ts timestamp, id long, kind string")
    assert got == sorted(want) and left <= 2  # idle keys are gone; the clock waits


def test_mappings_are_used_once_and_age(spark):
    names = {"{{A}}": "a", "{{B}}": "b"}
    m, r = (lambda k, s, i: (k, s, i, "mapping", names, None, None)), (lambda k, s, i, found, bad=False: (k, s, i, "response", None, found, bad))
    events = [
        m("once", 0, 1), r("once", 10, 2, ["{{B}}", "{{A}}", "{{B}}"]), r("once", 20, 3, ["{{A}}"]),
        m("stale", 0, 1), r("stale", 1801, 2, ["{{A}}"]), r("stale", 1802, 3, ["{{A}}"]),
        m("fresh", 0, 1), r("fresh", 1800, 2, ["{{A}}"]),
        m("gone", 0, 1), r("gone", 86_401, 2, ["{{A}}"]),
        m("late", 0, 1), r("late", 86_400, 2, ["{{A}}"]),
        m("many", 0, 1), r("many", 1, 2, ["{{A}}"] * 21), m("part", 0, 1), r("part", 1, 2, ["{{A}}", "{{C}}"]),
        m("bad", 0, 1), r("bad", 1, 2, ["{{A}}"], True), m("calm", 0, 1), r("calm", 1, 2, [], True), m("again", 0, 1), r("again", 1, 2, ["{{A}}"]), m("again", 2, 3), r("again", 3, 4, ["{{B}}"]),
        r("none", 0, 1, ["{{A}}"]), r("before", 0, 1, []), m("before", 1, 2), m("null", 0, 1), r("null", 1, 2, None), m("left", 0, 1),
    ]
    random.Random(1).shuffle(events)
    got, left = run(spark, timed.MappingStore(), events, "key string, ts timestamp, id long, kind string, names map<string,string>, found array<string>, suspicious boolean")
    outcome = {(k, i): (why, v) for k, i, why, v in got}
    assert outcome == {
        ("once", 2): ("restored", ["b", "a", "b"]), ("once", 3): ("missing", None), ("stale", 2): ("stale_mapping", None), ("stale", 3): ("missing", None), ("fresh", 2): ("restored", ["a"]),
        ("gone", 2): ("missing", None), ("late", 2): ("stale_mapping", None), ("many", 2): ("too_many_placeholders", None), ("part", 2): ("partial_restore", None), ("bad", 2): ("exfiltration", None),
        ("calm", 2): ("restored", []), ("again", 2): ("restored", ["a"]), ("again", 4): ("restored", ["b"]), ("none", 1): ("missing", None), ("before", 1): ("missing", None), ("null", 2): ("restored", []),
    }
    assert left <= 2  # expired mappings are gone too
    assert timed.MappingStore(age=1).age == 300_000


@pytest.mark.parametrize("seed", [1, 2])
def test_pending_records(spark, seed):
    events = [
        ("a", 0, 1, "pending", 100_000), ("a", 10, 2, "executing", None), ("a", 12, 3, "done", None),
        ("b", 0, 1, "executing", 100_000), ("b", 50, 2, "done", None), ("c", 0, 1, "executing", 20_000), ("d", 5, 1, "pending", None), ("e", 0, 1, "pending", 1000), ("e", 1, 2, "done", 1000),
    ]
    random.Random(seed).shuffle(events)
    got, left = run(spark, timed.PendingStore(30), events, "key string, ts timestamp, id long, status string, kept long")
    assert got == sorted(
        [
            ("a", ms(0), "pending", "set"), ("a", ms(10), "executing", "set"), ("a", ms(12), "done", "set"), ("a", ms(100), "dropped", "retention"),
            ("b", ms(0), "executing", "set"), ("b", ms(30), "pending", "recovered"), ("b", ms(50), "done", "set"), ("b", ms(100), "dropped", "retention"),
            ("c", ms(0), "executing", "set"), ("c", ms(20), "dropped", "retention"), ("e", ms(0), "pending", "set"), ("e", ms(1), "dropped", "retention"), ("e", ms(1), "done", "set"), ("e", ms(2), "dropped", "retention"),
        ]
    )
    assert left <= 2


@pytest.mark.parametrize("machine", [timed.RateLimit(2, 60), timed.PendingStore(30)])
def test_waiting_events_and_timers_of_a_key_are_few_rows(spark, machine):
    """The store has rows by key and micro-batch, not by event."""
    schema = "key string, ts timestamp, id long, " + ("kind string" if isinstance(machine, timed.RateLimit) else "status string, kept long")
    path = f"{shared_dir(spark)}/few-{uuid.uuid4().hex}"
    width = len(schema.split(",")) - 3
    rows = [(f"k{i % 2}", BASE + dt.timedelta(seconds=i * 7 % 1000), i, *("x", 1000)[:width]) for i in range(1000)]
    for i in range(2):
        spark.createDataFrame(rows[i::2], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = timed.run_timed(stream, machine, late="30 days").writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(f"{path}-out")
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 12
