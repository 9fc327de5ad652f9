"""Streaming forms: guarded release of chunks, stream heads, stream ends, statistics, replays and joins.

``Guard``, ``HeadProbe`` and ``StreamEnds`` are operators on ordered chunks (see
``ordered``): state by stream is bounded by the window, the held frames or the head.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.session import shared_dir
from tidewarden.operators.scan import Rule
from tidewarden.streaming.ordered import OrderedStream, run_ordered

#: Characters of the window, frames held back, first probes and their step.
WINDOW, HELD, FIRST_PROBES, PROBE_STEP = 8000, 8, 4, 4
#: Characters of a stream's head that are looked at, and of their window.
HEAD_BUDGET, HEAD_WINDOW = 200_000, 8192


class _Scanned(OrderedStream):
    """An operator that looks for rules."""

    def __init__(self, rules: Sequence[Rule], mark: str, silence_ms: int | None, event_time: bool) -> None:
        super().__init__(silence_ms, event_time)
        self.patterns = [(r.regex, 0 if r.case_sensitive else re.IGNORECASE) for r in rules]
        self.mark = mark

    def hit(self, text: str) -> bool:
        return any(re.search(p, text, f) for p, f in self.patterns)

    def cleaned(self, text: str) -> str:
        for p, f in self.patterns:
            text = re.sub(p, self.mark, text, flags=f)
        return text


class Guard(_Scanned):
    """Frames released behind a guard: ``seq, text, outcome``.

    The newest ``held`` frames stay back. The window of the newest text is probed at
    the first chunks, then at every PROBE_STEP-th and at the end. On a hit the frames
    still held go out as one ``sanitized`` frame and the stream ends; frames are
    ``released`` as newer ones come, and ``flushed`` at the end or when the stream
    is silent. Values that span chunks are found as long as they fit in the held
    frames and the window.
    """

    own_schema = "tail string, probes long, frames array<struct<seq:bigint,text:string>>"
    out_schema = "seq long, text string, outcome string"

    def __init__(self, rules: Sequence[Rule], mark: str = "[REDACTED:stream]", held: int = HELD, window: int = WINDOW, silence_ms: int | None = None, event_time: bool = False) -> None:
        super().__init__(rules, mark, silence_ms, event_time)
        self.held, self.window = held, window

    def start(self) -> tuple:
        return "", 0, []

    def take(self, own: tuple, seq: int, text: str, final: bool) -> tuple[tuple, list[tuple], bool]:
        tail, probes, frames = own
        tail, probes = (tail + text)[-self.window :], probes + 1
        frames = [*((f[0], f[1]) for f in frames), (seq, text)]
        if (probes <= FIRST_PROBES or probes % PROBE_STEP == 0 or final) and self.hit(tail):
            return self.start(), self._sanitized(frames), True
        kept = 0 if final else self.held
        out = [(*f, "released") for f in frames[: -self.held or None]] if len(frames) > self.held else []
        if final:
            out += [(*f, "flushed") for f in frames[len(out) :]]
        return (tail, probes, frames[len(frames) - min(kept, len(frames)) :]), out, final

    def _sanitized(self, frames: list[tuple]) -> list[tuple]:
        return [(frames[0][0], self.cleaned("".join(t for _, t in frames)), "sanitized")]

    def close_silent(self, own: tuple) -> list[tuple]:
        tail, _, frames = own
        frames = [(f[0], f[1]) for f in frames]
        if frames and self.hit(tail):
            return self._sanitized(frames)
        return [(*f, "flushed") for f in frames]


class HeadProbe(_Scanned):
    """The head of each stream is looked at, the rest passes: ``seq, text, outcome``.

    Up to ``budget`` characters are scanned as they come, in a sliding window. The
    frames are held so long; at a hit they go out as one ``sanitized`` frame, at the
    end of the budget or of the stream as they are (``released``). Frames behind
    that are ``passed`` without a look.
    """

    own_schema = "window string, seen long, passing boolean, frames array<struct<seq:bigint,text:string>>"
    out_schema = "seq long, text string, outcome string"

    def __init__(self, rules: Sequence[Rule], mark: str = "[REDACTED:command]", budget: int = HEAD_BUDGET, window: int = HEAD_WINDOW, silence_ms: int | None = None, event_time: bool = False) -> None:
        super().__init__(rules, mark, silence_ms, event_time)
        self.budget, self.window = budget, window

    def start(self) -> tuple:
        return "", 0, False, []

    def take(self, own: tuple, seq: int, text: str, final: bool) -> tuple[tuple, list[tuple], bool]:
        window, seen, passing, frames = own
        if passing:
            return own, [(seq, text, "passed")], final
        frames = [*((f[0], f[1]) for f in frames), (seq, text)]
        piece = text[: self.budget - seen]
        window, seen = (window + piece)[-self.window :], seen + len(piece)
        if piece and self.hit(window):
            return ("", seen, True, []), [(frames[0][0], self.cleaned("".join(t for _, t in frames)), "sanitized")], final
        if final or seen >= self.budget:
            return ("", seen, True, []), [(*f, "released") for f in frames], final
        return (window, seen, False, frames), [], False

    def close_silent(self, own: tuple) -> list[tuple]:
        return [(f[0], f[1], "released") for f in own[3]]


#: Events that end a stream of the protocols without a done mark (fixed values).
TERMINAL_TYPES = ("response.completed", "message_stop")
#: What replay texts end with where the stream broke off.
NOTICE = "[the answer ended before it was complete]"


class StreamEnds(OrderedStream):
    """One row for each stream that ended: ``end_reason, frames, replay``.

    Chunks are the data of one event each. ``done``: the done mark came, or an event
    that ends its protocol; ``terminal_without_done:REASON``: a finish reason came but
    no done mark; ``early_end``: neither. Without a done mark, ``replay`` is the
    newest text of the stream (``window`` characters), after an early end with a
    notice. Streams end by their last chunk, by the done mark, or by silence.
    """

    own_schema = "window string, finish string, frames long"
    out_schema = "end_reason string, frames long, replay string"

    def __init__(self, window: int = WINDOW, notice: str = NOTICE, silence_ms: int | None = None, event_time: bool = False) -> None:
        super().__init__(silence_ms, event_time)
        self.window, self.notice = window, notice

    def start(self) -> tuple:
        return "", "", 0

    def take(self, own: tuple, seq: int, text: str, final: bool) -> tuple[tuple, list[tuple], bool]:
        window, finish, frames = own
        frames += 1
        if text.strip() == "[DONE]":
            return self.start(), [("done", frames, None)], True
        delta, reason, ends = read_event(text)
        window = (window + delta)[-self.window :]
        if ends:
            return self.start(), [("done", frames, None)], True
        own = (window, reason or finish, frames)
        return own, self.close_silent(own) if final else [], final

    def close_silent(self, own: tuple) -> list[tuple]:
        window, finish, frames = own
        if finish:
            return [(f"terminal_without_done:{finish}", frames, window.strip())]
        return [("early_end", frames, "\n\n".join(x for x in (window.strip(), self.notice) if x))]


def read_event(data: str) -> tuple[str, str, bool]:
    """Text, finish reason, and whether it ends its protocol, of the data of one event of three vendor shapes; data that is no JSON object has none."""
    try:
        event = json.loads(data)
    except ValueError:
        return "", "", False
    if not isinstance(event, dict):
        return "", "", False
    choices = event.get("choices")
    choice = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
    delta = choice.get("delta", event.get("delta"))
    text = delta if isinstance(delta, str) else (delta.get("content") or delta.get("text") or "") if isinstance(delta, dict) else ""
    finish = choice.get("finish_reason")
    return text if isinstance(text, str) else "", finish if isinstance(finish, str) else "", event.get("type") in TERMINAL_TYPES


def release_guarded(chunks: DataFrame, rules: Sequence[Rule], mark: str = "[REDACTED:stream]", held: int = HELD, window: int = WINDOW) -> DataFrame:
    """Chunks (``stream_id, seq, text, last``) as frames released behind a ``Guard``."""
    return run_ordered(chunks, Guard(rules, mark, held, window))


def hourly_stats(events: DataFrame, ts_col: str, late: str, by: Sequence[str]) -> DataFrame:
    """Counters by hour and key, emitted when the watermark passes the hour."""
    return events.withWatermark(ts_col, late).groupBy(F.window(ts_col, "1 hour").alias("w"), *by).agg(F.count(F.lit(1)).alias("requests")).select(F.col("w.start").alias("hour"), *by, "requests")


def without_replays(events: DataFrame, keys: Sequence[str], ts_col: str, window: str = "300 seconds") -> DataFrame:
    """The first event of each key within the window."""
    return events.withWatermark(ts_col, window).dropDuplicatesWithinWatermark(list(keys))


def within_ttl(requests: DataFrame, responses: DataFrame, key: str, ttl: str = "1800 seconds") -> DataFrame:
    """Responses joined to requests of the same key no older than the limit (``req_ts``, ``resp_ts``)."""
    a = requests.withWatermark("req_ts", ttl)
    b = responses.withWatermark("resp_ts", ttl)
    return a.join(b, (a[key] == b[key]) & (F.col("resp_ts") >= F.col("req_ts")) & (F.col("resp_ts") <= F.col("req_ts") + F.expr(f"interval {ttl}"))).drop(b[key])


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}-state").outputMode("append").trigger(availableNow=True).start(base)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)


def each_batch(stream: DataFrame, apply, checkpoint: str):
    """Run ``apply(batch, id)`` on every micro-batch; a rule pack that ``apply`` reads anew may change between batches."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunked(df: DataFrame, id_col: str, text: Column, size: int) -> DataFrame:
    """Texts cut into chunks of ``size`` characters: ``stream_id, seq, text, last``."""
    n = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    rows = df.select(F.col(id_col).cast("string").alias("stream_id"), text.alias("_t"), n.alias("_n")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select("stream_id", F.col("seq").cast("long").alias("seq"), F.substring("_t", F.col("seq") * size + 1, F.lit(size)).alias("text"), (F.col("seq") == F.col("_n") - 1).alias("last"))
