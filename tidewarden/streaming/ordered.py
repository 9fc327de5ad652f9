"""Streams of chunks taken in order, with state by stream and timers.

``OrderedStream`` is the base of the stateful operators on chunks (``stream_id,
seq, text, last``): whatever micro-batches the chunks come in, each stream's are
taken in order of ``seq`` from 0. Chunks behind a gap wait in blocks of BLOCK places
in a map state; the end's place is part of the state, so it may come first. After the end the state is
dropped but for a mark that makes later chunks void. A stream that is silent for
``silence`` is closed by a timer: what its operator holds goes out, waiting chunks
behind a gap are void, and after the same time again the mark goes too.

The clock is processing time, or event time where a column ``ts`` with a watermark
is given; then a timer fires once the watermark passes a stream's newest chunk by
``silence``, and chunks older than the watermark are dropped by Spark.

Defined results: a null text is an empty chunk; of chunks with one seq the first
taken counts; chunks without seq or stream are void; a stream without an end stays
open until it is silent, or for ever without ``silence``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Places of a stream whose waiting chunks are one value of the store, a fixed value.
BLOCK = 128
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with several columns and timers needs this store; what the session sets besides the default stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        spark.conf.set(name, ROCKSDB)


class OrderedStream(StatefulProcessor):
    """One operator on ordered chunks; subclasses say what a chunk and a silence do to their own state."""

    #: Columns of the operator's state.
    own_schema: str
    #: Columns that it gives besides ``stream_id``.
    out_schema: str

    def __init__(self, silence_ms: int | None = None, event_time: bool = False) -> None:
        self.silence_ms, self.event_time = silence_ms, event_time

    def start(self) -> tuple:
        """The state of a new stream."""
        raise NotImplementedError

    def take(self, own: tuple, seq: int, text: str, final: bool) -> tuple[tuple, list[tuple], bool]:
        """State, rows and whether the stream ends, after one more chunk."""
        raise NotImplementedError

    def close_silent(self, own: tuple) -> list[tuple]:
        """Rows of a stream that went silent."""
        raise NotImplementedError

    def opened(self, own: tuple) -> tuple:
        """The state as ``take`` and ``close_silent`` use it, once for each micro-batch."""
        return own

    def closed(self, own: tuple) -> tuple:
        """The state as it is stored."""
        return own

    def _block(self, block: int) -> dict[int, str]:
        held = self.early.getValue((block,))
        return {seq: text for seq, text in held[0]} if held is not None else {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = ",".join(c.strip().replace(" ", ":", 1) for c in self.own_schema.split(", "))
        # few values, as each call to the store costs more than a chunk; waiting: chunks in ``early``
        self.state = handle.getValueState("state", f"next_seq long, last_seq long, ended boolean, newest long, waiting long, own struct<{own}>")
        self.early = handle.getMapState("early", "block long", "chunks array<struct<seq:bigint,text:string>>")

    def _rows(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            names = ["stream_id", *(c.split()[0] for c in self.out_schema.split(", "))]
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    def _set_timer(self, newest: int) -> None:
        if self.silence_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(newest + self.silence_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_seq, last_seq, ended, newest, waiting, own = self.state.get() or (0, -1, False, 0, 0, self.start())
        came: dict[int, str] = {}
        for batch in rows:
            if self.event_time and len(batch):
                newest = max(newest, int(batch["ts"].max().value // 1_000_000))
            for seq, text, last in zip(batch["seq"], batch["text"], batch["last"], strict=True):
                if not pd.isna(seq):
                    came.setdefault(int(seq), text if isinstance(text, str) else "")
                    if not pd.isna(last) and last:
                        last_seq = int(seq)
        if ended or key[0] is None:
            return
        out: list[tuple] = []
        blocks: dict[int, dict[int, str]] = {}
        if waiting:  # of chunks with one seq the one that waits came first
            for block in sorted({seq // BLOCK for seq in came if seq >= next_seq}):
                blocks[block] = self._block(block)
                came |= blocks[block]
        own = self.opened(own)
        while not ended:
            if next_seq not in came:
                block = next_seq // BLOCK
                if not waiting or block in blocks:
                    break
                blocks[block] = self._block(block)
                came |= blocks[block]
                continue
            text = came.pop(next_seq)
            waiting -= next_seq in blocks.get(next_seq // BLOCK, ())
            own, rows_of, ended = self.take(own, next_seq, text, next_seq == last_seq)
            out += rows_of
            ended = ended or next_seq == last_seq
            next_seq += 1
        if not ended:
            left: dict[int, dict[int, str]] = {}
            for seq, text in came.items():
                if seq > next_seq:
                    left.setdefault(seq // BLOCK, {})[seq] = text
            waiting += sum(seq not in blocks.get(block, ()) for block, chunks in left.items() for seq in chunks)
            for block in blocks.keys() | left.keys():
                if block not in left and blocks[block]:
                    self.early.removeKey((block,))
                elif block in left and left[block] != blocks.get(block):
                    self.early.updateValue((block,), (sorted(left[block].items()),))
        elif waiting or any(blocks.values()):
            self.early.clear()
        if not self.event_time and self.silence_ms is not None:
            newest = timerValues.getCurrentProcessingTimeInMs()
        self.state.update((next_seq, last_seq, ended, newest, 0 if ended else waiting, None if ended else tuple(self.closed(own))))
        self._set_timer(newest)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        if state is None:
            return
        next_seq, last_seq, ended, newest, waiting, own = state
        if ended:
            self.state.clear()
            return
        if waiting:
            self.early.clear()
        self.state.update((next_seq, last_seq, True, newest, 0, None))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.silence_ms)
        yield from self._rows(key, self.close_silent(self.opened(own)))

    def close(self) -> None:
        pass


def run_ordered(chunks: DataFrame, operator: OrderedStream, late: str = "10 seconds") -> DataFrame:
    """The rows of ``operator`` over a stream of chunks."""
    use_rocksdb(chunks.sparkSession)
    rows = chunks.select("stream_id", "seq", "text", "last", *(["ts"] if operator.event_time else []))
    if operator.event_time:
        rows = rows.withWatermark("ts", late)
    clock = "None" if operator.silence_ms is None else "EventTime" if operator.event_time else "ProcessingTime"
    return rows.groupBy("stream_id").transformWithStateInPandas(operator, f"stream_id string, {operator.out_schema}", "Append", clock)
