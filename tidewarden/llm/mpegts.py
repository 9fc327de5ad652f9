"""MPEG transport streams as a media column.

``multiplex`` stores a byte payload as an elementary stream: access units of
ACCESS_UNIT bytes, each in a packet with a presentation time, cut into 188-byte
transport packets with program tables in front, continuity counters, clock
references and random-access marks. ``demultiplex`` reads such bytes: it follows
the program tables (checksums checked) to the elementary stream, checks the
continuity counters, reassembles the access units and keeps their times and the
random-access points. Packets are handled as rows of a numpy array.

Defined results: a null text is an empty text; a payload is padded with bytes 0
to a positive multiple of 64, so equal texts have equal streams and no stream is
empty. ``demultiplex`` raises ``ValueError`` on lost synchronisation, missing or
damaged tables or packet heads, and ``read_streams`` turns that into ``error``
with null values. Repeated rows are stored row by row; an empty table gives an
empty table; other columns are kept, but for those with the names of new ones.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.session import small_batches

PACKET = 188
#: Payload bytes of an access unit; every RANDOM_ACCESS-th one is a random-access point.
ACCESS_UNIT, RANDOM_ACCESS = 8192, 4
#: Ticks of the 90 kHz clock between access units, and before the first.
TICKS, FIRST_TICK = 3600, 90_000
TABLE_PID, STREAM_PID = 0x1000, 0x0101
#: Fixed values of the standard: private data in packets, private stream 1.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
PAD = 64


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(raw: bytes) -> int:
    """The table checksum: most significant bit first, all ones at the start."""
    c = 0xFFFFFFFF
    for b in raw:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, table_id: int, body: bytes) -> bytes:
    """One packet that holds one short table section."""
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    section = head + section_crc(head).to_bytes(4, "big")
    packet = bytes([0x47]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return packet + b"\xff" * (PACKET - len(packet))


_TABLES = np.frombuffer(
    _section_packet(0, 0, b"\x00\x01" + (0xE000 | TABLE_PID).to_bytes(2, "big"))
    + _section_packet(TABLE_PID, 2, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"),
    dtype=np.uint8,
).reshape(2, PACKET)


def _time_bytes(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE])


def _clock_bytes(t: int) -> bytes:
    return ((t << 15) | 0x7E00).to_bytes(6, "big")


def multiplex(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    parts = [_TABLES]
    counter = 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        unit = payload[at : at + ACCESS_UNIT]
        time = (FIRST_TICK + k * TICKS) & ((1 << 33) - 1)
        data = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time_bytes(time) + unit
        first = k % RANDOM_ACCESS == 0
        # the adaptation field of a random-access point: length, flags, clock
        fields = b"\x50" + _clock_bytes(time - TICKS) if first else b""
        room = PACKET - 4 - (len(fields) + 1 if first else 0)
        n = 1 + max(0, -(-(len(data) - room) // (PACKET - 4)))
        block = np.empty((n, PACKET), np.uint8)
        block[:, 0] = 0x47
        block[:, 1] = STREAM_PID >> 8
        block[0, 1] |= 0x40
        block[:, 2] = STREAM_PID & 0xFF
        block[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        counter = (counter + n) & 15
        raw = np.frombuffer(data, np.uint8)
        head = min(room, len(raw))
        if n > 2:
            block[1:-1, 4:] = raw[head : head + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
        for row, piece, own in ((0, raw[:head], fields), *(((n - 1, raw[head + (n - 2) * (PACKET - 4) :], b""),) if n > 1 else ())):
            space = PACKET - 4 - len(piece)
            if space:
                block[row, 3] |= 0x20
                block[row, 4] = space - 1
                if space > 1:
                    block[row, 5] = 0
                    block[row, 6 : 4 + space] = 0xFF
                    block[row, 5 : 5 + len(own)] = np.frombuffer(own, np.uint8)
            block[row, 4 + space :] = piece
        parts.append(block)
    return np.concatenate(parts).tobytes()


@dataclass
class Demultiplexed:
    payload: bytes
    packets: int
    units: int
    times: list[int]
    random_access: list[int]
    continuity_errors: int


def _section(rows: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes:
    at = np.flatnonzero(pid == wanted)
    if not len(at):
        raise ValueError(f"no table on PID {wanted}")
    raw = rows[at[0]].tobytes()
    start = 5 + raw[4]
    size = 3 + (int.from_bytes(raw[start + 1 : start + 3], "big") & 0x0FFF)
    section = raw[start : start + size]
    if len(section) < size or section[0] != table_id or section_crc(section):
        raise ValueError(f"damaged table on PID {wanted}")
    return section


def demultiplex(media: bytes) -> Demultiplexed:
    """Read the first program's first elementary stream."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    programs = _section(rows, pid, 0, 0)
    table_pid = int.from_bytes(programs[10:12], "big") & 0x1FFF
    table = _section(rows, pid, table_pid, 2)
    skip = 12 + (int.from_bytes(table[10:12], "big") & 0x0FFF)
    stream_pid = int.from_bytes(table[skip + 1 : skip + 3], "big") & 0x1FFF
    own = rows[pid == stream_pid]
    if skip + 5 > len(table) or not len(own):
        raise ValueError("no elementary stream")
    control = own[:, 3]
    has_data, has_fields = control & 0x10 > 0, control & 0x20 > 0
    counters = (control & 15)[has_data].astype(np.int64)
    errors = int((np.diff(counters) % 16 != 1).sum())
    start = 4 + np.where(has_fields, own[:, 4].astype(np.int64) + 1, 0)
    start = np.minimum(np.where(has_data, start, PACKET), PACKET)
    first = own[:, 1] & 0x40 > 0
    marks = has_fields & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    data = own[np.arange(PACKET) >= start[:, None]].tobytes()
    before = np.cumsum(PACKET - start) - (PACKET - start)
    begins = before[first].tolist()
    payload, times, random_access = [], [], []
    for k, (a, b, mark) in enumerate(zip(begins, [*begins[1:], len(data)], marks[first].tolist(), strict=True)):
        if data[a : a + 3] != b"\x00\x00\x01" or b - a < 9 or b - a < 9 + data[a + 8] or data[a + 8] < 5 or not data[a + 7] & 0x80:
            raise ValueError("damaged packet start")
        size = int.from_bytes(data[a + 4 : a + 6], "big")
        p = data[a + 9 : a + 14]
        times.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1)
        payload.append(data[a + 9 + data[a + 8] : min(b, a + 6 + size)])
        if mark:
            random_access.append(k)
    return Demultiplexed(b"".join(payload), len(rows), len(times), times, random_access, errors)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the payload: these, then zeros up to a positive multiple of PAD."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def feature(read: Demultiplexed) -> str:
    """Packets, access units, times, random-access points, continuity errors, and the mean and spread of the samples."""
    samples = np.frombuffer(read.payload, np.uint8)
    return (
        f"packets={read.packets};units={read.units};first={read.times[0]};last={read.times[-1]};"
        f"random_access={','.join(map(str, read.random_access))};continuity_errors={read.continuity_errors};"
        f"mean={samples.mean():.4f};sd={samples.std():.4f}"
    )


def store_streams(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Add ``media_col``, the transport stream of each text (a column of that name is replaced)."""
    small_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def store(texts: pa.Array) -> pa.Array:
        return pa.array([multiplex(padded(t)[1]) for i in range(0, len(texts), 256) for t in texts.slice(i, 256).to_pylist()], pa.binary())

    return df.withColumn(media_col, store(F.col(text_col)))


def read_streams(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Add ``payload``, ``times`` (90 kHz), ``random_access``, ``continuity_errors`` and ``error`` (columns of these names are replaced)."""
    small_batches(df.sparkSession)
    names = ["payload", "times", "random_access", "continuity_errors", "error"]
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.string()]

    def one(media: bytes | None) -> tuple:
        try:
            read = demultiplex(media or b"")
        except ValueError as e:
            return None, None, None, None, str(e)
        return read.payload, read.times, read.random_access, read.continuity_errors, None

    @F.arrow_udf("payload binary, times array<bigint>, random_access array<int>, continuity_errors int, error string")
    def read(media: pa.Array) -> pa.Array:
        values = [one(m) for i in range(0, len(media), 256) for m in media.slice(i, 256).to_pylist()]
        columns = list(zip(*values, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

    held = "_read"
    while held in df.columns:
        held += "_"
    out = df.withColumn(held, read(F.col(media_col)))
    return out.withColumns({name: F.col(held)[name] for name in names}).drop(held)


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back and digest both, in one pass."""

    def one(text: str | None) -> tuple:
        size, payload = padded(text)
        media = multiplex(payload)
        read = demultiplex(media)
        return size, len(read.payload), hashlib.sha256(read.payload).hexdigest(), zlib.crc32(read.payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(read)

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                values = zip(*[one(t) for t in part.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], ["id", *names])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
