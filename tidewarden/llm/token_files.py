"""Token-id files: concatenated ids with Elias-Fano document boundaries.

``encode_texts`` gives each whole text's ids by the tokenizers library. A text is
cut before each white-space run and behind each letter that an ASCII digit or mark
follows, where every pre-token of a byte-level tokenizer has a border, and each
different piece of a batch is encoded once; texts
with white space outside ASCII or with added tokens go to the library whole.
``write_token_files`` deals rows out by id range, encodes them and writes them with
the data source ``token_ids``; ``read_token_files`` reads them back.

One file: ids of 2 or 4 bytes (little-endian) one document after the other; the
ends of the documents and the document ids as two ``Monotone`` sequences (low bits
packed, high bits in unary, the place of every 1,024th one bit for select); a
footer of fixed size. No table of 64-bit offsets is stored or built: a reader
selects the bounds of a run of documents and reads just their ids. ``manifest.json``
lists the files that committed tasks wrote, in order of document ids; files of
lost or repeated attempts aren't listed, so they are never read. A file is closed
at FILE_IDS ids and written as a stream, so a task holds one batch and its bounds.

Defined results: a null or empty text has the end id alone (no ids without one).
Rows are in ascending order of id, null ids first, rows of one id in order of a
hash of their texts. Repeated rows stay; ids must be integers; other columns aren't
stored. An empty table gives a manifest without files, which reads as no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewarden.functions.session import small_batches

#: Ids in one file at most, but for the last document.
FILE_IDS = 1 << 26
#: Values between two select samples; a multiple of 8.
BLOCK = 1 << 10
#: Ids that a reader holds at a time, but for one longer document.
READ_IDS = 1 << 20
#: Pieces of texts remembered by one Python worker, and the longest one in bytes.
REMEMBERED, LONGEST = 300_000, 64


# --- encoding

#: White space beyond ASCII, and what some regex dialects take for it.
_ODD_SPACE = "[\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200B}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(9, 14), 32]] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[33:127] = ~_IS_LETTER[33:127]


class PieceEncoder:
    """Ids of texts by the tokenizers library, each different piece of a batch encoded once."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread in each task
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        split = spec.get("pre_tokenizer") or {}
        #: only a byte-level split leaves the borders before white-space runs alone
        self.by_piece = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and spec.get("normalizer") is None
        self.added = [a["content"] for a in spec.get("added_tokens", ())]
        #: an added token that takes nothing from its neighbours: the library cuts there before all else
        plain = [a for a in spec.get("added_tokens", ()) if a["special"] and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"])]
        self.border = plain[0]["id"] if self.by_piece and plain else None
        self.border_text = plain[0]["content"].encode() if plain else b""
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        if len(self.newer) >= REMEMBERED // 2:
            self.older, self.newer = self.newer, {}
        newer, older = self.newer, self.older
        out = list(map(newer.get, pieces))
        fresh = [i for i, x in enumerate(out) if x is None]
        missing = []
        for i in fresh:
            out[i] = older.get(pieces[i])
            if out[i] is None:
                missing.append(i)
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            for i, x in zip(part, self._asked([pieces[i] for i in part]), strict=True):
                out[i] = x
        for i in fresh:
            if len(pieces[i]) <= LONGEST:
                newer[pieces[i]] = out[i]
        return out

    def _asked(self, pieces: list[bytes]) -> list[bytes]:
        """What the library gives for each piece: one text with the added token between them, or one text for each."""
        if self.border is None or self.border_text in b"".join(pieces):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        (found,) = self.tokenizer.encode_batch_fast([self.border_text.join(pieces).decode()], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = [-1, *np.flatnonzero(ids == self.border).tolist(), len(ids)]
        raw = ids.tobytes()
        return [raw[4 * a + 4 : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has; nulls are empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        filled = np.flatnonzero(np.diff(ends))
        if not len(filled):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        start = np.zeros(len(raw), bool)
        if self.by_piece:
            space = _IS_SPACE[raw]
            start[1:] = (space[1:] & ~space[:-1]) | (_IS_MARK[raw[1:]] & _IS_LETTER[raw[:-1]])
            whole = pc.match_substring_regex(texts, _ODD_SPACE)
            for a in self.added:
                whole = pc.or_(whole, pc.match_substring(texts, a))
            for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
                start[ends[i] : ends[i + 1]] = False
        start[ends[filled]] = True
        starts = np.flatnonzero(start)
        bounds = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        ids = self._ids(pieces.dictionary.to_pylist())
        which = pieces.indices.to_numpy()
        size = np.array([len(x) for x in ids], np.int64) // 4
        begin = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(ids), "<u4")
        upto = np.concatenate([[0], np.cumsum(size[which])])
        flat = np.empty(upto[-1], "<u4")
        for k in range(0, len(which), 1 << 17):
            part = which[k : k + (1 << 17)]
            a, b = upto[k], upto[k + len(part)]
            flat[a:b] = pool[np.arange(a, b) + np.repeat(begin[part] - upto[k : k + len(part)], size[part])]
        return flat, np.diff(upto[np.searchsorted(starts, ends)])


_loaded: dict[str, PieceEncoder] = {}


def _encoder(tokenizer_json: str) -> PieceEncoder:
    if tokenizer_json not in _loaded:
        _loaded.clear()
        _loaded[tokenizer_json] = PieceEncoder(tokenizer_json)
    return _loaded[tokenizer_json]


def _with_end(flat: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end_id is None:
        return flat, counts
    return np.insert(flat, np.cumsum(counts), end_id), counts + 1


def _slices(texts: pa.Array, limit: int = 8 << 20) -> Iterator[pa.Array]:
    """Runs of texts of about ``limit`` bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield texts.slice(at, end - at)
        at = end


def encode_texts(df: DataFrame, tokenizer_path: str, end_id: int | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``: each whole text's ids, and ``end_id`` where given, as little-endian unsigned 32-bit integers (binary).

    A column of that name is replaced.
    """
    small_batches(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # the size of a vocabulary

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        encoder, parts = _encoder(spec.value), []
        for run in _slices(texts):
            flat, counts = _with_end(*encoder.encode(run), end_id)
            ends = np.concatenate([[0], 4 * np.cumsum(counts)]).astype(np.int64)
            parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(run), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u4"))]))
        return (pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())).cast(pa.binary())

    return df.withColumn(ids_col, encode(F.col(text_col)))


# --- boundaries


class Monotone:
    """A monotone sequence of non-negative integers: packed low bits, unary high bits, select samples."""

    _HEAD = struct.Struct("<QBxxxxxxxQ")  # values, low bits, high bits

    def __init__(self, n: int, low_bits: int, n_high: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.n_high, self.low, self.high, self.samples = n, low_bits, n_high, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> Monotone:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        n_high = (top >> low_bits) + n
        if n_high >> 32:
            raise ValueError("too many values for one file")
        high, samples, low = np.zeros(-(-n_high // 8), np.uint8), [], []
        for at in range(0, n, BLOCK):
            part = values[at : at + BLOCK].astype(np.uint64)
            ones = (part >> np.uint64(low_bits)).astype(np.int64) + np.arange(at, at + len(part))
            samples.append(ones[0])
            np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
            if low_bits:
                bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=low_bits, bitorder="little")
                low.append(np.packbits(bits.ravel(), bitorder="little"))
        return cls(n, low_bits, n_high, np.concatenate(low) if low else np.zeros(0, np.uint8), high, np.array(samples, "<u4"))

    def to_bytes(self) -> bytes:
        return self._HEAD.pack(self.n, self.low_bits, self.n_high) + self.samples.astype("<u4").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Monotone:
        n, low_bits, n_high = cls._HEAD.unpack_from(data)
        at = cls._HEAD.size
        samples = np.frombuffer(data, "<u4", -(-n // BLOCK), at)
        at += samples.nbytes
        full, rest = divmod(n, BLOCK)
        low = np.frombuffer(data, np.uint8, full * BLOCK * low_bits // 8 + -(-rest * low_bits // 8), at)
        at += low.nbytes
        return cls(n, low_bits, n_high, low, np.frombuffer(data, np.uint8, -(-n_high // 8), at), samples)

    def run(self, start: int, stop: int) -> np.ndarray:
        """Values number ``start`` to ``stop`` - 1; only their blocks are unpacked."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.int64)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        at, n = first * BLOCK, min((last + 1) * BLOCK, self.n) - first * BLOCK
        begin = int(self.samples[first])
        end = int(self.samples[last + 1]) if last + 1 < len(self.samples) else self.n_high
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
        out = (np.flatnonzero(bits)[:n] + begin - np.arange(at, at + n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            packed = np.unpackbits(self.low[at * self.low_bits // 8 :], count=n * self.low_bits, bitorder="little").reshape(n, -1)
            wide = np.zeros((n, 64), np.uint8)
            wide[:, : self.low_bits] = packed
            out |= np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel().astype(np.int64)
        return out[start - at : stop - at]

    def select(self, i: int) -> int:
        """Value number ``i``."""
        return int(self.run(i, i + 1)[0])


# --- files

_MAGIC = b"TWIDS001"
#: bytes of an id, documents, documents without id, ids, smallest document id, bytes of the two sequences, mark
_FOOTER = struct.Struct("<QQQQqQQ8s")


class TokenFile:
    """One file, read by ranges."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.width, self.n_docs, self.n_null, self.n_ids, self.base, n_ends, n_keys, mark = _FOOTER.unpack(self._bytes(size - _FOOTER.size, _FOOTER.size))
        if mark != _MAGIC:
            raise ValueError(f"{path} is no token-id file")
        at = size - _FOOTER.size - n_ends - n_keys
        self.ends, self.keys = Monotone.from_bytes(self._bytes(at, n_ends)), Monotone.from_bytes(self._bytes(at + n_ends, n_keys))

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number ``start`` to ``stop`` - 1 of the file."""
        return np.frombuffer(self._bytes(start * self.width, (stop - start) * self.width), f"<u{self.width}")

    def bounds(self, first: int, stop: int) -> np.ndarray:
        """Where documents ``first`` to ``stop`` - 1 begin, and where the last of them ends."""
        before = [self.ends.select(first - 1)] if first else [0]
        return np.concatenate([before, self.ends.run(first, stop)]).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        """Ids of document number ``i``."""
        return self.ids(*self.bounds(i, i + 1).tolist())

    def doc_ids(self, first: int, stop: int) -> pa.Array:
        null = max(0, min(stop, self.n_null) - first)
        known = self.keys.run(max(first - self.n_null, 0), stop - self.n_null) + self.base
        return pa.concat_arrays([pa.nulls(null, pa.int64()), pa.array(known, pa.int64())])

    def batches(self, start: int) -> Iterator[pa.RecordBatch]:
        """``doc_id, start, n_tokens, ids`` of all documents; ``start`` ids are in the files before this one."""
        for first in range(0, self.n_docs, BLOCK):
            stop = min(first + BLOCK, self.n_docs)
            bounds = self.bounds(first, stop)
            at = 0
            while at < stop - first:
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + READ_IDS, side="right")) - 1)
                ids = self.ids(int(bounds[at]), int(bounds[end])).astype("<u4")
                offsets = (4 * (bounds[at : end + 1] - bounds[at])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        self.doc_ids(first + at, first + end),
                        pa.array(bounds[at:end] + start, pa.int64()),
                        pa.array(np.diff(bounds[at : end + 1]), pa.int64()),
                        pa.BinaryArray.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                at = end


class _OpenFile:
    """A file being written: ids go out as they come, bounds are kept for the end."""

    def __init__(self, system: fs.FileSystem, folder: str, width: int) -> None:
        self.name, self.width = f"ids-{uuid.uuid4().hex}.tok", width
        self.out = system.open_output_stream(f"{folder}/{self.name}")
        self.sizes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.n_null = self.n_ids = 0

    def add(self, keys: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.width == 2 and len(flat) and int(flat.max()) >> 16:
            raise ValueError("an id needs more than 2 bytes")
        self.out.write(flat.astype(f"<u{self.width}").tobytes())
        self.sizes.append(sizes.astype(np.uint32))
        self.keys.append(pc.drop_null(keys).to_numpy())
        if keys.null_count and sum(map(len, self.keys)) > len(self.keys[-1]):
            raise ValueError("rows must be in order of id")
        self.n_null += keys.null_count
        self.n_ids += len(flat)

    def close(self) -> dict:
        ends, keys = np.cumsum(np.concatenate(self.sizes), dtype=np.uint64), np.concatenate(self.keys).astype(np.int64)
        if (np.diff(keys) < 0).any():
            raise ValueError("rows must be in order of id")
        base = int(keys[0]) if len(keys) else 0
        first, second = Monotone.build(ends).to_bytes(), Monotone.build(keys.astype(np.uint64) - np.uint64(base % 2**64)).to_bytes()
        self.out.write(first + second + _FOOTER.pack(self.width, len(ends), self.n_null, self.n_ids, base, len(first), len(second), _MAGIC))
        self.out.close()
        return {"name": self.name, "docs": len(ends), "ids": self.n_ids}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, file_ids: int) -> None:
        self.path, self.width, self.file_ids = path, width, file_ids
        system, folder = _place(path)
        system.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        system, folder = _place(self.path)
        files, held = [], None
        for batch in iterator:
            ids = batch.column(1).cast(pa.large_binary())
            if ids.null_count:
                raise ValueError("ids must not be null")
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
            flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")
            at = 0
            while at < len(ids):
                held = held or _OpenFile(system, folder, self.width)
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + self.file_ids - held.n_ids, side="right")) - 1)
                held.add(batch.column(0).slice(at, end - at), flat[ends[at] : ends[end]], np.diff(ends[at : end + 1]))
                at = end
                if held.n_ids >= self.file_ids or at < len(ids):
                    files.append(held.close())
                    held = None
        if held:
            files.append(held.close())
        return _Written(TaskContext.get().partitionId(), files)

    def commit(self, messages: list[_Written | None]) -> None:
        """List the files of the tasks that count, in order, with the ids before each."""
        system, folder = _place(self.path)
        files, start = [], 0
        for f in (f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files):
            files.append(f | {"start": start})
            start += f["ids"]
        with system.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"files": files, "ids": start}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = _place(self.path)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f"{folder}/{f['name']}")


@dataclass
class _Part(InputPartition):
    name: str
    start: int


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Part]:
        system, folder = _place(self.path)
        with system.open_input_stream(f"{folder}/manifest.json") as f:
            files = json.loads(f.read())["files"]
        return [_Part(f["name"], f["start"]) for f in files] or [_Part("", 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.name:
            system, folder = _place(self.path)
            yield from TokenFile(system, f"{folder}/{part.name}").batches(part.start)


class TokenIdSource(DataSource):
    """The format ``token_ids``: rows ``doc_id long, ids binary`` in order of id go in, ``doc_id, start, n_tokens, ids`` come out.

    Options: ``path`` (file:, or what else the Arrow file systems open), ``width`` (bytes of an id), ``file_ids``.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("width", 4)), int(self.options.get("file_ids", FILE_IDS)))


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Write all texts' ids in ascending order of ``id_col`` as token-id files in the new folder ``path``.

    One exchange of ids and texts by ranges of id, hash of the text and row, so a
    third of all rows with one id still go to many tasks; encoding follows it, so
    that finding the ranges doesn't encode.
    """
    spark = df.sparkSession
    spark.dataSource.register(TokenIdSource)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec.get("added_tokens", ())), end_id or 0])
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    encoded = encode_texts(dealt, tokenizer_path, end_id).select("doc_id", "ids")
    encoded.write.format("token_ids").option("width", 2 if top < 1 << 16 else 4).option("file_ids", file_ids).mode("append").save(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document; ``start``: ids of all documents before it."""
    spark.dataSource.register(TokenIdSource)
    return spark.read.format("token_ids").load(path)
