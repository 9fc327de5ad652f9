"""BPE encoding by backtracking over longest matches, decoding by an offset table.

``BytePairTable`` holds a byte-level BPE vocabulary. To encode a pre-token, an
Aho-Corasick automaton gives the longest vocabulary entry at every byte; the
encoder takes the longest one that is *compatible* with the token before it
(no merge that the ordered merge list would have done across the border) and
steps back where none is. That yields exactly the tokens of the ordered merges
in linear time. Short encoded word groups and the answers about pairs are
remembered per Python worker in tables of bounded bytes. Decoding gathers bytes for all ids of a chunk at once from one
byte string with an offset per id.

Defined results: a null or empty text has no tokens; every other text is
encoded whole. Added tokens of the tokenizer file (such as an end-of-text mark)
are recognised in the text as the library does. Repeated rows are encoded row by
row; an empty table gives an empty table; other columns are kept as they are, but
for one with the name of the new column, which is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.session import small_batches

#: The split before the merges, a fixed value of this tokenizer family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Word groups remembered by one Python worker, and the longest one in characters.
REMEMBERED, LONGEST = 150_000, 48
#: Places for remembered answers about pairs of tokens (9 bytes each); a newer pair takes the place of an older one.
PAIRS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class BytePairTable:
    """Vocabulary, merges and automaton of one tokenizer file."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without prefix space is needed")
        value = {s: b for b, s in enumerate(byte_symbols())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        # latin-1 text: one character for each byte, as the automaton reads text
        text = {i: "".join(chr(value[c]) for c in s) for s, i in vocab.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.split: dict[int, tuple[int, int]] = {i: (i, i) for i in text}
        self.merged: dict[tuple[int, int], int] = {}
        #: rank of each id: byte tokens before all merges
        self.rank = {i: -1 for i in text}
        for r, (a, b) in enumerate(pairs):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if (left, right) in self.merged or self.rank[whole] >= 0:
                raise ValueError("two merges make one token")
            self.split[whole] = (left, right)
            self.merged[left, right] = whole
            self.rank[whole] = r
        by_text = {t: i for i, t in text.items()}
        #: length, and next shorter vocabulary entry that a token starts with, by id
        self.length, self.shorter = ([0] * (max(text) + 1) for _ in range(2))
        for i, t in text.items():
            self.length[i] = len(t)
            self.shorter[i] = next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), -1)
        self.automaton = ahocorasick.Automaton()
        for t, i in by_text.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.pairs, self.fits = array("q", [-1]) * PAIRS, bytearray(PAIRS)
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec.get("added_tokens", ())):
            raise ValueError("added tokens that take white space are not supported")
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pre_token = regex.compile(PRE_TOKEN)
        top = max([*text, *added.values()]) + 1
        table = [b""] * top
        for i, t in text.items():
            table[i] = t.encode("latin-1")
        for t, i in added.items():
            table[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.groups = _Groups(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the ordered merges leave the border between two tokens alone."""
        pair = left << 32 | right
        place = (left * 40_503 + right) & (PAIRS - 1)
        if self.pairs[place] != pair:
            self.fits[place] = self._compatible(left, right)
            self.pairs[place] = pair
        return self.fits[place] == 1

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges on both sides from the latest to the earliest. A merge across
        # the border that ranks before the merge undone last would have been done.
        rank, limit = self.rank, len(self.merged)
        while True:
            whole = self.merged.get((left, right))
            if whole is not None and rank[whole] < limit:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                limit, left = rank[left], self.split[left][1]
            else:
                # at equal rank on both sides the left one is merged first
                limit, right = rank[right] + 1, self.split[right][0]

    def encode_bytes(self, raw: str) -> list[int]:
        """Ids of one pre-token given as latin-1 text."""
        n = len(raw)
        longest = [0] * (n + 1)
        for end, (size, token) in self.automaton.iter(raw):
            longest[end - size + 1] = token
        length, shorter, pairs, fits, compatible = self.length, self.shorter, self.pairs, self.fits, self.compatible
        out: list[int] = []
        last = -1
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    place = (last * 40_503 + token) & (PAIRS - 1)
                    if fits[place] if pairs[place] == (last << 32 | token) else compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last = token
                at = end
                token = longest[at]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                last = out[-1] if out else -1
        return out

    def encode_piece(self, text: str) -> bytes:
        """32-bit ids (in the machine's order, little-endian on all that Spark supports) of a text without added tokens."""
        ids: list[int] = []
        for part in self.pre_token.findall(text):
            ids += self.encode_bytes(part.encode().decode("latin-1"))
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if self.added_split is not None and any(a in text for a in self.added):
            return b"".join(self.added.get(p) or self._encode_plain(p) for p in self.added_split.split(text) if p)
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        # No pre-token spans the border before a white-space run, and the run's
        # last blank goes with the word behind it. So with single blanks and line
        # ends, every word with the one before it is encoded alone.
        groups = self.groups
        if not text:
            return b""
        if _TWO_SPACES.search(text):
            return b"".join([groups["\r" + g] for g in _GROUP.findall(text)])
        head, *rest = text.replace("\n", " \n").split(" ")
        first = groups["\r" + head] if head else b""
        return first + b"".join(map(groups.__getitem__, rest))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of ``ids`` in order, and the end of each id's bytes."""
        begin = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8), ends
        where = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.bytes[where], ends


#: White space, or taken for it by one of the two regex dialects, beside blank and line end.
_ODD_SPACE = "".join(map(chr, [0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000]))
#: Two white-space characters in a row, one at the start, or an odd one.
_TWO_SPACES = re.compile(r"\s\s|^\s|[" + re.escape(_ODD_SPACE) + "]")
_GROUP = re.compile(r"\s*\S+|\s+")


class _Groups(dict):
    """Ids by word group. Keys: a word stands for blank + word, a word that starts
    with a line end for itself, and behind a carriage return a word without blank."""

    def __init__(self, table: BytePairTable) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, key: str) -> bytes:
        whole = key[1:] if key[:1] == "\r" else key if key[:1].isspace() else " " + key
        value = self.table.encode_piece(whole)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


_loaded: dict[str, BytePairTable] = {}


def table_of(tokenizer_json: str) -> BytePairTable:
    """The table of a tokenizer file, built once in each Python worker."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = BytePairTable(tokenizer_json)
    return _loaded[key]


def _encoded(texts: pa.Array, table: BytePairTable) -> list[bytes]:
    return [table.encode(t) if t else b"" for t in texts.to_pylist()]


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``: the ids of each whole text as little-endian unsigned 32-bit integers (binary).

    A column of that name is replaced. The tokenizer file is read on the driver
    (its size is that of a vocabulary) and goes to the tasks with the function.
    """
    spec = _tokenizer(df, tokenizer_path)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        table = table_of(spec.value)
        return pa.array([x for i in range(0, len(texts), 512) for x in _encoded(texts.slice(i, 512), table)], pa.binary())

    return df.withColumn(ids_col, encode(F.col(text_col)))


def bpe_round_trip(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", same_col: str = "round_trip") -> DataFrame:
    """``bpe_encode``, and in the same pass ``same_col``: whether decoding the ids gives the text back (null: empty)."""
    spec = _tokenizer(df, tokenizer_path)

    @F.arrow_udf("ids binary, same boolean")
    def encode(texts: pa.Array) -> pa.Array:
        table = table_of(spec.value)
        ids, same = [], []
        for i in range(0, len(texts), 512):
            part = texts.slice(i, 512)
            ids += (encoded := _encoded(part, table))
            same += [raw == (t or "").encode() for raw, t in zip(decode_rows(encoded, table), part.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], ["ids", "same"])

    held = "_encoded"
    while held in df.columns:
        held += "_"
    out = df.withColumn(held, encode(F.col(text_col)))
    return out.withColumns({ids_col: F.col(held)["ids"], same_col: F.col(held)["same"]}).drop(held)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the text of each row of ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text.

    A column of that name is replaced.
    """
    spec = _tokenizer(df, tokenizer_path)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        raw = pc.fill_null(ids, b"").to_pylist()
        return pa.array([b.decode("utf-8", "replace") for b in decode_rows(raw, table_of(spec.value))], pa.string())

    return df.withColumn(out_col, decode(F.col(ids_col)))


def decode_rows(rows: list[bytes], table: BytePairTable, limit: int = 1 << 19) -> Iterator[bytes]:
    """The bytes of each row of ids, decoded in runs of rows of about ``limit`` ids."""
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size + len(rows[end]) <= 4 * limit):
            size += len(rows[end])
            end += 1
        ids = np.frombuffer(b"".join(rows[at:end]), "<u4")
        data, ends = table.decode(ids)
        data = data.tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows[at:end]])])]
        yield from (data[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True))
        at = end


def _tokenizer(df: DataFrame, path: str):
    small_batches(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_digests(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: ``n_tokens, ids_sha256, decoded_sha256`` by row."""
    spec = _tokenizer(df, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(spec.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = _encoded(part.column(1), table)
                decoded = decode_rows(ids, table)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(b) // 4 for b in ids], pa.int64()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in ids]),
                        pa.array([hashlib.sha256(b.decode("utf-8", "replace").encode()).hexdigest() for b in decoded]),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
