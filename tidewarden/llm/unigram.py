"""Token counts of a unigram tokenizer by a count-only Viterbi pass.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each
character; dynamic programming carries the best score and the number of pieces
up to it, nothing else. Tie rules are those of the tokenizers library's Unigram
model: at equal score the piece that starts first stays; a character that no
one-character piece covers may be an unknown with the lowest score less 10,
counted as its UTF-8 bytes where the vocabulary has byte pieces, else runs of
unknowns count once. Words (a blank and what follows it) are segmented on their
own, as the library's Metaspace splitter does, and remembered, if short, in a
bounded table in each Python worker.

The vocabulary comes from a piece file. Such a file may hold merge ranks and no
log probabilities; ``zipf`` scores then take the piece of rank r as having
probability 1 / (r * H), with H the harmonic number of the vocabulary's size.

Defined results: a null or empty text has no tokens; a text is segmented whole
whatever its length. Repeated rows are counted row by row; an empty table gives
an empty table; other columns are kept, but for one with the name of the count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.session import small_batches

SPACE = chr(0x2581)
#: Score of an unknown character below the lowest score of the vocabulary, a fixed value of the library.
UNKNOWN_PENALTY = 10.0
#: Words remembered by one Python worker, and the longest one in characters.
REMEMBERED, LONGEST = 250_000, 48
#: Piece types of the file format (fixed values): normal, unknown, control, user-defined, unused, byte.
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size = varint()
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


def read_pieces(model: bytes) -> list[tuple[str, int]]:
    """Pieces of a piece file with their types, in order of ids."""
    out = []
    for field, value in _fields(model):
        if field == 1 and isinstance(value, bytes):
            own = dict(_fields(value))
            out.append((own[1].decode(), int(own.get(3, _NORMAL))))
    return out


def zipf_vocabulary(model: bytes) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) in order of ids, and the id of the unknown piece.

    Normal pieces are ranked in order of ids. Byte, control and unknown pieces
    have the score of a piece after the last.
    """
    pieces = read_pieces(model)
    normal = [i for i, (_, kind) in enumerate(pieces) if kind == _NORMAL]
    h = math.fsum(1 / r for r in range(1, len(normal) + 1))
    score = {i: -math.log(r * h) for r, i in enumerate(normal, 1)}
    last = -math.log((len(normal) + 1) * h)
    return [(p, score.get(i, last)) for i, (p, _) in enumerate(pieces)], next(i for i, (_, k) in enumerate(pieces) if k == _UNKNOWN)


class UnigramCounter:
    """Piece counts of words under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        held = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in held for b in range(256))
        self.words = _Words(self)

    def count_word(self, word: str) -> int:
        """Pieces of the best segmentation of one word."""
        n = len(word)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        reached = [False] * (n + 1)
        single = [False] * (n + 1)
        lost = [False] * (n + 1)
        reached[0] = True
        waiting = self.automaton.iter(word)
        held = next(waiting, None)
        for end in range(1, n + 1):
            # longest piece first: at equal scores the earlier start stays
            while held is not None and held[0] == end - 1:
                size, score = held[1]
                start = end - size
                total = best[start] + score
                if not reached[end] or total > best[end]:
                    best[end], count[end], reached[end] = total, count[start] + 1, True
                if size == 1:
                    single[end] = True
                held = next(waiting, None)
            if not single[end]:
                total = best[end - 1] + self.unknown
                if not reached[end] or total > best[end]:
                    if self.bytes:
                        more = len(word[end - 1].encode())
                    else:
                        more = 0 if lost[end - 1] else 1
                    best[end], count[end], reached[end], lost[end] = total, count[end - 1] + more, True, True
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        parts = text.replace(SPACE, " ").split(" ")
        return sum(map(self.words.__getitem__, parts[1:] if parts[0] == "" else parts))


class _Words(dict):
    def __init__(self, counter: UnigramCounter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        value = self.counter.count_word(SPACE + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_loaded: dict[int, UnigramCounter] = {}


def count_tokens(df: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Add ``out_col``, the number of tokens of each whole text (a column of that name is replaced). No shuffle."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        vocabulary = held.value
        key = hash(tuple(vocabulary))
        if key not in _loaded:
            _loaded[key] = UnigramCounter(vocabulary)
        counter = _loaded[key]
        return pa.array([counter.count(t or "") for i in range(0, len(texts), 512) for t in texts.slice(i, 512).to_pylist()], pa.int64())

    return df.withColumn(out_col, count(F.col(text_col)))
