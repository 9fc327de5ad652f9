"""Trigram language-model scores from sharded Elias-Fano n-gram tries.

The model has Dirichlet-smoothed levels, each normalised:

    p1(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p2(w | v)   = (c(v w) + M2 p1(w)) / (c(v) + M2)
    p3(w | u v) = (c(u v w) + M3 p2(w | v)) / (c(u v) + M3)

Counts come from the rows that aren't held out, without thresholds. Tokens are
hashes of words, then one end token; two start tokens stand in front.

N-grams are dealt to shards by their last word, or by their last two words where
the last one is frequent, so no word gathers its occurrences in one task; word
pairs that may be too many for one shard are split further by the word in front
of them, and their exact counts c(v w) are counted beforehand and sent to all
their shards. A shard knows c(v w) and c(u v w) of its n-grams; c(w) is known
there for all other words, and for the frequent ones from a list with a fixed
bound. The list only saves space: a word in front that isn't on it is looked up
in the counts of all words, once for each shard that needs it, and its exact c(v)
goes to that shard's task. The denominators c(u v) + M3 of p3 are taken from the
shard of the bigram (u, v), which is the same sum over the text.

Each shard is a trie over (w, v, u) in levels of Elias-Fano sequences: children
of all nodes of a level are one monotone sequence (node number times the range of
the ids, plus id), so one successor search finds a child of any node. Level three
is context-relative: u is stored as its place among the words seen before v.
Smoothed probabilities are quantised, downwards, to 16 bits in the log domain.
The levels lie in one anonymous memory map, in packed form: a search goes through
the sorted questions and a sampled directory, and unpacks only the parts of the
sequence that questions fall into, one at a time. (The map isn't a file: shards
are built and used in one task, and executors share no folder that could be
mapped.) A shard scores the occurrences of all rows, and the partial sums of each
run of rows are added up by run.

Defined results: a null or empty text is scored as the end token alone; a row
whose held-out flag is null is learned from; repeated ids are scored row by row
(and learned from as often); an empty table gives an empty table; without
training rows every token is unknown, and the score is the base score. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import mmap
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.session import shared_dir, small_batches, staged
from tidewarden.llm.textscan import mix, text_chunks, words

#: Smoothing weights of bigrams and trigrams.
M2, M3 = 2000.0, 20.0
#: Most words of the list of frequent words; results don't depend on it.
FREQUENT = 65_000
#: Tokens that a shard gets on average.
TOKENS_PER_SHARD = 1_500_000
#: Rows of a run, at most.
RUN_ROWS = 30_000
END = np.uint64(0x454E44)
START = np.uint64(0x53544152)
_ESCAPE, _START_CODE = 65_535, 65_534
#: Quantisation of natural logarithms: steps of STEP from LOWEST.
LOWEST, STEP = -45.0, 90.0 / 65_535


# ---- Elias-Fano sequences ---------------------------------------------------


@dataclass
class EliasFano:
    """A monotone sequence: low bits packed, high bits as a unary bit vector, and a directory of the first value and high bit of every _PART values."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    starts: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = [_low_bits(values[i : i + _PART], low_bits) for i in range(0, n, _PART)]
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        unary[high] = 1
        return cls(n, low_bits, np.concatenate(low) if low else np.zeros(0, np.uint8), np.packbits(unary), values[::_PART].copy(), np.append(high[::_PART], high[-1:] + 1).astype(np.int64))

    def part(self, k: int) -> np.ndarray:
        """The values from number k * _PART on, _PART at most."""
        at = k * _PART
        size = min(_PART, self.n - at)
        begin, end = int(self.starts[k]), int(self.starts[k + 1])
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)])[begin % 8 :]
        out = (np.flatnonzero(bits)[:size] + begin - np.arange(at, at + size)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            whole = _PART * self.low_bits // 8
            packed = np.unpackbits(self.low[k * whole : (k + 1) * whole])[: size * self.low_bits].reshape(size, self.low_bits)
            wide = np.zeros((size, 64), np.uint8)
            wide[:, 64 - self.low_bits :] = packed
            out |= np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
        return out

    def parts(self) -> int:
        return -(-self.n // _PART)

    def decode(self) -> np.ndarray:
        """All values."""
        return np.concatenate([np.zeros(0, np.uint64), *(self.part(k) for k in range(self.parts()))])

    def get(self, places: np.ndarray) -> np.ndarray:
        """The values at some places."""
        out = np.zeros(len(places), np.uint64)
        of = places // _PART
        for k in np.unique(of).tolist():
            here = of == k
            out[here] = self.part(k)[places[here] - k * _PART]
        return out

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that isn't smaller (the last place where there is none), and whether it is equal."""
        wanted = wanted.astype(np.uint64)
        at, same = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        if not self.n:
            return at, same
        order = _rough_order(wanted)
        asked = wanted[order]
        # the last part that begins with no more than the question, in whose reach its successor lies (or at the next one's begin)
        of = np.maximum(np.searchsorted(self.first, asked, side="right") - 1, 0)
        place, equal = np.empty(len(asked), np.int64), np.empty(len(asked), bool)
        by = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[by], np.arange(self.parts() + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            here = by[cut[k] : cut[k + 1]]
            values = self.part(k)
            found = np.searchsorted(values, asked[here])
            equal[here] = values[np.minimum(found, len(values) - 1)] == asked[here]
            place[here] = np.minimum(found + k * _PART, self.n - 1)
        at[order] = place
        same[order] = equal
        return at, same


#: Values that are packed and unpacked at a time; a multiple of 8.
_PART = 1 << 15


def _low_bits(values: np.ndarray, low_bits: int) -> np.ndarray:
    """The low bits of values, one value after the other."""
    if not low_bits:
        return np.zeros(0, np.uint8)
    wide = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(wide[:, 64 - low_bits :].ravel())


def _rough_order(values: np.ndarray) -> np.ndarray:
    """An order by the leading bits: sorting values with their places in the low bits is faster than argsort."""
    bits = max(1, len(values) - 1).bit_length()
    down = max(0, int(values.max()).bit_length() + bits - 64) if len(values) else 0
    mask = np.uint64((1 << bits) - 1)
    return (np.sort(((values >> np.uint64(down)) << np.uint64(bits)) | np.arange(len(values), dtype=np.uint64)) & mask).astype(np.int64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often they occur."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def successors(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``find`` in sorted values; the questions are put in order first, so the search runs through memory once."""
    wanted = wanted.astype(np.uint64)
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    order = _rough_order(wanted)
    asked = wanted[order]
    place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    at, same = np.empty(len(wanted), np.int64), np.empty(len(wanted), bool)
    at[order] = place
    same[order] = values[place] == asked
    return at, same


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((logs - LOWEST) / STEP), 0, 65_535).astype(np.uint16)


def from_codes(codes: np.ndarray) -> np.ndarray:
    return codes * STEP + LOWEST


class NgramTrie:
    """Levels over (w, v, u) with quantised values, in one memory map."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, p1, context, split: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        """From training occurrences. ``p1(words)`` and ``context(words)`` give p1 and c(v).

        ``split`` has v, w and c(v w) of the pairs of which other shards hold a part.
        """
        split_v, split_w, split_c = split or (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.vocabulary = EliasFano.build(distinct(np.concatenate([u, v, w, split_v, split_w]))[0])
        size = max(self.vocabulary.n, 1)
        self.size = np.uint64(size)
        held = self.vocabulary.decode()
        uid, vid, wid = (successors(held, x)[0].astype(np.uint64) for x in (u, v, w))
        pair = wid * self.size + vid
        apart = successors(held, split_w)[0].astype(np.uint64) * self.size + successors(held, split_v)[0].astype(np.uint64)
        pairs = distinct(np.concatenate([pair, apart]))[0]
        c2 = np.zeros(len(pairs), np.int64)
        own, c_own = distinct(pair)
        c2[successors(pairs, own)[0]] = c_own
        c2[successors(pairs, apart)[0]] = split_c
        of_pair = successors(pairs, pair)[0]
        self.pairs = EliasFano.build(pairs)
        before = distinct(vid * self.size + uid)[0]
        self.before = EliasFano.build(before)
        # place of u among the words before v: distance from the first word before v
        place = successors(before, vid * self.size + uid)[0] - successors(before, vid * self.size)[0]
        self.places = np.uint64(int(place.max()) + 1 if len(place) else 1)
        triples, c3 = distinct(of_pair.astype(np.uint64) * self.places + place.astype(np.uint64))
        self.triples = EliasFano.build(triples)
        p_w, c_v = p1(held[(pairs // self.size).astype(np.int64)]), context(held[(pairs % self.size).astype(np.int64)])
        p2 = (c2 + M2 * p_w) / (c_v + M2)
        top = np.log(c3 + M3 * p2[(triples // self.places).astype(np.int64)])
        self.values = {"p2": quantised(np.log(p2)), "weight": quantised(np.log(c2 + M3)), "top": quantised(top)}
        self._map()

    def _map(self) -> None:
        levels = (self.vocabulary, self.pairs, self.before, self.triples)
        parts = [a for level in levels for a in (level.low, level.high, level.first, level.starts)] + list(self.values.values())
        sizes = [-(-a.nbytes // 8) * 8 for a in parts]
        self.memory = mmap.mmap(-1, max(sum(sizes), 1))
        views, at = [], 0
        for a, size in zip(parts, sizes, strict=True):
            view = np.frombuffer(self.memory, a.dtype, len(a), at)
            np.copyto(np.frombuffer(memoryview(self.memory)[at : at + a.nbytes], a.dtype), a)
            views.append(view)
            at += size
        for level in levels:
            level.low, level.high, level.first, level.starts = views[:4]
            views = views[4:]
        self.values = dict(zip(self.values, views, strict=True))

    @property
    def nbytes(self) -> int:
        return len(self.memory)

    def logs(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, p1, context) -> tuple[np.ndarray, np.ndarray]:
        """ln of the numerator of p3, and ln of the weight c(v w) + M3, for each n-gram."""
        (uid, u_known), (vid, v_known), (wid, w_known) = (self.vocabulary.find(x) for x in (u, v, w))
        uid, vid, wid = (x.astype(np.uint64) for x in (uid, vid, wid))
        pair, seen = self.pairs.find(wid * self.size + vid)
        seen &= v_known & w_known
        low = np.empty(len(w))
        low[seen] = from_codes(self.values["p2"][pair[seen]])
        new = ~seen
        low[new] = np.log(M2 * p1(w[new]) / (context(v[new]) + M2))
        weight = np.full(len(w), math.log(M3))
        weight[seen] = from_codes(self.values["weight"][pair[seen]])
        out = low + math.log(M3)
        ask = np.flatnonzero(seen & u_known)
        if len(ask):
            at, same = self.before.find(vid[ask] * self.size + uid[ask])
            first, _ = self.before.find(vid[ask] * self.size)
            place = (at - first)[same].astype(np.uint64)
            ask = ask[same]
            triple, found = self.triples.find(pair[ask].astype(np.uint64) * self.places + place)
            out[ask[found]] = from_codes(self.values["top"][triple[found]])
        return out, weight


# ---- counting and scoring in Spark ------------------------------------------


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, held-out flags, token hashes with end tokens, and tokens by row, for runs of rows."""
    for begin in range(0, batch.num_rows, RUN_ROWS):
        part = batch.slice(begin, RUN_ROWS)
        for i, j, data, off in text_chunks(part.column(2)):
            h, _, _, per_row = words(data, off)
            per_row = per_row + 1
            ends = np.cumsum(per_row)
            tokens = np.full(int(ends[-1]), END, np.uint64)
            keep = np.ones(len(tokens), bool)
            keep[ends - 1] = False
            tokens[keep] = h
            yield part.column(0).slice(i, j - i), part.column(1).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool), tokens, per_row


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, c``: tokens of the rows that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h, c = distinct(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["word", "c"])

        for batch in batches:
            for _, out, tokens, per_row in _runs(batch):
                held.append(tokens[np.repeat(~out, per_row)])
                size += len(held[-1])
                if size >= 2_000_000:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return rows.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Frequent:
    """Sorted hashes of the frequent words, their ranks, and the counts by rank."""

    word: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    #: occurrences of the end token, and so of the start; tokens of a shard
    ends: int
    per_shard: int

    @property
    def ample(self) -> bool:
        """Whether some word alone could fill more than one shard."""
        return bool(len(self.count)) and max(float(self.count.max()), self.ends) > self.per_shard

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Rank on the list, _START_CODE, or _ESCAPE."""
        at, same = successors(self.word, h)
        return np.where(same, self.rank[at] if len(self.rank) else at, np.where(h == START, _START_CODE, _ESCAPE)).astype(np.uint16)


def _before(tokens: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens in front of each token, (u, v)."""
    starts = np.cumsum(per_row) - per_row
    padded = np.concatenate([np.full(2, START, np.uint64), tokens])
    v, u = padded[1:-1].copy(), padded[:-2].copy()
    v[starts] = START
    u[starts] = START
    second = starts[per_row > 1] + 1
    u[second] = START
    return u, v


def _splits(cv: np.ndarray, cw: np.ndarray, frequent: Frequent) -> np.ndarray:
    """How many shards a pair of words (codes) is split into: the rarer word's count over a shard's size; 1 where a word isn't on the list."""
    count = np.append(frequent.count, np.zeros(65_536 - len(frequent.count)))
    count[_START_CODE] = frequent.ends
    most = np.minimum(count[cv], count[cw])
    return np.maximum(np.ceil(most / frequent.per_shard), 1).astype(np.uint64)


def _pair_shard(v: np.ndarray, w: np.ndarray, sub: np.ndarray, shards: int) -> np.ndarray:
    by = mix(w + mix(v))
    return ((mix(np.where(sub > 0, mix(by + sub), by)) >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)


def _shard_of(u: np.ndarray, v: np.ndarray, w: np.ndarray, cv: np.ndarray, cw: np.ndarray, frequent: Frequent, shards: int) -> np.ndarray:
    sub = mix(u ^ END) % _splits(cv, cw, frequent) if frequent.ample else np.zeros(len(w), np.uint64)
    return np.where(cw == _ESCAPE, ((mix(w) >> np.uint64(20)) % np.uint64(shards)).astype(np.int32), _pair_shard(v, w, sub, shards))


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(buffer: pa.Buffer, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(buffer, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd"), kind, n)


#: Pairs of a shard and a word that a task holds before it passes them on.
_PAIRS_HELD = 2_000_000


def _context_counts(rows: DataFrame, vocabulary: DataFrame, frequent: Frequent, shards: int) -> DataFrame:
    """``shard, words, counts``: exact c(v) of the words that aren't on the list, packed, for each shard where they stand in front of a token."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def pairs() -> pa.RecordBatch:
            shard, v = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((v, shard))
            shard, v = shard[order], v[order]
            first = np.append(True, (shard[1:] != shard[:-1]) | (v[1:] != v[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(v[first].view(np.int64))], ["shard", "word"])

        for batch in batches:
            for _, _, tokens, per_row in _runs(batch):
                u, v = _before(tokens, per_row)
                cv = frequent.codes(v)
                at = np.flatnonzero(cv == _ESCAPE)
                if not len(at):
                    continue
                u, v, w = u[at], v[at], tokens[at]
                held.append((_shard_of(u, v, w, cv[at], frequent.codes(w), frequent, shards), v))
                size += len(v)
                if size >= _PAIRS_HELD:
                    yield pairs()
                    held, size = [], 0
        if size:
            yield pairs()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def packs() -> pa.RecordBatch:
            shard, word, c = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(3))
            order = np.argsort(shard, kind="stable")
            shard, word, c = shard[order], word[order], c[order]
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() + [len(shard)]
            parts = list(zip(cut[:-1], cut[1:], strict=True))
            return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in parts], pa.int32()), pa.array([word[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([_packed(c[a:b]) for a, b in parts], pa.binary())], ["shard", "words", "counts"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= _PAIRS_HELD:
                yield packs()
                held, size = [], 0
        if size:
            yield packs()

    # a word that isn't in the vocabulary has the count 0 and isn't sent
    found = rows.mapInArrow(asked, "shard int, word long").join(vocabulary, "word").select("shard", "word", "c").distinct()
    return found.mapInArrow(packed, "shard int, words binary, counts binary").withColumn("seconds", F.lit(None).cast("binary"))


def _split_pairs(rows: DataFrame, frequent: Frequent, shards: int) -> DataFrame:
    """``shard, words, counts, seconds``: exact c(v w) of the pairs that are split, for each of their shards (words: v, seconds: w)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows_of_pairs() -> pa.RecordBatch:
            v, w = np.array(list(held), np.uint64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(v.copy().view(np.int64)), pa.array(w.copy().view(np.int64)), pa.array(list(held.values()), pa.int64())], ["v", "w", "c"])

        for batch in batches:
            for _, out, tokens, per_row in _runs(batch):
                _, v = _before(tokens, per_row)
                cw, cv = frequent.codes(tokens), frequent.codes(v)
                at = np.flatnonzero(_splits(cv, cw, frequent) > 1)
                if not len(at):
                    continue
                code, c = np.unique(cv[at].astype(np.int64) << 16 | cw[at], return_inverse=True)
                learned = np.bincount(c, ~np.repeat(out, per_row)[at], len(code)).astype(np.int64)
                one = np.zeros(len(code), np.int64)
                one[c] = at
                for key in zip(v[one].tolist(), tokens[one].tolist(), learned.tolist(), strict=True):
                    held[key[:2]] += key[2]
                if len(held) > _PAIRS_HELD // 8:
                    yield rows_of_pairs()
                    held.clear()
        if held:
            yield rows_of_pairs()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w, c = (batch.column(i).to_numpy() for i in range(3))
            v, w = v.view(np.uint64), w.view(np.uint64)
            times = _splits(frequent.codes(v), frequent.codes(w), frequent).astype(np.int64)
            at = np.repeat(np.arange(len(v)), times)
            sub = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
            shard = _pair_shard(v[at], w[at], sub, shards)
            # two parts of a pair can fall into one shard
            order = np.lexsort((at, shard))
            at, shard = at[order], shard[order]
            keep = np.append(True, (at[1:] != at[:-1]) | (shard[1:] != shard[:-1]))[: len(at)]
            at, shard = at[keep], shard[keep]
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(pa.array([x.tobytes() for x in y[at]], pa.binary()) for y in (v, c, w))], ["shard", "words", "counts", "seconds"])

    pairs = rows.mapInArrow(counted, "v long, w long, c long").groupBy("v", "w").agg(F.sum("c").alias("c")).where("c > 0")
    return pairs.mapInArrow(sent, "shard int, words binary, counts binary, seconds binary")


def _deal(rows: DataFrame, frequent: Frequent, shards: int) -> DataFrame:
    """Occurrences (u, v, w, row) packed by shard and run; ids, flags and lengths of a run go along with one of its packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, out, tokens, per_row in _runs(batch):
                number += 1
                row = np.repeat(np.arange(len(per_row), dtype=np.uint16), per_row)
                u, v = _before(tokens, per_row)
                cw, cv, cu = (frequent.codes(x) for x in (tokens, v, u))
                shard = _shard_of(u, v, tokens, cv, cw, frequent, shards)
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                cut = np.flatnonzero(np.diff(shard, prepend=-1, append=shards))
                columns: dict[str, list] = {"shard": [], "run": [], "tokens": [], "row": [], "codes": [], "rare": [], "ids": [], "out": [], "n": []}
                for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    at = order[a:b]
                    codes = np.stack([cw[at], cv[at], cu[at]])
                    hashes = np.stack([tokens[at], v[at], u[at]])
                    columns["shard"].append(int(shard[a]))
                    columns["run"].append(number)
                    columns["tokens"].append(b - a)
                    columns["row"].append(_packed(np.diff(row[at], prepend=np.uint16(0))))
                    columns["codes"].append(_packed(codes))
                    columns["rare"].append(hashes[codes == _ESCAPE].tobytes())
                    columns["out"].append(np.packbits(out).tobytes())
                    columns["ids"].append(ids.cast(pa.int64()).to_pylist() if k == 0 else None)
                    columns["n"].append(per_row.tolist() if k == 0 else None)
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), kinds, strict=True)], list(columns))

    return rows.mapInArrow(run, "shard int, run long, tokens int, row binary, codes binary, rare binary, ids array<long>, out binary, n array<long>")


def _score_shard(table: pa.Table, contexts: pa.Table, frequent: Frequent, total: int, different: int) -> pa.Table:
    runs = table.num_rows
    sizes, us, vs, ws, rows, held = [], [], [], [], [], []
    codes_of = np.zeros(65_536, np.uint64)
    codes_of[frequent.rank] = frequent.word
    codes_of[_START_CODE] = START
    for k in range(runs):
        n = table["tokens"][k].as_py()
        row = np.cumsum(_unpacked(table["row"][k].as_buffer(), np.uint16, n), dtype=np.uint16)
        codes = _unpacked(table["codes"][k].as_buffer(), np.uint16, 3 * n).reshape(3, n)
        hashes = codes_of[codes]
        hashes[codes == _ESCAPE] = np.frombuffer(table["rare"][k].as_buffer(), np.uint64)
        ws.append(hashes[0])
        vs.append(hashes[1])
        us.append(hashes[2])
        rows.append(row)
        out = np.unpackbits(np.frombuffer(table["out"][k].as_buffer(), np.uint8)).astype(bool)
        held.append(out[row])
        sizes.append(len(row))
    u, v, w, out = (np.concatenate(x) for x in (us, vs, ws, held))
    del us, vs, ws, held
    # counts of the words that aren't on the list are complete in this shard
    own, c_own = distinct(w[~out])

    def counts(words: np.ndarray) -> np.ndarray:
        codes = frequent.codes(words)
        listed = codes < _START_CODE
        c = np.zeros(len(words))
        c[listed] = frequent.count[codes[listed]]
        if len(own):
            rare = ~listed
            at, same = successors(own, words[rare])
            c[rare] = np.where(same, c_own[at], 0)
        return c

    ends = int(frequent.count[frequent.rank[frequent.word == END]].sum())
    apart = contexts.filter(pc.is_valid(contexts["seconds"])) if contexts.num_rows else contexts
    split = tuple(np.frombuffer(b"".join(apart[name].to_pylist()), kind) for name, kind in (("words", np.uint64), ("seconds", np.uint64), ("counts", np.int64))) if apart.num_rows else None
    packs = contexts.filter(pc.is_null(contexts["seconds"])) if contexts.num_rows else contexts
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in packs["words"]] if packs.num_rows else []
    before = np.concatenate([np.zeros(0, np.uint64), *parts])
    c_before = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x.as_buffer(), np.int64, len(part)) for x, part in zip(packs["counts"] if parts else [], parts, strict=True))])
    order = np.argsort(before)
    before, c_before = before[order], c_before[order]

    def p1(words: np.ndarray) -> np.ndarray:
        return (counts(words) + 0.1) / (total + 0.1 * (different + 1))

    def context(words: np.ndarray) -> np.ndarray:
        codes = frequent.codes(words)
        listed = codes < _START_CODE
        c = np.zeros(len(words))
        c[listed] = frequent.count[codes[listed]]
        if len(before):
            rare = codes == _ESCAPE
            at, same = successors(before, words[rare])
            c[rare] = np.where(same, c_before[at], 0)
        c[words == START] = ends
        return c

    trie = NgramTrie(u[~out], v[~out], w[~out], p1, context, split)
    logs, weights = trie.logs(u, v, w, p1, context)
    # a token's weight is the denominator of the next one, behind the end there is none
    logs -= np.where(w == END, 0.0, weights)
    c = counts(w)
    base, known = np.log10(c + 0.1), c > 0
    result: dict[str, list] = {"run": table["run"].to_pylist(), "score": [], "base": [], "known": [], "ids": table["ids"].to_pylist(), "out": table["out"].to_pylist(), "n": table["n"].to_pylist()}
    at = 0
    for k in range(runs):
        part = slice(at, at + sizes[k])
        at += sizes[k]
        many = int(rows[k].max()) + 1 if sizes[k] else 0
        result["score"].append(np.bincount(rows[k], logs[part], many).tobytes())
        result["base"].append(np.bincount(rows[k], base[part], many).tobytes())
        result["known"].append(np.bincount(rows[k], known[part], many).astype(np.uint32).tobytes())
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
    return pa.table({k: pa.array(x, t) for (k, x), t in zip(result.items(), kinds, strict=True)})


def score_texts(documents: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``held_out`` marks the rows that aren't learned from. Ids are integers.
    """
    spark = documents.sparkSession
    shared_dir(spark)
    small_batches(spark)
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("out"), F.col(text_col).alias("text"))
    vocabulary = staged(word_counts(rows), "vocabulary")
    total, different = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the end token is always on the list
    top = vocabulary.orderBy((F.col("word") != int(END)).cast("int"), F.desc("c"), "word").limit(FREQUENT).toArrow()
    word, count = top["word"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(word)
    ends = int(count[word == END].sum())
    frequent = Frequent(word[order], order.astype(np.uint16), count.astype(np.float64), ends, TOKENS_PER_SHARD)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(1.2 * total / TOKENS_PER_SHARD))
    listed = spark.sparkContext.broadcast(frequent)
    total, different = int(total), int(different)

    def shard(table: pa.Table, contexts: pa.Table) -> pa.Table:
        return _score_shard(table, contexts, listed.value, total, different)

    def joined(table: pa.Table) -> pa.Table:
        head = next(k for k in range(table.num_rows) if table["ids"][k].is_valid)
        n = np.array(table["n"][head].as_py())
        score, base, known = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64)
        for k in range(table.num_rows):
            for sums, name, kind in ((score, "score", np.float64), (base, "base", np.float64), (known, "known", np.uint32)):
                part = np.frombuffer(table[name][k].as_buffer(), kind)
                sums[: len(part)] += part
        # the first token follows two start tokens
        score -= math.log(ends + M3)
        out = np.unpackbits(np.frombuffer(table["out"][head].as_buffer(), np.uint8))[: len(n)].astype(bool)
        return pa.table({
            "id": table["ids"][head].values, "held_out": out, "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), total),
            "base_score": base - n * math.log10(total + 0.1 * (different + 1)), "score": score / math.log(10),
        })

    contexts = _context_counts(rows, vocabulary, frequent, shards)
    if frequent.ample:
        contexts = contexts.unionByName(_split_pairs(rows, frequent, shards))
    sums = _deal(rows, frequent, shards).groupBy("shard").cogroup(contexts.groupBy("shard")).applyInArrow(shard, "run long, score binary, base binary, known binary, ids array<long>, out binary, n array<long>")
    scored = sums.groupBy("run").applyInArrow(joined, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    kind = documents.schema[id_col].dataType.simpleString()
    return scored.select(F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
