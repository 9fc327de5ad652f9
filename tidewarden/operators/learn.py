"""Character n-gram classifier: TF-IDF and logistic regression over packed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, StructField, StructType

from tidewarden.functions.session import small_batches, staged


def _spaced(text: Column) -> Column:
    """Lower case, with ideographs as words of their own; all ideographs lie behind U+2E7F, and scripts are looked up one character at a time."""
    lower = F.lower(text)
    return F.when(text.rlike(r"[\x{2E80}-\x{10FFFF}]"), F.regexp_replace(lower, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])", " $1 ")).otherwise(lower)


def padded_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words with a blank on both sides; ideographs count as words of their own."""
    words = F.filter(F.split(_spaced(text), r"\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.concat(*[_windows(p, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, grams))


def _windows(p: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(p) - (n - 1), F.lit(1)))
    return F.filter(F.transform(places, lambda i: F.substring(p, i, F.lit(n))), lambda g: F.length(g) == n)


#: Bytes of text that are hashed at a time; arrays of some 100 bytes for each byte are held.
_SLICE = 1 << 16
_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _murmur(words: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Murmur3 (seed 42) of ``length`` bytes from each start; ``words`` has four bytes from each place on."""
    h = np.full(len(start), 42, np.uint32)
    for at in range(0, length - 3, 4):
        h = _rotated(h ^ (_rotated(words[start + at] * _C1, 15) * _C2), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    if rest := length % 4:
        tail = words[start + (length - rest)] & np.uint32((1 << 8 * rest) - 1)
        h = h ^ (_rotated(tail * _C1, 15) * _C2)
    h = h ^ np.uint32(length)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _buckets(text: np.ndarray, starts: np.ndarray, low: int, high: int, features: int) -> np.ndarray:
    """The buckets of all n-grams of the texts that begin at ``starts`` in these bytes, in no order: each is its text's number times ``features`` and the bucket."""
    kind = np.uint32 if len(starts) * features <= 1 << 32 else np.int64
    word = ~_WHITE[text]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[starts < len(text)]
    first[inner] = word[inner]
    number = np.cumsum(first)[word]
    if not len(number):
        return np.zeros(0, kind)
    place = np.arange(len(number)) + 2 * number - 1  # a blank before and behind each word
    padded = np.full(place[-1] + 2, 32, np.uint8)
    padded[place] = text[word]
    wide = np.concatenate([padded, np.zeros(4, np.uint8)]).astype(np.uint32)
    words = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    begins = np.flatnonzero((padded & 0xC0) != 0x80)  # characters
    ends = np.append(begins[1:], len(padded))
    until = place[np.append(np.flatnonzero(np.diff(number)), len(number) - 1)] + 2
    bound = until[np.searchsorted(until, begins, side="right")]  # where each character's word ends
    before = np.concatenate([[0], np.cumsum(word)])[starts]  # a text's first word begins behind the words of those before it
    own = np.append(place, len(padded) + 1)[before] - 1
    out = []
    for n in range(low, high + 1):
        if len(begins) < n:
            break
        start, end = begins[: len(begins) - n + 1], ends[n - 1 :]
        inside = end <= bound[: len(start)]
        start, size = start[inside], (end - begins[: len(end)])[inside]
        for length in np.flatnonzero(np.bincount(size)):
            at = start if (size == length).all() else start[size == length]
            found = np.mod(_murmur(words, at, int(length)).view(np.int32), np.int32(features)).astype(kind)
            by_text = np.diff(np.append(np.searchsorted(at, own), len(at)))
            out.append(found + np.repeat(np.arange(len(starts), dtype=kind) * kind(features), by_text))
    return np.concatenate(out) if out else np.zeros(0, kind)


def _cut(text: np.ndarray) -> Iterator[np.ndarray]:
    """A text in slices that end at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > _SLICE:
        blanks = np.flatnonzero(_WHITE[text[at + _SLICE :]])
        end = at + _SLICE + (int(blanks[0]) if len(blanks) else len(text))
        yield text[at:end]
        at = min(end, len(text))
    yield text[at:]


def _vectors(found: list[tuple[np.ndarray, np.ndarray]], features: int) -> list[pa.Array]:
    """Sparse vectors of Spark ML."""
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in found])]), pa.int32())
    indices = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([i for i, _ in found]).astype(np.int32)))
    values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([c for _, c in found]).astype(np.float64)))
    n = len(found)
    return [pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, features, np.int32)), indices, values], ["type", "size", "indices", "values"])]


def _packed(found: list[tuple[np.ndarray, np.ndarray]], features: int) -> list[pa.Array]:
    """Bytes: the buckets in order of their counts, the different counts, and the buckets of each."""
    rows = []
    for buckets, counts in found:
        order = np.argsort(counts, kind="stable")
        times, runs = np.unique(counts, return_counts=True)
        rows.append((buckets[order].astype(_place_type(features)).tobytes(), times.astype("<u4").tobytes(), runs.astype("<u4").tobytes()))
    return [pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]


def _place_type(features: int) -> str:
    return "<u2" if features <= 1 << 16 else "<i4"


def _hashed(low: int, high: int, features: int, form: Callable[[list[tuple[np.ndarray, np.ndarray]], int], list[pa.Array]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the last column, a text, becomes the columns that ``form`` makes of its buckets and counts."""

    def counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Buckets and counts of texts that fit a slice, or of one text."""
        held = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = held.buffers()
        at = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1]
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        if len(texts) == 1:
            total = np.zeros(features, np.int64)
            for x in _cut(data):
                total += np.bincount(_buckets(x, np.zeros(1, np.int64), low, high, features), minlength=features)
            buckets = np.flatnonzero(total)
            return [(buckets, total[buckets])]
        keys, total = np.unique(_buckets(data, at[:-1] - at[0], low, high, features), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * features)
        return [(keys[a:b] - k * features, total[a:b]) for k, (a, b) in enumerate(pairwise(cuts.tolist()))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // _SLICE)) + 1
            for start, end in pairwise([0, *cuts.tolist(), len(texts)]):
                part = batch.slice(start, end - start)
                last = end - start - 1 if sizes[end - 1] > _SLICE else end - start  # a long text is the last of its slice
                made = form((counts(texts.slice(start, last)) if last else []) + (counts(texts.slice(end - 1, 1)) if last < end - start else []), features)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], *(f"_{k}" for k in range(len(made)))])

    return rows


def _counted(df: DataFrame, text_col: str, features: int, low: int, high: int, form: Callable, made: StructType) -> DataFrame:
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != text_col]
    schema = StructType([*(df.schema[c] for c in kept), StructField("known", BooleanType()), *made])
    return df.select(*kept, F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False)).alias("known"), _spaced(F.col(text_col)).alias("_text")).mapInArrow(_hashed(low, high, features, form), schema)


def with_counts(df: DataFrame, text_col: str = "text", features: int = 1 << 16, low: int = 3, high: int = 5) -> DataFrame:
    """The columns but the text, ``known`` (it has n-grams) and ``tf``: counts of its n-grams (``padded_ngrams``) by bucket, the same vector as HashingTF gives.

    Hashed in numpy in slices of a text, so no n-gram is ever an object of its own.
    """
    return _counted(df, text_col, features, low, high, _vectors, StructType([StructField("tf", VectorUDT())]))


#: Columns of ``packed_counts``.
_PACKED = ["known", "places", "times", "runs"]
#: Entries that are unpacked at a time; arrays of some 60 bytes for each are held.
_ENTRIES = 1 << 16
#: Rows of a table of packed counts that a task decodes at a time.
_ROWS = 512
#: Numbers of a sum that travel together.
_PIECE = 1 << 12


def packed_counts(df: DataFrame, text_col: str = "text", features: int = 1 << 16, low: int = 3, high: int = 5) -> DataFrame:
    """As ``with_counts``, but the buckets are bytes in ``places``, in order of their counts: ``times`` has the different counts, ``runs`` the number of buckets of each."""
    return _counted(df, text_col, features, low, high, _packed, StructType([StructField(c, BinaryType()) for c in _PACKED[1:]]))


def _unpacked(batch: pa.RecordBatch, features: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows with their entries' places and counts, and the entries by row."""

    def numbers(part: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
        column = part.column(name).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[[column.offset, column.offset + len(column)]]
        return np.frombuffer(data, kind, (at[1] - at[0]) // np.dtype(kind).itemsize, at[0]) if at[1] > at[0] else np.zeros(0, kind)

    entries = pc.binary_length(batch.column("places")).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(_place_type(features)).itemsize
    cuts = np.flatnonzero(np.diff(np.cumsum(entries) // _ENTRIES)) + 1
    for start, end in pairwise([0, *cuts.tolist(), len(entries)]):
        part = batch.slice(start, end - start)
        times = np.repeat(numbers(part, "times", "<u4").astype(np.float64), numbers(part, "runs", "<u4"))
        yield part, numbers(part, "places", _place_type(features)).astype(np.intp), times, entries[start:end]


def _by_row(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Sums of the entries of each row."""
    out = np.zeros(len(entries))
    if len(values):
        some = entries > 0
        out[some] = np.add.reduceat(values, (np.cumsum(entries) - entries)[some])
    return out


def _lengths(places: np.ndarray, times: np.ndarray, entries: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the weighted rows, 1 for rows without entries."""
    length = np.sqrt(_by_row((times * idf[places]) ** 2, entries))
    return np.where(length > 0, length, 1.0)


def _summed(rows: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The array of ``size`` numbers to which ``add`` has added something for each batch: by task first, then by pieces."""

    def pieces(k: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([x.tobytes() for x in held], pa.binary())], ["k", "piece"])

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            add(total, batch)
        held = [total[at : at + _PIECE] for at in range(0, size, _PIECE)]
        yield pieces(list(range(len(held))), held)

    def by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(x)
        yield pieces(list(held), list(held.values()))

    spark, name = rows.sparkSession, "spark.sql.parquet.columnarReaderBatchSize"
    tasks = max(16, 2 * spark.sparkContext.defaultParallelism)
    parts = rows.coalesce(tasks).mapInArrow(by_task, "k int, piece binary").repartition(8, "k").mapInArrow(by_piece, "k int, piece binary")
    out, own = np.zeros(size), spark.conf.get(name)
    spark.conf.set(name, str(min(int(own), _ROWS)))  # whole rows are held, and some are long
    try:
        for r in parts.collect():
            out[r["k"] * _PIECE : (r["k"] + 1) * _PIECE] = np.frombuffer(r["piece"])
    finally:
        spark.conf.set(name, own)
    return out


@dataclass
class Model:
    """Weights of buckets: ``idf`` before rows get length 1, ``coefficients`` after."""

    idf: np.ndarray
    coefficients: np.ndarray
    intercept: float


def _minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int, tolerance: float = 1e-6, memory: int = 10) -> np.ndarray:
    """L-BFGS with a line search for the strong Wolfe conditions, the steps and tests of convergence of Spark ML's."""
    value, slope = f(x)
    first, values, steps, again = abs(value), [value], [], True
    for _ in range(most):
        if np.linalg.norm(slope) <= max(tolerance * abs(value), 1e-8):
            break
        way, shares = -slope, []
        for dx, dg in steps:
            shares.append(dx @ way / (dx @ dg))
            way = way - shares[-1] * dg
        if steps:
            way = way * ((steps[0][0] @ steps[0][1]) / (steps[0][1] @ steps[0][1]))
        for (dx, dg), share in zip(reversed(steps), reversed(shares), strict=True):
            way = way + dx * (share - dg @ way / (dx @ dg))
        found = _step(f, x, value, slope, way, 1.0 if len(values) > 1 else 1 / np.linalg.norm(way))
        if found is None:
            if not again:
                break
            again, steps = False, []  # once more, straight down
            continue
        at, new_value, new_slope = found
        new = x + at * way
        dx, dg = new - x, new_slope - slope
        steps = ([(dx, dg)] if dx @ dg > 0 else []) + steps
        steps = steps[:memory]
        x, value, slope = new, new_value, new_slope
        if max(values[-20:]) - value <= tolerance * first:
            break
        values.append(value)
    return x


def _step(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, value: float, slope: np.ndarray, way: np.ndarray, at: float) -> tuple[float, float, np.ndarray] | None:
    """A step that meets the strong Wolfe conditions, with value and slope there."""
    down = slope @ way
    if not down < 0:
        return None

    def look(t: float) -> tuple[float, float, float, np.ndarray]:
        there, grad = f(x + t * way)
        return t, there, grad @ way, grad

    def between(a: tuple, b: tuple) -> float:
        (t0, f0, d0, _), (t1, f1, d1, _) = sorted((a, b), key=lambda p: p[0])
        m = d0 + d1 - 3 * (f0 - f1) / (t0 - t1)
        root = np.sqrt(max(m * m - d0 * d1, 0.0))
        low, high = t0 + 0.1 * (t1 - t0), t0 + 0.9 * (t1 - t0)
        t = t1 - (t1 - t0) * (d1 + root - m) / (d1 - d0 + 2 * root)
        return min(max(t, low), high) if np.isfinite(t) else (low + high) / 2

    low, high = (0.0, value, down, slope), None
    for k in range(10):
        now = look(at)
        if not np.isfinite(now[1]):
            at /= 2
            continue
        if now[1] > value + 1e-4 * at * down or (k and now[1] >= low[1]):
            high = now
            break
        if abs(now[2]) <= 0.9 * abs(down):
            return now[0], now[1], now[3]
        if now[2] >= 0:
            low, high = now, low
            break
        low, at = now, at * 1.5
    for _ in range(10 if high else 0):
        now = look(between(low, high))
        if now[1] > value + 1e-4 * now[0] * down or now[1] >= low[1]:
            high = now
            continue
        if abs(now[2]) <= 0.9 * abs(down):
            return now[0], now[1], now[3]
        if now[2] * (high[0] - low[0]) >= 0:
            high = low
        low = now
    return None


def fit(train: DataFrame, label_col: str, text_col: str = "text", features: int = 1 << 16, regularization: float = 1e-4) -> Model:
    """Class-balanced logistic regression on TF-IDF of length 1, the model that Spark ML's IDF, Normalizer and LogisticRegression give.

    ``train`` has the text, or the columns of ``packed_counts`` in a table that each
    step reads again. A task holds a few hundred thousand unpacked entries and one
    sum for each bucket, whatever the size of the table; nothing is cached. Rows
    whose label is null are left out.
    """
    if "places" not in train.columns:
        train = staged(packed_counts(train.select(label_col, text_col), text_col, features), "counts")
    small_batches(train.sparkSession)
    rows = train.where(F.col(label_col).isNotNull()).select((F.col(label_col) == 1).cast("double").alias("label"), *_PACKED[1:])

    def document_counts(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for part, places, _, _ in _unpacked(batch, features):
            y = part.column("label").to_numpy()
            total[:features] += np.bincount(places, minlength=features)
            total[features:] += [len(y), y.sum()]

    sums = _summed(rows, features + 2, document_counts)
    n, ones = sums[features:]
    idf = np.where(sums[:features] >= 2, np.log((n + 1) / (sums[:features] + 1)), 0.0)
    if not 0 < ones < n:
        return Model(idf, np.zeros(features), 0.0 if not n else np.inf if ones else -np.inf)
    share = min(max(ones / n, 1e-3), 1 - 1e-3)
    weights = np.array([0.5 / (1 - share), 0.5 / share])
    mass = weights @ [n - ones, ones]

    def moments(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for part, places, times, entries in _unpacked(batch, features):
            w = weights[part.column("label").to_numpy().astype(np.intp)]
            x = times * idf[places] / np.repeat(_lengths(places, times, entries, idf), entries)
            wx = np.repeat(w, entries) * x
            total[:features] += np.bincount(places, wx, features)
            total[features:] += np.bincount(places, wx * x, features)

    mean, square = _summed(rows, 2 * features, moments).reshape(2, -1) / mass
    spread = np.where(square - mean**2 > 1e-12 * square, square - mean**2, 0.0) * mass / (mass - weights**2 @ [n - ones, ones] / mass)
    scale = np.divide(1.0, np.sqrt(spread), out=np.zeros(features), where=spread > 0)

    def loss(point: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its slope at coefficients of centred features of variance 1, and their intercept."""
        v, c = point[:-1] * scale * idf, point[-1] - point[:-1] @ (mean * scale)

        def terms(total: np.ndarray, batch: pa.RecordBatch) -> None:
            for part, places, times, entries in _unpacked(batch, features):
                y = part.column("label").to_numpy()
                w, length = weights[y.astype(np.intp)], _lengths(places, times, entries, idf)
                margin = _by_row(times * v[places], entries) / length + c
                miss = w * (np.exp(-np.logaddexp(0, -margin)) - y)
                total[:features] += np.bincount(places, times * np.repeat(miss / length, entries), features)
                total[features:] += [miss.sum(), w @ (np.logaddexp(0, margin) - y * margin)]

        sums = _summed(rows, features + 2, terms) / mass
        slope = np.append(sums[:features] * idf * scale - sums[features] * mean * scale, sums[features])
        slope[:-1] += regularization * point[:-1]
        return sums[features + 1] + regularization / 2 * (point[:-1] @ point[:-1]), slope

    start = np.append(np.zeros(features), np.log(weights[1] * ones / (weights[0] * (n - ones))))
    found = _minimum(loss, start, 40)
    return Model(idf, found[:-1] * scale, float(found[-1] - found[:-1] @ (mean * scale)))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``confidence`` of label 1 and ``predicted``; texts without n-grams are ``-1`` (unknown).

    ``df`` has the text, or the columns of ``packed_counts``, then without the text.
    """
    kept = [c for c in df.columns if c not in _PACKED]
    features = len(model.idf)
    rows = df if "places" in df.columns else packed_counts(df.withColumn("_counted", F.col(text_col)), "_counted", features)
    small_batches(df.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.coefficients * model.idf
        for batch in batches:
            for part, places, times, entries in _unpacked(batch, features):
                margin = _by_row(times * v[places], entries) / _lengths(places, times, entries, model.idf) + model.intercept
                p, known = np.exp(-np.logaddexp(0, -margin)), part.column("known").to_numpy(zero_copy_only=False)
                predicted = np.where(known, (p >= 0.5).astype(np.int32), np.int32(-1))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(p, mask=~known), pa.array(predicted)], [*kept, "confidence", "predicted"])

    schema = StructType([*(df.schema[c] for c in kept), StructField("confidence", DoubleType()), StructField("predicted", IntegerType())])
    return rows.select(*kept, *_PACKED).mapInArrow(scored, schema)


def report(df: DataFrame, label_col: str, predicted_col: str = "predicted") -> DataFrame:
    """Precision, recall and F1 of both classes from one pass of counts."""
    c = df.groupBy().agg(*[F.count_if((F.col(label_col) == a) & (F.col(predicted_col) == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    out = None
    for k in (0, 1):
        hit, wrong, missed = F.col(f"n{k}{k}"), F.col(f"n{1 - k}{k}"), F.col(f"n{k}{1 - k}")
        p, r = F.try_divide(hit, hit + wrong), F.try_divide(hit, hit + missed)
        row = c.select(F.lit(k).alias("label"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), (hit + missed).alias("support"))
        out = row if out is None else out.unionByName(row)
    return out
