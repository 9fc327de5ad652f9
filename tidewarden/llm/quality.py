"""Quality classifier: histogram gradient-boosted trees over document statistics.

``document_statistics`` turns each whole text into a fixed vector of counts and
ratios (one pass, numpy over the UTF-8 bytes). ``fit_trees`` grows depth-limited
trees on binned statistics with the logistic loss, and keeps them as flat
arrays; ``Forest.score`` walks all trees for a whole batch with array gathers.

The fit looks at no more than ``max_labelled`` labelled rows (a bounded sample
by hash of the id); every document is scored.

Defined results: a null text is an empty text and is scored; a null label, or a
label other than 0 and 1, is not learned from; repeated ids are scored row by
row; if only one class (or no row) is labelled, the score is the smoothed share
of label 1 (0.5 without labels). Other columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.session import shared_dir, small_batches
from tidewarden.llm.textscan import rows_of, text_chunks, words

#: Upper bound of labelled rows that a fit reads.
MAX_LABELLED = 20_000

_SIGNS = "!#%&$*|.,;:?-_/\\<>@=+~^\"'()[]{}"
#: Byte classes: 0 other control, 1 space, 2 line end, 3 a-z, 4 A-Z, 5 0-9, 6 non-ASCII, then one for each of the first ten signs, then all further signs.
_OWN_SIGN = 10
_CLASSES = 7 + _OWN_SIGN + 1


def _byte_classes() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.int64)
    kinds[[0x20, 0x09]] = 1
    kinds[[0x0A, 0x0D]] = 2
    kinds[97:123] = 3
    kinds[65:91] = 4
    kinds[48:58] = 5
    kinds[128:] = 6
    for i, sign in enumerate(_SIGNS):
        kinds[ord(sign)] = 7 + min(i, _OWN_SIGN)
    return kinds


_KIND = _byte_classes()
STATISTICS = [
    "log_bytes", "log_words", *(f"share_{k}" for k in range(_CLASSES)), "word_bytes", "word_bytes_sd", "distinct_words",
    "same_as_last", "same_as_last_but_one", "short_words", "long_words", "words_per_line", "upper_of_letters", "signs_per_word",
]


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = rows_of(size)
    counts = np.bincount(row * _CLASSES + _KIND[data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float64)
    h, _, length, per_row = words(data, offsets)
    w = rows_of(per_row)
    per = np.maximum(per_row, 1)
    mean = np.bincount(w, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(w, length.astype(np.float64) ** 2, n) / per - mean**2, 0))
    distinct = np.zeros(n)
    if len(h):
        order = np.lexsort((h, w))
        hs, ws = h[order], w[order]
        new = np.ones(len(hs), dtype=bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])
        distinct = np.bincount(ws[new], minlength=n)
    again = [np.bincount(w[k:], (h[k:] == h[:-k]) & (w[k:] == w[:-k]), n) if len(h) > k else np.zeros(n) for k in (1, 2)]
    letters = counts[:, 3] + counts[:, 4]
    columns = [
        np.log1p(size), np.log1p(per_row), *(counts / np.maximum(size, 1)[:, None]).T, mean, spread, distinct / per,
        again[0] / per, again[1] / per, np.bincount(w, length <= 2, n) / per, np.bincount(w, length >= 12, n) / per,
        per_row / (counts[:, 2] + 1), counts[:, 4] / np.maximum(letters, 1), counts[:, 7:].sum(1) / per,
    ]
    return np.column_stack(columns).astype(np.float32)


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``stats`` (array of float) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_statistics(data, off) for _, _, data, off in text_chunks(batch.column(1))]
            if parts:
                flat = pa.array(np.concatenate(parts).ravel(), pa.float32())
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["id", "stats"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, stats array<float>").withColumnRenamed("id", id_col)


@dataclass
class Forest:
    """Trees of one depth as flat arrays: node i of a tree has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Boost ``trees`` depth-limited trees on histograms of gradient and curvature."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    feature, threshold, value = (np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, np.float32), (leaves, np.float64)))
    if not len(y) or y.min() == y.max():
        return Forest(feature[:0], threshold[:0], value[:0], bias, depth)
    f = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(f)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    spots = binned + np.arange(f) * bins
    last = np.array([len(c) for c in cuts])
    raw = np.full(len(y), bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        threshold[t] = np.inf
        for level in range(depth):
            base, wide = 2**level - 1, 2**level
            at = ((node - base)[:, None] * (f * bins) + spots).ravel()
            g = np.bincount(at, np.repeat(grad, f), wide * f * bins).reshape(wide, f, bins)
            c = np.bincount(at, np.repeat(curve, f), wide * f * bins).reshape(wide, f, bins)
            gl, cl = g.cumsum(2), c.cumsum(2)
            gt, ct = gl[:, :, -1:], cl[:, :, -1:]
            gain = gl**2 / (cl + ridge) + (gt - gl) ** 2 / (ct - cl + ridge) - gt**2 / (ct + ridge)
            gain[(cl < least / 4) | (ct - cl < least / 4) | (np.arange(bins) >= last[:, None])] = 0
            best = gain.reshape(wide, -1).argmax(1)
            split = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9
            j, b = best // bins, best % bins
            feature[t, base : base + wide] = np.where(split, j, 0)
            threshold[t, base : base + wide] = [cuts[jj][bb] if s else np.inf for jj, bb, s in zip(j, b, split, strict=True)]
            own = node - base
            node = 2 * node + 1 + (split[own] & (binned[np.arange(len(y)), j[own]] > b[own]))
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, curve, leaves) + ridge)
        raw += value[t][leaf]
    return Forest(feature, threshold, value, bias, depth)


def _fitted(stats: DataFrame, labels: DataFrame, learn_from: Column | None, id_col: str, label_col: str, max_labelled: int) -> Forest:
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("_y"))
    if learn_from is not None:
        known = known.where(learn_from)
    sample = stats.join(known, id_col).orderBy(F.xxhash64(F.col(id_col)), "_y").limit(max_labelled).select("stats", "_y").toArrow()
    y = sample["_y"].to_numpy().astype(np.float64)
    x = np.array(sample["stats"].combine_chunks().flatten(), dtype=np.float32).reshape(len(y), len(STATISTICS))
    return fit_trees(x, y)


def quality_scores(documents: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``id_col`` and ``score`` (0 to 1, higher: label 1 likelier) for every document.

    ``learn_from`` is a predicate on ``id_col`` that marks the rows whose label
    may be learned from. The statistics are written once in the shared folder
    and serve both the fit and the scores.
    """
    shared_dir(documents.sparkSession)
    small_batches(documents.sparkSession)
    stats = document_statistics(documents, id_col, text_col).checkpoint()
    forest = _fitted(stats, labels, learn_from, id_col, label_col, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(values))], ["id", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    return stats.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows whose score is ``threshold`` or more, whole and without a shuffle of texts; only texts go to Python."""
    small_batches(documents.sparkSession)
    forest = _fitted(document_statistics(documents, id_col, text_col), labels, learn_from, id_col, label_col, max_labelled)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        parts = [forest.score(_statistics(data, off)) >= threshold for _, _, data, off in text_chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return documents.where(good(F.col(text_col)))
