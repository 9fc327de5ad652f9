"""Product codes of vectors: k-means by parts in integers, with norm-of-sum bounds.

Vectors become integers, are cut into equal consecutive parts, and each part
position gets a codebook by Lloyd rounds. A row keeps, for each part, its entry and
a lower bound of the distance to any other entry with the round it was measured in
(its stamp). All codebooks so far go to the tasks (rounds x parts x entries x part
length integers, a bound that doesn't grow with the table). In a later round an
entry can have come nearer by no more than the length of its net displacement since
the stamp, the norm of the sum of its moves, which is at most the sum of the norms
of its moves that drifting bounds add up. While the distance to the row's own
entry, computed anew, is smaller than the bound less the largest such displacement
among the other entries, the row stays without a look at them; else it is compared
with all entries exactly and gets a new bound and stamp.

Each round writes the rows with their bounds in the shared folder and adds up each
task's parts by entry before the exchange, so an entry that takes a third of all
rows is still one row a task. Sums and distances are exact integers.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite
components are dropped, and so are rows whose vector hasn't the most frequent
length (the smaller one in a tie). Integers beyond 2**26 in size count as 2**26,
so that no sum overflows. A length that isn't a multiple of the number of parts is
filled up with zeros. The first codebook is that of the smallest ids (nulls last,
equal ids by vector); fewer rows than entries give fewer entries. Ties go to the
lower entry. Repeated rows are rows of their own; a table without usable rows gives
no rows. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.session import small_batches, staged

#: Largest size of an integer component.
TOP = 1 << 26
#: Rows that are compared with all entries at a time.
_CHUNK = 4096


def integer_vector(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component; null for a vector that is null, empty or not finite throughout."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-float(TOP)), F.least(F.lit(float(TOP)), F.floor(x.cast("double") * F.lit(scale)).cast("double"))).cast("int"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, whole)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries, as whole numbers in float64 where these are exact, else int64."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


class PartAssigner:
    """Entries of one part position, from all codebooks so far."""

    def __init__(self, history: np.ndarray) -> None:
        self.now = history[-1]
        self.round = len(history) - 1
        # net displacement of each entry since each round: the largest, whose it is, and the largest of the others
        moved = np.sqrt(((self.now[None] - history) ** 2).sum(2).astype(np.float64))
        self.widest = moved.argmax(1)
        self.most = moved.max(1)
        others = moved.copy()
        others[np.arange(len(moved)), self.widest] = 0
        self.second = others.max(1)

    def assign(self, x: np.ndarray, code: np.ndarray, stamp: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, int]:
        """Sets each row's entry, stamp and bound (stamp -1: none yet); returns squared distances and the number of rows that were compared with all entries."""
        own = ((x - self.now[code]) ** 2).sum(1)
        came = np.where(self.widest[stamp] == code, self.second[stamp], self.most[stamp])
        # a margin over rounding: what is near a tie is compared
        stays = (stamp >= 0) & (np.sqrt(own.astype(np.float64)) * (1 + 1e-12) + 1e-9 < bound - came)
        open_rows = np.flatnonzero(~stays)
        for at in range(0, len(open_rows), _CHUNK):
            rows = open_rows[at : at + _CHUNK]
            d = squared(x[rows], self.now)
            code[rows] = d.argmin(1)
            own[rows] = d.min(1)
            if d.shape[1] > 1:
                # the lowest but one
                bound[rows] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
            else:
                bound[rows] = np.inf
            stamp[rows] = self.round
        return own, len(open_rows)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width).astype(kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(values.ravel(), kind))


def _assigned(rows: DataFrame, history: np.ndarray, first: bool) -> DataFrame:
    """Rows with entries, stamps, bounds and squared distances by part for the last codebook of ``history`` (round, part, entry, component)."""
    held = rows.sparkSession.sparkContext.broadcast(history)
    parts, size = history.shape[1], history.shape[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigners = [PartAssigner(held.value[:, p]) for p in range(parts)]
        for batch in batches:
            n = batch.num_rows
            x = _matrix(batch.column("v"), parts * size, np.int64).reshape(n, parts, size)
            if first:
                code, stamp, bound = np.zeros((n, parts), np.int64), np.full((n, parts), -1, np.int64), np.zeros((n, parts))
            else:
                code, stamp, bound = (_matrix(batch.column(c), parts, k) for c, k in (("code", np.int64), ("stamp", np.int64), ("bound", np.float64)))
            error, looked = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
            for p, a in enumerate(assigners):
                c, s, b = code[:, p].copy(), stamp[:, p].copy(), bound[:, p].copy()
                error[:, p], _ = a.assign(x[:, p], c, s, b)
                code[:, p], stamp[:, p], bound[:, p] = c, s, b
                looked += s == a.round
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("v"), _lists(code, pa.int16()), _lists(stamp, pa.int16()), _lists(bound, pa.float64()), pa.array(error.sum(1)), pa.array(looked)],
                ["vec_id", "label", "v", "code", "stamp", "bound", "error", "looked"],
            )

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, v array<int>, code array<smallint>, stamp array<smallint>, bound array<double>, error long, looked long")


def _moved(rows: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook of the rows' means (rounded down); entries without rows stay."""
    parts, entries, size = book.shape
    names = [f"s{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            key = (_matrix(batch.column("code"), parts, np.int64) + np.arange(parts) * entries).ravel()
            np.add.at(sums, key, _matrix(batch.column("v"), parts * size, np.int64).reshape(-1, size))
            counts += np.bincount(key, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), *(pa.array(sums[used, i]) for i in range(size))], ["entry", "n", *names])

    found = rows.select("v", "code").mapInArrow(run, f"entry int, n long, {', '.join(f'{s} long' for s in names)}")
    out = book.reshape(-1, size).copy()
    for r in found.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).collect():  # parts x entries rows at most
        out[r["entry"]] = [r[s] // r["n"] for s in names]
    return out.reshape(book.shape)


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """Add ``label_error``, the sum of ``error`` over equal labels, nulls together.

    Labels that hold more than a thousandth of all rows, at most a thousand, are
    broadcast; the groups of the others are small, so an ordinary join takes them.
    """
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    rows = rows.withColumn("key", label)
    sums = staged(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sums.where(F.col("n") > total / 1000).select("key", F.col("label_error").alias("hot_error")))
    marked = rows.join(hot, "key", "left")
    common = marked.where(F.col("hot_error").isNotNull()).withColumnRenamed("hot_error", "label_error")
    rest = marked.where(F.col("hot_error").isNull()).drop("hot_error").join(sums.where(F.col("n") <= total / 1000).drop("n"), "key")
    return common.unionByName(rest).drop("key")


def assign_codes(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame | None, np.ndarray]:
    """Rows with ``code, error`` and what was kept of the bounds, and all codebooks (round, part, entry, component); None and an empty array where no row is usable.

    ``looked`` is the number of a row's parts that the last round compared with all entries.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), integer_vector(F.col(vector_col), scale).alias("v")).where("v is not null")
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return None, np.zeros((0, parts, 0, 0), np.int64)
    length = lengths["length"]
    size = -(-length // parts)
    rows = rows.where(F.size("v") == length)
    if length % parts:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), size * parts - length)))
    seeds = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    book = np.array([r["v"] for r in seeds], np.int64).reshape(-1, parts, size).transpose(1, 0, 2)
    history = book[None]
    for k in range(rounds):
        rows = staged(_assigned(rows, history, k == 0), "codes-rows")
        history = np.concatenate([history, _moved(rows, history[-1])[None]])
    return staged(_assigned(rows, history, rounds == 0), "codes-rows"), history


def vector_codes(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of each usable row.

    ``code``: two hex digits (four for more than 256 entries) for each part.
    """
    rows, history = assign_codes(df, parts, entries, rounds, scale, id_col, vector_col, label_col)
    if rows is None:
        kind = df.schema[id_col].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    digits = 2 if entries <= 256 else 4
    code = F.lower(F.concat_ws("", F.transform("code", lambda c: F.lpad(F.hex(c.cast("long")), digits, "0"))))
    text = ",".join(map(str, history[-1].ravel().tolist()))
    out = _with_label_errors(rows.select("vec_id", "label", code.alias("code"), "error"))
    return out.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
