"""Near-duplicate groups by a parity-sketch join on word 5-gram sets.

Every document's distinct 5-word shingles are dealt to K blocks by their hash
and XORed into one 63-bit word for each block: a parity sketch. Shingles that
two sets share cancel out, so the number of differing words is never more than
the symmetric difference. Sets with Jaccard similarity 3/4 or more differ in at
most a third of the smaller set's size, d; of the K words of such a pair at
least K - d agree, so by the pigeonhole principle their d + 1 first words in any
one order of all words share one. Those words are the join keys. K follows the
size band (fourfold bands from 64; a set in the top quarter of a band also
takes part in the next), so only sets that can be similar meet.

The order puts words of blocks with frequent shingles, and empty blocks, last,
which keeps passages that many documents share out of the keys. The list of
frequent shingles has a fixed bound and only decides the order: results don't
depend on it.

Verification is exact on sets of 64-bit shingle hashes. Only links that can join
two components are verified: first one link for each set, to the member of its
key groups that shares most keys; then, in key groups that still hold members of
different components, each set outside the group's largest component with its
nearest member, and at last, where a set has further ones, with every member
that passes a bit-wise parity sketch test (blocks of numpy, sizes sorted; never pairs as rows before the test).

Nothing holds a whole group: keys that may have very many holders are counted by
aggregation before a shuffle, groups are cut into parts for the comparison, and
tasks get rows by number and bytes, whatever the size of a group.

Defined results: a null or text without words has no shingles and is linked with
nothing; texts with equal sets are one node (copies are never expanded; a node's
number is a 64-bit hash of its set); in ``near_duplicates`` rows with one id are
one node, and a row without id has no component (null). Ids are integers. Empty
tables give empty tables; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.session import shared_dir, small_batches, staged
from tidewarden.llm.textscan import mix, text_chunks, words

#: Words in a shingle.
WIDTH = 5
#: Similar: DEN * intersection >= NUM * union. The bounds below follow from 3/4.
NUM, DEN = 3, 4
#: Most shingles that the order of the keys treats as frequent (8 bytes each go to every task).
FREQUENT = 1 << 16
#: A shingle counts towards frequent ones where it is in so many documents of about COUNTED shingles.
LOCALLY, COUNTED = 3, 1 << 20
#: Keys of nothing but frequent shingles with so many holders are grouped by aggregation and join, not in one task.
HEAVY = 1 << 18
#: Keys that one grouping task gets on average.
KEYS_PER_BUCKET = 1 << 18
#: Members of a key group in one part of a comparison.
BLOCK = 1024
#: Rows (members of groups with their short sketches) that one comparing task gets on average.
ROWS_PER_BUCKET = 1 << 14
#: Bytes of a short sketch at most: longer ones are folded for the comparison of groups, whole ones decide afterwards.
SHORT = 512
#: Bits of the filter of candidate ids that keeps other texts out of the verification; false hits cost time only.
FILTER_BITS = 1 << 22

#: Constants of the orders in which a pair's first common group is looked for.
_ORDERS = [int(x) for x in np.random.default_rng(9).integers(-(2**63), 2**63, 4, dtype=np.int64)]
_C = np.random.default_rng(5).integers(1, 2**62, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and their number by row."""
    h, _, _, per_row = words(data, offsets)
    n = len(h)
    ends = np.cumsum(per_row)
    starts = ends - per_row
    grams = np.zeros(max(n - WIDTH + 1, 0), np.uint64)
    for k in range(WIDTH):
        grams += h[k : k + len(grams)] * _C[k]
    out, counts = [], np.zeros(len(per_row), np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b - a >= WIDTH:
            s = np.sort(grams[a : b - WIDTH + 1])
            if len(s) > 1:
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                s = s[new]
        elif b > a:
            s = (h[a:b] * _C[: b - a]).sum(dtype=np.uint64, keepdims=True) + _C[WIDTH] * np.uint64(b - a)
        else:
            continue
        out.append(s)
        counts[i] = len(s)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    # mixing is one-to-one, but sorted order is wanted of the mixed values
    flat = mix(flat)
    at = 0
    for c in counts.tolist():
        flat[at : at + c].sort()
        at += c
    return flat, counts


def band(n: int) -> int:
    """Size band: 0 below 64, then fourfold."""
    return 0 if n < 64 else (n.bit_length() - 1) // 2 - 2


def blocks_of(b: int) -> int:
    return 64 << (2 * b)


def join_keys(s: np.ndarray, frequent: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one set: for each band that it takes part in, its d + 1 first words, and whether all shingles of the word are ``heavy``."""
    n = len(s)
    own = band(n)
    bands = [own, own + 1] if DEN * n >= NUM * blocks_of(own) else [own]
    hot, weighty = among(s, frequent), among(s, heavy)
    out, out_heavy = [], []
    for b in bands:
        k = blocks_of(b)
        block = s >> np.uint64(64 - k.bit_length() + 1)
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(block[1:], block[:-1], out=first[1:])
        runs = np.flatnonzero(first)
        word = np.bitwise_xor.reduceat(s, runs)
        key = mix(word + block[runs] * _C[0] + (np.full(1, b, np.uint64) * _C[1])) >> np.uint64(1)
        if hot.any():
            key |= np.logical_or.reduceat(hot, runs).astype(np.uint64) << np.uint64(63)
        full = np.logical_and.reduceat(weighty, runs) if weighty.any() else np.zeros(len(key), bool)
        need = n // 3 + 1
        if need < len(key):
            at = np.argpartition(key, need - 1)[:need]
            key, full = key[at], full[at]
        elif need > len(key):
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), block[runs])[: need - len(key)]
            key = np.concatenate([key, mix(empty * _C[2] + np.full(1, b, np.uint64) * _C[3]) | np.uint64(1 << 63)])
            full = np.concatenate([full, np.ones(len(empty), bool)])
        out.append(key)
        out_heavy.append(full)
    return np.concatenate(out), np.concatenate(out_heavy)


def among(s: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are in a sorted list."""
    if not len(listed):
        return np.zeros(len(s), bool)
    at = np.searchsorted(listed, s)
    at[at == len(listed)] = 0
    return listed[at] == s


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, shingles and counts of runs of rows."""
    for i, j, data, off in text_chunks(batch.column(1)):
        flat, counts = shingle_sets(data, off)
        yield batch.column(0).slice(i, j - i), flat, counts


def set_features(docs: DataFrame) -> DataFrame:
    """One pass over the texts (``id, text, h``), two kinds of rows.

    ``id, h, n, k1, k2, bits, short``: size, identity and bit sketch of each row's
    set, and the folded sketch where it has more than SHORT bytes;
    ``shingle, c``: shingles that several documents of one run of rows have.
    """
    names = ["id", "h", "n", "k1", "k2", "bits", "short", "shingle", "c"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def out(**columns: object) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[x], k) if x in columns else pa.nulls(size, k) for x, k in zip(names, kinds, strict=True)], names)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, c = h[first], np.diff(np.append(first, len(h)))
        keep = c >= LOCALLY
        return out(shingle=h[keep].view(np.int64), c=c[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            at_row = 0
            for ids, flat, counts in _rows(batch):
                k1, k2, bits, short, at = [], [], [], [], 0
                for c in counts.tolist():
                    s = flat[at : at + c]
                    at += c
                    one, two = identity(s)
                    k1.append(one)
                    k2.append(two)
                    whole = parity_bits(s, bits_of(c)) if c else np.zeros(0, np.uint8)
                    bits.append(whole.tobytes())
                    short.append(folded(whole, SHORT).tobytes() if len(whole) > SHORT else None)
                yield out(id=ids.cast(pa.int64()), h=batch.column(2).slice(at_row, len(ids)), n=counts, k1=k1, k2=k2, bits=bits, short=short)
                at_row += len(ids)
                held.append(flat)
                size += len(flat)
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    return docs.mapInArrow(run, "id long, h long, n long, k1 long, k2 long, bits binary, short binary, shingle long, c long")


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ _C[4]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch XORed onto its halves until it has ``size`` bytes: distances only shrink."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def frequent_shingles(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of most documents, up to FREQUENT, and those of them in HEAVY documents or more; both sorted."""
    counts = features.where("shingle is not null").groupBy("shingle").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "shingle").limit(FREQUENT).toArrow()
    words_, c = top["shingle"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy()
    return np.sort(words_), np.sort(words_[c >= HEAVY])


def key_groups(docs: DataFrame, frequent: np.ndarray, heavy: np.ndarray, buckets: int) -> DataFrame:
    """``g, k1, k2, keys``: the sets that hold each key which two different sets hold.

    ``g`` is a digest of the group's sets, so keys of the same sets are one
    group; ``keys`` counts them.

    The keys are dealt to buckets as packed arrays: 48 bits of each key (with
    its bucket, more bits the more buckets there are; a chance collision only
    makes one more candidate) and the number of its set in the array's own list.
    Keys that may have HEAVY holders or more are dealt by key and set and leave
    their bucket as rows: counts and digests of their holders are aggregated
    before a shuffle, so no task holds all of them.
    """
    low = np.uint64((1 << 48) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, flat, counts in _rows(batch):
                ends = np.cumsum(counts)
                sets: dict[tuple[int, int], int] = {}
                keys, fulls, of = [], [], []
                for known, a, b in zip(ids.is_valid().to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    s = flat[a:b]
                    if b == a or not known:
                        continue
                    name = identity(s)
                    if name not in sets:
                        sets[name] = len(sets)
                        own, full = join_keys(s, frequent, heavy)
                        keys.append(own)
                        fulls.append(full)
                        of.append(len(own))
                if not sets:
                    continue
                key, full = np.concatenate(keys), np.concatenate(fulls)
                row = np.repeat(np.arange(len(sets), dtype=np.uint32), of)
                names = np.array(list(sets), np.int64)
                spread = (key >> np.uint64(13)) if not len(heavy) else np.where(full, mix(names[row, 0].view(np.uint64)), key) >> np.uint64(13)
                # heavy keys: negative buckets
                bucket = (spread % np.uint64(buckets)).astype(np.int64)
                if len(heavy):
                    bucket = np.where(full, -1 - bucket, bucket)
                order = np.argsort(bucket, kind="stable")
                key, row, bucket = (key & low)[order], row[order], bucket[order]
                packed = key.view(np.uint8).reshape(-1, 8)[:, :6]
                cut = np.flatnonzero(np.diff(bucket, prepend=-buckets - 1, append=buckets))
                out: dict[str, list] = {"bucket": [], "held": [], "row": [], "names": []}
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    here, at = np.unique(row[a:b], return_inverse=True)
                    out["bucket"].append(int(bucket[a]))
                    out["held"].append(packed[a:b].tobytes())
                    out["row"].append(np.diff(at, prepend=0).astype(np.uint16).tobytes())
                    out["names"].append(names[here].tobytes())
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    def meet(table: pa.Table) -> pa.Table:
        weighty = table["bucket"][0].as_py() < 0
        names = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table["names"].to_pylist()]
        first = np.cumsum([0, *map(len, names)])
        row = np.concatenate([np.cumsum(np.frombuffer(x, np.uint16).astype(np.int32)) + f for x, f in zip(table["row"].to_pylist(), first[:-1].tolist(), strict=True)])
        names = np.concatenate(names)
        packed = np.frombuffer(b"".join(table["held"].to_pylist()), np.uint8).reshape(-1, 6)
        key = np.zeros((len(packed), 8), np.uint8)
        key[:, :6] = packed
        key = key.view(np.int64).ravel()
        if weighty:
            return pa.table({"g": pa.nulls(len(key), pa.int64()), "key": key, "k1": names[row, 0].copy(), "k2": names[row, 1].copy()})
        for distinct in (False, True):
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            if distinct and len(key):  # copies of one set that came from different tasks
                _, same = np.unique(names[row], axis=0, return_inverse=True)
                order = np.lexsort((same.ravel(), key))
                key, row, same = key[order], row[order], same.ravel()[order]
                keep = np.append(True, (np.diff(key) != 0) | (np.diff(same) != 0))
                key, row = key[keep], row[keep]
            size = np.diff(np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)))
            keep = np.repeat(size > 1, size)
            key, row = key[keep], row[keep]
        # groups of the same sets get one number, from the sets alone
        own = mix(names[row, 0].view(np.uint64) + mix(names[row, 1].view(np.uint64)))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(np.append(first, len(key)))
        g = np.zeros(0, np.uint64)
        if len(key):
            g = np.repeat(mix(np.add.reduceat(own, first) + mix(np.bitwise_xor.reduceat(own, first) + size.astype(np.uint64))), size)
        return pa.table({"g": g.view(np.int64), "key": pa.nulls(len(key), pa.int64()), "k1": names[row, 0].copy(), "k2": names[row, 1].copy()})

    dealt = docs.mapInArrow(deal, "bucket int, held binary, row binary, names binary")
    met = dealt.groupBy("bucket").applyInArrow(meet, "g long, key long, k1 long, k2 long")
    if not len(heavy):
        return met.groupBy("g", "k1", "k2").agg(F.count(F.lit(1)).alias("keys"))
    met = staged(met, "keys")
    entries = staged(met.where("g is null").select("key", "k1", "k2").distinct(), "heavy-keys")
    digest = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *[F.bit_xor(F.xxhash64(F.lit(x), "k1", "k2")).alias(f"d{x}") for x in (1, 2)]).where("c > 1")
    groups = entries.join(digest.select("key", F.xxhash64("c", "d1", "d2").alias("g")), "key").select("g", "k1", "k2")
    return met.where("g is not null").select("g", "k1", "k2").unionByName(groups).groupBy("g", "k1", "k2").agg(F.count(F.lit(1)).alias("keys"))


def parity_bits(s: np.ndarray, bits: int) -> np.ndarray:
    """One bit flipped for each shingle."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").astype(np.uint8)


def bits_of(n: int) -> int:
    return max(64, 2 << (n - 1).bit_length())


def candidate_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` of the sets in ``nodes`` (``node, id, h``: a row that has the set), from their texts."""
    spot = F.pmod(F.xxhash64("id", "h"), F.lit(FILTER_BITS)).cast("int")
    marks = nodes.select(spot.alias("spot")).select(F.expr("spot div 64").alias("w"), F.expr("shiftleft(1L, spot % 64)").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    filter_words = np.zeros(FILTER_BITS // 64, np.int64)
    filter_words[marks["w"].to_numpy()] = marks["m"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = (filter_words.view(np.uint64)[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            for _, flat, counts in _rows(batch.filter(pa.array(keep))):
                ends = np.cumsum(counts)
                sets = [flat[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True) if b > a]
                names = np.array([identity(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["k1", "k2", "shingles"])

    found = docs.where("id is not null").select("id", "text", spot.alias("spot")).mapInArrow(run, "k1 long, k2 long, shingles binary")
    wanted = found.select(F.xxhash64("k1", "k2").alias("node"), "shingles").join(nodes.select("node"), "node", "left_semi")
    return wanted.groupBy("node").agg(F.first("shingles").alias("shingles"))


def passed(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sizes and bit sketches allow similarity."""
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    near = (F.col("na") * NUM <= F.col("nb") * DEN) & (F.col("nb") * NUM <= F.col("na") * DEN)
    both = pairs.join(right, "b").join(left, "a").where(near).select("a", "b", "na", "nb", "ba", "bb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            keep = []
            for both, x, y in zip(sizes, batch.column(4), batch.column(5), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                while len(s) != len(t):  # the longer sketch is folded to half its length
                    if len(s) > len(t):
                        s, t = t, s
                    t = t[: len(t) // 2] ^ t[len(t) // 2 :]
                keep.append(7 * int(np.bitwise_count(s ^ t).sum()) <= both)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, sets_of: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar, decided on the whole sets."""
    pairs = staged(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets_of.select("node", "id", "h"), "node")
    sets = staged(candidate_sets(docs, nodes), "shingles")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                same = int((t[at] == s).sum())
                keep.append(DEN * same >= NUM * (len(s) + len(t) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(both.mapInArrow(run, "a long, b long").distinct(), "links")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, comp``: the smallest node that each linked node reaches.

    Smallest labels spread over the links and each label is replaced by its own
    label (pointer jumping) until nothing changes; each round is a written table.
    """
    ends = links.where(F.col(a) != F.col(b))
    edges = staged(ends.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(ends.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = staged(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).withColumn("changed", F.lit(True)), "labels")
    while labels.where("changed").limit(1).count():
        near = edges.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        spread = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = spread.select(F.col("u").alias("l"), F.col("l").alias("j"))
        labels = staged(spread.join(jump, "l").select("u", F.least("l", "j").alias("l"), (F.least("l", "j") != F.col("old")).alias("changed")), "labels")
    return labels.select(F.col("u").alias("node"), F.col("l").alias("comp"))


def open_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """``g, node, comp`` of the key groups that hold members of two components under ``links``."""
    joined = members.join(components(links), "node", "left").select("g", "node", F.coalesce("comp", "node").alias("comp"))
    still = joined.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g")
    return staged(joined.join(still, "g"), "open")


def open_pairs(members: DataFrame, sketches: DataFrame, nearest: bool) -> DataFrame:
    """``a, b, g``: pairs ``a < b`` of one key group and different components that pass the short sketch test.

    With ``nearest``, of each member only the pair with the fewest differing bits
    (of each part that it meets); rows without ``a`` then name the groups ``g`` in
    which a member has further pairs. All pairs of the other groups are there.
    Rows can repeat.

    In a group, the members outside its largest component (the *others*) meet
    all members; two members of the largest component need no comparison. Others
    and members are cut into parts of about BLOCK, and each pair of parts is a
    unit of its own, dealt by hash; a task gets about ROWS_PER_BUCKET rows of at
    most SHORT bytes.

    Near copies share many groups. Each member carries the smallest of its groups
    in several orders; where these agree for a pair, that group is common to both
    and only it yields the pair, so a pair comes out about once. A pair without
    such agreement comes out of all its groups.
    """
    firsts = members.groupBy("node").agg(F.array(*[F.min(F.col("g").bitwiseXOR(F.lit(c))) for c in _ORDERS]).alias("firsts"))
    by_comp = members.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"))
    facts = by_comp.groupBy("g").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("main"))
    parts = lambda n: F.ceil(n / F.lit(float(BLOCK))).cast("int")
    facts = staged(facts.select("g", F.col("main.comp").alias("main"), "size", (F.col("size") - F.col("main.c")).alias("others")).withColumns({"p": parts(F.col("size")), "q": parts(F.col("others"))}), "groups")
    total = facts.agg(F.sum(F.col("size") * F.col("q") + F.col("others") * F.col("p"))).first()[0] or 0
    buckets = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / ROWS_PER_BUCKET))
    known = firsts.join(sketches.select("node", "n", F.coalesce("short", "bits").alias("bits")), "node")
    rows = members.join(facts.select("g", "main", "p", "q"), "g").join(known, "node")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(F.lit(1), "node"), F.col(n)).cast("int")
    # side 0 is met by the others, side 1 are the others, 2 is both: in groups of one part nobody needs two rows
    single = (F.col("p") == 1) & (F.col("q") == 1)
    other = F.col("comp") != F.col("main")
    right = rows.withColumns({"side": F.when(single & other, 2).otherwise(0).cast("byte"), "i": own("p")}).withColumn("j", steps("q"))
    left = rows.where(other & ~single).withColumns({"side": F.lit(1).cast("byte"), "j": own("q")}).withColumn("i", steps("p"))
    columns = ["g", "i", "j", "side", "node", "comp", "n", "bits", "firsts"]
    dealt = right.select(*columns).unionByName(left.select(*columns)).withColumn("bucket", F.pmod(F.xxhash64("g", "i", "j"), F.lit(buckets)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        g, i, j, side, n, node, comp = (table[c].to_numpy() for c in ("g", "i", "j", "side", "n", "node", "comp"))
        order = np.lexsort((n, j, i, g))
        g, i, j, side, n, node, comp = (x[order] for x in (g, i, j, side, n, node, comp))
        bits = table["bits"].combine_chunks()
        firsts = table["firsts"].combine_chunks().flatten().to_numpy().reshape(len(g), -1)[order]
        orders = np.array(_ORDERS, np.int64)
        new = np.flatnonzero(np.append(True, (np.diff(g) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))) if len(g) else np.zeros(0, np.int64)
        found: list[np.ndarray] = []
        more: set[int] = set()
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(g)], strict=True):
            met = np.flatnonzero(side[a:b] != 1)
            if not len(met) or not side[a:b].any():
                continue
            raw = bits.take(pa.array(order[a:b])).to_pylist()
            wide = np.array([len(x) for x in raw])
            # all members of one width, and the same folded once
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for w in np.unique(wide[met]).tolist():
                at = met[wide[met] == w]
                held[w] = at + a, np.frombuffer(b"".join([raw[x] for x in at.tolist()]), np.uint64).reshape(len(at), -1)
            halves = {w: m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :] for w, (_, m) in held.items() if w > 8}
            for r in (np.flatnonzero(side[a:b]) + a).tolist():
                w = int(wide[r - a])
                x = np.frombuffer(raw[r - a], np.uint64)
                best: tuple[float, int] | None = None
                passing = 0
                for other in (w // 2, w, 2 * w):
                    if other not in held:
                        continue
                    rows_y, y = held[other]
                    first = int(np.searchsorted(n[rows_y], -(-n[r] * NUM // DEN), side="left"))
                    to = int(np.searchsorted(n[rows_y], n[r] * DEN // NUM, side="right"))
                    if first >= to:
                        continue
                    ys = rows_y[first:to]
                    apart_from = comp[ys] != comp[r]
                    if not apart_from.any():
                        continue
                    if other > w:
                        y, own_x = halves[other], x
                    else:
                        own_x = x if other == w else x[: len(x) // 2] ^ x[len(x) // 2 :]
                    ys = ys[apart_from]
                    apart = np.bitwise_count(y[first:to][apart_from] ^ own_x).sum(1, dtype=np.int64)
                    near = 7 * apart <= n[ys] + n[r]
                    if near.any():
                        at = np.flatnonzero(near)
                        agree = firsts[ys[at]] == firsts[r]
                        here = agree[np.arange(len(at)), agree.argmax(1)] & (firsts[r] == g[r] ^ orders)[agree.argmax(1)]
                        near[at] = here | ~agree.any(1)
                    if nearest:
                        passing += int(near.sum())
                        if near.any():
                            k = int(np.argmin(np.where(near, apart, 1 << 40)))
                            best = min(best or (1 << 40, 0), (int(apart[k]), int(ys[k])))
                        continue
                    ys = ys[near]
                    if len(ys):
                        found.append(np.sort(np.column_stack([np.full(len(ys), node[r]), node[ys]]), 1))
                if passing > 1:
                    more.add(int(g[r]))
                if best is not None:
                    found.append(np.sort(np.array([[node[r], node[best[1]]]]), 1))
        ab = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        none = [None] * len(more)
        columns = {"a": [*ab[:, 0].tolist(), *none], "b": [*ab[:, 1].tolist(), *none], "g": [*[None] * len(ab), *sorted(more)]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()})

    return dealt.groupBy("bucket").applyInArrow(compare, "a long, b long, g long")


def set_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of every row of ``id, text, h``, and ``k1, k2, class, comp`` of every set of rows with an id.

    ``class`` numbers the sets that links join, ``comp`` is the smallest id that has one of them.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    seen = staged(set_features(docs), "features")
    features = seen.where("shingle is null")
    filled = features.where("n > 0 and id is not null")
    # ids can repeat with different sets, so a set's own number stands for it until the end
    by_set = filled.groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "h")).alias("row"), F.first("bits").alias("bits"), F.first("short").alias("short"))
    sets_of = staged(by_set.select(F.xxhash64("k1", "k2").alias("node"), "k1", "k2", "n", "row.id", "row.h", "bits", "short"), "sets")
    sketches = sets_of.select("node", "n", "bits", "short")
    keys = filled.agg(F.sum(F.col("n") / 3 + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(1.25 * keys / KEYS_PER_BUCKET))
    held = key_groups(docs, *frequent_shingles(seen), buckets)
    members = staged(held.select("g", F.xxhash64("k1", "k2").alias("node"), "keys"), "members")

    # First round: each node to the member that shares most keys, preferring members whose keys are shared widely.
    wide = members.groupBy("node").agg(F.sum("keys").alias("w"))
    weighed = members.join(wide, "node")
    heads = weighed.groupBy("g").agg(F.max(F.struct("w", (-F.col("node")).alias("m"))).alias("h"))
    stars = weighed.join(heads, "g").select("node", "keys", (-F.col("h.m")).alias("head"), F.col("h.w").alias("w")).where("node <> head")
    best = stars.groupBy("node", "head", "w").agg(F.sum("keys").alias("c")).groupBy("node").agg(F.max(F.struct("c", "w", (-F.col("head")).alias("m"))).alias("r"))
    first = best.select(F.col("node").alias("b"), (-F.col("r.m")).alias("a"))
    links = verified(passed(first, sketches), docs, sets_of)

    # Then key groups that still hold members of two components: each member's nearest, and then all pairs of groups with more than these.
    for nearest in (True, False):
        still = open_members(members, links)
        found = staged(open_pairs(still, sketches, nearest), "found")
        pairs = found.where("a is not null").select("a", "b").distinct()
        links = links.unionByName(verified(passed(pairs, sketches), docs, sets_of))
        members = still.drop("comp").join(found.where("a is null").select("g").distinct(), "g", "left_semi")
    comp = components(links)
    whole = sets_of.join(comp, "node", "left").select("k1", "k2", "id", F.coalesce("comp", "node").alias("comp"))
    named = whole.groupBy("comp").agg(F.min("id").alias("smallest"))
    return features, whole.join(named, "comp").select("k1", "k2", F.col("comp").alias("class"), F.col("smallest").alias("comp"))


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row."""
    features, sets = set_components(_texts(documents, id_col, text_col))
    # Rows of one id with different sets are one node.
    by_id = features.where("n > 0 and id is not null").join(sets.select("k1", "k2", "comp"), ["k1", "k2"]).select("id", "comp")
    several = by_id.groupBy("id").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a <> z").select("id", "a")
    merged = components(by_id.join(several, "id").select("a", F.col("comp").alias("b")))
    comp = sets.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("c")), "comp", "left").select("k1", "k2", F.coalesce("c", "comp").alias("comp"))
    whole = features.select("id", "n", "k1", "k2").join(comp, ["k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("comp"))
    kind = documents.schema[id_col].dataType.simpleString()
    return whole.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, of equal ids with the smallest hash of the text.

    Rows of one id whose texts aren't near copies stay apart; of rows with equal
    id and text one stays (the smallest of all columns in order; columns with maps or
    variants, which have no order, count by their JSON). A row without
    id, and one without words, has no near copies and is kept; copies of the
    latter with the same id and text are one. Other columns are left as they are
    whatever their names.
    """
    features, sets = set_components(_texts(documents, id_col, text_col))
    rows = features.where("id is not null").select("id", "h", "n", "k1", "k2").join(sets.select("k1", "k2", "class"), ["k1", "k2"], "left")
    group = [F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("id")), F.col("n") > 0]
    best = rows.groupBy(*[c.alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.min(F.struct("id", "h")).alias("r"))
    kept = staged(best.select("r.id", "r.h").distinct(), "kept")
    marked = documents.withColumns({(own := _unused(documents, "_id")): F.col(id_col).cast("long"), (text := _unused(documents, "_h")): F.xxhash64(text_col)})
    chosen = marked.join(kept.select(F.col("id").alias(own), F.col("h").alias(text)), [own, text], "left_semi")
    if rows.join(kept, ["id", "h"], "left_semi").count() > kept.count():
        chosen = chosen.groupBy(own, text).agg(F.min_by(F.struct(*documents.columns), _order(documents)).alias("_row")).select("_row.*")
    return chosen.select(*documents.columns).unionByName(documents.where(F.col(id_col).isNull()))


def _order(df: DataFrame) -> Column:
    """A struct of all columns that can be compared."""
    unordered = [n for n, t in df.dtypes if "map<" in t or "variant" in t]
    return F.struct(*[F.to_json(F.struct(c)) if c in unordered else F.col(c) for c in df.columns])


def _unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name
