"""Merkle manifest of a table as persistent trees in aligned blocks.

A leaf is the digest of a row's fields, a node the digest of up to ARITY
consecutive nodes. Per group, leaves ascend by id; the groups' roots make the top
tree. The tree is cut into aligned blocks of ARITY ** LEVELS nodes: one task holds
one block as a ``PersistentTree``, whose root is a node of the next distributed
level. Once all levels are up, each block gets the siblings of its root on the way
to the top, and its versions are made: a leaf with another digest is a version of
the block that shares all nodes but the copied ancestors of that leaf, and the
version goes on upwards by the siblings of its block, level by level.

Tables hold digests only; the texts are read once. Positions come from one range
exchange over group, id, digest and row, so a group with a third of all rows is
many tasks, and from counts of each range. Nothing but the number of levels comes
to the driver.

Defined results: null fields are ``-``; rows of one id are in order of their
digests; null ids come first; the null group comes first; repeated rows are leaves
of their own; a table without rows gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.session import staged

#: Children of a node, and levels of a block.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 over each field as ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _digest(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


class PersistentTree:
    """A tree whose versions share nodes: a node is (digest, children) and never changes."""

    def __init__(self, digests: Sequence[str], levels: int) -> None:
        self.levels = levels
        nodes: list[tuple] = [(d, ()) for d in digests]
        for _ in range(levels):
            nodes = [self._node(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        (self.root,) = nodes

    @staticmethod
    def _node(children: Sequence[tuple]) -> tuple:
        return _digest([c[0] for c in children]), tuple(children)

    def _way(self, leaf: int) -> list[int]:
        """The child to take at each level from the root down to a leaf."""
        return [leaf // ARITY**k % ARITY for k in range(self.levels - 1, -1, -1)]

    def version(self, leaf: int, digest: str) -> tuple:
        """The root of the version in which one leaf has another digest: only its ancestors are copied."""
        way, path = self._way(leaf), [self.root]
        for k in way[:-1]:
            path.append(path[-1][1][k])
        node = (digest, ())
        for parent, k in zip(reversed(path), reversed(way), strict=True) if way else ():
            node = self._node((*parent[1][:k], node, *parent[1][k + 1 :]))
        return node

    def siblings(self, leaf: int) -> list[str]:
        """From the leaf up: digests left and right of the way, each run's as one text."""
        out, node = [], self.root
        for k in self._way(leaf):
            digests = [c[0] for c in node[1]]
            out = ["".join(digests[:k]), "".join(digests[k + 1 :]), *out]
            node = node[1][k]
        return out


def folded(digest: str, siblings: Sequence[str]) -> str:
    """The root over a digest and the texts left and right of it, level by level."""
    for left, right in zip(siblings[::2], siblings[1::2], strict=True):
        digest = _digest((left, digest, right))
    return digest


def _positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``pos``, their place in group ``g`` by ``order``, and ``n``, the rows of the group.

    Ranges are counted as they lie; a range's first place in a group is the sum of the ranges before it.
    """

    def numbered(batches):
        seen: dict[str, int] = {}  # only the group at hand
        for batch in batches:
            places = []
            for g in batch.column("g").to_pylist():
                if g not in seen:
                    seen = {g: 0}
                places.append(seen[g])
                seen[g] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ranged = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    lying = staged(ranged.mapInArrow(numbered, f"{kept}, place long").withColumn("range", F.spark_partition_id()), "merkle-rows")
    counts = lying.groupBy("g", "range").agg((F.max("place") + 1).alias("here"))
    of_group = Window.partitionBy("g")  # as many rows as ranges
    starts = counts.select(
        F.col("g").alias("cg"),
        F.col("range").alias("cr"),
        F.coalesce(F.sum("here").over(of_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("here").over(of_group).alias("n"),
    )
    # groups + ranges rows at most; joined by range and group, so a large group isn't one key
    placed = lying.join(starts, (F.col("g") == F.col("cg")) & (F.col("range") == F.col("cr")))
    return placed.select(*rows.columns, (F.col("start") + F.col("place")).alias("pos"), "n")


def _levels(n: int, above: int) -> int:
    """Levels of a block whose leaves are ``above`` levels over the leaves of a tree of n."""
    return max(0, min(LEVELS, height(n) - above))


def _sorted(table: pa.Table) -> list[dict]:
    return table.sort_by("pos").to_pylist()


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).alias("block")


def _grown(leaves: DataFrame) -> list[DataFrame]:
    """All distributed levels of the trees of ``g, pos, n, digest``, the roots last."""
    largest = leaves.agg(F.max("n")).first()[0] or 1
    levels = [leaves.select("g", "pos", "n", "digest")]

    def reduced(above: int) -> Callable[[pa.Table], pa.Table]:
        def block(table: pa.Table) -> pa.Table:
            rows = _sorted(table)
            first = rows[0]
            tree = PersistentTree([r["digest"] for r in rows], _levels(first["n"], above))
            return pa.table({"g": [first["g"]], "pos": pa.array([first["pos"] // BLOCK], pa.int64()), "n": pa.array([first["n"]], pa.int64()), "digest": [tree.root[0]]})

        return block

    while True:
        above = LEVELS * (len(levels) - 1)
        up = levels[-1].groupBy("g", _block()).applyInArrow(reduced(above), "g string, pos long, n long, digest string")
        levels.append(staged(up, "merkle-level"))
        if BLOCK ** (len(levels) - 1) >= largest:
            return levels


_PATHS = "g string, pos long, path array<string>, subroot string, root string"


def _children(rows: list[dict], groups: list[str], places: list[int], subroots: list[str], parent: dict, above: int) -> pa.Table:
    """The siblings upwards of each node of a block, the block's own siblings being the parent's."""
    tree = PersistentTree([r["digest"] for r in rows], _levels(rows[0]["n"], above))
    paths = [tree.siblings(i) + parent["path"] for i in range(len(rows))]
    return pa.table({"g": groups, "pos": pa.array(places, pa.int64()), "path": pa.array(paths, pa.list_(pa.string())), "subroot": subroots, "root": [parent["root"]] * len(rows)})


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """For each block of leaves its siblings upwards: ``g, pos, path, subroot, root``, down from those of the roots."""
    def downward(above: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def down(nodes: pa.Table, parents: pa.Table) -> pa.Table:
            rows, (parent,) = _sorted(nodes), parents.to_pylist()
            return _children(rows, [r["g"] for r in rows], [r["pos"] for r in rows], [parent["subroot"]] * len(rows), parent, above)

        return down

    paths = tops
    for k in range(len(levels) - 2, 0, -1):
        cogroups = levels[k].groupBy("g", _block()).cogroup(paths.groupBy("g", "pos"))
        paths = staged(cogroups.applyInArrow(downward(LEVELS * k), _PATHS), "merkle-paths")
    return paths


def merkle_manifest(df: DataFrame, fields: Sequence[str], tampered: Column, tampered_fields: dict[str, Column], group_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row.

    ``proof_sha256`` is the digest of all siblings from the leaf to the root.
    ``folded_root`` is the root of the version in which a row where ``tampered``
    holds has its ``tampered_fields`` in place of its own; ``verified`` tells
    whether it is the root.
    """
    other = leaf_digest([tampered_fields.get(f, F.col(f)) for f in fields])
    leaves = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"),  # null first, then bytewise
        F.col(id_col).alias("id"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        F.when(tampered, other).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = staged(_positions(staged(leaves, "merkle-leaves"), ["id", "digest", "row"]).drop("row"), "merkle-placed")
    levels = _grown(placed)
    subroots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), "digest")
    top = staged(_positions(subroots, ["key"]), "merkle-groups")
    top_levels = _grown(top)
    roots = top_levels[-1].select("g", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))

    def top_down(nodes: pa.Table, parents: pa.Table) -> pa.Table:
        rows, (parent,) = _sorted(nodes), parents.to_pylist()
        return _children(rows, [r["key"] for r in rows], [0] * len(rows), [r["digest"] for r in rows], parent, 0)

    tops = top.groupBy("g", _block()).cogroup(_paths(top_levels, roots).groupBy("g", "pos")).applyInArrow(top_down, _PATHS)
    paths = _paths(levels, staged(tops, "merkle-paths"))

    def versions(nodes: pa.Table, parents: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        rows, (parent,) = nodes.select(["digest", "other", "n"]).to_pylist(), parents.to_pylist()
        tree = PersistentTree([r["digest"] for r in rows], _levels(rows[0]["n"], 0))
        path, root = parent["path"], parent["root"]
        above = "".join(path).encode()
        proofs, roots = [], []
        for i, r in enumerate(rows):
            proofs.append(sha256("".join(tree.siblings(i)).encode() + above).hexdigest())
            roots.append(folded(tree.version(i, r["other"] or r["digest"])[0], path))
        return pa.table(
            {
                "id": nodes["id"],
                "leaf": nodes["digest"],
                "subroot": [parent["subroot"]] * len(rows),
                "root": [root] * len(rows),
                "proof_sha256": proofs,
                "folded_root": roots,
                "verified": [x == root for x in roots],
            }
        )

    out = placed.groupBy("g", _block()).cogroup(paths.groupBy("g", "pos")).applyInArrow(versions, f"id {df.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)
