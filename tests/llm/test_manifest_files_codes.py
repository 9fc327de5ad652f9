"""Merkle manifest, token-id files and vector codes against plain versions, and their odd cases."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidewarden.llm import codes, merkle, token_files
from tidewarden.llm.queries import BYTE_BPE, END_ID, op12_token_files

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# --- manifest


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(level):
    levels = [level]
    while len(level) > 1:
        level = [H(level[i : i + 8]) for i in range(0, len(level), 8)]
        levels.append(level)
    return levels


def plain_manifest(rows):
    """(leaf, subroot, root, proof, folded, verified) of rows (id, group, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = plain_tree([leaf(*r) for r in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (key, _, text) in enumerate(groups[g]):
            d = leaf(key, g, text.translate(LOWER) if text is not None else None) if key is not None and key % 2 else leaf(key, g, text)
            proof = ""
            for levels, place in ((trees[g], i), (top, at)):
                for level in levels[:-1]:
                    a = place // 8 * 8
                    left, right = "".join(level[a:place]), "".join(level[place + 1 : a + 8])
                    proof, d, place = proof + left + right, H([left, d, right]), place // 8
            out.append((key, trees[g][0][i], trees[g][-1][0], top[-1][0], H([proof]), d, d == top[-1][0]))
    return out


def manifest(df):
    return merkle.merkle_manifest(df, ["doc_id", "lang", "text"], F.col("doc_id") % 2 == 1, {"text": merkle.ascii_lower(F.col("text"))})


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1}, {"en": 9, "de": 513}, {None: 4097, "é": 65, "": 3}, {f"l{k:03}": 1 + k % 3 for k in range(90)}])
def test_manifest_is_a_plain_tree(spark, sizes):
    rng = random.Random(5)
    rows = [(i, g, rng.choice(["Abc x", "lower", "", None, "Ä ß"]) if i % 5 else f"T{i}") for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    rng.shuffle(rows)
    got = manifest(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(plain_manifest(rows))


def test_manifest_odd_rows(spark):
    rows = [(None, "en", "a"), (None, "en", "A"), (1, "en", "Same"), (1, "en", "Same"), (1, "en", "Other"), (2, None, None), (3, "en", "Word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({c: F.lit("x") for c in ("g", "pos", "n", "digest", "other", "id")})
    assert sorted(map(tuple, manifest(df).collect()), key=str) == sorted(plain_manifest(rows), key=str)
    assert manifest(df.where("false")).count() == 0


def test_versions_share_all_but_the_ancestors():
    tree = merkle.PersistentTree([f"{i:064x}" for i in range(500)], 3)
    new = tree.version(137, "f" * 64)
    old = tree.root

    def nodes(node):
        return {id(node)} | {x for c in node[1] for x in nodes(c)}

    assert len(nodes(new) - nodes(old)) == 4 and new[0] != old[0]
    assert merkle.folded("f" * 64, tree.siblings(137)) == new[0] and merkle.folded(f"{137:064x}", tree.siblings(137)) == old[0]


# --- token-id files


def test_monotone():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (1024, 3), (1025, 1 << 40), (5000, 5000)):
        v = np.sort(rng.integers(0, top, n))
        m = token_files.Monotone.from_bytes(token_files.Monotone.build(v).to_bytes())
        assert (m.run(0, n) == v).all()
        for a, b in rng.integers(0, n + 1, (40, 2)).tolist():
            assert (m.run(a, b) == v[a:b]).all()
        assert all(m.select(i) == v[i] for i in rng.integers(0, n, 20 if n else 0).tolist())
    v = np.sort(rng.integers(0, 1 << 32, 50_000))
    assert len(token_files.Monotone.build(v).to_bytes()) * 8 / len(v) < 2.2 + np.log2((1 << 32) / len(v))


ODD = [None, "", " ", "a", "don't  stop\n\nnow ", "é中👍\n\r\t  x", "nbsp  x  y", "line  sep　 \x1c x", "word " * 30_000, "x" * 20_000, "same text", "same text", "<|endoftext|> x  <|endoftext|>y", "﻿bom  ​ "]


def test_encoder_is_the_library(spark):
    rng = random.Random(6)
    t = Tokenizer.from_file(BYTE_BPE)
    with open(BYTE_BPE, encoding="utf-8") as f:
        encoder = token_files.PieceEncoder(f.read())
    alphabet = list("ab 'st12,.\n\t\r\v\f") + [" ", " ", "’", "é", "ß", "中", "👍", "  ", "\n\n", "'ll", "\x1d", "᠎"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    for part in (texts, texts[5:400], texts[:1]):
        flat, counts = encoder.encode(pa.array(part, pa.string()))
        want = [t.encode(x or "", add_special_tokens=False).ids for x in part]
        assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]
    for name in ("word_bpe_49k.json",):  # another kind of split: whole texts
        path = BYTE_BPE.replace("byte_bpe_50k.json", name)
        with open(path, encoding="utf-8") as f:
            other = token_files.PieceEncoder(f.read())
        lib = Tokenizer.from_file(path)
        flat, counts = other.encode(pa.array(["Ab  cd", "", "x y"]))
        assert not other.by_piece and flat.tolist() == [i for x in ("Ab  cd", "", "x y") for i in lib.encode(x, add_special_tokens=False).ids]


def test_token_files_query(spark):
    t = Tokenizer.from_file(BYTE_BPE)
    at, want = 0, []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, END_ID]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in op12_token_files(spark, SMALL).orderBy("doc_id").collect()] == want


def test_token_files_odd_rows_and_select(spark, tmp_path):
    rows = [(i * 7 - 20, x, "e") for i, x in enumerate(ODD)] + [(None, "no id", "e"), (None, "no id", "e"), (-20, "again", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    path = f"file://{tmp_path}/x"
    token_files.write_token_files(df, path, BYTE_BPE, END_ID, file_ids=300)
    t = Tokenizer.from_file(BYTE_BPE)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    want = {(i, tuple([*t.encode(x or "", add_special_tokens=False).ids, END_ID])) for i, x, _ in rows}
    assert len(got) == len(rows) and {(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got} == want
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    with open(tmp_path / "x" / "manifest.json") as f:
        files = json.load(f)["files"]
    assert len(files) > 2 and files[0]["start"] == 0
    at = 0
    for f in files:  # random access: one document's ids by select
        one = token_files.TokenFile(fs.LocalFileSystem(), str(tmp_path / "x" / f["name"]))
        for i in range(f["docs"]):
            assert one.document(i).tolist() == np.frombuffer(got[at + i]["ids"], "<u4").tolist()
        at += f["docs"]
    token_files.write_token_files(df.where("false"), f"{path}-empty", BYTE_BPE)
    assert token_files.read_token_files(spark, f"{path}-empty").count() == 0


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    path = f"file://{tmp_path}/x"
    token_files.write_token_files(df, path, BYTE_BPE)
    (tmp_path / "x" / "ids-left.tok").write_bytes(b"half a file")
    assert token_files.read_token_files(spark, path).count() == 2
    unordered = spark.createDataFrame([(2, bytearray(4)), (1, bytearray(4))], "doc_id long, ids binary").coalesce(1)
    with pytest.raises(PySparkException, match="order of id"):
        unordered.write.format("token_ids").mode("append").save(f"{path}-bad")


# --- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    x = np.array([[int(np.floor(1024 * float(c))) for c in v] for _, v, _ in rows], np.int64).reshape(len(rows), parts, -1)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])[:entries]
    book = x[order].transpose(1, 0, 2).copy()

    def nearest():
        return np.array([[int(((book[p] - x[i, p]) ** 2).sum(1).argmin()) for p in range(parts)] for i in range(len(rows))])

    for _ in range(rounds):
        code = nearest()
        for p in range(parts):
            for e in range(book.shape[1]):
                if (here := code[:, p] == e).any():
                    book[p, e] = [int(s) // int(here.sum()) for s in x[here, p].sum(0)]
    code = nearest()
    error = [sum(int(((book[p, c] - x[i, p]) ** 2).sum()) for p, c in enumerate(code[i])) for i in range(len(rows))]
    of_label = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        of_label[label] = of_label.get(label, 0) + e
    text = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code[i]), error[i], of_label[r[2]], text) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("n", "size", "entries"), [(900, 8, 256), (700, 16, 40), (30, 8, 256), (1, 4, 256)])
def test_codes_are_plain_rounds(spark, n, size, entries):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(12, size))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=size)).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    for i in range(0, n - 5, 9):  # repeated vectors and ties
        rows[i + 5] = (i + 5, rows[i][1], rows[i + 5][2])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    assert sorted(map(tuple, codes.vector_codes(df, entries=entries).collect())) == sorted(plain_codes(rows, entries=entries))


def test_bounds_spare_comparisons(spark):
    """In separated clusters the last round looks at few rows; sums of moves would look at more."""
    rng = np.random.default_rng(8)
    centres = 20 * rng.normal(size=(16, 8))
    rows = [(i, (centres[i % 16] + rng.normal(size=8)).tolist(), 0) for i in range(3000)]
    found, history = codes.assign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=16)
    assert found.agg(F.sum("looked")).first()[0] < 0.05 * 4 * len(rows)
    net = np.sqrt(((history[-1] - history[0]) ** 2).sum(-1))
    drift = sum(np.sqrt(((b - a) ** 2).sum(-1)) for a, b in zip(history, history[1:]))
    assert (net <= drift + 1e-9).all() and (net < drift - 1).any()


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 6, 1), (2, None, 1), (3, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (4, [nan] * 6, 1), (5, [inf] + [0.0] * 5, 1), (6, [1.0] * 5, 1), (7, [], 1), (None, [0.25] * 6, None), (1, [0.5] * 6, None), (8, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("v", "code", "key", "error")})
    got = codes.vector_codes(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["error"]) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 8, 0), (True, 0, 0)]
    assert codes.vector_codes(df.where("false")).count() == 0 and codes.vector_codes(df.where("vec_id = 2")).count() == 0


def test_exact_where_floats_are_not():
    x = np.array([[1 << 26, 3], [-(1 << 26), 1]], np.int64)
    assert codes.squared(x, x[:1]).tolist() == [[0], [(1 << 54) + 4]]
