"""Operators for training data against plain versions, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.conftest import SMALL
from tidewarden.llm import ann, bpe, html_extract, jaccard, lm, mixing, mpegts, quality, sharding, unigram
from tidewarden.llm.queries import BYTE_BPE, PIECES, op4_rendezvous_shards, queries

ODD = [None, "", " ", "a", "A a a a a a a", "é中👍\n\r\t  x", "word " * 5000, "same text here for two rows now", "same text here for two rows now", "<|endoftext|> x  <|endoftext|>"]
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", i) for i, t in enumerate(ODD)] + [(None, "row without id and some words", None, None), (3, "a", "s", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_quality(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels, F.col("doc_id") % 3 != 1).collect()}
    held = [(scores[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] % 3 == 1]
    assert len(scores) == docs.count() and np.mean([(s >= 0.5) == q for s, q in held]) >= 0.85
    none = labels.where("false")
    assert {r["score"] for r in quality.quality_scores(odd, none).collect()} == {0.5}
    assert quality.quality_scores(odd, labels).count() == odd.count() and quality.quality_scores(empty, labels).count() == 0
    assert quality.keep_quality(odd, none).count() == odd.count()


def test_forest_walk_is_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    f = quality.fit_trees(x, y, trees=10, depth=3)
    want = np.full(len(x), f.bias)
    for t in range(10):
        for i in range(len(x)):
            n = 0
            for _ in range(3):
                n = 2 * n + 1 + int(x[i, f.feature[t, n]] > f.threshold[t, n])
            want[i] += f.value[t, n - 7]
    assert np.allclose(f.score(x), 1 / (1 + np.exp(-want))) and np.mean((f.score(x) >= 0.5) == y) > 0.8


def test_lm_matches_counting(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).unionByName(odd.where("doc_id is not null and doc_id <> 3").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = {r["doc_id"]: tokens(r["text"]) + [None] for r in docs.collect()}
    got = {r["doc_id"]: r for r in lm.score_texts(docs, F.col("id") % 10 == 0).collect()}
    c, c2, c3 = Counter(), Counter(), Counter()
    for i, w in rows.items():
        if i % 10:
            x = ["<s>", "<s>", *w]
            c.update(w), c2.update(zip(x[1:], w)), c3.update(zip(x, x[1:], w))
    total, kinds, ends = sum(c.values()), len(c), c[None]
    z = total + 0.1 * (kinds + 1)
    for i, w in rows.items():
        s, x = 0.0, ["<s>", "<s>", *w]
        for u, v, y in zip(x, x[1:], w):
            cv = ends if v == "<s>" else max(c[v], 1)
            p2 = (c2[v, y] + lm.M2 * (c[y] + 0.1) / z) / (cv + lm.M2)
            s += math.log10((c3[u, v, y] + lm.M3 * p2) / ((ends if u == v == "<s>" else c2[u, v]) + lm.M3))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[y] > 0 for y in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[y] + 0.1) / z) for y in w), abs=1e-6)
        assert r["score"] == pytest.approx(s, abs=0.002 * len(w))
    assert lm.score_texts(empty, F.lit(False)).count() == 0
    assert lm.score_texts(odd, F.lit(True)).count() == odd.count()


def test_lm_does_not_depend_on_the_list(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    whole = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("id") % 10 == 0).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 4)
    few = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("id") % 10 == 0).collect()}
    assert few == pytest.approx(whole, rel=1e-9)


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1000, 50), (70_000, 2**50)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = lm.EliasFano.build(v)
        assert (e.decode() == v).all()
        if n:
            ask = rng.integers(0, top, 200, dtype=np.uint64)
            at, same = e.find(ask)
            assert (same == np.isin(ask, v)).all() and (v[at[same]] == ask[same]).all()


def test_poisson_mix(spark, odd, empty):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = {r["source"]: r["n"] for r in mixing.mix_sources(d, {"a": 1.0, "b": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["a"] - 2000) < 200 and abs(got["b"] - 2000) < 200
    assert abs(mixing.poisson_steps(3.0)[2] - math.exp(-3) * (1 + 3 + 4.5)) < 1e-12
    big = mixing.mix_sources(d.where("source = 'a'"), {"a": 1.0}, epochs=40.0).count()
    assert abs(big - 40_000) < 1500
    twice = [sorted(map(tuple, mixing.mix_sources(odd, {"s": 2.0}, other_weight=1.0).select("doc_id", "copy", "shuffle_key").collect(), ), key=str) for _ in range(2)]
    assert twice[0] == twice[1]
    assert mixing.mix_sources(empty, {"s": 1.0}).count() == 0


def test_shards(spark, odd, empty):
    rows = op4_rendezvous_shards(spark, SMALL).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in rows)
    w = spark.range(20_000).select(F.col("id").alias("doc_id"))
    share = [r["count"] for r in sharding.assign_shards(w, [1.0, 3.0]).groupBy("shard").count().orderBy("shard").collect()]
    assert abs(share[1] / share[0] - 3) < 0.3
    assert sharding.shard_slots(odd, [1.0] * 3).count() == odd.count() and sharding.shard_slots(empty, [1.0]).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (None, [1.0] * 16), (703, [1.0] * 3), (704, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        assert len(got[q]) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in got[q])
        hits += len({i for i, _ in got[q]} & set(want))
    assert hits >= 0.9 * 20 * 30 and set(got) == set(range(0, 600, 20))
    assert ann.nearest(df.where("vec_id < 5"), F.col("id") % 20 == 0).count() == 4
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0


PAGES = [
    ("<article><h1>T</h1><p>one two<p>three &amp; four</article><footer>f</footer>", "T\none two\nthree & four"),
    ('<body><nav><a href=1>home</a></nav><div><h2>Head</h2><p>One two three four five.</p><div class="ad">buy</div><p>Six seven.</p></div><aside><p>other</p></aside><div id="comments"><p>nice one</p></div></body>', "Head\nOne two three four five.\nSix seven."),
    ("plain   words\nonly", "plain words only"), ("", ""), (None, ""), ("<div><script>var a=1</script></div>", ""), ("<p>open <b>bold<br>more", "open bold more"),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "page_id long, html string")
    weights = html_extract.learn_weights(spark.read.parquet(f"{SMALL}/pages.parquet"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages, weights).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_extract.learn_weights(pages.where("false"))["article"] > 0


def test_html_keeps_all_labelled_regions():
    weights = html_extract.weights_of({})
    for page, text in (
        ("<body><p>out</p><main><h1>Title</h1><article>body</article><p>more</p></main><p>out</p>", "Title\nbody\nmore"),
        ("<p>out</p><article>one two three</article><p>between</p><article>four</article><p>out</p>", "one two three\nbetween\nfour"),
        ("<article>one<article>two</article>three</article><p>out</p>", "one\ntwo\nthree"),
        ("<main>one<article>two</main><p>out</p>", "one\ntwo"),
        ("<article>one</article></main><article>two<p>open", "one\ntwo\nopen"),
    ):
        assert html_extract.main_text(page, weights) == text


def test_html_never_leaves_out_an_article_with_its_wrapper():
    weights = html_extract.weights_of({})
    article = "<article><h1>T</h1><p>one two</p></article>"
    for page, text in (
        (f'<div class="layout has-sidebar">{article}</div>', "T\none two"),
        (f'<div class="content-with-nav"><div id="page-widget-wrap">{article}<div class="ad">buy</div></div></div>', "T\none two"),
        (f'<form id="f"><main>{article}</main></form>', "T\none two"),
        (f'<div class="ad">buy {article}<div>x</div>', "T\none two"),
        (f'<div class="ad"><div>buy</div>{article}<div>x</div></div>', "T\none two"),
        (f'<div><div class="ad"><div>buy</div>{article}</div>', "T\none two"),
        (f'<aside>links<aside>{article}</aside>', "T\none two"),
        ('<article class="post has-sidebar">one</article>', "one"),
        ('<main class="with-nav">one</main>', "one"),
        (f'{article}<div id="comments"><article class="comment-body">nice</article></div>', "T\none two"),
        (f'{article}<aside><article>other</article></aside>', "T\none two"),
        ('<article>one<div class="ad">buy<div>now</div></div>two</article>', "one\ntwo"),
    ):
        assert html_extract.main_text(page, weights) == text, page


def test_unigram_counts(spark, odd, empty):
    with open(PIECES, "rb") as f:
        vocabulary, unknown = unigram.zipf_vocabulary(f.read())
    t = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in unigram.count_tokens(docs, vocabulary).collect():
        assert r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids)
    assert unigram.count_tokens(empty.select("doc_id", "text"), vocabulary).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = tokens(t)
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for size in (3, 4, 5, 6, 9, 20, 60, 80, 250, 300):
        base = [rng.choice(words) for _ in range(size)]
        for k in range(14):
            text = list(base)
            for _ in range(rng.randint(0, 1 + size // 20)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if k % 5 == 4:
                text = text[: max(1, int(size * rng.uniform(0.7, 1)))]
            rows.append((i, " ".join(text)))
            i += 1
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows += [(i + k, passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([5, 30, 100])))) for k in range(30)]
    rows += [(2, "another text of the row with id two and more words"), (5000, None), (5001, ""), (5002, rows[0][1])]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert jaccard.near_duplicates(empty).count() == 0
    assert jaccard.near_duplicates(odd).where("doc_id is null").first()["component_id"] is None
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 10


def test_transport_streams(spark, odd, empty):
    for r in mpegts.media_digests(odd).collect():
        raw = (ODD[r["doc_id"]] if r["doc_id"] is not None else "row without id and some words") or ""
        n, payload = mpegts.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    for n in (1, 63, 64, 65, 168, 176, 184, 185, 8191, 8192, 8193, 50_000):
        payload = mpegts.padded("q" * n)[1]
        media = mpegts.multiplex(payload)
        read = mpegts.demultiplex(media)
        assert read.payload == payload and read.continuity_errors == 0 and read.random_access[0] == 0
        assert read.times == [90_000 + 3600 * k for k in range(read.units)]
    lost = media[: 188 * 10] + media[188 * 11 :]
    assert mpegts.demultiplex(lost).continuity_errors == 1
    stored = mpegts.store_streams(odd.select("doc_id", "text"))
    back = mpegts.read_streams(stored.unionByName(stored.limit(1).withColumn("media", F.lit(b"xx"))))
    assert back.where("error is null").count() == odd.count() and back.where("error is not null").count() == 1
    assert mpegts.media_digests(empty).count() == 0


def test_bpe(spark, odd, empty):
    t = Tokenizer.from_file(BYTE_BPE)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in bpe.bpe_decode(bpe.bpe_encode(docs, BYTE_BPE), BYTE_BPE).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    table = bpe.table_of(open(BYTE_BPE, encoding="utf-8").read())
    rng = random.Random(1)
    letters = list("ab Th  \n\t'sre12,.!é中👍\r \u0085 ") + ["<|endoftext|>", " the", "'re"]
    for _ in range(3000):
        s = "".join(rng.choices(letters, k=rng.randint(0, 25)))
        assert np.frombuffer(table.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids
    assert bpe.bpe_digests(empty, BYTE_BPE).count() == 0


def test_registered_queries():
    assert {n.split("_")[0] for n in queries()} == {f"op{k}" for k in range(1, 14)}


def test_lm_splits_hot_pairs(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("doc_id % 2 = 0")
    whole = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("id") % 10 == 0).collect()}
    monkeypatch.setattr(lm, "TOKENS_PER_SHARD", 100)
    pairs, made = lm._split_pairs, []
    monkeypatch.setattr(lm, "_split_pairs", lambda *a: made.append(pairs(*a)) or made[-1])
    split = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("id") % 10 == 0).collect()}
    assert split == pytest.approx(whole, rel=1e-9) and made[0].count() > 10


CLASH = ["copy", "copies", "rate", "shuffle_key", "text2", "ids", "n_tokens", "media", "payload", "error", "id", "h", "n", "_id", "_h", "shard", "score", "vec", "out"]


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASH})


def own_values(rows, but=()):
    """Whether each row still has its own values in the clashing columns."""
    return all(r[c] == f"own {c} {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASH if c not in but)


def test_clashing_columns(spark, odd, clashing):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    with open(PIECES, "rb") as f:
        vocabulary, _ = unigram.zipf_vocabulary(f.read())
    n = odd.count()
    kept = quality.keep_quality(clashing, labels.where("false")).collect()
    assert len(kept) == n and own_values(kept)
    assert quality.quality_scores(clashing, labels).count() == n
    assert lm.score_texts(clashing.withColumn("id", F.col("doc_id")), F.col("id") % 10 == 0).count() == n
    mixed = mixing.mixed_rows(clashing, {"s": 2.0}, other_weight=1.0)
    assert mixed.columns == clashing.columns and own_values(mixed.collect())
    added = mixing.mix_sources(clashing, {"s": 2.0}, other_weight=1.0).collect()
    assert own_values(added, ("copy", "copies", "rate", "shuffle_key")) and {type(r["copy"]) for r in added} == {int}
    assert sharding.shard_slots(clashing, [1.0] * 3).count() == n and own_values(sharding.assign_shards(clashing, [1.0], out_col="s16").collect())
    assert own_values(unigram.count_tokens(clashing, vocabulary).collect(), ("n_tokens",))
    assert own_values(bpe.bpe_decode(bpe.bpe_encode(clashing, BYTE_BPE), BYTE_BPE).collect(), ("ids",))
    trip = bpe.bpe_round_trip(clashing, BYTE_BPE).collect()
    assert own_values(trip, ("ids",)) and all(r["round_trip"] for r in trip)
    back = mpegts.read_streams(mpegts.store_streams(clashing)).collect()
    assert own_values(back, ("media", "payload", "error")) and all(r["error"] is None for r in back)
    pages = clashing.select("doc_id", *CLASH, F.col("text").alias("html"), F.lit("kept").alias("text"))
    found = html_extract.extract_main_text(pages, html_extract.weights_of({})).collect()
    assert own_values(found) and len(found) == n and found[0]["text"] != "kept"
    groups = jaccard.keep_one(clashing)
    assert groups.columns == clashing.columns and own_values(groups.collect())


def test_repeated_ids(spark):
    a, b = "one two three four five six seven eight", "some other text that is no copy of it at all"
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "w"), (2, a, "z"), (3, b, "v"), (4, None, "u"), (4, None, "t"), (None, a, "s"), (None, a, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(map(tuple, jaccard.keep_one(docs.repartition(3)).collect()), key=str)
    assert kept == sorted([(1, a, "w"), (1, b, "y"), (4, None, "t"), (None, a, "s"), (None, a, "r")], key=str)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    scores = quality.quality_scores(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert len(scores) == len(rows) and len({r["score"] for r in scores if r["doc_id"] == 4}) == 1
    v = [[1.0, 0.0], [1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    near = ann.nearest(spark.createDataFrame([(20, v[0]), (20, v[1]), (20, v[2]), (3, v[3])], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=2).collect()
    # each of the three rows is asked; the two others with its id are candidates
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in near) == sorted([(20, 1, 20, 1.0), (20, 2, 20, 0.9)] * 2 + [(20, 1, 20, 0.9), (20, 2, 20, 0.9)])


def test_hot_groups(spark, monkeypatch):
    """A third of all rows are near copies of one text, and keys, groups and parts are all over their bounds."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(60):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((k, " ".join(text)))
    rows += [(100 + k, " ".join(rng.choice(words) for _ in range(40))) for k in range(60)]
    rows += [(200 + k, " ".join(base[:20] + [rng.choice(words) for _ in range(25)])) for k in range(40)]
    for name, value in (("HEAVY", 5), ("BLOCK", 8), ("ROWS_PER_BUCKET", 64), ("KEYS_PER_BUCKET", 256)):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)


def test_short_sketches_bound_distances():
    rng = np.random.default_rng(4)
    for n in (10, 900, 5000, 30_000):
        s = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        t = np.sort(np.concatenate([s[n // 10 :], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        x, y = (jaccard.parity_bits(v, jaccard.bits_of(n)) for v in (s, t))
        apart = len(np.setxor1d(s, t))
        far = [int(np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum()) for size in (len(x), 512, 64)]
        assert apart >= far[0] >= far[1] >= far[2]


def test_statistics_match_plain_counts():
    texts = ["", "One one TWO, three!\n\nfour five  five 123", "é中 x", "a" * 70 + " b"]
    raw = [t.encode() for t in texts]
    got = quality._statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    names = {name: k for k, name in enumerate(quality.STATISTICS)}
    for text, data, row in zip(texts, raw, got, strict=True):
        w = tokens(text)
        per, size = max(len(w), 1), max(len(data), 1)
        lengths = [len(x.encode()) for x in w] or [0]
        letters = sum(chr(b).isascii() and chr(b).isalpha() for b in data)
        want = {
            "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(w)), "share_3": sum(97 <= b < 123 for b in data) / size, "share_5": sum(48 <= b < 58 for b in data) / size,
            "share_6": sum(b >= 128 for b in data) / size, "word_bytes": sum(lengths) / per, "word_bytes_sd": float(np.std(lengths)), "distinct_words": len(set(w)) / per,
            "same_as_last": sum(x == y for x, y in zip(w, w[1:])) / per, "same_as_last_but_one": sum(x == y for x, y in zip(w, w[2:])) / per, "short_words": sum(0 < n <= 2 for n in lengths) / per,
            "long_words": sum(n >= 12 for n in lengths) / per, "words_per_line": len(w) / (sum(b in b"\n\r" for b in data) + 1), "upper_of_letters": sum(65 <= b < 91 for b in data) / max(letters, 1),
        }
        for name, value in want.items():
            assert row[names[name]] == pytest.approx(value, abs=1e-5), (name, text)


def test_trees_choose_the_best_split():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3)).astype(np.float32)
    y = (x[:, 1] > 0.3).astype(float)
    f = quality.fit_trees(x, y, trees=1, depth=1)
    share = (y.sum() + 1) / (len(y) + 2)
    grad, curve = y - share, share * (1 - share)

    def gain(j, cut):
        left = x[:, j] <= cut
        g, c = [grad[s].sum() for s in (left, ~left)], [curve * s.sum() for s in (left, ~left)]
        return sum(a * a / (b + 1.0) for a, b in zip(g, c)) - grad.sum() ** 2 / (curve * len(y) + 1.0)

    cuts = [(j, c) for j in range(3) for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1]).astype(np.float32))]
    best = max(gain(j, c) for j, c in cuts)
    assert gain(int(f.feature[0, 0]), f.threshold[0, 0]) == pytest.approx(best)


def test_maximum_run_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        values = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 14))]
        a, b = html_extract.best_run(values)
        sums = [sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
        assert sum(values[a:b]) == max([0.0, *sums])


def test_html_weights_decide(spark):
    """Pages whose articles aren't marked and whose classes and elements say nothing: only learned weights find the text."""
    pages = [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    plain = html_extract.weights_of({})

    def renamed(page):
        for old, new in (("<nav>", '<div class="k1">'), ("</nav>", "</div>"), ('class="ad"', 'class="k2"'), ("<footer>", '<div class="k3">'), ("</footer>", "</div>")):
            page = page.replace(old, new)
        return page

    within, without = Counter(), Counter()
    half = len(pages) // 2
    for page in pages[:half]:
        html_extract.count_page(renamed(page), within, without)
    learned = html_extract.weights_of({k: (within[k], without[k]) for k in {*within, *without}})
    held = [(html_extract.main_text(p, plain), re.sub("</?article>", "", renamed(p))) for p in pages[half:]]
    right = lambda weights: np.mean([html_extract.main_text(p, weights) == t for t, p in held])
    no_scan = np.mean([html_extract.blocks_text(html_extract.tokens(p, plain)) == t for t, p in held])
    assert right(learned) >= 0.9 and right({k: -v for k, v in learned.items()}) < 0.1 and right(plain) < 0.1 and no_scan < 0.1


def test_html_is_linear():
    import time

    for page in ("<a " * 350_000, "<script " * 60_000 + "<!--" * 60_000, '<a "' * 250_000 + ">", "<div class=ad>" * 60_000, "<article>" * 50_000 + "</main>" * 50_000, "<p " * 200_000 + ">x"):
        began = time.time()
        html_extract.main_text(page, html_extract.weights_of({}))
        assert time.time() - began < 5


def test_long_texts_are_whole(spark):
    """One text of a megabyte, with and without blanks, through the operators that remember words."""
    texts = ["x" * 200_000 + " y", "lorem ipsum " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(BYTE_BPE)
    for r in bpe.bpe_round_trip(docs, BYTE_BPE).collect():
        assert r["round_trip"] and np.frombuffer(r["ids"], "<u4").tolist() == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    table = bpe.table_of(open(BYTE_BPE, encoding="utf-8").read())
    assert all(len(k) <= bpe.LONGEST for k in table.groups)
    back = mpegts.read_streams(mpegts.store_streams(docs)).collect()
    assert all(r["payload"].startswith(texts[r["doc_id"]].encode()) for r in back)


def test_damaged_streams(spark):
    rng = random.Random(2)
    whole = mpegts.multiplex(mpegts.padded("some text " * 900)[1])
    damaged = []
    for _ in range(300):
        raw = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        damaged.append(bytes(raw[: 188 * rng.randint(1, len(raw) // 188)]))
    rows = spark.createDataFrame([(i, m) for i, m in enumerate([None, b"", b"G" * 188, *damaged])], "i int, media binary")
    assert mpegts.read_streams(rows).count() == len(damaged) + 3


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}
    ids = sorted(x)
    m = np.array([x[i] for i in ids])
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("id") % 20 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in got:
        s = m @ x[q]
        want = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:20]
        recall.append(len(got[q] & {ids[i] for i in want}) / 20)
    assert len(got) == sum(i % 20 == 0 for i in ids) and np.mean(recall) >= 0.9


def test_ann_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 7)
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = ann.nearest(df, F.col("id") % 20 == 0).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {20} and len(got) == df.where("vec_id % 20 = 0").count()
