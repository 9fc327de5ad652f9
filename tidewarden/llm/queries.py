"""The registered queries of this package and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.session import shared_dir
from tidewarden.llm import ann, bpe, codes, html_extract, jaccard, lm, merkle, mixing, mpegts, quality, sharding, token_files, unigram

#: Public tokenizer files.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc_of_id(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels with remainder 1 are held out (a null id isn't)."""
    scores = quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn_from=_crc_of_id(3) != 1)
    held_out = F.coalesce(_crc_of_id(3) == 1, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a trigram model of those that aren't held out."""
    return lm.score_texts(_table(spark, sf_dir, "documents"), held_out=_crc_of_id(10) == 0)


#: Target weights of the sources; a source that isn't named has weight 1 with all others.
MIX_WEIGHTS = {f"src{k}": 4.0 if k == 0 else 1.0 for k in range(20)}


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights, with their texts, shuffled."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, other_weight=1.0)
    return mixed.select("doc_id", "source", "text", "copies", "copy", "shuffle_key")


_U = "(('0x' || substr(md5({0}), 1, 13))::BIGINT)::DOUBLE"

OP3_SQL = f"""
WITH weights AS (
  SELECT 'src' || k AS s, CASE WHEN k = 0 THEN 4.0 ELSE 1.0 END::DOUBLE AS w FROM range(20) t(k) UNION ALL SELECT NULL, 1.0
), docs AS (
  SELECT d.*, CASE WHEN source IN (SELECT s FROM weights WHERE s IS NOT NULL) THEN source END AS g FROM documents d
), sizes AS (
  SELECT g, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS b FROM docs GROUP BY g
), rates AS (
  SELECT g, (w / sum(w) OVER ()) * (sum(b) OVER ()) / b AS rate FROM sizes JOIN weights ON g IS NOT DISTINCT FROM s
), counted AS (
  SELECT doc_id, source, text, rate,
    {_U.format("concat_ws('|', 'mix', '0', coalesce(doc_id::VARCHAR, ''))")} / 4503599627370496.0 AS u
  FROM docs JOIN rates ON docs.g IS NOT DISTINCT FROM rates.g
), terms AS (
  SELECT g, k, sum(p) OVER (PARTITION BY g ORDER BY k) AS upto
  FROM (SELECT g, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 120) t(k))
), copies AS (
  SELECT doc_id, source, text, u, (SELECT count(*) FROM terms WHERE terms.g IS NOT DISTINCT FROM (CASE WHEN source IN (SELECT s FROM weights WHERE s IS NOT NULL) THEN source END) AND upto <= u)::INT AS copies
  FROM counted
)
SELECT doc_id, source, text, copies, copy::INT AS copy,
  md5(concat_ws('|', 'mix', 'order', coalesce(doc_id::VARCHAR, ''), copy::VARCHAR)) AS shuffle_key
FROM copies, LATERAL (SELECT unnest(range(0, copies)) AS copy) t
"""


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 by the key law, with slots and the shard among 17."""
    slots = sharding.shard_slots(_table(spark, sf_dir, "documents"), [1.0] * 16)
    return slots.withColumn("law", F.lit("key"))


OP4_SQL = f"""
WITH table_of AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), scored AS (
  SELECT doc_id, text, coalesce(doc_id::VARCHAR, '') AS key, s,
    1.0 / -ln(({_U.format("concat_ws('|', 'shard', s::VARCHAR, coalesce(doc_id::VARCHAR, ''))")} + 0.5) / 4503599627370496.0) AS score
  FROM documents, range(17) t(s)
), best AS (
  SELECT doc_id, any_value(text) AS text, any_value(key) AS key,
    arg_max(s, score) FILTER (WHERE s < 16) AS shard, arg_max(s, score) AS grown_shard
  FROM scored GROUP BY doc_id
), rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, shard, grown_shard,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    ('0x' || substr(md5(concat_ws('|', 'shard', 'stripe', key)), 1, 6))::BIGINT % 64 AS stripe
  FROM best, table_of
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY stripe, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM rows
"""


def op5_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), is_query=F.col("id") % 20 == 0)


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    found = html_extract.extract_main_text(pages, html_extract.learn_weights(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the piece vocabulary with Zipf scores."""
    with open(PIECES, "rb") as f:
        vocabulary, _ = unigram.zipf_vocabulary(f.read())
    return unigram.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens")


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (Jaccard of word 5-grams 0.75 or more)."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a transport stream and read back, as digests."""
    return mpegts.media_digests(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and what decoding them gives, as digests."""
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language; where 3 divides the id's checksum the text is lower-cased for the folded root."""
    documents = _table(spark, sf_dir, "documents")
    return merkle.merkle_manifest(documents, ["doc_id", "source", "lang", "n_chars", "text"], _crc_of_id(3) == 0, {"text": merkle.ascii_lower(F.col("text"))})


#: Levels of a language's tree and of the tree of languages that the SQL spells out: 8 ** 7 rows and 8 ** 3 languages.
_LEVELS, _TOP_LEVELS = 7, 3


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """Nodes of each level ``name_k`` and their runs ``name_k_runs``; a group with one node left carries it on."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT g, pos, d, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(levels):
        steps.append(f"{name}_{k}_runs AS MATERIALIZED (SELECT g, pos // 8 AS run, list(d ORDER BY pos) AS ds, any_value(n) AS n FROM {name}_{k} GROUP BY ALL)")
        steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT g, run AS pos, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, count(*) OVER (PARTITION BY g) AS n FROM {name}_{k}_runs)")
    return ",\n".join(steps)


def _way_sql(name: str, start: str, levels: int) -> str:
    """Proof and folded digest of each row of ``start`` (r, g, pos, proof, fold), level by level."""
    steps, last = [], start
    for k in range(levels):
        i = "(pos % 8)::INT"
        left, right = f"array_to_string(ds[1:{i}], '')", f"array_to_string(ds[{i} + 2:], '')"
        alone = "n = 1"
        steps.append(
            f"{name}_way_{k} AS (SELECT r, w.g, pos // 8 AS pos, CASE WHEN {alone} THEN proof ELSE proof || {left} || {right} END AS proof, "
            f"CASE WHEN {alone} THEN fold ELSE sha256({left} || fold || {right}) END AS fold FROM {last} w JOIN {name}_{k}_runs t ON w.g = t.g AND w.pos // 8 = t.run)"
        )
        last = f"{name}_way_{k}"
    return ",\n".join(steps)


def _leaf_sql(text: str) -> str:
    field = "coalesce(strlen({0}) || ':' || {0}, '-')"
    return "sha256(" + " || ".join(field.format(f"({c})::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11_SQL = f"""
WITH table_of AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("text")} AS d,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0
      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents, table_of
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d, r) - 1 AS pos FROM rows
),
{_tree_sql("low", "leaves", _LEVELS)},
groups AS MATERIALIZED (SELECT '' AS g, g AS key, row_number() OVER (ORDER BY g) - 1 AS pos, d FROM low_{_LEVELS}),
{_tree_sql("top", "groups", _TOP_LEVELS)},
begun AS (SELECT r, g, pos, '' AS proof, coalesce(other, d) AS fold FROM leaves),
{_way_sql("low", "begun", _LEVELS)},
above AS (SELECT r, '' AS g, q.pos, proof, fold FROM low_way_{_LEVELS - 1} w JOIN groups q ON w.g = q.key),
{_way_sql("top", "above", _TOP_LEVELS)}
SELECT doc_id, l.d AS leaf, q.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.d AS verified
FROM leaves l JOIN groups q ON l.g = q.key JOIN top_way_{_TOP_LEVELS - 1} w USING (r), top_{_TOP_LEVELS} t
"""


#: The id that ends a document.
END_ID = 2


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as token-id files and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, BYTE_BPE, END_ID)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 4 parts, 256 entries, 4 rounds."""
    return codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def _round_sql(k: int, last: bool) -> str:
    nearest = f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, label, p, x, best.e AS e, best.d AS d FROM (
    SELECT vec_id, label, p, any_value(x) AS x, min({{'d': xx - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS best
    FROM parts JOIN c{k} USING (p) GROUP BY vec_id, label, p)
)"""
    moved = f"""
c{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (
    SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (
      SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, size + 1)) AS i FROM size_of) GROUP BY ALL) GROUP BY ALL
  ) m USING (p, e)
)"""
    return nearest if last else nearest + "," + moved


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), size_of AS (SELECT len(v) // 4 AS size FROM kept LIMIT 1
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * size + 1 : p * size + size] AS x, list_inner_product(x, x) AS xx FROM kept, size_of, range(4) t(p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
), {",".join(_round_sql(k, k == 4) for k in range(5))},
whole AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c4)) AS codebooks_sha256
FROM whole
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_trees, op2_trie_lm, op3_poisson_mix, op4_rendezvous_shards, op5_collision_ann, op6_html_main_text, op7_unigram_counts, op8_parity_join, op9_transport_streams, op10_bpe, op11_merkle_manifest, op12_token_files, op13_vector_codes]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_poisson_mix": OP3_SQL, "op4_rendezvous_shards": OP4_SQL, "op11_merkle_manifest": OP11_SQL, "op13_vector_codes": OP13_SQL}
