"""The queries opN_<name> over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import katz, neardup, packing, pieces, secrets, sharding, toxicity, vectors
from .common import documents


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; BRIGHTFOLD_TOKENIZERS names another folder."""
    if folder := os.environ.get("BRIGHTFOLD_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.findings(spark))
    found = secrets.scan(documents(spark, sf_dir), forest)
    return found.select("doc_id", "start", "length", F.crc32(F.col("candidate")).alias("candidate_crc32"), "score", "is_secret")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(neardup.numbered(documents(spark, sf_dir)), k=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws
         ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.d = doc_id
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(documents(spark, sf_dir))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), added=True)


def op7_approximate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    return pieces.digest(pieces.encode(documents(spark, sf_dir), path), path)


#: Bytes a shard may hold in op9.
SHARD_BYTES = 1 << 20


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.with_sizes(sharding.assign(documents(spark, sf_dir), SHARD_BYTES))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, COALESCE(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT), 60, '0') AS k
  FROM documents),
b AS (
  SELECT depth, substr(k, 1, depth) AS p, sum(n_bytes) AS s, min(k) = max(k) AS one
  FROM d, range(0, 61) t(depth) GROUP BY ALL),
leaf AS (
  SELECT d.doc_id, d.n_bytes, d.k, min(b.depth)::INTEGER AS depth
  FROM d JOIN b ON b.p = substr(d.k, 1, b.depth) WHERE b.s <= {SHARD_BYTES} OR b.one GROUP BY ALL)
SELECT doc_id, n_bytes, substr(k, 1, depth) AS shard, depth, 0::BIGINT AS page,
       sum(n_bytes) OVER (PARTITION BY substr(k, 1, depth))::BIGINT AS shard_bytes,
       count(*) OVER (PARTITION BY substr(k, 1, depth)) AS shard_rows
FROM leaf
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_near_duplicates, op3_toxicity, op4_katz_scores, op5_exact_top_k, op6_best_fit_packing, op7_approximate_nearest, op8_piece_encoding, op9_extendible_sharding, op10_token_counts)}
SQL: dict[str, str] = {"op2_near_duplicates": OP2_SQL, "op5_exact_top_k": OP5_SQL, "op9_extendible_sharding": OP9_SQL}
