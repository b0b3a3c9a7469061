"""One registered query per operator, applied to its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchhouse.llm import rule_cascade
from watchhouse.llm.common import table


def _tokenizer(name: str) -> str:
    return import_module("public_tokenizers").path(name)


def op1_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the factorisation machine."""
    from watchhouse.llm import quality_fm as fm

    docs = table(spark, sf_dir, "documents")
    model = fm.train(docs, table(spark, sf_dir, "labels"))
    read = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
    return fm.score(read, model).select("doc_id", fm.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of nearly equal bytes."""
    from watchhouse.llm.histogram_sort import shard_documents

    found = shard_documents(table(spark, sf_dir, "documents"), 24, ["doc_id"])
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed along a Hilbert curve into sequences of 1024 tokens."""
    from watchhouse.llm.curve_pack import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 1024)


def op4_shifted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    from watchhouse.llm.curve_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    from watchhouse.llm.license_vote import vote

    return vote(table(spark, sf_dir, "documents"))


def op6_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from watchhouse.llm.page_difference import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, encoded and decoded exactly."""
    from watchhouse.llm.prefix_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by the Jaccard similarity of their five-word shingles."""
    from watchhouse.llm.jaccard_join import components

    return components(table(spark, sf_dir, "documents"))


def op9_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return rule_cascade.judge(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a string of 200 bytes found elsewhere, removed."""
    from watchhouse.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned over the bytes of every document."""
    from watchhouse.llm.token_align import align_documents

    found = align_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def op12_zone_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh label is moved on by one first."""
    from watchhouse.llm.zone_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_grid_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-equal vectors of one label."""
    from watchhouse.llm.grid_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_ZONE_NEGATIVES_SQL = f"""
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
    FROM u a JOIN u c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3"""
_GRID_DEDUP_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND {_WHOLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over the documents."""
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_factor_quality, op2_histogram_shards, op3_curve_packing, op4_shifted_curves, op5_license_diagonals,
        op6_page_difference, op7_prefix_bpe, op8_ngram_jaccard, op9_rule_cascade, op10_suffix_dedup,
        op11_token_alignment, op12_zone_negatives, op13_grid_near_dedup, pipeline)
}
SQL = {name: " ".join(line.strip() for line in sql.strip().splitlines()) for name, sql in (
    ("op9_rule_cascade", rule_cascade.ORACLE_SQL), ("op12_zone_negatives", _ZONE_NEGATIVES_SQL), ("op13_grid_near_dedup", _GRID_DEDUP_SQL))}
