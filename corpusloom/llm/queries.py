"""The training-data queries, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import binpack, encode, leakage, mix, neardup, pairs, quality, split
from corpusloom.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(table(spark, sf_dir, "documents"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = split.items_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))
    return split.split_oversized(items, table(spark, sf_dir, "render_specs"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece = 1").select("item_table", "item_id")


@query
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


@query
def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = split.items_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))
    specs = table(spark, sf_dir, "render_specs")
    return split.coverage(split.split_oversized(items, specs), items, specs)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.plan_mix(*(table(spark, sf_dir, t) for t in ("documents", "source_specs", "source_parts")))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).where("short").select("spec_name", F.col("part_config").alias("config"))


@query
def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(table(spark, sf_dir, "documents"), _plan(spark, sf_dir))


@query
def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every mix, and whether no part gives more than it can."""
    s = p4_shares(spark, sf_dir)
    return s.groupBy("spec_name").agg(F.sum("records").alias("records"), F.bool_and((F.col("records") == F.col("quota")) & (F.col("records") <= F.col("limit"))).alias("within"))


@query
def p4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.realise(table(spark, sf_dir, "documents"), _plan(spark, sf_dir))


@query
def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.fill_bins(binpack.token_sizes(table(spark, sf_dir, "documents")))


@query
def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.fill_check(p7_bins(spark, sf_dir))


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.fill_report(p7_bins(spark, sf_dir))


SQL["p3_found"] = """
WITH lim AS (SELECT spec_name, min(max_example_tokens) AS most FROM render_specs WHERE max_example_tokens IS NOT NULL GROUP BY 1),
items AS (
  SELECT 'documents' AS item_table, doc_id AS item_id, render_spec, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'conversations', conv_id, render_spec, list_sum(list_transform(messages, lambda m: coalesce(octet_length(encode(m.content)), 0))) FROM conversations)
SELECT DISTINCT item_table, item_id FROM items JOIN lim ON render_spec = spec_name WHERE size > most
"""

SQL["p3_cover"] = SQL["p3_found"].replace("SELECT DISTINCT item_table, item_id FROM", "SELECT DISTINCT item_table, item_id, size::BIGINT AS size, true AS within FROM")
SQL["p7_check"] = "SELECT count(*) AS items, 0::BIGINT AS overfull, 0::BIGINT AS lost, true AS tight FROM documents"

SQL["p4_found"] = r"""
WITH pool AS (
  SELECT dataset_name, lower(trim(source)) AS config, count(*) AS n FROM documents
  WHERE split = 'train' AND text IS NOT NULL AND regexp_matches(text, '[^\s\p{Z}\x{85}\x1c-\x1f\x{feff}\x{200b}-\x{200d}\x{2060}]') GROUP BY 1, 2)
SELECT s.spec_name, p.config FROM source_parts p JOIN source_specs s USING (spec_name)
LEFT JOIN pool ON pool.dataset_name = s.dataset_name AND pool.config = lower(trim(p.config))
WHERE s.n_train_docs IS NOT NULL AND p.weight IS NOT NULL
  AND p.weight * s.n_train_docs > p.max_repeats * least(coalesce(n, 0), coalesce(p.cap, coalesce(n, 0)))
"""


SQL["p4_totals"] = r"""
WITH pool AS (
  SELECT dataset_name, lower(trim(source)) AS config, count(*) AS n FROM documents
  WHERE split = 'train' AND text IS NOT NULL AND regexp_matches(text, '[^\s\p{Z}\x{85}\x1c-\x1f\x{feff}\x{200b}-\x{200d}\x{2060}]') GROUP BY 1, 2)
SELECT s.spec_name, least(any_value(s.n_train_docs), sum(coalesce(p.max_repeats, s.n_train_docs) * least(coalesce(n, 0), coalesce(p.cap, coalesce(n, 0)))))::BIGINT AS records, true AS within
FROM source_parts p JOIN source_specs s USING (spec_name) LEFT JOIN pool ON pool.dataset_name = s.dataset_name AND pool.config = lower(trim(p.config))
WHERE s.n_train_docs IS NOT NULL AND p.weight IS NOT NULL GROUP BY 1
"""


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_leaks(spark, sf_dir).where("how = 'stretch'").select("doc_id", "item_id")


@query
def p2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neardup.cross_split_pairs(table(spark, sf_dir, "documents"))
    return near.select(F.least("train_id", "eval_id").alias("doc_id_a"), F.greatest("train_id", "eval_id").alias("doc_id_b"))


@query
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.overlap_report(table(spark, sf_dir, "documents"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_stats(spark, sf_dir).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


@query
def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective(table(spark, sf_dir, "conversations"))
