"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import cover_tree, line_dedup, mixing, nearest, packing, simhash_dedup, suffix_dedup, token_files, toxicity, warc
from tidelens.llm._shared import scratch, table


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), cos=0.93)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, with_ids=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(spark, folder, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.marked_lines(docs.select("doc_id", "text"), distance=None).withColumnRenamed("__gone", "gone")
    return out.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.transform(F.array_sort("gone"), lambda x: x.cast("string")), ","), F.lit("")).alias("removed"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), machine, "score")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeats(table(spark, sf_dir, "documents"), length=400, keep="none")
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cover_tree": op1_cover_tree,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_toxicity": op5_toxicity,
    "op6_nearest": op6_nearest,
    "op7_token_files": op7_token_files,
    "op8_suffix_repeats": op8_suffix_repeats,
    "op9_pareto_mix": op9_pareto_mix,
    "op10_simhash": op10_simhash,
}

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, ''))) AS name, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), a AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (WHERE size > 0) AS docs FROM d GROUP BY source
), b AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS cap FROM a
), c AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM b
), e AS (
  SELECT *, max(CASE WHEN lev * weight <= cap THEN lev END) OVER () AS l FROM c
), f AS (
  SELECT source, source_size, docs, least(cap, coalesce(l * weight, cap)) AS target FROM e
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM f
), h AS (
  SELECT *, target - CAST(whole * source_size AS DOUBLE) AS rest FROM g
), i AS (
  SELECT *, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0.0::DOUBLE END AS part FROM h
), j AS (
  SELECT d.doc_id, d.size, i.source, i.source_size, i.target, i.whole, i.rest,
    (CAST(('0x' || substr(md5('7:' || d.name), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
    CASE WHEN i.part < 1 THEN i.part / (1.0::DOUBLE - i.part) END AS odds, CASE WHEN i.docs > 0 THEN CAST(i.source_size AS DOUBLE) / i.docs END AS mean
  FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source
), k AS (
  SELECT *, CASE WHEN size > 0 AND rest > 0 THEN (u / (1.0::DOUBLE - u)) / (odds * sqrt(size / mean)) END AS rank FROM j
), m AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total,
    sum(size) OVER (PARTITION BY source, rank) AS peers FROM k WHERE rank IS NOT NULL
), picked AS (
  SELECT source, max(rank) AS cut FROM m WHERE total - peers / 2.0::DOUBLE <= rest GROUP BY source
)
SELECT k.doc_id, k.size, k.source_size, k.target,
  CAST((k.whole + CASE WHEN k.rank <= picked.cut THEN 1 ELSE 0 END) * k.size AS BIGINT) AS taken
FROM k LEFT JOIN picked ON k.source IS NOT DISTINCT FROM picked.source
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), r AS (
  SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS response FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> response THEN response END AS refers_to FROM r
"""

SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op9_pareto_mix": OP9_SQL}
