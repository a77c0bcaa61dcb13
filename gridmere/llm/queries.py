"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmere.llm import contamination, licences, lines, negatives, passages, quality, shards, simhash, toxicity
from gridmere.llm.packing import pack_documents
from gridmere.llm.prefix_trie import oracle_sql as prefix_trie_sql
from gridmere.llm.prefix_trie import prefix_trie
from gridmere.llm.suffix_arrays import repeated_strings
from gridmere.llm.token_files import token_rows

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminations(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.REJECT_AT).cast("int").alias("predicted"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return shards.shuffle_into_shards(table(spark, sf_dir)).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir), BYTE_BPE, end_id=2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_frequent_lines(table(spark, sf_dir)).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir), BYTE_BPE)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), is_anchor=F.col("id") % 100 == 0, relabel=relabel
    )


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_license_scan, op3_quality_rules, op4_benchmark_decontamination,
        op5_toxicity, op6_substring_dedup, op7_sharding, op8_token_files, op9_line_dedup, op10_best_fit_packing,
        op11_prefix_trie, op12_hard_negatives, op13_suffix_array_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op2_license_scan": licences.oracle_sql(),
    "op3_quality_rules": quality.oracle_sql(),
    "op11_prefix_trie": prefix_trie_sql(),
    "op12_hard_negatives": negatives.oracle_sql(),
    "op9_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, i AS line_no, lines[i] AS line,
                   translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
        ),
        frequent AS (
            SELECT line_key, max(doc_id) AS last_doc FROM split WHERE length(line_key) >= 40
            GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
        )
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE last_doc IS NOT NULL AND last_doc <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no)
                               FILTER (WHERE last_doc IS NULL OR last_doc = doc_id), '')) AS kept_sha256
        FROM split LEFT JOIN frequent USING (line_key) GROUP BY doc_id
    """,
}
