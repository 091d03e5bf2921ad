"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm import secrets

    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.samples(spark)))
    joined = {k: F.array_join(k, ",") for k in ("base_spans", "all_spans")}
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined["base_spans"], 256).alias("base_sha256"), joined["all_spans"].alias("spans"), "n_markov")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    weights = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_trees(chat.chains(rows.unionByName(more))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm.lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: The same targets, keys and prefix sums, over whole sources.
OP9 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    coalesce(greatest(0.25, 1 - 4 * (length(text) - length(translate(text, '#*$%&|<>', ''))) / nullif(length(text), 0)), 0.25) AS q,
    (CAST(CAST('0x' || substr(sha256('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM d GROUP BY source),
lv AS (
  SELECT *, (1.5 * sum(source_size) OVER () - (sum(2.0 * source_size) OVER r - 2.0 * source_size)) / (sum(w) OVER () - (sum(w) OVER r - w)) AS lvl
  FROM s WINDOW r AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size, round(least(2.0 * source_size, w * (SELECT lvl FROM lv WHERE lvl * w <= 2.0 * source_size ORDER BY 2.0 * source_size / w LIMIT 1)), 6) AS target FROM lv),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t)
SELECT d.doc_id, d.size, g.source_size, g.target,
  CAST(d.size * (whole + CASE WHEN sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_mix_sources": OP9}
