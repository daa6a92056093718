"""The named queries of this package: each applies its operator to a whole table of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthlog.llm import (
    decontaminate,
    infill,
    line_rules,
    lm,
    merkle,
    mixing,
    near_dup,
    secrets,
    set_join,
    shards,
    site_tree,
    spans,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(_table(spark, sf_dir, "pages"))


def op9_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(_table(spark, sf_dir, "documents"))


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_minmax_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"), shingle=2)


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.repeated_runs(_table(spark, sf_dir, "documents"), by_words=True)
    return found.withColumnRenamed("first_id", "first_doc_id")


def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.permutations(_table(spark, sf_dir, "documents"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op11_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.classes(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.infill(_table(spark, sf_dir, "documents")))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {
        "op1_warc_salvage": op1_warc_salvage,
        "op2_minmax_near_dup": op2_minmax_near_dup,
        "op3_attention_lm": op3_attention_lm,
        "op4_sentence_spans": op4_sentence_spans,
        "op5_temperature_mix": op5_temperature_mix,
        "op6_secret_ownership": op6_secret_ownership,
        "op7_hilbert_shards": op7_hilbert_shards,
        "op8_site_style_tree": op8_site_style_tree,
        "op9_simhash_leaks": op9_simhash_leaks,
        "op10_line_rules": op10_line_rules,
        "op11_partition_join": op11_partition_join,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_infill": op13_infill,
    }
