"""The training-data pipeline: five stages over ``documents``, each on what the one before kept.

Null and empty texts have no words and are rejected by the quality rules. Rows with a null id are never near copies of
others; rows that repeat an id stay or go together where duplicates are concerned and are judged by their own texts
elsewhere. Rows equal in every respect are kept as often as they come, save where one is a copy of another. A null
source, language or length is a value of its own. Columns beyond those of ``documents`` are carried along; the last
stage gives one that has the name of a column it adds the prefix ``input_``. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.llm import decontaminate, line_rules, mixing, near_dup, shards
from hearthlog.session import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail them; ``n_chars`` is counted anew."""
    cleaned = line_rules.clean(line_rules.keep(docs))
    kind = cleaned.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.char_length("text").cast(kind))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class (five-word shingles, similarity 0.8)."""
    return near_dup.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to twice as often as large ones."""
    return mixing.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed rows with their shard and slot along the Hilbert curve of source, language and length."""
    for name in ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"):
        if name in docs.columns:
            free = f"input_{name}"
            while free in docs.columns:
                free = f"input_{free}"
            docs = docs.withColumnRenamed(name, free)
    carried = [c for c in docs.columns if c != "doc_id"]
    return shards.shard(docs, carry=carried).drop("law", "grown_shard")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("sharding", sharding),
]

# Permutation-free set algebra cannot express the curve's tie order; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are staged once for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
