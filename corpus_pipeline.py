"""The corpus pipeline: quality rules, language identification, exact dedup, near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, op02_language, op05_packing, op07_quality, op08_exact, op10_minhash

#: (name, function); each function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("quality_rules", op07_quality.stage),
    ("language_id", op02_language.stage),
    ("exact_dedup", op08_exact.stage),
    ("minhash_dedup", op10_minhash.stage),
    ("best_fit_packing", op05_packing.stage),
]

#: The cascade is plain SQL, but code lengths, sketches and evolved packings are not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before kept, written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = common.materialise(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
