"""Shared by the plan modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return rounded(F.col(c) if isinstance(c, str) else c)


def q6(x: str) -> str:
    """The SQL of r6."""
    return f"(CASE WHEN round({x}, 6) = 0 THEN 0.0::DOUBLE ELSE round({x}, 6) END)"


def score(c: str = "props") -> Column:
    """Nested score of an event; null where the path is missing or not a number."""
    return F.try_to_number(F.get_json_object(c, "$.k"), F.lit("999999999999")).cast("double")


SCORE = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)"
