"""Dense codes for sorted distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import UNKNOWN
from basketry.operators.skew import HOT_ROWS, running_total


def vocabulary(df: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(value, code) with code 0 for the first value in sort order; null counts as 'unknown'."""
    values = df.select(F.coalesce(column, F.lit(UNKNOWN)).alias("value")).distinct().withColumn("_all", F.lit(0))
    numbered = running_total(values, ["_all"], ["value"], F.lit(1), "_seq", hot_rows)
    return numbered.select("value", (F.col("_seq") - 1).cast("bigint").alias("code"))


def dense_index(df: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(column, position) from 0 in value order, for drawing rows by number."""
    values = df.select(column).distinct().withColumn("_all", F.lit(0))
    numbered = running_total(values, ["_all"], [column], F.lit(1), "_seq", hot_rows)
    return numbered.select(column, (F.col("_seq") - 1).cast("bigint").alias("position"))


def encoded(df: DataFrame, column: str, vocab: DataFrame, name: str) -> DataFrame:
    """Code of each value; values the vocabulary lacks get 0."""
    codes = vocab.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    key = F.coalesce(F.col(column), F.lit(UNKNOWN))
    joined = df.join(codes, key == F.col("_value"), "left")
    return joined.withColumn(name, F.coalesce("_code", F.lit(0))).drop("_value", "_code")
