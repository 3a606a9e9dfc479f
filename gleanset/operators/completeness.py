"""Missing counts per column and the completeness of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.functions.scalars import percent
from gleanset.functions.text import empty


def missing_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, total, percentage): one aggregate for all columns."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(empty(F.col(f"`{c}`").cast("string"))).alias(f"__{i}") for i, c in enumerate(columns)],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("missing")) for i, c in enumerate(columns)])
    return counted.select("total", F.inline(cells)).select(
        "column", "missing", "total", percent(F.col("missing"), F.col("total")).alias("percentage")
    )


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing and filled cells per column with percentages."""
    filled = F.col("total") - F.col("missing")
    return missing_stats(df, columns).select(
        "column", F.col("missing").alias("missing_count"), filled.alias("filled_count"),
        F.col("percentage").alias("missing_percentage"), F.round(100.0 - F.col("percentage"), 1).alias("complete_percentage"),
    )


def overall_completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: records, fields, mean completeness, columns at least 25 % missing."""
    return completeness(df, columns).agg(
        F.max(F.col("missing_count") + F.col("filled_count")).alias("total_records"),
        F.count(F.lit(1)).alias("total_fields"),
        F.round(F.avg("complete_percentage"), 1).alias("overall_health_score"),
        F.count_if(F.col("missing_percentage") >= 25.0).alias("needs_attention_count"),
    )
