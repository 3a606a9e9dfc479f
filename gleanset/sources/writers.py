"""Sinks: three-way split, error table, appends, labelled and CSV exports, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.functions.scalars import iso_text, second_text
from gleanset.plans.cleaning import CleaningResult, with_error_text


def write_split(result: CleaningResult, path: str) -> None:
    """cleaned, invalid and removed rows in one pass, one folder per outcome.

    An outcome without rows gets no folder.
    """
    rows = with_error_text(result.classified).withColumn("outcome", F.col("__outcome")).drop("__errors", "__outcome")
    rows.write.mode("overwrite").partitionBy("outcome").parquet(path)


def write_errors(result: CleaningResult, path: str) -> None:
    """The long error table, one folder per rule."""
    result.errors.write.mode("overwrite").partitionBy("rule").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def run_log(result: CleaningResult, user_id: int, file: str, as_of: str, rules: list[str]) -> DataFrame:
    """One activity row of a cleaning run; empty counters are NULL."""
    # one entry per rule
    pairs = F.array_sort(F.collect_list(F.struct("rule", "n")))
    counts = result.rule_counts.agg(F.when(F.size(pairs) > 0, F.to_json(F.map_from_entries(pairs)))).scalar()
    return result.summary.select(
        F.lit(user_id).alias("user_id"),
        F.lit(f"Cleaned file {file} using rules: {', '.join(rules)}").alias("action"),
        "total_rows", F.col("clean_rows").alias("valid_rows"), "invalid_rows",
        F.col("duplicate_rows_removed").alias("removed_rows"),
        (F.to_json(F.array(*map(F.lit, rules))) if rules else F.lit(None)).cast("string").alias("rules_applied"),
        counts.alias("rule_counts"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )


def _yes(c: str) -> Column:
    return F.when(F.col(c) == 1, "Yes").otherwise("No")


def _dashes(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("--"))


def label_logs(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Activity export of all rows; with ``most``, of the newest so many, newest first."""
    chosen = rows if most is None else rows.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    return chosen.select(
        F.col("id").alias("Log ID"), F.col("username").alias("Username"), F.col("action").alias("Action Performed"),
        F.col("total_rows").alias("Total Rows"), iso_text(F.col("created_at")).alias("Timestamp"),
    )


def label_uploads(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("Log ID"), F.col("username").alias("Uploaded By"), F.col("filename").alias("Original Filename"),
        second_text(F.col("uploaded_at")).alias("Uploaded At"), F.col("total_rows").alias("Total Rows"),
        F.col("rows_imported").alias("Rows Imported"), F.col("rows_rejected").alias("Rows Rejected"), F.col("status").alias("Status"),
    )


def label_fields(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("Field ID"), F.col("field_name").alias("Display Name"),
        F.col("normalized_name").alias("Normalized Name"), F.col("usage_count").alias("Usage Count"),
    )


def label_aliases(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("Alias ID"), F.col("alias").alias("Header Alias"), F.col("target_type").alias("Target System Layer"),
        F.col("target_identifier").alias("Mapped Identifier"),
    )


def label_users(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("User ID"), F.col("username").alias("Username"), F.col("role").alias("Role"),
        _yes("is_active").alias("Is Active"), _dashes("manager_id").alias("Manager ID"),
    )
