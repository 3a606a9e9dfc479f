"""Exact and fuzzy duplicates, standalone dedup, golden records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions.keys import fuzzy_text, letter_bound, normalized, similarity, similarity_bound
from gleanset.operators.skew import HOT_ROWS, attach, without_heaviest


_ID_RANGE = 10**20


def completeness(columns: list[str]) -> Column:
    """Number of non-null cells of a row."""
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNotNull().cast("int") for c in columns])


def _place(score: str, row_id: str) -> Column:
    """Rank of a row inside its key as one number: high score first, then low id.

    A plain decimal keeps the winner aggregate on the hash path; a struct would
    make Spark sort every task's rows by key.
    """
    shifted = F.col(row_id).cast("decimal(20,0)") - F.lit("-9223372036854775808").cast("decimal(20,0)")
    return (-F.col(score)).cast("decimal(9,0)") * F.lit(str(_ID_RANGE)).cast("decimal(21,0)") + shifted


def _place_id(place: Column) -> Column:
    shifted = F.pmod(place, F.lit(str(_ID_RANGE)).cast("decimal(21,0)"))
    return (shifted + F.lit("-9223372036854775808").cast("decimal(20,0)")).cast("bigint")


def winner_id(score: str, row_id: str) -> Column:
    """Aggregate: id of the row with the highest score, the lowest id among equals."""
    return _place_id(F.min(_place(score, row_id)))


def key_winners(
    rows: DataFrame, keys: list[str], score: str, row_id: str, eligible: str | None = None
) -> DataFrame:
    """Ids of the rows kept per key: highest score, then lowest id. NULL keys are equal.

    An aggregate, so each task sends one candidate per key it holds. With
    ``eligible``, a boolean column, only eligible rows compete; it joins the
    key instead of being a filter, which Catalyst would push below the cleaning
    expressions and evaluate twice.
    """
    if eligible is None:
        return rows.groupBy(*keys).agg(winner_id(score, row_id).alias(row_id)).select(row_id)
    kept = [F.when(F.col(eligible), F.col(k)).alias(k) for k in keys]
    best = rows.select(eligible, score, row_id, *kept).groupBy(eligible, *keys).agg(
        winner_id(score, row_id).alias("__best"), F.min(F.col(eligible).cast("int")).alias("__in")
    )
    return best.filter(F.col("__in") == 1).select(F.col("__best").alias(row_id))


def mark_kept(rows: DataFrame, keys: list[str], score: str, row_id: str, name: str = "kept") -> DataFrame:
    """Flag the row that survives exact dedup; the flag comes back by unique id."""
    if not keys:
        return rows.withColumn(name, F.lit(True))
    winners = key_winners(rows.select(*keys, score, row_id), keys, score, row_id)
    flagged = rows.join(winners.withColumn("__won", F.lit(True)), row_id, "left")
    return flagged.withColumn(name, F.col("__won").isNotNull()).drop("__won")


def fuzzy_duplicates(
    rows: DataFrame,
    identity: list[str],
    texts: list[str],
    score: str,
    row_id: str,
    threshold: float = fixed.FUZZY_THRESHOLD,
    block_rows: int | None = None,
) -> DataFrame:
    """(row_id, position, column, score) of rows that resemble their block's base row.

    A block is the rows of one e-mail / phone value. Every row is compared with
    the block's base row, the most complete one, so the work is linear and
    blocks of any size are compared: the base of a heavy key is broadcast and
    its rows are spread. With ``block_rows``, larger blocks are skipped.
    """
    texts_struct = F.struct(*[fuzzy_text(F.col(f"`{t}`")).alias(f"t{i}") for i, t in enumerate(texts)])
    keyed = rows.dropna(subset=identity).select(row_id, score, *identity, texts_struct.alias("texts"))
    order = F.struct(-F.col(score), F.col(row_id))
    blocks = keyed.groupBy(*identity).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(F.col(row_id).alias("base_id"), F.col("texts").alias("base_texts")), order).alias("base"),
    )
    compared_blocks = blocks.filter(F.col("n") >= 2)
    if block_rows is not None:
        compared_blocks = compared_blocks.filter(F.col("n") <= block_rows)
        keyed = without_heaviest(keyed, blocks, identity, "n", block_rows)
    met = attach(keyed, compared_blocks.select(*identity, "n", "base.*"), identity, "n", row_id)
    pairs = met.filter(F.col(row_id) != F.col("base_id"))
    compared = pairs.select(
        row_id,
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(t).alias("column"),
                     F.col(f"base_texts.t{i}").alias("a"), F.col(f"texts.t{i}").alias("b"))
            for i, t in enumerate(texts)
        ])),
    )
    near = compared.filter(similarity_bound(F.col("a"), F.col("b")) >= threshold)
    likely = near.filter(letter_bound(F.col("a"), F.col("b")) >= threshold)
    scored = likely.select(row_id, "position", "column", similarity(F.col("a"), F.col("b")).alias("score"))
    return scored.filter(F.col("score") >= threshold)


def drop_duplicates(
    rows: DataFrame, columns: list[str], types: dict[str, str], row_id: str, mode: str = "composite"
) -> DataFrame:
    """Standalone dedup on normalised values: rows plus ``kept`` and ``removal_reason``.

    ``composite`` joins all columns into one key, any other mode uses the first
    column. NULL parts read ``nan`` in the key.
    """
    if not columns:
        return rows.withColumn("kept", F.lit(True)).withColumn("removal_reason", F.lit(None).cast("string"))
    used = columns if mode == "composite" else columns[:1]
    parts = [F.coalesce(normalized(F.col(f"`{c}`"), types.get(c, "text")), F.lit("nan")) for c in used]
    values = [c for c in rows.columns if c != row_id]
    keyed = rows.withColumn("__key", F.concat_ws("|", *parts)).withColumn("__score", completeness(values))
    masters = keyed.groupBy("__key").agg(
        winner_id("__score", row_id).alias("__master"),
        F.count(F.lit(1)).alias("__n"),
    )
    marked = attach(keyed, masters, ["__key"], "__n", row_id)
    kept = F.col(row_id) == F.col("__master")
    reason = F.concat(
        F.lit("Duplicate of row "), (F.col("__master") + 2).cast("string"),
        F.lit(f" (based on {', '.join(columns)})"),
    )
    return marked.select(
        *[F.col(f"`{c}`") for c in rows.columns], kept.alias("kept"), F.when(~kept, reason).alias("removal_reason")
    )


def repeated(
    rows: DataFrame, keys: list[str], row_id: str, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Flag every row whose key occurs more than once; NULLs count as equal."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counted = attach(rows, counts, keys, "__n", row_id, hot_rows)
    return counted.withColumn(name, F.col("__n") > 1).drop("__n")


def best_values(rows: DataFrame, cluster: str, columns: list[str], row_id: str) -> DataFrame:
    """(cluster, column, value): most frequent, then longest, then first; blanks skipped.

    Two aggregates in a row: value counts combine map-side, then the best count
    wins, so a cluster of any size is never held in one task.
    """
    cells = rows.select(
        cluster, row_id,
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
        ])),
    )
    present = F.when(~F.col("value").isin("", "nan"), F.col("value"))
    counts = cells.withColumn("value", present).groupBy(cluster, "column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first")
    )
    order = F.struct(F.col("value").isNull(), -F.col("n"), -F.length("value"), F.col("first"))
    return counts.groupBy(cluster, "column").agg(F.min_by("value", order).alias("value"))


def golden_records(rows: DataFrame, cluster: str, columns: list[str], row_id: str) -> DataFrame:
    """One merged record per cluster."""
    best = best_values(rows, cluster, columns, row_id)
    return best.groupBy(cluster).agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    )
