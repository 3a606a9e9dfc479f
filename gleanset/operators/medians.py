"""Exact medians of several columns without holding all values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A pass brackets the median between two sketch quantiles whose ranks are off by
# at most 1/ACCURACY of the rows it looks at. The sketch has some ACCURACY entries
# per task and column.
ACCURACY = 10_000
# Values in a bracket that may be ranked in one task; above it a pass narrows again.
MOST = 1_000_000


def _brackets(df: DataFrame, places: dict[str, tuple[float, float]], within: dict[str, tuple], accuracy: int) -> dict[str, tuple]:
    """Two quantiles around each column's place, of its values in the bracket so far."""
    made = []
    for c, (low, high) in places.items():
        value = F.col(c)
        if c in within:
            value = F.when(value.between(F.lit(within[c][0]), F.lit(within[c][1])), value)
        quantiles = F.array(F.lit(max(0.0, low - 2.0 / accuracy)), F.lit(min(1.0, high + 2.0 / accuracy)))
        made.append(F.percentile_approx(value, quantiles, accuracy).alias(c))
    return {c: tuple(q) for c, q in df.agg(*made).first().asDict().items()}


def exact_medians(df: DataFrame, columns: list[str], accuracy: int = ACCURACY, most: int = MOST) -> DataFrame:
    """One row with the exact median of each double column.

    Brackets, two numbers per column, come to the driver; each narrowing divides
    the values inside by some thousands, so a million million rows take two.
    Then values inside are counted and ranked.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    known = [c for c in columns if counts[c]]
    if not known:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in columns])
    brackets = _brackets(df, {c: (0.5, 0.5) for c in known}, {}, accuracy)
    wide = [c for c in known if counts[c] * 4 / accuracy > most and brackets[c][0] < brackets[c][1]]
    while wide:
        seen = df.agg(
            *[F.count(F.when(F.col(c) < F.lit(brackets[c][0]), 1)).alias(f"{c}_below") for c in wide],
            *[F.count(F.when(F.col(c).between(*map(F.lit, brackets[c])), 1)).alias(f"{c}_inside") for c in wide],
        ).first().asDict()
        places = {}
        for c in wide:
            below, inside = seen[f"{c}_below"], seen[f"{c}_inside"]
            places[c] = (((counts[c] - 1) // 2 - below) / inside, (counts[c] // 2 + 1 - below) / inside)
        narrow = _brackets(df, places, brackets, accuracy)
        wide = [
            c for c in wide
            if narrow[c][0] < narrow[c][1] and narrow[c] != brackets[c] and seen[f"{c}_inside"] * 4 / accuracy > most
        ]
        brackets.update(narrow)
    cells = []
    for c in known:
        (low, high), n = brackets[c], counts[c]
        # everything below the bracket is one group, so its count combines map-side
        inside = F.struct(F.when(F.col(c) >= F.lit(low), F.col(c)).alias("v"))
        cells.append(F.struct(F.lit(c).alias("name"), F.lit(n).alias("n"), F.when(F.col(c) <= F.lit(high), inside).alias("cell")))
    placed = df.select(F.inline(F.array(*cells))).filter("cell is not null").select("name", "n", "cell.v")
    counts = placed.groupBy("name", "n", "v").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(
        W.partitionBy("name").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0)
    )
    ranked = counts.withColumn("upto", upto).filter("v is not null")
    lower = F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) / 2), F.col("v")))
    upper = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("v")))
    medians = ranked.groupBy("name").agg(((lower + upper) / 2).alias("median"))
    return medians.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])
