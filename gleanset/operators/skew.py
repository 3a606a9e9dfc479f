"""Joins and group facts that hold up when one key owns a third of all rows.

Three shapes are used throughout the library:

* a fact per key (winner, count) is computed by an aggregate, so the map side
  combines the hot key before the shuffle;
* the fact goes back to its rows by the unique row id where that is possible,
  since unique keys cannot be skewed;
* where a row must meet its key's fact, :func:`spread_join` sends the rows of the
  heaviest keys through a broadcast of bounded size and only the rest through
  the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most this many keys are ever broadcast; every other key then holds less
# than 1/HOT_KEYS of the rows.
HOT_KEYS = 4096
HOT_ROWS = 10_000
# Slice numbers of rows of heavy keys: so many that they spread over all tasks, however many there are.
SLICES = 1 << 20


def same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two aliased frames."""
    pairs = [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys]
    return reduce(lambda a, b: a & b, pairs)


def heaviest(facts: DataFrame, count: str, rows: int = HOT_ROWS, keys: int = HOT_KEYS) -> DataFrame:
    """The per-key facts of the heaviest keys, a frame of bounded size."""
    return facts.filter(F.col(count) > rows).orderBy(F.desc(count)).limit(keys)


def spread_join(
    rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame, row_id: str
) -> DataFrame:
    """Left join ``facts`` (one row per key) to ``rows``.

    Keys compare null-safe.

    ``hot`` holds the facts of the heaviest keys and is bounded, so it is
    broadcast. In the shuffled join the rows of those keys carry a slice number
    that no fact has, which spreads them over all tasks.
    """
    named = [c for c in facts.columns if c not in keys]
    hot = hot.select(*[F.col(f"`{k}`") for k in keys], F.struct(*named).alias("__hot"))
    cold = facts.select(
        *[F.col(f"`{k}`") for k in keys], F.struct(*named).alias("__cold"), F.lit(0).alias("__slice")
    )
    marked = rows.alias("r").join(F.broadcast(hot).alias("h"), same("r", "h", keys), "left")
    apart = F.col("h.__hot").isNotNull()
    sliced = marked.select(
        "r.*",
        "h.__hot",
        F.when(~apart, 0)
        .otherwise(1 + F.pmod(F.xxhash64(F.col(f"r.`{row_id}`")), F.lit(SLICES)))
        .cast("int")
        .alias("__slice"),
    )
    joined = sliced.alias("r").join(
        cold.alias("f"), same("r", "f", keys) & (F.col("r.__slice") == F.col("f.__slice")), "left"
    )
    fact = F.coalesce(F.col("r.__hot"), F.col("f.__cold"))
    return joined.select(
        *[F.col(f"r.`{c}`") for c in rows.columns], *[fact[c].alias(c) for c in named]
    )


def attach(
    rows: DataFrame, facts: DataFrame, keys: list[str], count: str, row_id: str,
    hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """:func:`spread_join` of facts that carry the row count of their key."""
    return spread_join(rows, facts, keys, heaviest(facts, count, hot_rows, hot_keys), row_id)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of another table; NULL keys find nothing.

    Rows are evaluated once. A small table is broadcast by Spark itself, by its
    measured size; for a large one AQE splits the partitions of heavy and of
    NULL keys, as both sides are plain rows.
    """
    named = [c for c in table.columns if c not in keys]
    joined = rows.alias("r").join(
        table.alias("t"), reduce(lambda a, b: a & b, [F.col(f"r.`{k}`") == F.col(f"t.`{k}`") for k in keys]), "left"
    )
    return joined.select("r.*", *[F.col(f"t.`{c}`") for c in named])


def without_heaviest(
    rows: DataFrame, facts: DataFrame, keys: list[str], count: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows outside the heaviest keys; for callers whose rule ignores big groups."""
    hot = heaviest(facts, count, hot_rows).select(*keys)
    return rows.alias("r").join(F.broadcast(hot).alias("h"), same("r", "h", keys), "left_anti")
