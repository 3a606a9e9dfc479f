"""Pages by key: a cursor leads to the next page, counted key ranges to any other.

No page sorts the rows before it. A cursor is the sort value and id of the last row
seen; the page after it is a top-k of the rows behind the cursor, to which each task
sends one page at most. For a jump, the keys are cut into ranges once and counted;
the range a page begins in is cut again until it is small, and the cursor before the
page is read from it. Ids must be unique and not NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gleanset.plans.records import RecordQuery
from gleanset.session import settle

# A range of so many keys is not cut again; a top-k of its narrow rows finds the cursor.
SMALL = 10_000
# Ranges a larger one is cut into, at most; their first keys come to the driver.
RANGES = 1024


@dataclass(frozen=True)
class Cursor:
    """Place of a row in a sorted search: its sort value and id."""

    value: object
    id: int


def _keys(df: DataFrame, query: RecordQuery) -> DataFrame:
    """Sort value and id of the matching rows."""
    return query.matching(df).select(F.col(f"`{query.sort_column(df)}`").alias("value"), "id")


def _order(ascending: bool, back: bool = False) -> list[Column]:
    """The order of key rows; ``back`` turns it round."""
    value = F.asc_nulls_first("value") if ascending != back else F.desc_nulls_last("value")
    return [value, F.desc("id") if back else F.asc("id")]


def _behind(value: Column, row_id: Column, cursor: Cursor, ascending: bool, itself: bool = False) -> Column:
    """Is a row behind the cursor, or at it? NULL values come first upwards and last downwards."""
    later = row_id >= F.lit(cursor.id) if itself else row_id > F.lit(cursor.id)
    if cursor.value is None:
        return value.isNotNull() | later if ascending else value.isNull() & later
    low = F.lit(cursor.value)
    if ascending:
        return value.isNotNull() & ((value > low) | ((value == low) & later))
    return value.isNull() | (value < low) | ((value == low) & later)


def cursor_of(query: RecordQuery, df: DataFrame, row: Row) -> Cursor:
    """The cursor of a row of ``df``, such as the last one of a page."""
    return Cursor(row[query.sort_column(df)], row["id"])


def page_after(df: DataFrame, query: RecordQuery, cursor: Cursor | None) -> DataFrame:
    """The ``per_page`` rows behind the cursor, or the first ones without a cursor."""
    rows = query.matching(df)
    if cursor is not None:
        rows = rows.filter(_behind(F.col(f"`{query.sort_column(df)}`"), F.col("id"), cursor, query.ascending))
    return rows.orderBy(*query.order(df)).limit(query.per_page)


def _counted(keys: DataFrame, ascending: bool, ranges: int | None) -> DataFrame:
    """(range, rows, value, id) of key ranges of about equal size, with the first key of each.

    Ids break ties, so a value that a third of the rows share is cut like any other.
    Without ``ranges`` Spark cuts into shuffle partitions and joins small neighbours.
    """
    number = () if ranges is None else (ranges,)
    cut = keys.repartitionByRange(*number, *_order(ascending)).withColumn("range", F.spark_partition_id())
    # NULL is the least in a struct: first upwards, last downwards
    first = F.min(F.struct("value", "id")) if ascending else F.max(F.struct("value", F.bitwise_not("id").alias("id")))
    found = cut.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), first.alias("first"))
    first_id = F.col("first.id") if ascending else F.bitwise_not("first.id")
    return found.select("range", "rows", "first.value", first_id.alias("id"))


def page_index(df: DataFrame, query: RecordQuery, ranges: int | None = None) -> DataFrame:
    """Counted key ranges of a search, written once: a row per shuffle partition at most, or ``ranges`` rows."""
    return settle(_counted(_keys(df, query), query.ascending, ranges))


def cursor_before(
    df: DataFrame, query: RecordQuery, index: DataFrame, page: int, ranges: int = RANGES, small: int = SMALL
) -> Cursor | None:
    """The cursor behind which page ``page`` begins, None for the first page.

    A page beyond the last one begins behind the last row, so it is empty. ``index``
    is the :func:`page_index` of the same search over the same rows.
    """
    # one narrow row per range
    steps = index.orderBy("range").collect()
    skipped = min((max(1, page) - 1) * query.per_page, sum(s["rows"] for s in steps))
    if skipped == 0:
        return None
    keys = _keys(df, query)
    while True:
        # the range that holds the last row before the page
        at = 0
        while skipped > steps[at]["rows"]:
            skipped -= steps[at]["rows"]
            at += 1
        value, row_id, up = F.col("value"), F.col("id"), query.ascending
        keys = keys.filter(_behind(value, row_id, Cursor(steps[at]["value"], steps[at]["id"]), up, itself=True))
        if at + 1 < len(steps):
            keys = keys.filter(~_behind(value, row_id, Cursor(steps[at + 1]["value"], steps[at + 1]["id"]), up, itself=True))
        rows = steps[at]["rows"]
        if rows <= small:
            break
        steps = _counted(keys, up, min(ranges, -(-rows // small))).orderBy("range").collect()
        if len(steps) == 1:
            break
    last = keys.orderBy(*_order(up)).limit(skipped).orderBy(*_order(up, back=True)).first()
    return Cursor(last["value"], last["id"])


def page_at(df: DataFrame, query: RecordQuery, index: DataFrame, **sizes: int) -> DataFrame:
    """The search's own page, found through its index."""
    return page_after(df, query, cursor_before(df, query, index, query.page, **sizes))
