"""Record search, paging, export, quota and deletion."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions.scalars import map_json, second_text
from gleanset.operators import filters
from gleanset.operators.mapping import custom_value, export_projection, resolve_custom_keys


@dataclass(frozen=True)
class RecordQuery:
    """A record search: filters, order and page; nothing runs until an output is used."""

    fields: dict[str, str] = field(default_factory=dict)
    name: str | None = None
    search: str | None = None
    search_columns: tuple[str, ...] = tuple(fixed.SEARCH_COLUMNS)
    custom: tuple[tuple[str, str], ...] = ()
    missing_field: str | None = None
    missing_dashes: bool = False
    created: tuple[str | None, str | None] = (None, None)
    updated: tuple[str | None, str | None] = (None, None)
    file_id: int | str | None = None
    record_id: int | str | None = None
    exact: bool = False
    ignore_case: bool = True
    sort_by: str = "id"
    ascending: bool = False
    page: int = 1
    per_page: int = 20

    def predicate(self, df: DataFrame) -> Column:
        """All conditions AND-ed; conditions on absent columns are skipped."""
        found = []
        for name, column in (("record_id", "id"), ("file_id", "file_id")):
            if getattr(self, name) is not None:
                found.append(filters.whole_number(column, getattr(self, name)))
        for given, text in self.fields.items():
            column = fixed.FIELD_SYNONYMS.get(given, given)
            if not str(text).strip() or column not in df.columns:
                continue
            cell = F.col(f"`{column}`")
            found.append(filters.equals(cell, text) if self.exact else filters.contains(cell, text, self.ignore_case))
        if self.name:
            found.append(filters.name_contains(self.name))
        if self.search:
            found.append(filters.anywhere(self.search, [c for c in self.search_columns if c in df.columns]))
        for field_id, text in self.custom:
            found.append(filters.contains(custom_value(field_id), text))
        if self.missing_field in df.columns:
            found.append(filters.lacks(self.missing_field, self.missing_dashes))
        for column, (low, high) in (("created_at", self.created), ("updated_at", self.updated)):
            if column in df.columns and (low or high):
                found.append(filters.between(column, low, high))
        return filters.every(found)

    def matching(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate(df))

    def sort_column(self, df: DataFrame) -> str:
        """The sort column if the table has it, else the id."""
        wanted = fixed.FIELD_SYNONYMS.get(self.sort_by.lower(), self.sort_by.lower())
        return wanted if wanted in df.columns and wanted != "custom_fields" else "id"

    def order(self, df: DataFrame) -> list[Column]:
        """By the sort column; ids break ties."""
        column = self.sort_column(df)
        first = F.asc(column) if self.ascending else F.desc(column)
        return [first] if column == "id" else [first, F.asc("id")]

    def rows(self, df: DataFrame) -> DataFrame:
        return page_of(self.matching(df), self.order(df), self.page, self.per_page)

    def info(self, df: DataFrame) -> DataFrame:
        return page_info(self.matching(df), self.page, self.per_page)

    def export(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """The whole search; with ``rows``, the first so many in its order."""
        if rows is None:
            return self.matching(df)
        return self.matching(df).orderBy(*self.order(df)).limit(rows)


def page_of(df: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    start = (max(1, page) - 1) * per_page
    return df.orderBy(*order).offset(start).limit(per_page)


def page_info(df: DataFrame, page: int, per_page: int) -> DataFrame:
    """total, pages, page (clamped), first and last row number of the page."""
    total = F.col("total")
    pages = F.ceil(total / F.lit(per_page))
    shown = F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(page).cast("bigint"), pages))
    counted = df.agg(F.count(F.lit(1)).alias("total")).withColumn("page", shown)
    first = (F.col("page") - 1) * per_page + 1
    return counted.select(
        "total", pages.alias("pages"), "page",
        F.when(total > 0, first).otherwise(0).alias("first_row"),
        F.when(total > 0, F.least(F.col("page") * per_page, total)).otherwise(0).alias("last_row"),
    )


def preview(df: DataFrame, row_id: str, rows: int = 15) -> DataFrame:
    """First rows as text with blanks for NULL."""
    first = df.orderBy(row_id).limit(rows)
    return first.select(row_id, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns if c != row_id])


def csv_rows(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Export form: timestamps as text, custom fields as JSON text under their names."""
    changed = {c: second_text(F.col(c)) for c in ("created_at", "updated_at") if c in df.columns}
    if "custom_fields" in df.columns:
        changed["custom_fields"] = map_json(resolve_custom_keys(F.col("custom_fields"), names))
    return df.withColumns(changed)


def client_export(df: DataFrame, approved: RecordQuery, request: RecordQuery, row_limit: int) -> DataFrame:
    """A key's approved filters AND the request's; the key caps the rows.

    A client searches fewer columns than a user does.
    """
    allowed = df.filter(approved.predicate(df))
    return replace(request, search_columns=tuple(fixed.CLIENT_SEARCH_COLUMNS)).export(allowed, row_limit)


def delete_matching(df: DataFrame, query: RecordQuery) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the number deleted; NULL conditions delete nothing."""
    hit = F.coalesce(query.predicate(df), F.lit(False))
    return df.filter(~hit), df.filter(hit).agg(F.count(F.lit(1)).alias("deleted"))


# ── Export quota ────────────────────────────────────────────────────────────
def export_limits(users: DataFrame, role_limits: DataFrame) -> DataFrame:
    """Limit per user: own limit, else the role's, else the fixed one."""
    fallback = F.lit(fixed.DEFAULT_QUOTA)
    for role, limit in fixed.ROLE_QUOTAS.items():
        fallback = F.when(F.col("role") == role, limit).otherwise(fallback)
    joined = users.join(role_limits, users["role"] == role_limits["role_name"], "left")
    chosen = F.coalesce(F.col("export_limit"), F.col("default_limit"), fallback)
    return joined.select("id", "role", chosen.cast("bigint").alias("active_limit"))


def daily_usage(usage: DataFrame) -> DataFrame:
    """Rows exported per user and day, summed over the append-only usage log."""
    return usage.groupBy("user_id", "export_date").agg(F.sum("rows_count").cast("bigint").alias("rows_count"))


def quota_decision(limits: DataFrame, usage: DataFrame, day: str, matching: DataFrame) -> DataFrame:
    """Per user: would an export of the matching rows stay within the day's limit?"""
    used = daily_usage(usage.filter(F.col("export_date") == F.lit(day).cast("date"))).select(
        F.col("user_id").alias("id"), F.col("rows_count").alias("used"))
    wanted = matching.agg(F.count(F.lit(1))).scalar()
    known = limits.join(used, "id", "left").withColumn("requested", wanted)
    spent = F.coalesce("used", F.lit(0))
    return known.select(
        "id", spent.alias("used"), "requested", "active_limit", (spent + F.col("requested") <= F.col("active_limit")).alias("allowed")
    )


def filtered_export(
    df: DataFrame, query: RecordQuery, wanted: list[str], names: dict[str, str]
) -> DataFrame:
    """Requested columns of the matching rows."""
    return export_projection(query.matching(df), wanted, names)


def export_within_quota(
    df: DataFrame, query: RecordQuery, wanted: list[str], names: dict[str, str],
    user_id: int, limits: DataFrame, usage: DataFrame, day: str,
) -> tuple[DataFrame, DataFrame]:
    """A user's filtered export and the usage row to book for it.

    Both are empty if the matching rows would exceed what is left of the user's
    limit of the day, or if the user has no limit.
    """
    asked = quota_decision(limits.filter(F.col("id") == user_id), usage, day, query.matching(df))
    allowed = asked.agg(F.coalesce(F.max("allowed"), F.lit(False))).scalar()
    booked = asked.filter("allowed").select(
        F.col("id").alias("user_id"), F.lit(day).cast("date").alias("export_date"), F.col("requested").alias("rows_count")
    )
    return filtered_export(df.filter(allowed), query, wanted, names), booked
