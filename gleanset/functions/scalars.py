"""Name, header, phone, revenue, time and JSON helpers on single columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset import fixed
from gleanset.functions.text import empty, filled, missing, strip, title_case


# ── Headers and names ───────────────────────────────────────────────────────
def normal_header(c: Column, keep_symbols: bool = False) -> Column:
    """``First Name`` -> ``first_name``; other symbols go unless kept."""
    text = F.lower(strip(c))
    if not keep_symbols:
        text = F.regexp_replace(text, r"(?U)[^a-z0-9\s_\-]", "")
    return F.btrim(F.regexp_replace(text, r"(?U)[\s_\-]+", "_"), F.lit("_"))


def header_name(header: str, keep_symbols: bool = False) -> str:
    """The same rule for a column name held by the driver."""
    text = header.strip().lower()
    if not keep_symbols:
        text = re.sub(r"[^a-z0-9\s_\-]", "", text)
    return re.sub(r"[\s_\-]+", "_", text).strip("_")


def column_label(name: str) -> str:
    return fixed.MASTER_LABELS.get(name, name.replace("_", " ").title())


def field_label(name: str) -> str:
    """Label of a column that becomes a custom field."""
    return " ".join(part.capitalize() for part in name.split("_"))


def first_name(c: Column) -> Column:
    return filled(F.regexp_extract(strip(c), r"(?U)^(\S+)", 1))


def last_name(c: Column) -> Column:
    return filled(F.regexp_extract(strip(c), r"(?sU)^\S+\s+(.*)$", 1))


def full_name(first: Column, last: Column) -> Column:
    joined = F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))
    return strip(joined)


def no_null_words(c: Column) -> Column:
    """The texts nan, nat and null are NULL at ingestion."""
    return F.when(~F.lower(strip(c)).isin(*fixed.NULL_WORDS), c)


def or_dashes(c: Column) -> Column:
    return F.coalesce(filled(c), F.lit("--"))


def synonym(record: Column, names: list[str], default: str | None = None) -> Column:
    """First non-empty value among several keys of a map column."""
    values = [filled(F.try_element_at(record, F.lit(n))) for n in names]
    return F.coalesce(*values, F.lit(default))


# ── Contact details ─────────────────────────────────────────────────────────
def best_phone(numbers: Column, fallback: Column) -> Column:
    """Raw, else sanitized number of the first entry, else the fallback."""
    head = F.get(numbers, F.lit(0))
    return F.coalesce(
        filled(head["raw_number"]), filled(head["sanitized_number"]), filled(fallback), F.lit("")
    )


def website(url: Column, domain: Column) -> Column:
    return F.coalesce(filled(url), F.concat(F.lit("https://"), filled(domain)), F.lit(""))


def revenue_text(amount: Column) -> Column:
    billions = F.concat(F.lit("$"), F.round(amount / 1e9, 1).cast("string"), F.lit("B"))
    millions = F.concat(F.lit("$"), F.round(amount / 1e6, 1).cast("string"), F.lit("M"))
    whole = F.concat(F.lit("$"), F.format_number(amount, 0))
    return F.when(amount >= 1e9, billions).when(amount >= 1e6, millions).otherwise(whole)


# ── Activity texts ──────────────────────────────────────────────────────────
def run_file(action: Column) -> Column:
    """File name inside ``Cleaned file F using rules: ...``."""
    name = F.regexp_replace(action, r"^Cleaned file\s+", "")
    return strip(F.substring_index(name, " using rules:", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_kind(path: Column) -> Column:
    text = F.lower(path)
    kind = F.lit("logs")
    for word in ("removed", "invalid", "cleaned"):
        kind = F.when(text.contains(word), F.lit(word)).otherwise(kind)
    return kind


def notice_kind(action: Column) -> Column:
    """export, import or clean; NULL when the action notifies nobody."""
    text = F.lower(action)
    return (
        F.when(text.contains("export"), "export")
        .when(text.contains("upload") | text.contains("ingest"), "import")
        .when(text.contains("cleaned file"), "clean")
    )


def notice_text(username: Column, action: Column) -> Column:
    said = (
        F.when(notice_kind(action) == "export", "exported records")
        .when(notice_kind(action) == "import", "uploaded a spreadsheet")
        .otherwise("cleaned spreadsheet data")
    )
    return F.concat(username, F.lit(" "), said, F.lit(": "), action)


# ── Time, numbers, JSON ─────────────────────────────────────────────────────
def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def second_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def days_since(ts: Column, as_of: Column) -> Column:
    """Whole 24-hour periods, never below zero."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    return F.greatest(F.lit(0).cast("bigint"), F.floor(seconds / 86400))


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole * 100, 1)).otherwise(F.lit(0.0))


def page_count(total: Column, per_page: int) -> Column:
    return F.ceil(total / F.lit(per_page))


def json_map(c: Column, value: T.DataType | None = None) -> Column:
    """JSON object as a map; NULL and broken text give the empty map."""
    kind = T.MapType(T.StringType(), value or T.StringType())
    return F.coalesce(F.from_json(c, kind), F.create_map().cast(kind))


def map_json(c: Column) -> Column:
    """JSON text of a map with its keys in order, NULL for the empty map."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(c)))
    return F.when(F.size(c) > 0, F.to_json(ordered))


def sheet_label(file: Column, sheet: Column) -> Column:
    """``file_sheet`` with forbidden characters replaced, at most 30 long."""
    joined = F.concat_ws("_", file, sheet)
    return F.left(F.translate(joined, r":\/?*[]", "_______"), F.lit(30))
