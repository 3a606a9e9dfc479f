"""Cleaning rules: each takes a text column and returns the cleaned column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions.text import filled, missing, number_text, plain_number, strip, title_case


def trim_whitespace(c: Column, kind: str = "text") -> Column:
    return strip(c)


def clean_special_chars(c: Column, kind: str = "text") -> Column:
    """Drop the characters a semantic type does not allow; empty becomes NULL."""
    if kind == "date":
        return c
    unwanted = fixed.UNWANTED_CHARS.get(kind, fixed.UNWANTED_CHARS_OTHER)
    return filled(F.regexp_replace(c, unwanted, ""))


def _scaled(text: Column, prefix: str, units: str) -> Column:
    """Amount times its unit, NULL when the text is not ``amount unit``."""
    shape = f"(?i){prefix}{fixed.AMOUNT}\\s*({units})\\s*$"
    letter = F.lower(F.left(F.regexp_extract(text, shape, 2), F.lit(1)))
    amount = F.replace(F.regexp_extract(text, shape, 1), F.lit(","), F.lit("")).try_cast("double")
    factors = F.create_map(*[F.lit(x) for pair in fixed.UNIT_FACTORS.items() for x in pair])
    return amount * F.try_element_at(factors, letter)


def currency_amount(c: Column) -> Column:
    """The number behind a currency text or shorthand, NULL if there is none."""
    text = strip(c)
    bare = F.replace(F.regexp_replace(text, fixed.CURRENCY_PREFIX, ""), F.lit(","), F.lit(""))
    return F.coalesce(_scaled(text, fixed.CURRENCY_PREFIX, fixed.CURRENCY_UNITS), plain_number(bare))


def normalize_currency(c: Column, kind: str = "numeric") -> Column:
    """Currency text as plain decimal text; what cannot be parsed stays as it is."""
    return F.coalesce(number_text(currency_amount(c)), c)


def shorthand_number(c: Column) -> Column:
    """Parser of the median and mean fill: L, Cr, K and M only."""
    text = F.regexp_replace(strip(c), fixed.SHORTHAND_PREFIX, "")
    bare = F.replace(text, F.lit(","), F.lit(""))
    return F.coalesce(_scaled(text, "^", fixed.SHORTHAND_UNITS), plain_number(bare))


def fill_placeholder(c: Column, kind: str = "text") -> Column:
    """``Unknown`` for missing text and url cells, nothing for other types."""
    if kind not in ("text", "url"):
        return c
    return F.when(missing(c), F.lit("Unknown")).otherwise(c)


def fill_statistic(c: Column, statistic: Column) -> Column:
    """Missing cells take the rounded statistic, if there is one."""
    return F.when(missing(c) & statistic.isNotNull(), number_text(F.round(statistic, 2))).otherwise(c)


def lower_email(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def title_name(c: Column) -> Column:
    """Title-case a name; blank and NULL stay."""
    return F.when(missing(c), c).otherwise(title_case(strip(c)))
