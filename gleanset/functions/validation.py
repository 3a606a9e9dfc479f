"""Validation rules: a failing predicate and the message of the failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions.text import missing, plain_number, strip


def _said(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def validate_email(c: Column) -> tuple[Column, Column]:
    text = strip(c)
    return c.isNotNull() & ~text.rlike(fixed.EMAIL_FORMAT), _said("Invalid email format", text)


def validate_email_domain(c: Column) -> tuple[Column, Column]:
    text = strip(c)
    domain = F.substring_index(text, "@", -1)
    return c.isNotNull() & text.contains("@") & ~domain.contains("."), _said("Invalid domain", domain)


def validate_phone(c: Column) -> tuple[Column, Column]:
    text = strip(c)
    digits = F.when(
        text.startswith("+"), F.regexp_replace(F.substr(text, F.lit(2)), r"(?U)[\s\-()]", "")
    ).otherwise(F.regexp_replace(text, r"(?U)[\s+\-()]", ""))
    return c.isNotNull() & ~digits.rlike(fixed.PHONE_DIGITS), _said("Invalid phone", c)


def validate_url(c: Column) -> tuple[Column, Column]:
    return c.isNotNull() & ~strip(c).rlike(fixed.URL_FORMAT), _said("Invalid URL", c)


def validate_numeric(c: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(c, r"(?U)[₹$€£¥%,\s]", "")
    return c.isNotNull() & plain_number(bare).isNull(), _said("Not numeric", c)


def validate_numeric_range(
    c: Column, min_val: float | None = None, max_val: float | None = None
) -> tuple[Column, Column]:
    """Outside the bounds; text that is no number is left to validate_numeric."""
    number = plain_number(c)
    outside = F.lit(False)
    if min_val is not None:
        outside = outside | (number < F.lit(float(min_val)))
    if max_val is not None:
        outside = outside | (number > F.lit(float(max_val)))
    return F.coalesce(outside, F.lit(False)), _said("Out of range", c)


def parsed_date(c: Column) -> Column:
    """Timestamp of the first accepted format; the shape test picks the parser."""
    text = strip(c)
    parsed = F.lit(None).cast("timestamp")
    for shape, formats in fixed.DATE_SHAPES.items():
        attempts = [F.try_to_timestamp(text, F.lit(f)) for f in formats] or [text.try_cast("timestamp")]
        parsed = F.when(text.rlike(shape), F.coalesce(*attempts)).otherwise(parsed)
    return parsed


def validate_date(c: Column) -> tuple[Column, Column]:
    return c.isNotNull() & parsed_date(c).isNull(), _said("Invalid date", c)


def validate_not_empty(c: Column) -> tuple[Column, Column]:
    return missing(c), F.lit("Empty value")
