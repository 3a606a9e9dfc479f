"""Small text and number helpers shared by the rule builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanset import fixed


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, not only spaces."""
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def squeeze(c: Column) -> Column:
    """Turn every run of whitespace into one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def missing(c: Column) -> Column:
    """NULL or blank after strip."""
    return F.coalesce(strip(c), F.lit("")) == ""


def empty(c: Column) -> Column:
    """NULL or exactly the empty string."""
    return c.isNull() | (c == "")


def filled(c: Column) -> Column:
    """``c`` with the empty string read as NULL."""
    return F.when(c != "", c)


def plain_number(c: Column) -> Column:
    """Parse ordinary decimal text; NULL for everything else."""
    return F.regexp_extract(strip(c), fixed.PLAIN_NUMBER, 0).try_cast("double")


def number_text(x: Column) -> Column:
    """Decimal text of a double with at least one digit after the point.

    Each helper here uses its argument once, so nested rules stay small plans.
    """
    return F.regexp_replace(x.try_cast("decimal(38,12)").cast("string"), r"(\.\d+?)0*$", "$1")


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, also after apostrophe or hyphen."""
    words = F.split(F.regexp_replace(F.lower(c), r"(\p{L}+)", "\u0001$1"), "\u0001")
    raised = F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    return F.array_join(raised, "")
