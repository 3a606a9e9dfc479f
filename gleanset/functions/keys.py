"""Comparison keys: canonical values, normalised values and fuzzy text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset import fixed
from gleanset.functions.cleaning import lower_email
from gleanset.functions.text import number_text, plain_number, squeeze, strip


def canonical(c: Column, kind: str) -> Column:
    """Value under which two cells of the same type count as equal."""
    text = strip(c)
    if kind == "email":
        # the part after the first @ decides whether dots and + tags count
        lowered = F.lower(text)
        domains = "|".join(d.replace(".", r"\.") for d in fixed.ALIASED_MAIL_DOMAINS)
        local = F.replace(F.regexp_extract(lowered, r"^([^@+]*)", 1), F.lit("."), F.lit(""))
        plain = F.concat(local, F.lit("@"), F.substring_index(lowered, "@", -1))
        return F.when(lowered.rlike(f"^[^@]*@({domains})$"), plain).otherwise(lowered)
    if kind == "phone":
        return F.regexp_replace(F.regexp_replace(text, r"[^\d]", ""), r"^91(?=\d{9,}$)", "")
    if kind in ("text", "url"):
        return squeeze(F.lower(text))
    return text


def _normal_url(text: Column) -> Column:
    lowered = F.lower(text)
    full = F.when(lowered.rlike("^https?://"), lowered).otherwise(F.concat(F.lit("https://"), lowered))
    site = F.regexp_extract(full, r"^(https?://[^/?#]*)", 1)
    path = F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.concat(site, F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), r"/+$", ""))


def _normal_number(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"[₹$,]", "")
    thousands = F.regexp_extract(bare, r"^(\d+(?:\.\d+)?)k", 1)
    digits = F.regexp_extract(bare, r"(\d+)", 1)
    worded = F.lit(None).cast("double")
    for word, factor in reversed(fixed.NUMBER_WORDS.items()):
        worded = F.when(
            bare.contains(word) & (digits != ""), digits.try_cast("double") * F.lit(factor)
        ).otherwise(worded)
    number = (
        F.when(thousands != "", thousands.try_cast("double") * 1000)
        .when(worded.isNotNull(), worded)
        .otherwise(plain_number(bare))
    )
    return F.coalesce(number_text(number), bare)


def normalized(c: Column, kind: str = "text") -> Column:
    """Normalised value of the standalone dedup key."""
    text = strip(c)
    if kind == "email":
        return lower_email(text)
    if kind == "phone":
        return F.ltrim(F.regexp_replace(text, r"\D", ""), F.lit("0"))
    if kind == "url":
        return _normal_url(text)
    if kind == "text":
        return squeeze(F.lower(text))
    if kind == "numeric":
        return _normal_number(text)
    return text


def fuzzy_text(c: Column) -> Column:
    """Lower-case words for similarity; NULL becomes the empty text."""
    words = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^a-z0-9\s]", " ")
    return strip(squeeze(words))


@F.pandas_udf(T.DoubleType())
def _ratcliff_obershelp(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = difflib.SequenceMatcher(None, pair[0], pair[1]).ratio()
        out.append(seen[pair])
    return pd.Series(out)


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp ratio of two texts, 0 if either is NULL.

    Spark has no expression for it, so this is the one Arrow UDF; callers keep
    its input small by blocking and by :func:`similarity_bound`.
    """
    blank = a.isNull() | b.isNull()
    ratio = _ratcliff_obershelp(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    return F.when(blank, F.lit(0.0)).otherwise(ratio)


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from how often each letter occurs in both texts.

    Matching blocks use every letter of either text once at most. Letters
    outside ``LETTERS`` count as one.
    """
    def often(c: Column, letter: str) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))

    shared = sum((F.least(often(a, x), often(b, x)) for x in LETTERS), F.lit(0))
    rest = [F.length(c) - sum((often(c, x) for x in LETTERS), F.lit(0)) for c in (a, b)]
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * (shared + F.least(*rest)) / total)


def similarity_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the text lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        2.0 * F.least(F.length(a), F.length(b)) / total
    )
