"""Semantic column types: by name, by alias, by sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset import fixed
from gleanset.functions.text import plain_number, strip
from gleanset.functions.validation import parsed_date


def is_identifier(name: str, match: str = "substring") -> bool:
    """Substring test by default (``paid`` counts); ``token`` needs whole words."""
    lowered = name.lower()
    if match == "token":
        tokens = lowered.replace("_", " ").split()
        return lowered in fixed.IDENTIFIER_KEYWORDS or any(t in fixed.IDENTIFIER_KEYWORDS for t in tokens)
    return any(k in lowered for k in fixed.IDENTIFIER_KEYWORDS)


def identifier_columns(names: list[str]) -> list[str]:
    """Second detector: its own keywords, spaces read as underscores."""
    return [
        n for n in names
        if any(k in n.lower().replace(" ", "_") for k in fixed.IDENTIFIER_KEYWORDS_ALT)
    ]


def alias_type(name: str) -> str | None:
    cleaned = name.strip().lower()
    for kind, aliases in fixed.COLUMN_ALIASES.values():
        if cleaned in aliases:
            return kind
    return None


def type_or_text(name: str) -> str:
    return alias_type(name) or "text"


def stored_type(name: str, dtype: str) -> str:
    """Semantic type of a stored column from its SQL type and name."""
    if dtype.startswith(("int", "bigint", "smallint", "tinyint", "decimal", "double", "float")):
        return "numeric"
    if dtype.startswith(("timestamp", "date")):
        return "date"
    for word, kind in (("phone", "phone"), ("email", "email"), ("url", "url")):
        if word in name.lower():
            return kind
    return "text"


def sample(df: DataFrame, columns: list[str], row_id: str, size: int) -> DataFrame:
    """The first ``size`` non-null values of every column, as (column, value).

    One top-k per column: each task keeps ``size`` rows and reads one column
    plus the row id, so nothing is sorted or shuffled as a whole.
    """
    parts = [
        df.select(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), row_id)
        .filter("value is not null")
        .orderBy(row_id)
        .limit(size)
        for c in columns
    ]
    return reduce(DataFrame.unionAll, parts).select("column", strip(F.col("value")).alias("value"))


def _rate(hit: Column) -> Column:
    return F.avg(F.coalesce(hit, F.lit(False)).cast("int"))


def _cells(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """All non-null values as (column, value), after the columns ``by``, in one pass over the rows."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(*by, F.inline(cells)).filter("value is not null").select(*by, "column", strip(F.col("value")).alias("value"))


def profile(
    df: DataFrame, columns: list[str], row_id: str, size: int | None = None, by: list[str] | None = None
) -> DataFrame:
    """Hit rates and inferred type per column, and per value of ``by``; empty columns are text.

    Every value counts, in one aggregate that tasks combine first; with ``size``
    only the first so many values of a column by row id, over all of ``by``.
    """
    value = F.col("value")
    digits = F.regexp_replace(value, r"[^\d.\-]", "")
    cells = _cells(df, columns, by) if size is None else sample(df, columns, row_id, size)
    rates = cells.groupBy(*(by or []), "column").agg(
        F.count(F.lit(1)).alias("sampled"),
        *[_rate(value.rlike(p)).alias(f"{k}_rate") for k, p in fixed.INFERENCE_PATTERNS.items()],
        _rate(plain_number(digits).isNotNull()).alias("numeric_rate"),
        _rate(parsed_date(value).isNotNull()).alias("date_rate"),
    )
    dated = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    inferred = F.when(F.col("column").isin(dated), "date") if dated else F.when(F.lit(False), "date")
    for kind in ("email", "phone", "url", "numeric"):
        inferred = inferred.when(F.col(f"{kind}_rate") >= fixed.INFERENCE_HIT_RATE, kind)
    inferred = inferred.when(F.col("date_rate") >= fixed.INFERENCE_DATE_RATE, "date").otherwise("text")
    return rates.withColumn("inferred", inferred)


def resolve(
    df: DataFrame,
    columns: list[str],
    row_id: str,
    overrides: dict[str, str] | None = None,
    match: str = "substring",
) -> DataFrame:
    """(column, semantic_type, matched_by, hit rates) for every column."""
    named = []
    for c in columns:
        if overrides and c in overrides:
            named.append((c, overrides[c], "override"))
        elif is_identifier(c, match):
            named.append((c, "identifier", "identifier"))
        elif alias_type(c):
            named.append((c, alias_type(c), "alias"))
        else:
            named.append((c, None, "inference"))
    names = df.sparkSession.createDataFrame(named, "column string, named string, matched_by string")
    rates = profile(df, columns, row_id)
    return names.join(rates, "column", "left").select(
        "column",
        F.coalesce("named", "inferred", F.lit("text")).alias("semantic_type"),
        "matched_by",
        *[F.coalesce(F.round(f"{k}_rate", 2), F.lit(0.0)).alias(f"{k}_rate")
          for k in ("email", "phone", "url", "numeric", "date")],
    )


def _named_types(columns: list[str], overrides: dict[str, str] | None) -> dict[str, str | None]:
    """Types that overrides or names decide, None for the others."""
    types = {}
    for c in columns:
        if overrides and c in overrides:
            types[c] = overrides[c]
        elif is_identifier(c):
            types[c] = "identifier"
        else:
            types[c] = alias_type(c)
    return types


def column_types(
    df: DataFrame, columns: list[str], row_id: str, overrides: dict[str, str] | None = None
) -> dict[str, str]:
    """Types for plan building; samples the data only for undecided columns."""
    types = _named_types(columns, overrides)
    undecided = [c for c in columns if types[c] is None]
    if undecided:
        # one row per column
        found = {r["column"]: r["inferred"] for r in profile(df, undecided, row_id).collect()}
        types.update({c: found.get(c, "text") for c in undecided})
    return types


def sheet_types(
    rows: DataFrame, sheet: str, columns: dict[str, list[str]], overrides: dict[str, str] | None = None
) -> dict[str, dict[str, str]]:
    """Types of the ``columns`` of every sheet, as :func:`column_types` finds them in the sheet alone, in one pass."""
    types = {name: _named_types(own, overrides) for name, own in columns.items()}
    undecided = sorted({c for own in types.values() for c, kind in own.items() if kind is None})
    found = {}
    if undecided:
        # one row per sheet and column
        rates = profile(rows.withColumnRenamed(sheet, "__sheet"), undecided, "", by=["__sheet"])
        found = {(r["__sheet"], r["column"]): r["inferred"] for r in rates.select("__sheet", "column", "inferred").collect()}
    return {name: {c: kind or found.get((name, c), "text") for c, kind in own.items()} for name, own in types.items()}
