"""Enrichment of records from a person reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.functions.scalars import best_phone, revenue_text, website
from gleanset.functions.text import filled, strip
from gleanset.operators.skew import lookup

STATUS = "Enriched"


def person_fields() -> dict[str, Column]:
    """Master columns taken from a person record."""
    numbers = F.array(F.struct(F.col("raw_phone").alias("raw_number"), F.col("clean_phone").alias("sanitized_number")))
    return {
        "first_name": F.col("first_name"),
        "last_name": F.col("last_name"),
        "email_address": F.col("email"),
        "primary_phone_number": best_phone(numbers, F.lit("")),
        "job_title": F.col("job_title"),
        "city": F.col("city"),
        "website_url": website(F.col("website_url"), F.col("primary_domain")),
        "annual_revenue": revenue_text(F.col("annual_revenue")),
    }


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")).isin("", "--")


def matched(records: DataFrame, people: DataFrame, row_id: str = "id") -> DataFrame:
    """Records with ``person``: the match on e-mail, else on full name; NULL without one.

    Several persons under one key count as the one with the lowest e-mail. Rows
    without a key, and rows of a heavy key, are spread over tasks.
    """
    fields = person_fields()
    plain = people.select(
        F.lower("email").alias("mail_key"),
        F.lower(F.concat_ws(" ", "first_name", "last_name")).alias("name_key"),
        *[strip(v.cast("string")).alias(n) for n, v in fields.items()],
    )
    person = plain.select("mail_key", "name_key", F.struct(*[filled(F.col(n)).alias(n) for n in fields]).alias("person"))
    by_mail = person.groupBy("mail_key").agg(F.min_by("person", "person").alias("by_mail"))
    by_name = person.groupBy("name_key").agg(F.min_by("person", "mail_key").alias("by_name"))
    full = F.lower(strip(F.concat_ws(" ", F.col("first_name"), F.col("last_name"))))
    keyed = records.withColumns({"mail_key": filled(F.lower("email_address")), "name_key": filled(full)})
    found = lookup(keyed, by_mail, ["mail_key"])
    # a name only decides where the record has no e-mail
    named = found.withColumn("name_key", F.when(F.col("mail_key").isNull(), F.col("name_key")))
    both = lookup(named, by_name, ["name_key"])
    return both.select(
        *[F.col(f"`{c}`") for c in records.columns], F.coalesce("by_mail", "by_name").alias("person")
    )


def enrich(records: DataFrame, people: DataFrame, label: str = "Bulk Enrichment", row_id: str = "id") -> DataFrame:
    """Fill blank and ``--`` fields from the matched person and stamp the record.

    ``enrich_status`` is enriched, skipped (nothing new) or no_match, and
    ``enriched_fields`` lists the filled columns.
    """
    rows = matched(records, people, row_id)
    names = [n for n in person_fields() if n in records.columns]
    # the stamps are fields too: blank ones make a match count as enriched
    offered = {n: F.col("person")[n] for n in names}
    for stamp, text in (("lead_source", label), ("record_status", STATUS)):
        if stamp in records.columns:
            offered[stamp] = F.when(F.col("person").isNotNull(), F.lit(text))
    news = {n: _blank(F.col(f"`{n}`")) & v.isNotNull() for n, v in offered.items()}
    listed = F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, hit in news.items()]))
    marked = rows.withColumn("enriched_fields", listed)
    status = (
        F.when(F.col("person").isNull(), "no_match")
        .when(F.size("enriched_fields") == 0, "skipped")
        .otherwise("enriched")
    )
    values = {n: F.when(news[n], offered[n]).otherwise(F.col(f"`{n}`")) for n in names}
    for stamp in ("lead_source", "record_status"):
        if stamp in offered:
            values[stamp] = F.when(F.size("enriched_fields") > 0, offered[stamp]).otherwise(F.col(stamp))
    return marked.select(
        *[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in records.columns],
        status.alias("enrich_status"), "enriched_fields",
    )


def compare(records: DataFrame, people: DataFrame, row_id: str = "id") -> DataFrame:
    """(row_id, field, existing, enriched) for every value the match offers."""
    rows = matched(records, people, row_id).filter("person is not null")
    cells = F.array(*[
        F.struct(F.lit(n).alias("field"), F.coalesce(strip(F.col(f"`{n}`")), F.lit("")).alias("existing"),
                 F.col("person")[n].alias("enriched"))
        for n in person_fields() if n in records.columns
    ])
    return rows.select(row_id, F.inline(cells)).filter("enriched is not null")


def apply_updates(records: DataFrame, updates: DataFrame, allowed: list[str], row_id: str = "id") -> DataFrame:
    """Write the selected field updates of allowed columns; NULL leaves a value."""
    columns = [c for c in updates.columns if c in allowed and c in records.columns]
    joined = records.alias("r").join(updates.alias("u"), row_id, "left")
    return joined.select(
        F.col(row_id),
        *[F.coalesce(F.col(f"u.`{c}`"), F.col(f"r.`{c}`")).alias(c) if c in columns else F.col(f"r.`{c}`")
          for c in records.columns if c != row_id],
    )
