"""Mapped and unmapped ingestion with duplicate rejection and a ledger."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.functions.scalars import json_map, map_json, normal_header
from gleanset.functions.text import strip
from gleanset.operators.mapping import custom_value, grown_registry, map_rows, numbered, resolve_headers


@dataclass(frozen=True)
class Ingested:
    """Rows to append, rows refused as duplicates, the ledger row, and the registry if fields were resolved."""

    accepted: DataFrame
    rejected: DataFrame
    ledger: DataFrame
    registry: DataFrame | None = None


def key_parts(mapping: dict[str, str], columns: list[str]) -> list[Column]:
    """Comparable value of every mapped target; NULL and blank are the same."""
    targets = sorted({t for t in mapping.values() if t and ":" in t})
    parts = []
    for target in targets:
        layer, name = target.split(":", 1)
        names = ["first_name", "last_name"] if name == "full_name" and name not in columns else [name]
        for n in names:
            cell = custom_value(n) if layer == "custom" else F.col(f"`{n}`")
            if layer == "custom" or n in columns:
                parts.append(F.lower(strip(F.coalesce(cell, F.lit("")))))
    return parts


def duplicate_key(mapping: dict[str, str], columns: list[str]) -> Column:
    return F.concat_ws("\u0001", *key_parts(mapping, columns))


def first_in_batch(rows: DataFrame, key: str, row_id: str) -> DataFrame:
    """(key, row_id) of the first row per key, combined before the shuffle."""
    return rows.groupBy(key).agg(F.min(row_id).alias(row_id))


def digest(key: Column) -> Column:
    """A key in 16 bytes."""
    return F.unhex(F.md5(key.cast("binary")))


def split_duplicates(
    rows: DataFrame, stored: DataFrame, mapping: dict[str, str], columns: list[str], row_id: str, empty: str | None = None
) -> DataFrame:
    """Rows with ``is_duplicate``: a repeat in the batch or already stored.

    ``stored`` has mapped rows, or the column ``digest`` of an index of their
    keys. Rows that ``empty`` marks have no key: they are no one's repeat, and
    first of none. Keys are reduced to one row each before they meet the stored
    keys, and the verdict returns by unique row id, so a key of any weight stays
    harmless. Only stored keys that the batch has are carried further, so a small
    batch goes to the stored ones and not the reverse.
    """
    key = duplicate_key(mapping, columns)
    keyed = rows.filter(~F.col(empty)) if empty else rows
    firsts = first_in_batch(keyed.select(row_id, digest(key).alias("digest")), "digest", row_id)
    known = stored.select("digest") if stored.columns == ["digest"] else stored.select(digest(key).alias("digest"))
    hits = known.join(firsts.select("digest"), "digest", "left_semi").distinct()
    fresh = firsts.join(hits, "digest", "left_anti").select(row_id, F.lit(True).alias("__fresh"))
    return rows.join(fresh, row_id, "left").withColumn("is_duplicate", F.col("__fresh").isNull()).drop("__fresh")


def rejected_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Refused rows as JSON text, custom fields nested."""
    cells = [*[F.col(f"`{c}`") for c in ("file_id", "imported_by", *columns)], F.col("custom_fields")]
    return rows.select("file_id", F.to_json(F.struct(*cells)).alias("row_data"))


def read_rejects(rejects: DataFrame, columns: list[str]) -> DataFrame:
    """Stored JSON of refused rows as wide rows with a custom-field map."""
    schema = "struct<" + ",".join(f"`{c}`:string" for c in columns) + ",custom_fields:map<string,string>>"
    kept = [c for c in rejects.columns if c != "row_data"]
    return rejects.select(*kept, F.from_json("row_data", schema).alias("r")).filter("r is not null").select(*kept, "r.*")


def ledger_rows(rows: DataFrame, by: list[str], imported: str = "imported", rejected: str = "rejected") -> DataFrame:
    """Rows read, imported and rejected per file and sheet; rows without a value are read only."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(imported)).alias("rows_imported"),
        F.count_if(F.col(rejected)).alias("rows_rejected"),
    ).withColumn("status", F.lit("completed"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("files"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("total_rows", "rows_imported", "rows_rejected")],
    )


def ingest(
    df: DataFrame, mapping: dict[str, str], stored: DataFrame, columns: list[str], row_id: str,
    file_id: str = "file_id", user: str = "import", dedupe: bool = True,
) -> Ingested:
    """Map rows onto the table and, with ``dedupe``, refuse repeats and stored rows.

    ``mapping`` holds final targets (``master:x``, ``custom:id``); unmapped
    ingestion passes what header resolution found and ``dedupe=False``.
    """
    mapped = map_rows(df, mapping, columns, [row_id, file_id], mark="__empty").withColumn("imported_by", F.lit(user))
    if file_id != "file_id":
        mapped = mapped.withColumnRenamed(file_id, "file_id")
    if dedupe:
        judged = split_duplicates(mapped, stored, mapping, columns, row_id, "__empty")
    else:
        judged = mapped.withColumn("is_duplicate", F.lit(False))
    named = judged.withColumns({"imported": ~F.col("__empty") & ~F.col("is_duplicate"), "rejected": ~F.col("__empty") & F.col("is_duplicate")})
    plain = [c for c in mapped.columns if c != "__empty"]
    return Ingested(
        named.filter("imported").select(*plain), rejected_json(named.filter("rejected"), columns), ledger_rows(named, ["file_id"])
    )


def ingest_mapped(
    df: DataFrame, mapping: dict[str, str], registry: DataFrame, stored: DataFrame, columns: list[str], row_id: str,
    file_id: str = "file_id", user: str = "import",
) -> Ingested:
    """A file with a mapping that a user has confirmed, as one job: new fields, rows, rejects, ledger and usage counts.

    Headers sent to ``create_new`` take the field with their normalised name, or
    a new one with the next number. If any row is imported, every header of a
    custom field counts as a use; a new field starts with one.
    """
    spark = df.sparkSession
    wanted = [(h, i) for i, (h, t) in enumerate(mapping.items()) if t == "create_new"]
    headers = spark.createDataFrame(wanted, "header string, place int").withColumn("norm", normal_header(F.col("header")))
    known = registry.groupBy(F.col("normalized_name").alias("norm")).agg(F.min(F.col("id").cast("bigint")).alias("known"))
    met = headers.join(known, "norm", "left")
    unknown = met.filter("known IS NULL").groupBy("norm").agg(F.min_by("header", "place").alias("field_name"))
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    fresh = numbered(unknown, "norm", top, "new_id")
    # One number for each header of the file reaches the driver: targets are part of the plan.
    ids = met.join(fresh.select("norm", "new_id"), "norm", "left").select("header", F.coalesce("known", "new_id").alias("id")).collect()
    targets = final_mapping(mapping, {r["header"]: r["id"] for r in ids})
    done = ingest(df, targets, stored, columns, row_id, file_id, user)
    customs = [(int(t.removeprefix("custom:")),) for t in targets.values() if t.startswith("custom:")]
    imported = done.accepted.select(F.lit(1).alias("one")).limit(1).agg(F.count("one")).scalar()
    used = spark.createDataFrame(customs, "id long").groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", (F.col("n") * imported).alias("uses"))
    return replace(done, registry=grown_registry(registry, fresh, used))


def ingest_unmapped(
    df: DataFrame, aliases: DataFrame, registry: DataFrame, columns: list[str], row_id: str, file_id: str = "file_id", user: str = "import",
) -> Ingested:
    """A file without a mapping as one job: headers find master columns, aliases and fields, or become fields; nothing is refused."""
    spark = df.sparkSession
    named = [(h,) for h in df.columns if h not in (row_id, file_id)]
    resolved, grown = resolve_headers(spark.createDataFrame(named, "header string"), aliases, registry)
    targets = {r["header"]: r["target"] for r in resolved.select("header", "target").collect()}
    ordered = {h: targets[h] for (h,) in named if h in targets}
    none = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) + ", custom_fields map<string,string>")
    return replace(ingest(df, ordered, none, columns, row_id, file_id, user, dedupe=False), registry=grown)


def to_stored(rows: DataFrame) -> DataFrame:
    """Custom fields as JSON text, the stored form."""
    return rows.withColumn("custom_fields", map_json(F.col("custom_fields")))


def from_stored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("custom_fields", json_map(F.col("custom_fields")))


def final_mapping(mapping: dict[str, str], created: dict[str, int]) -> dict[str, str]:
    """Drop ignored headers and give ``create_new`` headers their new field."""
    result = {}
    for header, target in mapping.items():
        if target == "create_new":
            result[header] = f"custom:{created[header]}"
        elif target and target not in ("ignore", "__discard__"):
            result[header] = target
    return result


def store_cleaned(
    cleaned: DataFrame, mapping: dict[str, str], columns: list[str], file_id: int, user: str, as_of: str
) -> DataFrame:
    """Cleaned rows in table form with file, time and user stamps."""
    mapped = map_rows(cleaned, mapping, columns, [], keep_blank=False)
    stamp = F.lit(as_of).cast("timestamp_ntz")
    return mapped.withColumns({
        "file_id": F.lit(file_id), "created_at": stamp, "updated_at": stamp, "imported_by": F.lit(user),
    })
