"""Header mapping, hybrid-schema projections and schema changes.

A record keeps fixed columns and ``custom_fields``, a map from field id to
text; the map is JSON text only where it is read or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions.scalars import (
    column_label, field_label, first_name, header_name, last_name, normal_header, no_null_words,
)
from gleanset.functions.text import empty, filled, missing, strip
from gleanset.operators.skew import lookup

MAX_FIELDS = 10_000


# ── Registry as a dimension ─────────────────────────────────────────────────
def registry_names(registry: DataFrame, active_only: bool = False) -> dict[str, str]:
    """Field id -> display name; the registry is configuration and bounded."""
    rows = registry.filter("is_active = 1") if active_only else registry
    found = rows.select(F.col("id").cast("string"), "field_name").orderBy(F.col("id").cast("bigint")).limit(MAX_FIELDS + 1).collect()
    if len(found) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} registered fields")
    return {r[0]: r[1] for r in found}


def literal_map(entries: dict[str, str]) -> Column:
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def numbered(rows: DataFrame, column: str, start: Column, name: str) -> DataFrame:
    """Dense numbers after ``start`` over distinct texts, without one global sort.

    The first hex digits of a digest split the texts into 4096 even groups;
    each group is numbered by itself after the running total of the groups
    before it.
    """
    grouped = rows.withColumn("__group", F.substring(F.md5(F.col(column)), 1, 3))
    sizes = grouped.groupBy("__group").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(W.orderBy("__group").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("__group", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("__group").orderBy(column))
    placed = grouped.withColumn("__within", within).join(F.broadcast(offsets), "__group")
    return placed.withColumn(name, start + F.col("__before") + F.col("__within")).drop(
        "__group", "__before", "__within"
    )


# ── Header mapping ──────────────────────────────────────────────────────────
def _alias_targets(aliases: DataFrame) -> DataFrame:
    target = F.concat("target_type", F.lit(":"), "target_identifier")
    return aliases.select(normal_header(F.col("alias")).alias("norm"), target.alias("target"), F.col("id").alias("place"))


def _master_targets(spark: SparkSession) -> DataFrame:
    rows = []
    for i, (name, label) in enumerate(fixed.MASTER_LABELS.items()):
        rows += [(n, f"master:{name}", i) for n in dict.fromkeys([name, header_name(label)])]
    return spark.createDataFrame(rows, "norm string, target string, place int")


def _registry_targets(registry: DataFrame) -> DataFrame:
    norms = F.explode(F.array_distinct(F.array(F.col("normalized_name"), normal_header(F.col("field_name")))))
    return registry.select(
        norms.alias("norm"), F.concat(F.lit("custom:"), F.col("id").cast("string")).alias("target"), F.col("id").alias("place")
    )


def _first_target(*sources: DataFrame) -> DataFrame:
    """One target per normalised header, earlier sources first, then lowest id."""
    parts = [
        s.select("norm", "target", F.lit(i).alias("source"), F.col("place").cast("bigint").alias("place"))
        for i, s in enumerate(sources)
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("norm").agg(F.min_by("target", F.struct("source", "place")).alias("target"))


def suggest_mapping(
    headers: DataFrame, aliases: DataFrame, registry: DataFrame, row_id: str = "file_id"
) -> DataFrame:
    """Target per header: alias, master column, active custom field, else create_new.

    Equal lower-case texts have equal normalised forms, so one join decides.
    """
    targets = _first_target(
        _alias_targets(aliases), _master_targets(headers.sparkSession), _registry_targets(registry.filter("is_active = 1"))
    )
    named = headers.withColumn("norm", normal_header(F.col("header")))
    return lookup(named, targets, ["norm"]).withColumn("target", F.coalesce("target", F.lit("create_new")))


def resolve_headers(
    headers: DataFrame, aliases: DataFrame, registry: DataFrame, row_id: str = "file_id"
) -> tuple[DataFrame, DataFrame]:
    """Unmapped ingestion: master column, alias, registry field, else a new field.

    Returns the headers with target and ``is_new``, and the registry with the
    new fields and raised usage counts.
    """
    spark = headers.sparkSession
    masters = _master_targets(spark).filter(F.concat(F.lit("master:"), "norm") == F.col("target"))
    known = registry.select(
        F.col("normalized_name").alias("norm"), F.concat(F.lit("custom:"), F.col("id").cast("string")).alias("target"),
        F.col("id").alias("place"),
    )
    targets = _first_target(masters, _alias_targets(aliases), known)
    named = headers.withColumn("norm", normal_header(F.col("header"))).filter("norm <> ''")
    matched = lookup(named, targets, ["norm"])
    unknown = matched.filter("target is null").groupBy("norm").agg(F.min(strip(F.col("header"))).alias("field_name"))
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    fresh = numbered(unknown, "norm", top, "new_id")
    resolved = lookup(matched, fresh.select("norm", "new_id"), ["norm"]).select(
        *headers.columns, "norm",
        F.coalesce("target", F.concat(F.lit("custom:"), F.col("new_id").cast("string"))).alias("target"),
        F.col("target").isNull().alias("is_new"),
    )
    used = (
        resolved.filter("not is_new and target like 'custom:%'")
        .groupBy(F.substring_index("target", ":", -1).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    )
    return resolved, grown_registry(registry, fresh, used)


def grown_registry(registry: DataFrame, fresh: DataFrame, used: DataFrame) -> DataFrame:
    """The registry with ``fresh`` fields (norm, field_name, new_id), each used once, and the uses of ``used`` (id, uses) added."""
    rows = registry.select(F.col("id").cast("bigint").alias("id"), "field_name", "normalized_name", "is_active").unionByName(
        fresh.select(F.col("new_id").alias("id"), "field_name", F.col("norm").alias("normalized_name"), F.lit(1).alias("is_active"))
    )
    first = fresh.select(F.col("new_id").alias("id"), F.lit(1).cast("bigint").alias("uses"))
    uses = used.select("id", "uses").unionByName(first).groupBy("id").agg(F.sum("uses").alias("uses"))
    return rows.join(uses, "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)).cast("bigint"))


# ── Projection onto the hybrid table ────────────────────────────────────────
def map_rows(
    df: DataFrame,
    mapping: dict[str, str],
    columns: list[str],
    carry: list[str],
    null_words: bool = True,
    keep_blank: bool = True,
    mark: str | None = None,
) -> DataFrame:
    """Rows as fixed columns plus ``custom_fields``; rows without a value go, or stay with ``mark`` set if it names a column.

    ``mapping`` sends a header to ``master:column`` or ``custom:id``; a full
    name goes to first and last name unless the table has that column. With
    ``keep_blank=False`` blank cells count as missing.
    """
    fields: dict[str, Column] = {}
    customs: dict[str, Column] = {}
    values = []
    for header, target in mapping.items():
        if header not in df.columns or not target or ":" not in target:
            continue
        layer, name = target.split(":", 1)
        value = strip(F.col(f"`{header}`").cast("string"))
        if null_words:
            value = no_null_words(value)
        if not keep_blank:
            value = filled(value)
        values.append(value)
        # a later header overrides an earlier one where it has a value
        if layer == "custom":
            customs[name] = F.coalesce(value, customs[name]) if name in customs else value
        elif name == "full_name" and name not in columns:
            for part, cell in (("first_name", first_name(value)), ("last_name", last_name(value))):
                fields[part] = F.coalesce(cell, fields[part]) if part in fields else cell
        elif name in columns:
            fields[name] = F.coalesce(value, fields[name]) if name in fields else value
    none = F.coalesce(*values).isNull() if values else F.lit(True)
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in customs]), F.array(*customs.values())) if customs \
        else F.create_map().cast("map<string,string>")
    kept = F.map_filter(pairs, lambda k, v: v.isNotNull())
    return (df if mark else df.filter(~none)).select(
        *carry,
        *[fields.get(n, F.lit(None).cast("string")).alias(n) for n in columns],
        F.when(F.size(kept) > 0, kept).alias("custom_fields"), *([none.alias(mark)] if mark else []),
    )


def custom_value(field_id: str, fields: str = "custom_fields") -> Column:
    return F.try_element_at(F.col(fields), F.lit(field_id))


def resolve_custom_keys(fields: Column, names: dict[str, str], unknown: str | None = None) -> Column:
    """Field ids as display names; unknown ids stay or take ``unknown.format(id)``."""
    known = literal_map(names)

    def renamed(key: Column, value: Column) -> Column:
        fallback = key
        if unknown is not None:
            before, after = unknown.split("{}")
            fallback = F.when(key.try_cast("bigint").isNotNull(), F.concat(F.lit(before), key, F.lit(after))).otherwise(key)
        return F.coalesce(F.try_element_at(known, key), fallback)

    return F.transform_keys(fields, renamed)


def flatten(
    df: DataFrame, columns: list[str], names: dict[str, str], ids: list[str], label=column_label
) -> DataFrame:
    """One column per fixed column and per custom field, under display headers."""
    return df.select(
        *[F.col(f"`{n}`").alias(label(n)) for n in columns],
        *[custom_value(i).alias(names.get(i, f"Custom Field {i}")) for i in ids],
    )


def custom_ids(df: DataFrame, fields: str = "custom_fields") -> list[str]:
    """Field ids in use, in numeric order; bounded by the registry."""
    found = df.select(F.explode(F.map_keys(fields)).alias("id")).distinct().limit(MAX_FIELDS + 1).collect()
    if len(found) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} custom fields")
    return sorted((r["id"] for r in found), key=lambda i: (not i.isdigit(), int(i) if i.isdigit() else 0, i))


def export_projection(df: DataFrame, wanted: list[str], names: dict[str, str]) -> DataFrame:
    """Requested ``master:x`` / ``custom:id`` columns in order, under display names."""
    picked = []
    for target in wanted:
        layer, name = target.split(":", 1)
        if layer == "custom":
            picked.append(filled(custom_value(name)).alias(names.get(name, f"Custom Field {name}")))
        elif name in df.columns:
            picked.append(F.col(f"`{name}`").alias(column_label(name)))
    return df.select(*picked)


# ── Schema changes ──────────────────────────────────────────────────────────
def _or_null(fields: Column) -> Column:
    return F.when(F.size(fields) > 0, fields)


def promote(df: DataFrame, field_id: str, column: str, fields: str = "custom_fields") -> DataFrame:
    """Custom field -> physical column; the key leaves the map."""
    rest = F.map_filter(F.col(fields), lambda k, v: k != field_id)
    value = custom_value(field_id, fields)
    if column in df.columns:
        value = F.coalesce(value, F.col(f"`{column}`"))
    return df.withColumns({column: value, fields: _or_null(rest)})


def demote(df: DataFrame, column: str, field_id: str, fields: str = "custom_fields") -> DataFrame:
    """Physical column -> custom field for its non-empty values; the column goes."""
    if column in fixed.SYSTEM_COLUMNS:
        raise ValueError("cannot move a system column")
    current = F.coalesce(F.col(fields), F.create_map().cast("map<string,string>"))
    others = F.map_filter(current, lambda k, v: k != field_id)
    cell = F.col(f"`{column}`").cast("string")
    moved = F.map_concat(others, F.create_map(F.lit(field_id), cell))
    return df.withColumn(fields, F.when(empty(cell), F.col(fields)).otherwise(moved)).drop(column)


def delete_custom(df: DataFrame, field_id: str, fields: str = "custom_fields") -> DataFrame:
    return df.withColumn(fields, _or_null(F.map_filter(F.col(fields), lambda k, v: k != field_id)))


def repoint_aliases(aliases: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    hit = (F.col("target_type") == old[0]) & (F.col("target_identifier") == old[1])
    return aliases.withColumns({
        "target_type": F.when(hit, new[0]).otherwise(F.col("target_type")),
        "target_identifier": F.when(hit, new[1]).otherwise(F.col("target_identifier")),
    })


def add_column(df: DataFrame, label: str, dtype: str = "string") -> DataFrame:
    name = header_name(label, keep_symbols=True)
    if not name or name in fixed.SYSTEM_COLUMNS or name in df.columns:
        raise ValueError(f"column {name!r} is reserved or exists")
    return df.withColumn(name, F.lit(None).cast(dtype))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name in fixed.SYSTEM_COLUMNS or name not in df.columns:
        raise ValueError(f"column {name!r} is reserved or missing")
    return df.drop(name)


def rename_column(df: DataFrame, old: str, label: str) -> DataFrame:
    new = header_name(label, keep_symbols=True)
    if old in fixed.SYSTEM_COLUMNS or new in fixed.SYSTEM_COLUMNS or new in df.columns:
        raise ValueError(f"cannot rename {old!r} to {new!r}")
    return df.withColumnRenamed(old, new)


def set_active(registry: DataFrame, field_id: int, active: bool) -> DataFrame:
    changed = F.when(F.col("id") == field_id, F.lit(int(active))).otherwise(F.col("is_active"))
    return registry.withColumn("is_active", changed)


# ── Record views ────────────────────────────────────────────────────────────
def import_records(df: DataFrame, record: str = "record") -> list[Column]:
    """Fixed columns of an imported record map, through the accepted synonyms."""
    from gleanset.functions.scalars import synonym

    return [
        synonym(F.col(record), names, "active" if column == "record_status" else None).alias(column)
        for column, names in fixed.IMPORT_SYNONYMS.items()
    ]


def display_columns(df: DataFrame) -> list[Column]:
    """name, email, phone, company and state for display, ``--`` when empty."""
    from gleanset.functions.scalars import full_name, or_dashes

    shown = {"email": "email_address", "phone": "primary_phone_number", "company": "company_name", "state": "state_province"}
    return [
        or_dashes(full_name(F.col("first_name"), F.col("last_name"))).alias("name"),
        *[or_dashes(F.col(source)).alias(name) for name, source in shown.items() if source in df.columns],
    ]


def extra_attributes(df: DataFrame, names: dict[str, str], columns: list[str], key: str = "id") -> DataFrame:
    """(key, label, value): custom fields under their names and populated extra columns."""
    fields = resolve_custom_keys(F.col("custom_fields"), names, "Unregistered Field #{}")
    customs = df.select(key, F.explode(fields).alias("label", "value"))
    cells = F.array(*[F.struct(F.lit(field_label(n)).alias("label"), F.col(f"`{n}`").cast("string").alias("value")) for n in columns])
    extras = df.select(key, F.inline(cells)).filter(~missing(F.col("value")))
    return customs.unionByName(extras)


def field_usage(df: DataFrame, fields: str = "custom_fields") -> DataFrame:
    """Rows holding each custom field, counted in one pass."""
    return df.select(F.explode(F.map_keys(fields)).alias("field_id")).groupBy("field_id").agg(F.count(F.lit(1)).alias("n"))


def split_full_name(df: DataFrame) -> DataFrame:
    """Replace ``full_name`` by first and last name; without that column nothing changes."""
    if "full_name" not in df.columns:
        return df
    return df.withColumns({
        "first_name": first_name(F.col("full_name")), "last_name": last_name(F.col("full_name"))
    }).drop("full_name")
