"""Schema, ingestion, search, export, completeness and enrichment queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gleanset.catalog.base import Tables, query
from gleanset.functions import scalars
from gleanset.operators import completeness as complete, enrich as enriching, filters, mapping as hybrid
from gleanset.plans import ingest as ingestion, paging, records as plan
from gleanset.plans.records import RecordQuery

c = F.col

NAMES = {"1": "Loyalty Tier", "2": "Market Segment"}
_J1, _J2, _J77 = ("json_extract_string(custom_fields, '$.\"%s\"')" % i for i in ("1", "2", "77"))


def records(t: Tables):
    return ingestion.from_stored(t.records)


# ── Projections and schema changes ──────────────────────────────────────────
_MAPPED = {"full_name": "master:full_name", "email": "master:email_address", "phone": "custom:2", "segment": "custom:5", "website": "ignore"}
_TABLE = ["first_name", "last_name", "email_address"]
_MAP_SQL = r"""
mapped AS (SELECT record_id, nullif(regexp_extract(n, '^(\S+)', 1), '') AS first_name, nullif(regexp_extract(n, '^\S+\s+(.*)$', 1), '') AS last_name,
  trim(email) AS email_address, trim(phone) AS phone, trim(segment) AS segment FROM (SELECT *, trim(full_name) AS n FROM contacts) x)
"""


@query("p2_mapped_rows", f"WITH {_MAP_SQL} SELECT * FROM mapped")
def _(t: Tables):
    rows = hybrid.map_rows(t.contacts, _MAPPED, _TABLE, ["record_id"])
    return rows.select("record_id", *_TABLE, hybrid.custom_value("2").alias("phone"), hybrid.custom_value("5").alias("segment"))


@query("p3_split_full_name", r"""
SELECT record_id, nullif(regexp_extract(trim(full_name), '^(\S+)', 1), '') AS first_name, nullif(regexp_extract(trim(full_name), '^\S+\s+(.*)$', 1), '') AS last_name FROM contacts""")
def _(t: Tables):
    return t.contacts.select("record_id", scalars.first_name(c("full_name")).alias("first_name"), scalars.last_name(c("full_name")).alias("last_name"))


@query("p5_null_words", """
SELECT record_id, CASE WHEN lower(trim(v)) IN ('nan', 'nat', 'null') THEN NULL ELSE v END AS value
FROM (SELECT record_id, CASE record_id % 6 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'null' WHEN 2 THEN 'NaT' ELSE segment END AS v FROM contacts) x""")
def _(t: Tables):
    dirty = F.when(c("record_id") % 6 == 0, " NaN ").when(c("record_id") % 6 == 1, "null").when(c("record_id") % 6 == 2, "NaT").otherwise(c("segment"))
    return t.contacts.select("record_id", scalars.no_null_words(dirty).alias("value"))


@query("p6_rows_with_a_value", "SELECT record_id, trim(email) AS email, trim(website) AS website FROM contacts WHERE coalesce(email, website) IS NOT NULL")
def _(t: Tables):
    return hybrid.map_rows(t.contacts, {"email": "master:email", "website": "master:website"}, ["email", "website"], ["record_id"]).drop("custom_fields")


@query("p7_export_projection", f"""
SELECT country AS "Country", first_name AS "First Name", nullif({_J1}, '') AS "Loyalty Tier", email_address AS "Email Address", nullif({_J77}, '') AS "Custom Field 77" FROM records""")
def _(t: Tables):
    wanted = ["master:country", "master:first_name", "custom:1", "master:email_address", "custom:77", "master:unknown"]
    return hybrid.export_projection(records(t), wanted, NAMES)


@query("p8_resolved_keys", f"""
SELECT id, {_J1} AS tier, {_J2} AS segment, {_J77} AS unknown FROM records""")
def _(t: Tables):
    named = records(t).select("id", hybrid.resolve_custom_keys(c("custom_fields"), NAMES, "Unregistered Field #{}").alias("m"))
    return named.select("id", *[F.try_element_at("m", F.lit(k)).alias(n) for k, n in (
        ("Loyalty Tier", "tier"), ("Market Segment", "segment"), ("Unregistered Field #77", "unknown"))])


@query("p9_flattened_fields", f"""
SELECT id AS "Id", company_name AS "Company Name", {_J1} AS "Loyalty Tier", {_J2} AS "Market Segment", {_J77} AS "Custom Field 77" FROM records""")
def _(t: Tables):
    rows = records(t)
    return hybrid.flatten(rows, ["id", "company_name"], NAMES, hybrid.custom_ids(rows))


@query("s6_flat_table_for_cleaning", f"""
SELECT first_name AS "First Name", state_province AS "State / Province", {_J1} AS "Loyalty Tier", {_J2} AS "Market Segment", {_J77} AS "Custom Field 77" FROM records""")
def _(t: Tables):
    rows = records(t)
    names = hybrid.registry_names(t.field_registry, active_only=True)
    return hybrid.flatten(rows, ["first_name", "state_province"], names, hybrid.custom_ids(rows))


@query("p10_promote_field", f"""
SELECT id, {_J1} AS loyalty_tier, nullif(concat_ws(',', CASE WHEN {_J2} IS NULL THEN NULL ELSE concat('2=', {_J2}) END, CASE WHEN {_J77} IS NULL THEN NULL ELSE concat('77=', {_J77}) END), '') AS rest FROM records""")
def _(t: Tables):
    return hybrid.promote(records(t), "1", "loyalty_tier").select("id", "loyalty_tier", _pairs("custom_fields").alias("rest"))


def _pairs(fields: str):
    entries = F.array_sort(F.map_entries(fields))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("p11_demote_column", f"""
SELECT id, nullif(concat_ws(',', CASE WHEN {_J1} IS NULL THEN NULL ELSE concat('1=', {_J1}) END, CASE WHEN {_J2} IS NULL THEN NULL ELSE concat('2=', {_J2}) END,
  CASE WHEN {_J77} IS NULL THEN NULL ELSE concat('77=', {_J77}) END, CASE WHEN lead_source IS NULL OR lead_source = '' THEN NULL ELSE concat('9=', lead_source) END), '') AS fields FROM records""")
def _(t: Tables):
    moved = hybrid.demote(records(t), "lead_source", "9")
    return moved.select("id", F.nullif(_pairs("custom_fields"), F.lit("")).alias("fields"))


@query("p12_delete_field", f"""
SELECT id, CASE WHEN {_J2} IS NULL THEN NULL ELSE concat('2=', {_J2}, ',77=', {_J77}) END AS fields FROM records""")
def _(t: Tables):
    return hybrid.delete_custom(records(t), "1").select("id", _pairs("custom_fields").alias("fields"))


@query("p13_changed_columns", """
SELECT id, company_name AS account_name, CAST(NULL AS VARCHAR) AS middle_name, country FROM records""")
def _(t: Tables):
    rows = hybrid.rename_column(hybrid.add_column(t.records, "Middle Name"), "company_name", "Account Name")
    return hybrid.drop_column(rows, "gender" if "gender" in rows.columns else "job_title").select("id", "account_name", "middle_name", "country")


@query("p13b_active_fields", f"""
SELECT id, {_J1} AS "Loyalty Tier", json_extract_string(custom_fields, '$."3"') AS "E-mail Opt In", json_extract_string(custom_fields, '$."4"') AS "Fax" FROM records""")
def _(t: Tables):
    """Fields that are active once one is switched off and another on, as columns of the records."""
    registry = hybrid.set_active(hybrid.set_active(t.field_registry, 2, False), 4, True)
    names = hybrid.registry_names(registry, active_only=True)
    return hybrid.flatten(records(t), ["id"], names, list(names), label=str)


@query("p14_import_synonyms", """
SELECT id, email_address, CASE WHEN id % 2 = 0 THEN nullif(first_name, '') ELSE NULL END AS first_name, nullif(state_province, '') AS state_province, coalesce(nullif(record_status, ''), 'active') AS record_status FROM records""")
def _(t: Tables):
    record = F.create_map(
        F.lit("email_address"), F.lit(""), F.lit("Email"), c("email_address"), F.when(c("id") % 2 == 0, "First Name").otherwise("other"),
        c("first_name"), F.lit("state"), c("state_province"), F.lit("status"), c("record_status"))
    rows = t.records.select("id", record.alias("record"))
    return rows.select("id", *hybrid.import_records(rows)).select("id", "email_address", "first_name", "state_province", "record_status")


@query("p15_display_columns", """
SELECT id, coalesce(nullif(trim(concat(coalesce(first_name, ''), ' ', coalesce(last_name, ''))), ''), '--') AS name, coalesce(nullif(email_address, ''), '--') AS email,
  coalesce(nullif(primary_phone_number, ''), '--') AS phone, coalesce(nullif(company_name, ''), '--') AS company, coalesce(nullif(state_province, ''), '--') AS state FROM records""")
def _(t: Tables):
    return t.records.select("id", *hybrid.display_columns(t.records))


@query("p16_extra_attributes", f"""
SELECT id, 'Loyalty Tier' AS label, {_J1} AS value FROM records WHERE {_J1} IS NOT NULL UNION ALL SELECT id, 'Market Segment', {_J2} FROM records WHERE {_J2} IS NOT NULL
UNION ALL SELECT id, 'Unregistered Field #77', {_J77} FROM records WHERE {_J77} IS NOT NULL UNION ALL SELECT id, 'Job Title', job_title FROM records WHERE trim(job_title) <> ''
UNION ALL SELECT id, 'Lead Source', lead_source FROM records WHERE trim(lead_source) <> ''""")
def _(t: Tables):
    return hybrid.extra_attributes(records(t), NAMES, ["job_title", "lead_source"])


@query("p17_run_labels", """
SELECT id, concat('f', CAST(id AS VARCHAR), '.xlsx') AS file, CASE id % 4 WHEN 0 THEN 'cleaned' WHEN 1 THEN 'invalid' WHEN 2 THEN 'removed' ELSE 'logs' END AS kind,
  concat('out_', CAST(id AS VARCHAR), '.csv') AS base FROM runs""")
def _(t: Tables):
    folder = F.element_at(F.array(*map(F.lit, ["Cleaned", "Invalid", "Removed", "Other"])), (c("id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("Files/"), folder, F.lit("/out_"), c("id").cast("string"), F.lit(".csv"))
    return t.runs.select("id", scalars.run_file(c("action")).alias("file"), scalars.file_kind(path).alias("kind"), scalars.base_name(path).alias("base"))


@query("m10_split_names", r"""
SELECT record_id, nullif(regexp_extract(trim(full_name), '^(\S+)', 1), '') AS first_name, nullif(regexp_extract(trim(full_name), '^\S+\s+(.*)$', 1), '') AS last_name, email FROM contacts""")
def _(t: Tables):
    return hybrid.split_full_name(t.contacts.select("record_id", "full_name", "email"))


@query("a17_field_usage", f"""
SELECT '1' AS field_id, count({_J1}) AS n FROM records UNION ALL SELECT '2', count({_J2}) FROM records UNION ALL SELECT '77', count({_J77}) FROM records""")
def _(t: Tables):
    return hybrid.field_usage(records(t))


@query("a17b_column_usage", """
SELECT 'job_title' AS col, count(*) FILTER (WHERE job_title <> '') AS n FROM records UNION ALL SELECT 'lead_source', count(*) FILTER (WHERE lead_source <> '') FROM records""")
def _(t: Tables):
    return complete.missing_stats(t.records, ["job_title", "lead_source"]).select(c("column").alias("col"), (c("total") - c("missing")).alias("n"))


# ── Ingestion ───────────────────────────────────────────────────────────────
_INGEST_MAP = {"full_name": "master:full_name", "email": "master:email_address", "phone": "custom:2"}
_INGEST_SQL = rf"""
WITH {_MAP_SQL},
incoming AS (SELECT m.*, record_id % 3 AS file_id, concat_ws('|', coalesce(phone, ''), lower(coalesce(email_address, '')), lower(coalesce(first_name, '')), lower(coalesce(last_name, ''))) AS k FROM mapped m
  WHERE coalesce(phone, email_address, first_name, last_name) IS NOT NULL),
judged AS (SELECT i.*, row_number() OVER (PARTITION BY k ORDER BY record_id) > 1 OR k IN (SELECT k FROM incoming s WHERE s.segment = 'BUILDING') AS is_duplicate FROM incoming i)
"""


def _incoming(t: Tables):
    return t.contacts.withColumn("file_id", c("record_id") % 3)


def _stored(t: Tables):
    return hybrid.map_rows(t.contacts.filter("segment = 'BUILDING'"), _INGEST_MAP, _TABLE, ["record_id"])


def _ingest(t: Tables):
    return ingestion.ingest(_incoming(t), _INGEST_MAP, _stored(t), _TABLE, "record_id", user="loader")


@query("m2_mapped_ingestion", _INGEST_SQL + "SELECT record_id, file_id, first_name, last_name, email_address, phone FROM judged WHERE NOT is_duplicate")
def _(t: Tables):
    return _ingest(t).accepted.select("record_id", "file_id", *_TABLE, hybrid.custom_value("2").alias("phone"))


# A file's total is what was read, with the rows that have no value.
_READ_SQL = "(SELECT record_id, record_id % 3 AS file_id FROM contacts) r LEFT JOIN judged j USING (record_id)"


@query("m3_unmapped_ingestion", _INGEST_SQL + f"SELECT r.file_id, count(*) AS total_rows, count(j.record_id) AS rows_imported, 0 AS rows_rejected FROM {_READ_SQL} GROUP BY r.file_id")
def _(t: Tables):
    done = ingestion.ingest(_incoming(t), _INGEST_MAP, _stored(t), _TABLE, "record_id", dedupe=False)
    return done.ledger.select("file_id", "total_rows", "rows_imported", "rows_rejected")


def _sparse(t: Tables):
    """Incoming rows of which every seventh has no value in a mapped column."""
    gone = c("record_id") % 7 == 0
    return _incoming(t).withColumns({n: F.when(~gone, c(n)) for n in ("full_name", "email", "phone")}).withColumnRenamed("website", "Loyalty-Tier")


_SPARSE_SQL = rf"""
WITH {_MAP_SQL},
incoming AS (SELECT m.*, concat_ws('|', coalesce(phone, ''), lower(coalesce(email_address, '')), lower(coalesce(first_name, '')), lower(coalesce(last_name, ''))) AS k FROM mapped m
  WHERE coalesce(phone, email_address, first_name, last_name) IS NOT NULL AND record_id % 7 <> 0),
judged AS (SELECT i.record_id, row_number() OVER (PARTITION BY k ORDER BY record_id) = 1 AS imported FROM incoming i)
"""


@query("m2b_ledger_of_sparse_files", _SPARSE_SQL + """
SELECT c.record_id % 3 AS file_id, count(*) AS total_rows, count(*) FILTER (WHERE imported) AS rows_imported, count(*) FILTER (WHERE NOT imported) AS rows_rejected, 'completed' AS status
FROM contacts c LEFT JOIN judged USING (record_id) GROUP BY 1""")
def _(t: Tables):
    """Rows without a value are read, but neither imported nor refused."""
    none = _stored(t).limit(0)
    return ingestion.ingest(_sparse(t), _INGEST_MAP, none, _TABLE, "record_id").ledger


_NEW_FIELDS = """
fresh AS (SELECT norm, field_name, CAST(4 + row_number() OVER (ORDER BY substr(md5(norm), 1, 3), norm) AS BIGINT) AS id FROM (VALUES {0}) AS x(norm, field_name))"""


@query("m2c_registry_after_ingestion", "WITH " + _NEW_FIELDS.format("('segment', 'segment'), ('revenue', 'revenue')") + """,
imported AS (SELECT least(count(*), 1) AS n FROM contacts WHERE record_id % 7 <> 0 AND coalesce(full_name, email, phone) IS NOT NULL)
SELECT CAST(id AS BIGINT) AS id, field_name, normalized_name, is_active, CASE WHEN id IN (1, 2) THEN n ELSE 0 END AS uses FROM field_registry, imported
UNION ALL SELECT id, field_name, norm, 1, 1 + n FROM fresh, imported""")
def _(t: Tables):
    """Two headers become fields, one finds its field by the normalised name; each custom target counts as a use."""
    mapping = {**_INGEST_MAP, "segment": "create_new", "revenue": "create_new", "Loyalty-Tier": "create_new", "no_such_header": "ignore"}
    return ingestion.ingest_mapped(_sparse(t), mapping, t.field_registry, _stored(t), _TABLE, "record_id").registry


@query("m3b_unmapped_file", "WITH " + _NEW_FIELDS.format(", ".join(f"('{n}', '{n}')" for n in ("full_name", "email", "phone", "website", "revenue", "joined"))) + """
SELECT CAST(id AS BIGINT) AS id, field_name, normalized_name, is_active, CASE WHEN id = 2 THEN 1 ELSE 0 END AS uses FROM field_registry UNION ALL SELECT id, field_name, norm, 1, 1 FROM fresh""")
def _(t: Tables):
    """Headers of a file without a mapping: one is an alias, the others become fields."""
    return ingestion.ingest_unmapped(_incoming(t), t.field_aliases, t.field_registry, _TABLE, "record_id").registry


@query("j5_duplicates_of_stored", _INGEST_SQL + "SELECT record_id, is_duplicate FROM judged")
def _(t: Tables):
    mapped = hybrid.map_rows(t.contacts, _INGEST_MAP, _TABLE, ["record_id"])
    return ingestion.split_duplicates(mapped, _stored(t), _INGEST_MAP, _TABLE, "record_id").select("record_id", "is_duplicate")


@query("w7_first_in_batch", _INGEST_SQL + "SELECT min(record_id) AS record_id FROM incoming GROUP BY k")
def _(t: Tables):
    mapped = hybrid.map_rows(t.contacts, _INGEST_MAP, _TABLE, ["record_id"])
    keyed = mapped.select("record_id", ingestion.duplicate_key(_INGEST_MAP, _TABLE).alias("k"))
    return ingestion.first_in_batch(keyed, "k", "record_id").select("record_id")


@query("s5_ledger", _INGEST_SQL + f"""
SELECT r.file_id, count(*) AS total_rows, count(*) FILTER (WHERE NOT is_duplicate) AS rows_imported, count(*) FILTER (WHERE is_duplicate) AS rows_rejected, 'completed' AS status FROM {_READ_SQL} GROUP BY r.file_id""")
def _(t: Tables):
    return _ingest(t).ledger


@query("s5b_ledger_totals", _INGEST_SQL + f"""
SELECT count(DISTINCT r.file_id) AS files, count(*) AS total_rows, count(*) FILTER (WHERE NOT is_duplicate) AS rows_imported, count(*) FILTER (WHERE is_duplicate) AS rows_rejected FROM {_READ_SQL}""")
def _(t: Tables):
    return ingestion.ledger_totals(_ingest(t).ledger)


@query("s9_rejected_rows", _INGEST_SQL + "SELECT file_id, email_address, phone, imported_by FROM (SELECT *, 'loader' AS imported_by FROM judged) x WHERE is_duplicate")
def _(t: Tables):
    rejects = _ingest(t).rejected
    text = c("row_data")
    return rejects.select("file_id", F.get_json_object(text, "$.email_address").alias("email_address"),
                          F.get_json_object(text, "$.custom_fields.2").alias("phone"), F.get_json_object(text, "$.imported_by").alias("imported_by"))


@query("s10_rejects_read_back", _INGEST_SQL + "SELECT CAST(file_id AS BIGINT) AS file_id, first_name, last_name, email_address, phone FROM judged WHERE is_duplicate")
def _(t: Tables):
    wide = ingestion.read_rejects(_ingest(t).rejected, _TABLE)
    return wide.select("file_id", *_TABLE, hybrid.custom_value("2").alias("phone"))


@query("s8_store_cleaned", r"""
SELECT nullif(regexp_extract(trim(full_name), '^(\S+)', 1), '') AS first_name, nullif(trim(email), '') AS email_address, nullif(trim(phone), '') AS phone, 7 AS file_id, 'loader' AS imported_by,
  '2024-02-01 00:00:00' AS created_at FROM contacts WHERE coalesce(nullif(trim(full_name), ''), nullif(trim(email), ''), nullif(trim(phone), '')) IS NOT NULL""")
def _(t: Tables):
    rows = ingestion.store_cleaned(t.contacts, _INGEST_MAP, _TABLE, 7, "loader", "2024-02-01 00:00:00")
    return rows.select("first_name", "email_address", hybrid.custom_value("2").alias("phone"), "file_id", "imported_by", scalars.second_text(c("created_at")).alias("created_at"))


@query("s15_client_import", """
SELECT id, email_address, coalesce(nullif(company_name, ''), NULL) AS company_name, coalesce(nullif(record_status, ''), 'active') AS record_status FROM records""")
def _(t: Tables):
    """JSON rows under other names reach the fixed columns."""
    sent = t.records.select("id", F.to_json(F.struct(
        c("email_address").alias("Email"), c("company_name").alias("company"), c("record_status").alias("status"))).alias("json"))
    rows = sent.select("id", scalars.json_map(c("json")).alias("record"))
    return rows.select("id", *hybrid.import_records(rows)).select("id", "email_address", "company_name", "record_status")


# ── Search ──────────────────────────────────────────────────────────────────
def _search(key: str, where: str, **options):
    @query(key, f"SELECT id, email_address, country FROM records WHERE {where}")
    def _(t: Tables):
        return RecordQuery(**options).matching(records(t)).select("id", "email_address", "country")


_search("f1_contains", "email_address LIKE '%mail1%' AND company_name LIKE '%BUILD%'", fields={"email": "mail1", "company": "BUILD"}, ignore_case=False)
_search("f2_name_contains", "first_name LIKE '%n1%' OR last_name LIKE '%n1%'", name="n1")
_search("f3_contains_ignoring_case", "industry ILIKE '%mach%' AND city ILIKE '%city_1%'", fields={"industry": "mach", "city": "city_1"})
_search("f4_equals_ignoring_case", "lower(country) = lower('nation_3') AND lower(record_status) = lower('ACTIVE')", fields={"country": "nation_3", "status": "ACTIVE"}, exact=True)
_search("f5_whole_number", "file_id = 7", file_id="7")
_search("f6_general_search", "first_name ILIKE '%ee2%' OR last_name ILIKE '%ee2%' OR email_address ILIKE '%ee2%' OR primary_phone_number ILIKE '%ee2%' OR company_name ILIKE '%ee2%' OR job_title ILIKE '%ee2%' OR city ILIKE '%ee2%' OR state_province ILIKE '%ee2%' OR country ILIKE '%ee2%' OR industry ILIKE '%ee2%' OR lead_source ILIKE '%ee2%' OR imported_by ILIKE '%ee2%'", search="ee2")
_search("f7_created_between", "created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-09 00:00:00'", created=("2024-01-05 00:00:00", "2024-01-09 00:00:00"))
_search("f8_custom_field_contains", f"{_J1} LIKE '%tier1%' AND {_J2} LIKE '%U%'", custom=(("1", "tier1"), ("2", "U")))
_search("f9_missing_field", "primary_phone_number IS NULL OR primary_phone_number IN ('', '--')", missing_field="primary_phone_number", missing_dashes=True)
_search("f9b_missing_or_empty", "lead_source IS NULL OR lead_source = ''", missing_field="lead_source")
_search("f15_rows_of_file", "file_id = 3", file_id=3)


@query("f10_composed_filters", "SELECT id FROM records WHERE industry ILIKE '%build%' AND record_status = 'active' AND created_at >= TIMESTAMP '2024-01-10 00:00:00' AND city ILIKE '%1%'")
def _(t: Tables):
    approved = RecordQuery(fields={"industry": "build", "status": "active"})
    asked = RecordQuery(fields={"city": "1"}, created=("2024-01-10 00:00:00", None))
    return t.records.filter(approved.predicate(t.records) & asked.predicate(t.records)).select("id")


@query("f14_delete_matching", "SELECT id FROM records WHERE NOT coalesce(job_title ILIKE '%analyst%' AND file_id = 4, false)")
def _(t: Tables):
    return plan.delete_matching(t.records, RecordQuery(fields={"job_title": "analyst"}, file_id=4))[0].select("id")


@query("f14b_deleted_count", "SELECT count(*) AS deleted FROM records WHERE job_title ILIKE '%analyst%' AND file_id = 4")
def _(t: Tables):
    return plan.delete_matching(t.records, RecordQuery(fields={"job_title": "analyst"}, file_id=4))[1]


@query("f16_output_files", """
SELECT id, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS stamped FROM uploads WHERE filename LIKE '%f1%' AND uploaded_at >= TIMESTAMP '1997-01-01' AND uploaded_at < TIMESTAMP '1997-07-02'""")
def _(t: Tables):
    """The time stands in the file name."""
    named = t.uploads.withColumn("file", F.concat("filename", F.lit("_cleaned_"), F.date_format("uploaded_at", "yyyyMMdd_HHmmss"), F.lit(".xlsx")))
    stamp = F.to_timestamp(F.regexp_extract("file", r"_(\d{8}_\d{6})\.", 1), "yyyyMMdd_HHmmss").cast("timestamp_ntz")
    found = named.filter(filters.contains(c("filename"), "f1")).withColumn("stamp", stamp).filter(filters.days("stamp", "1997-01-01", "1997-07-01"))
    return found.select("id", scalars.second_text(c("stamp")).alias("stamped"))


@query("f17_registry_search", """
SELECT h.file_id, r.id FROM headers h JOIN field_registry r ON lower(trim(h.header)) = lower(r.field_name) WHERE r.field_name ILIKE '%fax%' OR r.normalized_name ILIKE '%fax%'""")
def _(t: Tables):
    """Uploaded headers that name a registry field matching a search."""
    found = t.field_registry.filter(filters.anywhere("fax", ["field_name", "normalized_name"]))
    heads = t.headers.withColumn("name", F.lower(F.trim("header")))
    return heads.join(found.withColumn("name", F.lower("field_name")), "name").select("file_id", "id")


# ── Order, page, export ─────────────────────────────────────────────────────
@query("l1_sorted_search", "SELECT id, country FROM records ORDER BY country ASC, id ASC LIMIT 500")
def _(t: Tables):
    return RecordQuery(sort_by="country", ascending=True, per_page=500).rows(t.records).select("id", "country")


@query("l2_page", "SELECT id, company_name FROM records WHERE industry ILIKE '%b%' ORDER BY id DESC LIMIT 20 OFFSET 40")
def _(t: Tables):
    return RecordQuery(fields={"industry": "b"}, page=3).rows(t.records).select("id", "company_name")


@query("l2b_page_info", """
SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, CAST(ceil(count(*) / 20.0) AS BIGINT) AS page,
  (CAST(ceil(count(*) / 20.0) AS BIGINT) - 1) * 20 + 1 AS first_row, count(*) AS last_row FROM records WHERE industry ILIKE '%b%'""")
def _(t: Tables):
    return RecordQuery(fields={"industry": "b"}, page=99_999).info(t.records)


@query("l2c_page_after_key", """
SELECT id, country, company_name FROM records WHERE country > 'NATION_2' OR (country = 'NATION_2' AND id > 10) ORDER BY country ASC, id ASC LIMIT 200""")
def _(t: Tables):
    """The page behind a row of which value and id are known."""
    asked = RecordQuery(sort_by="country", ascending=True, per_page=200)
    return paging.page_after(t.records, asked, paging.Cursor("NATION_2", 10)).select("id", "country", "company_name")


@query("l2d_page_by_key", """
SELECT id, job_title FROM (SELECT id, job_title, row_number() OVER (ORDER BY job_title DESC NULLS LAST, id) AS n, count(*) OVER () AS total FROM records WHERE industry ILIKE '%b%') x
WHERE n > (total // 100) * 50 AND n <= (total // 100) * 50 + 50""")
def _(t: Tables):
    """The page in the middle of a search, whatever its length, through counted key ranges."""
    asked = RecordQuery(fields={"industry": "b"}, sort_by="job_title", per_page=50)
    index = paging.page_index(t.records, asked)
    total = index.agg(F.sum("rows")).first()[0] or 0
    return paging.page_at(t.records, replace(asked, page=total // 100 + 1), index).select("id", "job_title")


@query("l3_preview", "SELECT record_id, coalesce(full_name, '') AS full_name, coalesce(email, '') AS email FROM contacts ORDER BY record_id LIMIT 15")
def _(t: Tables):
    return plan.preview(t.contacts.select("record_id", "full_name", "email"), "record_id")


@query("l6_export_cap", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 50000")
def _(t: Tables):
    from gleanset.fixed import EXPORT_ROWS
    order = [F.desc("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return t.lineitem.orderBy(*order).limit(EXPORT_ROWS).select("l_orderkey", "l_linenumber", "l_partkey")


@query("m7_record_query", f"""
SELECT id, first_name, {_J1} AS tier FROM records WHERE company_name ILIKE '%ltd%' AND created_at >= TIMESTAMP '2024-01-03 00:00:00' ORDER BY first_name DESC NULLS LAST, id ASC LIMIT 50 OFFSET 50""")
def _(t: Tables):
    asked = RecordQuery(fields={"company": "ltd"}, created=("2024-01-03 00:00:00", None), sort_by="first_name", page=2, per_page=50)
    rows = asked.rows(records(t)).withColumn("m", hybrid.resolve_custom_keys(c("custom_fields"), NAMES))
    return rows.select("id", "first_name", F.try_element_at("m", F.lit("Loyalty Tier")).alias("tier"))


@query("m8_filtered_export", f"""
SELECT first_name AS "First Name", nullif({_J2}, '') AS "Market Segment", country AS "Country" FROM records WHERE first_name LIKE '%Ann1%' OR last_name LIKE '%Ann1%'""")
def _(t: Tables):
    return plan.filtered_export(records(t), RecordQuery(name="Ann1"), ["master:first_name", "custom:2", "master:country"], NAMES)


@query("m9_client_export", "SELECT id, country FROM records WHERE industry ILIKE '%machinery%' AND created_at >= TIMESTAMP '2024-01-08 00:00:00' ORDER BY id DESC LIMIT 40")
def _(t: Tables):
    approved = RecordQuery(fields={"industry": "machinery"})
    asked = RecordQuery(created=("2024-01-08 00:00:00", None))
    return plan.client_export(t.records, approved, asked, 40).select("id", "country")


# ── Completeness ────────────────────────────────────────────────────────────
_FIELDS = ["first_name", "last_name", "email_address", "job_title", "state_province", "lead_source"]


def _stats_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS col, count(*) FILTER (WHERE {n} IS NULL OR CAST({n} AS VARCHAR) = '') AS missing_count, count(*) AS total FROM {table}" for n in columns)


@query("a5_missing_stats", f"SELECT col, missing_count, round(missing_count / total * 100, 1) AS percentage FROM ({_stats_sql('records', _FIELDS)}) s")
def _(t: Tables):
    return complete.missing_stats(t.records, _FIELDS).select(c("column").alias("col"), c("missing").alias("missing_count"), "percentage")


_COMPLETE_SQL = f"SELECT col, missing_count, total - missing_count AS filled_count, round(missing_count / total * 100, 1) AS missing_percentage, round(100.0 - round(missing_count / total * 100, 1), 1) AS complete_percentage, total FROM ({_stats_sql('records', _FIELDS)}) s"


@query("a6_column_completeness", f"SELECT col, missing_count, filled_count, missing_percentage, complete_percentage FROM ({_COMPLETE_SQL}) x")
def _(t: Tables):
    return complete.completeness(t.records, _FIELDS).withColumnRenamed("column", "col")


@query("a6b_overall_completeness", f"""
SELECT max(total) AS total_records, count(*) AS total_fields, round(avg(complete_percentage), 1) AS overall_health_score, count(*) FILTER (WHERE missing_percentage >= 25.0) AS needs_attention_count FROM ({_COMPLETE_SQL}) x""")
def _(t: Tables):
    return complete.overall_completeness(t.records, _FIELDS)


_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("a6c_wide_completeness", f"SELECT col, missing_count, total FROM ({_stats_sql('lineitem', _WIDE)}) s")
def _(t: Tables):
    return complete.missing_stats(t.lineitem, _WIDE).select(c("column").alias("col"), c("missing").alias("missing_count"), "total")


# ── Enrichment ──────────────────────────────────────────────────────────────
_MATCH_SQL = """
WITH persons AS (SELECT lower(email) AS mail, lower(concat(first_name, ' ', last_name)) AS full_name, first_name, last_name,
    coalesce(nullif(raw_phone, ''), nullif(clean_phone, '')) AS phone, job_title, city, email FROM people),
by_name AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY mail) AS place FROM persons) x WHERE place = 1),
hits AS (SELECT r.*, coalesce(p.mail, n.mail) IS NOT NULL AS hit, coalesce(p.first_name, n.first_name) AS p_first, coalesce(p.last_name, n.last_name) AS p_last, coalesce(p.email, n.email) AS p_email,
    CASE WHEN p.mail IS NULL THEN n.phone ELSE p.phone END AS p_phone, coalesce(p.job_title, n.job_title) AS p_title
  FROM records r LEFT JOIN persons p ON lower(r.email_address) = p.mail
  LEFT JOIN by_name n ON r.email_address IS NULL AND n.full_name = lower(trim(concat(coalesce(r.first_name, ''), ' ', coalesce(r.last_name, '')))))
"""


@query("j8_enrich", _MATCH_SQL + """
SELECT id, CASE WHEN hit AND coalesce(trim(primary_phone_number), '') IN ('', '--') THEN coalesce(p_phone, primary_phone_number) ELSE primary_phone_number END AS primary_phone_number,
  CASE WHEN hit AND job_title IS NULL THEN p_title ELSE job_title END AS job_title,
  CASE WHEN hit AND email_address IS NULL THEN p_email ELSE email_address END AS email_address,
  CASE WHEN NOT hit THEN 'no_match' WHEN (coalesce(trim(primary_phone_number), '') IN ('', '--') AND p_phone IS NOT NULL) OR job_title IS NULL OR email_address IS NULL OR coalesce(first_name, '') = ''
    OR coalesce(last_name, '') = '' OR coalesce(lead_source, '') = '' OR record_status IS NULL THEN 'enriched' ELSE 'skipped' END AS enrich_status FROM hits""")
def _(t: Tables):
    return enriching.enrich(t.records, t.people).select("id", "primary_phone_number", "job_title", "email_address", "enrich_status")


@query("j9_compare", _MATCH_SQL + """
SELECT id, 'job_title' AS field, coalesce(trim(job_title), '') AS existing, p_title AS enriched FROM hits WHERE hit
UNION ALL SELECT id, 'primary_phone_number', coalesce(trim(primary_phone_number), ''), p_phone FROM hits WHERE hit AND p_phone IS NOT NULL
UNION ALL SELECT id, 'email_address', coalesce(trim(email_address), ''), p_email FROM hits WHERE hit""")
def _(t: Tables):
    found = enriching.compare(t.records, t.people)
    return found.filter(c("field").isin("job_title", "primary_phone_number", "email_address"))


@query("j10_apply_updates", """
SELECT id, CASE WHEN industry = 'BUILDING' THEN 'Lead' ELSE job_title END AS job_title, city FROM records""")
def _(t: Tables):
    updates = t.records.filter("industry = 'BUILDING'").select("id", F.lit("Lead").alias("job_title"), F.lit("Nowhere").alias("city"))
    rows = enriching.apply_updates(t.records, updates, ["job_title"])
    return rows.select("id", "job_title", "city")
