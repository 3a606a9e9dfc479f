"""Source and sink queries: each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanset.catalog.base import Tables, query
from gleanset.catalog.records import records
from gleanset.catalog.runs import _RUN_SQL, contact_run
from gleanset.functions import scalars
from gleanset.plans import ingest as ingestion, records as plan
from gleanset.plans.records import RecordQuery
from gleanset.session import scratch_path
from gleanset.sources import readers, writers

c = F.col


_BROKEN_SQL = "CASE WHEN record_id % 3 = 0 THEN replace(full_name, ' ', chr(10)) ELSE nullif(full_name, '') END"


def _with_breaks(rows):
    """A third of the names run over several lines."""
    broken = F.replace(c("full_name"), F.lit(" "), F.lit("\n"))
    return rows.withColumn("full_name", F.when(c("record_id") % 3 == 0, broken).otherwise(c("full_name")))


def _write_cells(rows, path: str, sep: str) -> None:
    rows.write.mode("append").option("header", True).option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


@query("s1_csv_source", f"SELECT CAST(record_id AS VARCHAR) AS record_id, {_BROKEN_SQL} AS full_name, nullif(revenue, '') AS revenue, segment FROM contacts")
def _(t: Tables):
    """Comma and semicolon files in one folder, with delimiters and line breaks in cells."""
    path = scratch_path(t.spark, "csv")
    rows = _with_breaks(t.contacts.select("record_id", "full_name", "revenue", "segment"))
    _write_cells(rows.filter("record_id % 2 = 0"), path, ";")
    _write_cells(rows.filter("record_id % 2 = 1").select("segment", "revenue", "full_name", "record_id"), path, ",")
    return readers.read_csv(t.spark, path)


@query("s2_sheet_folder", f"""SELECT segment AS sheet, 'book_2024_' || left(translate(segment, ':\\/?*[]', '_______'), 20) AS sheet_label, count(*) AS n,
  count_if(contains({_BROKEN_SQL}, chr(10))) AS broken FROM contacts GROUP BY segment""")
def _(t: Tables):
    path = scratch_path(t.spark, "sheets")
    rows = _with_breaks(t.contacts.select("record_id", "full_name", c("segment").alias("sheet")))
    rows.write.partitionBy("sheet").option("header", True).option("escape", '"').csv(path)
    rows = readers.read_sheets(t.spark, path, "csv", "book/2024")
    broken = F.count_if(F.contains("full_name", F.lit("\n")))
    return rows.groupBy("sheet", "sheet_label").agg(F.count(F.lit(1)).alias("n"), broken.alias("broken"))


@query("s2b_sheet_labels", """
SELECT doc_id, left(translate(concat(source, '_', lang, ':', CAST(doc_id AS VARCHAR), '/a very long sheet name'), ':\\/?*[]', '_______'), 30) AS label FROM documents""")
def _(t: Tables):
    sheet = F.concat("lang", F.lit(":"), c("doc_id").cast("string"), F.lit("/a very long sheet name"))
    return t.documents.select("doc_id", scalars.sheet_label(c("source"), sheet).alias("label"))


@query("s3_json_records", "SELECT record_id, full_name, email FROM contacts")
def _(t: Tables):
    """Some files hold plain objects, others objects with a records array."""
    path = scratch_path(t.spark, "json")
    rows = t.contacts.select("record_id", "full_name", "email", "website")
    rows.filter("website is null").drop("website").write.json(f"{path}/plain")
    nested = rows.filter("website is not null").drop("website").select(F.array(F.struct("*")).alias("records"))
    nested.write.json(f"{path}/nested")
    return readers.read_json_records(t.spark, f"{path}/*", "record_id bigint, full_name string, email string")


@query("s4_table_source", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t: Tables):
    return readers.read_table(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_orderstatus", "no_such_column"])


@query("s7_split_sink", _RUN_SQL + "SELECT outcome, count(*) AS n, sum(record_id)::BIGINT AS ids FROM labelled GROUP BY outcome")
def _(t: Tables):
    path = scratch_path(t.spark, "split")
    writers.write_split(contact_run(t), path)
    return t.spark.read.parquet(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"))


@query("s14_error_sink", _RUN_SQL + "SELECT e[1] AS rule, count(*) AS n, count(DISTINCT record_id) AS n_rows FROM (SELECT record_id, unnest(errors) AS e FROM labelled) x GROUP BY 1")
def _(t: Tables):
    path = scratch_path(t.spark, "errors")
    writers.write_errors(contact_run(t), path)
    return t.spark.read.parquet(path).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("n_rows"))


@query("a21_errors_by_rule", _RUN_SQL + "SELECT record_id, e[1] AS rule, e[2] AS message FROM (SELECT record_id, unnest(errors) AS e FROM labelled) x")
def _(t: Tables):
    """The members of every rule, in long form."""
    return contact_run(t).errors.select("record_id", "rule", "message")


@query("s8b_append_sink", "SELECT file_id, count(*) AS n FROM (SELECT 1 AS file_id FROM contacts WHERE email IS NOT NULL UNION ALL SELECT 2 FROM contacts WHERE phone IS NOT NULL) x GROUP BY 1")
def _(t: Tables):
    path = scratch_path(t.spark, "append")
    for number, column, target in ((1, "email", "master:email_address"), (2, "phone", "master:primary_phone_number")):
        filled = t.contacts.filter(c(column).isNotNull()).select(F.concat(F.lit("x"), column).alias(column))
        rows = ingestion.store_cleaned(filled, {column: target}, ["email_address", "primary_phone_number"], number, "loader", "2024-02-01 00:00:00")
        writers.append(ingestion.to_stored(rows), path)
    return t.spark.read.parquet(path).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query("s11_csv_export", """
SELECT CAST(id AS VARCHAR) AS id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  CASE WHEN custom_fields IS NULL OR custom_fields = '{}' THEN NULL ELSE custom_fields END AS custom_fields FROM (
  SELECT id, created_at, CASE id % 4 WHEN 2 THEN concat('{"Loyalty Tier":"tier', CAST(id % 3 AS VARCHAR), '"}')
    WHEN 3 THEN concat('{"77":"x","Loyalty Tier":"tier', CAST(id % 3 AS VARCHAR), '","Market Segment":"', industry, '"}') END AS custom_fields FROM records) x""")
def _(t: Tables):
    path = scratch_path(t.spark, "export")
    found = RecordQuery().export(records(t))
    writers.write_csv(plan.csv_rows(found, {"1": "Loyalty Tier", "2": "Market Segment"}).select("id", "created_at", "custom_fields"), path)
    return readers.read_csv(t.spark, path, ",")


@query("s13_run_log", _RUN_SQL + """
SELECT 7 AS user_id, 'Cleaned file contacts.csv using rules: email (Validate Email)' AS action, count(*) AS total_rows, count(*) FILTER (WHERE outcome = 'cleaned') AS valid_rows,
  count(*) FILTER (WHERE outcome = 'invalid') AS invalid_rows, count(*) FILTER (WHERE outcome = 'removed') AS removed_rows, '["email (Validate Email)"]' AS rules_applied,
  (SELECT concat('{', string_agg(concat('"', rule, '":', CAST(n AS VARCHAR)), ',' ORDER BY rule), '}') FROM (SELECT e[1] AS rule, count(*) AS n FROM (SELECT unnest(errors) AS e FROM labelled) y GROUP BY 1) z) AS rule_counts FROM labelled""")
def _(t: Tables):
    return writers.run_log(contact_run(t), 7, "contacts.csv", "2024-02-01 00:00:00", ["email (Validate Email)"]).drop("created_at")
