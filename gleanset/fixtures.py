"""Input views over the base tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["contacts"] = """
SELECT c_custkey AS record_id,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('  ', c_name, '  SMITH ')
       WHEN 2 THEN concat(c_name, ' Smith') WHEN 3 THEN concat(c_name, ' Smyth') ELSE lower(c_name) END AS full_name,
  CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('user', g, '.example.com')
       WHEN 3 THEN concat('user', g, '@example') WHEN 4 THEN concat(' User.', g, '+promo@Gmail.com ')
       WHEN 5 THEN concat('user', g, '@gmail.com') ELSE concat('user', g, '@mail', CAST(c_nationkey AS STRING), '.example.com') END AS email,
  CASE c_custkey % 5 WHEN 0 THEN concat('+91 98765-4', lpad(g, 4, '0')) WHEN 1 THEN concat('98765 4', lpad(g, 4, '0'))
       WHEN 2 THEN '12345' WHEN 3 THEN NULL ELSE concat('(555) 123-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END AS phone,
  CASE c_custkey % 4 WHEN 0 THEN 'https://www.example.com/a/' WHEN 1 THEN 'example.org' WHEN 2 THEN 'not a url' ELSE NULL END AS website,
  CASE c_custkey % 8 WHEN 0 THEN '$1,250.50' WHEN 1 THEN '5 Cr' WHEN 2 THEN '2.5 Lakhs' WHEN 3 THEN '65K'
       WHEN 4 THEN '3M' WHEN 5 THEN 'n/a' WHEN 6 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) END AS revenue,
  CASE c_custkey % 3 WHEN 0 THEN '2024-01-31' WHEN 1 THEN '31/01/2024' ELSE 'not a date' END AS joined,
  c_mktsegment AS segment
FROM (SELECT *, CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) AS g FROM customer) c
"""

VIEWS["users"] = """
SELECT id, concat('user', CAST(id AS STRING)) AS username,
  CASE WHEN id = 0 THEN 'admin' WHEN id < 5 THEN 'manager' WHEN id < 25 THEN 'team_lead' ELSE 'user' END AS role,
  CASE WHEN id = 0 THEN NULL WHEN id < 5 THEN 0 WHEN id < 25 THEN 1 + id % 4 ELSE 5 + id % 20 END AS manager_id,
  CASE WHEN id % 10 = 9 THEN 0 ELSE 1 END AS is_active,
  CASE WHEN id % 6 = 0 THEN 500 ELSE NULL END AS export_limit
FROM (SELECT DISTINCT user_id AS id FROM events) u
"""

VIEWS["logs"] = """
SELECT event_id AS id, user_id, ts AS created_at,
  CASE event_type WHEN 'signup' THEN 'Logged in'
    WHEN 'error' THEN concat('Failed login attempt for username: user', CAST(user_id AS STRING))
    WHEN 'click' THEN concat('Uploaded file f', CAST(event_id AS STRING), '.csv')
    WHEN 'view' THEN concat('Searched records query: ', props)
    ELSE concat('Exported ', CAST(CAST(floor(value) AS BIGINT) AS STRING), ' records. Filters: No filters') END AS action,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS total_rows
FROM events
"""

VIEWS["runs"] = """
SELECT o_orderkey AS id, o_custkey % 150 AS user_id, o_orderdate AS created_at,
  concat('Cleaned file f', CAST(o_orderkey AS STRING), '.xlsx using rules: email (Validate Email)') AS action,
  100 + o_orderkey % 50 AS total_rows,
  100 + o_orderkey % 50 - o_orderkey % 7 - o_orderkey % 5 AS valid_rows,
  o_orderkey % 7 AS invalid_rows, o_orderkey % 5 AS removed_rows,
  concat('{"validate_email":', CAST(o_orderkey % 4 AS STRING), ',"validate_not_empty":', CAST(o_orderkey % 3 AS STRING),
         ',"duplicate_removal":', CAST(o_orderkey % 5 AS STRING), '}') AS rule_counts
FROM orders
"""

VIEWS["master_records"] = """
SELECT record_id AS id, record_id % 20 AS file_id, full_name AS first_name, segment AS last_name,
  CASE WHEN record_id % 9 = 0 THEN NULL ELSE concat('{"1":"', coalesce(trim(email), ''), '","2":"', coalesce(phone, ''), '"}') END AS custom_fields,
  concat('user', CAST(record_id % 150 AS STRING)) AS imported_by
FROM contacts
"""

# The master table after its fields have been promoted to columns.
VIEWS["records"] = """
SELECT c_custkey AS id, c_custkey % 20 AS file_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('Ann', CAST(c_custkey % 40 AS STRING)) END AS first_name,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('Lee', CAST(c_custkey % 30 AS STRING)) END AS last_name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('user', CAST(c_custkey AS STRING), '@mail', CAST(c_nationkey AS STRING), '.example.com') END AS email_address,
  CASE WHEN c_custkey % 4 = 0 THEN '--' WHEN c_custkey % 4 = 1 THEN '' ELSE concat('555', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS primary_phone_number,
  concat(c_mktsegment, ' Ltd') AS company_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Analyst' END AS job_title,
  concat('City_', CAST(c_nationkey AS STRING)) AS city,
  CASE WHEN c_custkey % 2 = 0 THEN concat('State', CAST(c_nationkey % 5 AS STRING)) ELSE NULL END AS state_province,
  n_name AS country, c_mktsegment AS industry,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'active' END AS record_status,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Import' END AS lead_source,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN concat('{"1":"tier', CAST(c_custkey % 3 AS STRING), '"}')
       ELSE concat('{"1":"tier', CAST(c_custkey % 3 AS STRING), '","2":"', c_mktsegment, '","77":"x"}') END AS custom_fields,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(c_custkey % 30 AS INT) * INTERVAL '1' DAY AS created_at,
  concat('user', CAST(c_custkey % 150 AS STRING)) AS imported_by
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

# Registry fields; id 77 is used in records but not registered.
VIEWS["field_registry"] = """
SELECT * FROM (VALUES (1, 'Loyalty Tier', 'loyalty_tier', 1), (2, 'Market Segment', 'market_segment', 1),
  (3, 'E-mail Opt In', 'e_mail_opt_in', 1), (4, 'Fax', 'fax', 0)) AS t(id, field_name, normalized_name, is_active)
"""

VIEWS["field_aliases"] = """
SELECT * FROM (VALUES (1, 'E-mail', 'custom', '3'), (2, 'Mobile No', 'master', 'primary_phone_number'),
  (3, 'Company', 'master', 'company_name'), (4, 'Name', 'master', 'full_name'), (5, 'Segment', 'custom', '2'),
  (6, 'segment', 'custom', '1')) AS t(id, alias, target_type, target_identifier)
"""

# Header cells of uploaded files, one row per file and column.
VIEWS["headers"] = """
SELECT o_orderkey AS file_id, CASE o_orderkey % 12 WHEN 0 THEN ' E-Mail ' WHEN 1 THEN 'Mobile  No' WHEN 2 THEN 'First Name'
  WHEN 3 THEN 'company' WHEN 4 THEN 'Loyalty-Tier' WHEN 5 THEN 'STATE / province' WHEN 6 THEN 'segment'
  WHEN 7 THEN concat('Extra #', CAST(o_custkey % 9 AS STRING)) WHEN 8 THEN 'Name' WHEN 9 THEN 'Fax' WHEN 10 THEN 'job_title'
  ELSE 'Postal / ZIP Code' END AS header
FROM orders
"""

VIEWS["presets"] = """
SELECT o_orderkey AS id, o_custkey % 150 AS user_id, concat('preset', CAST(o_orderkey AS STRING)) AS name,
  CASE WHEN o_orderkey % 2 = 0 THEN '{"email":["trim_whitespace","validate_email"],"phone":["handle_missing"]}'
    ELSE '{"rules":{"revenue":["handle_missing","normalize_currency"],"email":["validate_email"]},"strategies":{"revenue":"median"}}' END AS rules_json
FROM orders
"""

# Every user has status changes on some of their events.
VIEWS["status_logs"] = """
SELECT event_id AS id, user_id AS actor_id, ts AS created_at,
  concat(CASE WHEN value < 60 THEN 'Deactivated' ELSE 'Activated' END, ' user user', CAST((user_id + event_id) % 150 AS STRING),
         ' (id=', CAST((user_id + event_id) % 150 AS STRING), ')') AS action
FROM events WHERE event_type = 'signup'
"""

VIEWS["accounts"] = """
SELECT user_id AS id, concat('user', CAST(user_id AS STRING)) AS username, min(ts) AS created_at,
  CASE WHEN user_id % 8 = 3 THEN 'deactivated' ELSE 'active' END AS status,
  CASE WHEN user_id % 8 = 3 THEN max(ts) ELSE NULL END AS deactivated_at
FROM events GROUP BY user_id
"""

VIEWS["uploads"] = """
SELECT o_orderkey AS id, o_custkey % 150 AS user_id, concat('f', CAST(o_orderkey % 1000 AS STRING), '.csv') AS filename,
  concat('sheet', CAST(o_orderkey % 3 AS STRING)) AS sheet, o_orderdate AS uploaded_at, 50 + o_orderkey % 40 AS total_rows,
  50 + o_orderkey % 40 - o_orderkey % 6 AS rows_imported, o_orderkey % 6 AS rows_rejected,
  CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status
FROM orders
"""

VIEWS["login_attempts"] = """
SELECT event_id AS id, concat('user', CAST(user_id % 10 AS STRING)) AS username, ts AS attempted_at,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS success
FROM events
"""

VIEWS["change_requests"] = """
SELECT event_id AS id, user_id, ts AS requested_at, CASE WHEN value < 50 THEN 'pending' ELSE 'approved' END AS status,
  CASE WHEN value < 50 THEN NULL ELSE event_id % 5 END AS reviewed_by
FROM events WHERE event_type = 'click'
"""

VIEWS["notifications"] = """
SELECT event_id AS id, user_id AS sender_id, event_id % 5 AS recipient_id, concat('note ', CAST(event_id AS STRING)) AS message,
  event_type AS action_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS created_at, CASE WHEN value < 80 THEN 0 ELSE 1 END AS is_read
FROM events WHERE event_type IN ('view', 'purchase')
"""

VIEWS["key_requests"] = """
SELECT event_id AS id, user_id, ts AS created_at, CASE WHEN value < 30 THEN 'pending' ELSE 'approved' END AS status
FROM events WHERE event_type = 'error'
"""

# Person records of the enrichment reference.
VIEWS["people"] = """
SELECT concat('USER', CAST(c_custkey AS STRING), '@mail', CAST(c_nationkey AS STRING), '.example.com') AS email,
  concat('Ann', CAST(c_custkey % 40 AS STRING)) AS first_name, concat('Lee', CAST(c_custkey % 30 AS STRING)) AS last_name,
  CASE WHEN c_custkey % 2 = 0 THEN concat('+1555', lpad(CAST(c_custkey AS STRING), 7, '0')) ELSE '' END AS raw_phone,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('1555', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS clean_phone,
  'Director' AS job_title, concat('City_', CAST(c_nationkey AS STRING)) AS city,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('https://site', CAST(c_custkey AS STRING), '.example.com') END AS website_url,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('site', CAST(c_custkey AS STRING), '.example.com') END AS primary_domain,
  c_acctbal * 250000 AS annual_revenue
FROM customer WHERE c_custkey % 3 <> 1
"""

_NEEDS = {"master_records": ["contacts"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_spark_text(sf_dir, name))


def _spark_text(sf_dir: str, name: str) -> str:
    if name in BASE_TABLES:
        return f"parquet.`{sf_dir}/{name}.parquet`"
    names = "|".join([*BASE_TABLES, *VIEWS])
    # the table name after FROM or JOIN
    def source(found: re.Match) -> str:
        inner = found.group(2)
        text = _spark_text(sf_dir, inner)
        return f"{found.group(1)} {text if inner in BASE_TABLES else f'({text})'} {inner}"
    return re.sub(rf"\b(FROM|JOIN) ({names})\b", source, VIEWS[name])


def stream_view(spark: SparkSession, name: str, table: str, stream: DataFrame) -> DataFrame:
    """A derived view that reads a streaming table instead of the files."""
    source = f"base_{table}"
    stream.createOrReplaceTempView(source)
    text = re.sub(rf"\bFROM {table}\b", f"FROM {source} {table}", VIEWS[name])
    return spark.sql(text)


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the views it reads, as common table expressions."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    parts = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    body = sql.strip()
    found = re.match(r"WITH( RECURSIVE)? ", body)
    if found:
        return f"{found.group(0)}{parts},\n{body[found.end():]}"
    return f"WITH {parts}\n{body}"
