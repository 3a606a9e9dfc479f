"""Activity, access, quota, health and calendar queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gleanset.catalog.base import Tables, query
from gleanset.functions import scalars
from gleanset.operators import access, activity, filters
from gleanset.plans import records as plan
from gleanset.sources import writers

c = F.col

_KINDS = {
    "exports": "lower(action) LIKE '%export%'",
    "imports": "lower(action) LIKE '%upload%' OR lower(action) LIKE '%ingest%' OR (lower(action) LIKE '%import%' AND lower(action) NOT LIKE '%export%')",
    "cleans": "lower(action) LIKE '%cleaned file%'",
    "searches": "lower(action) LIKE '%search%' OR lower(action) LIKE '%filter%'",
    "logins": "lower(action) LIKE '%login%'",
    "deletes": "lower(action) LIKE '%delete%' OR lower(action) LIKE '%removed%'",
}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {w}) AS {n}" for n, w in _KINDS.items())
AS_OF = dt.date(2024, 1, 24)


# ── Counts and charts ───────────────────────────────────────────────────────
@query("a1_category_counts", f"SELECT count(*) AS total_events, {_COUNTS}, count(DISTINCT user_id) AS unique_users FROM logs")
def _(t: Tables):
    return activity.activity_stats(t.logs)


@query("a1b_period_stats", f"""
SELECT count(*) AS total_events, {_COUNTS}, count(DISTINCT user_id) AS unique_users FROM logs WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-18' AND DATE '2024-01-24'""")
def _(t: Tables):
    first, last = activity.stats_range("week", AS_OF)
    return activity.activity_stats(t.logs.filter(filters.days("created_at", str(first), str(last))))


@query("a2_distinct_users", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS users FROM logs GROUP BY 1")
def _(t: Tables):
    return t.logs.groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count_distinct("user_id").alias("users"))


def _buckets(name: str, unit: str, expression: str):
    @query(name, f"SELECT CAST({expression} AS VARCHAR) AS period, count(*) AS total, {_COUNTS} FROM logs WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-27' GROUP BY 1")
    def _(t: Tables):
        found = activity.bucket_counts(t.logs, unit, dt.date(2024, 1, 3), dt.date(2024, 1, 27))
        return found.withColumn("period", c("period").cast("string"))


_buckets("a3_activity_by_day", "day", "CAST(created_at AS DATE)")
_buckets("a3b_activity_by_week", "week", "CAST(date_trunc('week', created_at) AS DATE)")
_buckets("a3c_activity_by_month", "month", "CAST(date_trunc('month', created_at) AS DATE)")

_CHART = "SELECT CAST(s.p AS VARCHAR) AS period, {label} AS label, count(l.id) AS total, " + ", ".join(
    f"count(l.id) FILTER (WHERE {w}) AS {n}" for n, w in _KINDS.items()) + """
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL '1' {unit})) AS DATE) AS p) s
LEFT JOIN logs l ON CAST(date_trunc('{trunc}', l.created_at) AS DATE) = s.p AND CAST(l.created_at AS DATE) >= DATE '{first}' AND CAST(l.created_at AS DATE) <= DATE '{last}' GROUP BY s.p"""


def _chart(name: str, kind: str, start: str, unit: str, trunc: str, label: str, **custom):
    last = str(custom.get("last", AS_OF))

    @query(name, _CHART.format(label=label, first=start, last=last, unit=unit, trunc=trunc))
    def _(t: Tables):
        span = activity.period(kind, AS_OF, **custom)
        return activity.chart(t.logs, span).withColumn("period", c("period").cast("string"))


_chart("a4_chart_week", "week", "2024-01-18", "DAY", "day", "strftime(s.p, '%a %d %b')")
_chart("j7_chart_month_zero_filled", "month", "2023-12-25", "WEEK", "week", "concat(strftime(s.p, '%d %b'), '–', strftime(s.p + INTERVAL '6' DAY, '%d %b'))")
_chart("a4b_chart_year", "year", "2023-02-01", "MONTH", "month", "strftime(s.p, '%b %Y')")
_chart("a4c_chart_custom", "custom", "2024-01-08", "WEEK", "week", "concat(strftime(s.p, '%d %b'), '–', strftime(s.p + INTERVAL '6' DAY, '%d %b'))",
       first=dt.date(2024, 1, 10), last=dt.date(2024, 2, 6))


@query("j16_events_in_periods", """
SELECT p.name, count(*) AS events FROM logs l JOIN (VALUES ('first', DATE '2024-01-01', DATE '2024-01-10'), ('middle', DATE '2024-01-08', DATE '2024-01-20')) AS p(name, first, last)
ON CAST(l.created_at AS DATE) BETWEEN p.first AND p.last GROUP BY p.name""")
def _(t: Tables):
    periods = t.spark.createDataFrame(
        [("first", dt.date(2024, 1, 1), dt.date(2024, 1, 10)), ("middle", dt.date(2024, 1, 8), dt.date(2024, 1, 20))],
        "name string, first date, last date")
    return activity.events_in_periods(t.logs, periods)


@query("l4_top_users", "SELECT username, count(*) AS event_count FROM logs l JOIN users u ON u.id = l.user_id GROUP BY username ORDER BY event_count DESC, username LIMIT 5")
def _(t: Tables):
    return activity.top_users(t.logs, t.users)


@query("l5_active_dates", "SELECT DISTINCT CAST(CAST(created_at AS DATE) AS VARCHAR) AS active_date FROM logs WHERE user_id = 7 ORDER BY 1 DESC LIMIT 50")
def _(t: Tables):
    return activity.active_dates(t.logs, 7).withColumn("active_date", c("active_date").cast("string"))


@query("u4_distinct_actors", "SELECT DISTINCT user_id FROM logs")
def _(t: Tables):
    return t.logs.select("user_id").distinct()


@query("a18_dashboard", """
SELECT (SELECT count(*) FROM runs WHERE action LIKE 'Cleaned file%') AS cleaned_files, sum(total_rows)::BIGINT AS total_rows, count(*) FILTER (WHERE action LIKE 'Uploaded file%' AND CAST(created_at AS DATE) = DATE '2024-01-12') AS uploads_on_day,
  strftime(max_by(created_at, CASE WHEN action LIKE 'Uploaded file%' THEN id END), '%Y-%m-%d %H:%M') AS last_upload, (SELECT count(*) FROM users WHERE is_active = 1) AS active_users
FROM (SELECT id, created_at, action, total_rows FROM logs UNION ALL SELECT id, created_at, action, total_rows FROM runs) x""")
def _(t: Tables):
    columns = ["id", "created_at", "action", "total_rows"]
    both = t.logs.select(*columns).unionByName(t.runs.select(*columns))
    return activity.dashboard(both, t.users, "2024-01-12")


@query("a24_pending_and_unread", """
SELECT (SELECT count(*) FROM change_requests WHERE status = 'pending') AS pending, (SELECT count(*) FROM notifications WHERE is_read = 0) AS unread""")
def _(t: Tables):
    pending = t.change_requests.agg(F.count_if(c("status") == "pending").alias("pending"))
    return pending.withColumn("unread", t.notifications.agg(F.count_if(c("is_read") == 0)).scalar())


# ── Log and user listings ───────────────────────────────────────────────────
@query("j1_logs_with_users", "SELECT l.id, u.username, l.action FROM logs l JOIN users u ON u.id = l.user_id")
def _(t: Tables):
    return access.with_username(t.logs, t.users, "user_id", "id").select("id", "username", "action")


@query("f11_login_logs", "SELECT id, action FROM logs WHERE action LIKE '%Logged in%' OR action LIKE '%Logged out%' OR action LIKE '%Failed login%' OR action LIKE '%Session expired%'")
def _(t: Tables):
    return t.logs.filter(filters.log_kind("login")).select("id", "action")


@query("f11b_import_and_export_logs", "SELECT id, action FROM logs WHERE action LIKE '%Uploaded file%' OR action LIKE '%Ingested%' OR action LIKE '%Exported%'")
def _(t: Tables):
    return t.logs.filter(filters.log_kind("import") | filters.log_kind("export")).select("id", "action")


@query("f12_log_search", """
SELECT l.id, u.username FROM logs l JOIN users u ON u.id = l.user_id WHERE (u.username LIKE '%user1%' OR l.action LIKE '%user1%') AND CAST(l.created_at AS DATE) >= DATE '2024-01-10' AND CAST(l.created_at AS DATE) <= DATE '2024-01-12'""")
def _(t: Tables):
    dated = t.logs.filter(filters.days("created_at", "2024-01-10", "2024-01-12"))
    named = access.with_username(dated, t.users, "user_id", "id")
    return named.filter(filters.contains(c("username"), "user1") | filters.contains(c("action"), "user1")).select("id", "username")


@query("f13_user_filter", "SELECT id, username FROM users WHERE username LIKE '%1%' AND role = 'user' AND is_active = 1")
def _(t: Tables):
    return t.users.filter(filters.user_filter("1", "user", True)).select("id", "username")


@query("l7_sorted_users", "SELECT id, username, role FROM users ORDER BY username DESC, id")
def _(t: Tables):
    return t.users.orderBy(*filters.user_order("username_desc")).select("id", "username", "role")


@query("s12_labelled_logs", """
SELECT l.id AS "Log ID", u.username AS "Username", l.action AS "Action Performed", l.total_rows AS "Total Rows", strftime(l.created_at, '%Y-%m-%dT%H:%M:%S') AS "Timestamp"
FROM logs l JOIN users u ON u.id = l.user_id""")
def _(t: Tables):
    return writers.label_logs(access.with_username(t.logs, t.users, "user_id", "id"))


@query("s12b_labelled_users", """
SELECT id AS "User ID", username AS "Username", role AS "Role", CASE WHEN is_active = 1 THEN 'Yes' ELSE 'No' END AS "Is Active", coalesce(CAST(manager_id AS VARCHAR), '--') AS "Manager ID" FROM users""")
def _(t: Tables):
    return writers.label_users(t.users)


@query("s12c_labelled_uploads", """
SELECT p.id AS "Log ID", u.username AS "Uploaded By", p.filename AS "Original Filename", strftime(p.uploaded_at, '%Y-%m-%d %H:%M:%S') AS "Uploaded At", p.total_rows AS "Total Rows",
  p.rows_imported AS "Rows Imported", p.rows_rejected AS "Rows Rejected", p.status AS "Status" FROM uploads p JOIN users u ON u.id = p.user_id""")
def _(t: Tables):
    return writers.label_uploads(access.with_username(t.uploads, t.users, "user_id", "id"))


@query("s12d_labelled_fields", """
SELECT f.id AS "Field ID", f.field_name AS "Display Name", f.normalized_name AS "Normalized Name", count(r.id) AS "Usage Count"
FROM field_registry f LEFT JOIN records r ON json_extract_string(r.custom_fields, concat('$."', CAST(f.id AS VARCHAR), '"')) IS NOT NULL GROUP BY 1, 2, 3""")
def _(t: Tables):
    from gleanset.operators.mapping import field_usage
    from gleanset.plans.ingest import from_stored
    usage = field_usage(from_stored(t.records)).select(c("field_id").try_cast("int").alias("id"), c("n").alias("usage_count"))
    return writers.label_fields(t.field_registry.join(usage, "id", "left").fillna({"usage_count": 0}))


@query("s12e_labelled_aliases", """
SELECT a.id AS "Alias ID", a.alias AS "Header Alias", a.target_type AS "Target System Layer", a.target_identifier AS "Mapped Identifier", count(h.file_id) AS uses
FROM field_aliases a LEFT JOIN headers h ON lower(trim(h.header)) = lower(a.alias) GROUP BY 1, 2, 3, 4""")
def _(t: Tables):
    uses = t.headers.groupBy(F.lower(F.trim("header")).alias("head")).agg(F.count(F.lit(1)).alias("uses"))
    labelled = writers.label_aliases(t.field_aliases)
    return labelled.join(uses, F.lower("Header Alias") == c("head"), "left").drop("head").fillna({"uses": 0})


# ── Hierarchy and notices ───────────────────────────────────────────────────
@query("j2_managers", """
SELECT u.id, m.username AS manager, g.username AS grand_manager FROM users u LEFT JOIN users m ON u.manager_id = m.id LEFT JOIN users g ON m.manager_id = g.id""")
def _(t: Tables):
    return access.with_managers(t.users).select("id", "manager", "grand_manager")


_GRANTS = "(VALUES ('admin', 'export'), ('admin', 'import'), ('admin', 'users'), ('manager', 'export'), ('manager', 'import'), ('team_lead', 'import'), ('user', 'import')) AS g(role, permission)"


def _permissions(t: Tables):
    names = {"export": 1, "import": 2, "users": 3}
    roles = {"admin": [1, 2, 3], "manager": [1, 2], "team_lead": [2], "user": [2]}
    make = t.spark.createDataFrame
    role_rows = make([(i, r) for i, r in enumerate(roles)], "role_id int, role string")
    grants = make([(i, p) for i, r in enumerate(roles.values()) for p in r], "role_id int, permission_id int")
    return access.role_permissions(role_rows, grants, make([(i, n) for n, i in names.items()], "permission_id int, permission string"))


@query("j3_user_permissions", f"SELECT u.id, g.permission FROM users u JOIN {_GRANTS} USING (role)")
def _(t: Tables):
    return t.users.join(_permissions(t), "role").select("id", "permission")


@query("a20_permissions_per_role", f"""
SELECT u.role, count(*) AS members, max(p.permissions) AS permissions FROM users u JOIN (SELECT role, string_agg(permission, ', ' ORDER BY permission) AS permissions FROM {_GRANTS} GROUP BY role) p ON p.role = u.role GROUP BY u.role""")
def _(t: Tables):
    members = t.users.groupBy("role").agg(F.count(F.lit(1)).alias("members"))
    return members.join(access.permissions_per_role(_permissions(t)), "role")


@query("j4_visible_users", """
SELECT id AS viewer, id AS visible FROM users UNION SELECT m.id, t.id FROM users m JOIN users t ON t.manager_id = m.id WHERE m.role = 'manager' AND t.role = 'team_lead'
UNION SELECT t.id, u.id FROM users t JOIN users u ON u.manager_id = t.id WHERE t.role = 'team_lead' AND u.role = 'user'
UNION SELECT m.id, u.id FROM users m JOIN users t ON t.manager_id = m.id JOIN users u ON u.manager_id = t.id WHERE m.role = 'manager' AND t.role = 'team_lead' AND u.role = 'user'""")
def _(t: Tables):
    return access.visible_users(t.users)


@query("j4b_visible_logs", """
SELECT l.id FROM logs l WHERE l.user_id = 2 OR l.user_id IN (SELECT id FROM users WHERE manager_id = 2 AND role = 'team_lead')
  OR l.user_id IN (SELECT u.id FROM users u JOIN users t ON u.manager_id = t.id WHERE t.manager_id = 2 AND t.role = 'team_lead' AND u.role = 'user')""")
def _(t: Tables):
    return access.visible_rows(t.logs, t.users, 2, "manager").select("id")


@query("j13_request_listing", """
SELECT r.id, u.username, w.username AS reviewer FROM change_requests r JOIN users u ON r.user_id = u.id LEFT JOIN users w ON r.reviewed_by = w.id""")
def _(t: Tables):
    named = access.with_username(t.change_requests, t.users, "user_id", "id")
    reviewers = t.users.select(c("id").alias("reviewed_by"), c("username").alias("reviewer"))
    return access.lookup(named, reviewers, ["reviewed_by"]).select("id", "username", "reviewer")


_SAID = "CASE WHEN lower(l.action) LIKE '%export%' THEN 'export' WHEN lower(l.action) LIKE '%upload%' OR lower(l.action) LIKE '%ingest%' THEN 'import' WHEN lower(l.action) LIKE '%cleaned file%' THEN 'clean' END"
_NOTICE_SQL = f"""
WITH acts AS (SELECT l.id, l.user_id AS sender_id, u.manager_id, {_SAID} AS action_type, concat(u.username, CASE {_SAID} WHEN 'export' THEN ' exported records: ' WHEN 'import' THEN ' uploaded a spreadsheet: ' ELSE ' cleaned spreadsheet data: ' END, l.action) AS message
  FROM logs l JOIN users u ON u.id = l.user_id)
SELECT id, CAST(manager_id AS BIGINT) AS recipient_id, sender_id, message, action_type FROM acts WHERE action_type IS NOT NULL AND manager_id IS NOT NULL
"""


_ORPHAN_SQL = """
UNION ALL SELECT a.id, w.id, a.sender_id, a.message, a.action_type FROM acts a JOIN users w ON w.role = 'admin' AND w.id <> a.sender_id WHERE a.action_type IS NOT NULL AND a.manager_id IS NULL"""


@query("j14_notifications", _NOTICE_SQL + _ORPHAN_SQL)
def _(t: Tables):
    return access.notifications(t.logs, t.users)


@query("u2_inbox", """
SELECT 'request' AS type, id, requested_at AS timestamp, status AS detail FROM change_requests WHERE status = 'pending'
UNION ALL SELECT 'api_key_request', id, created_at, status FROM key_requests WHERE status = 'pending' UNION ALL SELECT 'notification', id, created_at, message FROM notifications""")
def _(t: Tables):
    return access.newest_first(access.inbox(t.change_requests.filter("status = 'pending'"), t.key_requests.filter("status = 'pending'"), t.notifications))


# ── Export quota ────────────────────────────────────────────────────────────
_LIMIT_SQL = """SELECT u.id, u.role, coalesce(u.export_limit, r.default_limit, CASE u.role WHEN 'admin' THEN 1000000 WHEN 'manager' THEN 100000 ELSE 50000 END)::BIGINT AS active_limit
FROM users u LEFT JOIN (VALUES ('user', 40000), ('team_lead', 45000)) AS r(role_name, default_limit) ON r.role_name = u.role"""
_USAGE_SQL = "SELECT user_id, CAST(created_at AS DATE) AS export_date, total_rows AS rows_count FROM logs WHERE action LIKE 'Exported%'"


def _limits(t: Tables):
    roles = t.spark.createDataFrame([("user", 40000), ("team_lead", 45000)], "role_name string, default_limit int")
    return plan.export_limits(t.users, roles)


def _usage(t: Tables):
    return t.logs.filter(filters.log_kind("export")).select("user_id", F.to_date("created_at").alias("export_date"), c("total_rows").alias("rows_count"))


@query("j15_export_limits", _LIMIT_SQL)
def _(t: Tables):
    return _limits(t)


@query("a14_daily_usage", f"SELECT user_id, CAST(export_date AS VARCHAR) AS export_date, sum(rows_count)::BIGINT AS rows_count FROM ({_USAGE_SQL}) x GROUP BY 1, 2")
def _(t: Tables):
    return plan.daily_usage(_usage(t)).withColumn("export_date", c("export_date").cast("string"))


@query("a15_rows_exported", f"SELECT coalesce(sum(rows_count), 0)::BIGINT AS rows_exported FROM ({_USAGE_SQL}) x WHERE export_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15'")
def _(t: Tables):
    inside = _usage(t).filter(c("export_date").between(dt.date(2024, 1, 5), dt.date(2024, 1, 15)))
    return inside.agg(F.coalesce(F.sum("rows_count"), F.lit(0)).alias("rows_exported"))


@query("a16_quota_decision", f"""
WITH used AS (SELECT user_id, sum(rows_count) AS used FROM ({_USAGE_SQL}) x WHERE export_date = DATE '2024-01-10' GROUP BY 1), asked AS (SELECT count(*) AS n FROM records WHERE industry ILIKE '%b%')
SELECT l.id, coalesce(u.used, 0)::BIGINT AS used, n AS requested, l.active_limit, coalesce(u.used, 0) + n <= l.active_limit AS allowed FROM ({_LIMIT_SQL}) l LEFT JOIN used u ON u.user_id = l.id, asked""")
def _(t: Tables):
    matching = plan.RecordQuery(fields={"industry": "b"}).matching(t.records)
    return plan.quota_decision(_limits(t), _usage(t), "2024-01-10", matching)


_ALLOWED_SQL = f"""
WITH used AS (SELECT user_id, sum(rows_count) AS used FROM ({_USAGE_SQL}) x WHERE export_date = DATE '2024-01-10' GROUP BY 1), asked AS (SELECT count(*) AS n FROM records WHERE industry ILIKE '%b%'),
verdict AS (SELECT l.id, n AS requested, coalesce(u.used, 0) + n <= l.active_limit AS allowed FROM ({_LIMIT_SQL}) l LEFT JOIN used u ON u.user_id = l.id, asked WHERE l.id = 17)
"""


def _export(t: Tables):
    asked = plan.RecordQuery(fields={"industry": "b"})
    return plan.export_within_quota(t.records, asked, ["master:id", "master:industry"], {}, 17, _limits(t), _usage(t), "2024-01-10")


@query("m8b_export_within_quota", _ALLOWED_SQL + """SELECT id AS "Id", industry AS "Industry" FROM records WHERE industry ILIKE '%b%' AND (SELECT allowed FROM verdict)""")
def _(t: Tables):
    return _export(t)[0]


@query("m8c_booked_usage", _ALLOWED_SQL + "SELECT id AS user_id, '2024-01-10' AS export_date, requested AS rows_count FROM verdict WHERE allowed")
def _(t: Tables):
    return _export(t)[1].withColumn("export_date", c("export_date").cast("string"))


# ── Data health ─────────────────────────────────────────────────────────────
_HEALTH_SQL = """
WITH health AS (SELECT id, created_at, concat('f', CAST(id AS VARCHAR), '.xlsx') AS file_name, total_rows, valid_rows, round(valid_rows / total_rows * 100, 1) AS score,
  CAST(json_extract_string(rule_counts, '$.validate_not_empty') AS INT) AS blank_required, CAST(json_extract_string(rule_counts, '$.duplicate_removal') AS INT) AS duplicates_flagged,
  CAST(json_extract_string(rule_counts, '$.validate_email') AS INT) AS format_errors FROM runs)
"""


@query("a10_run_scores", _HEALTH_SQL + "SELECT id, file_name, score FROM health")
def _(t: Tables):
    return activity.run_health(t.runs).select("id", "file_name", "score")


@query("a10b_overall_score", _HEALTH_SQL + """
SELECT round(sum(valid_rows) / sum(total_rows) * 100, 1) AS overall_score, sum(blank_required)::BIGINT AS blank_required, sum(duplicates_flagged)::BIGINT AS duplicates_flagged, sum(format_errors)::BIGINT AS format_errors FROM health""")
def _(t: Tables):
    return activity.overall_health(activity.run_health(t.runs))


_ISSUES_SQL = """concat_ws('; ', CASE WHEN duplicates_flagged > 0 THEN concat('Duplicates flagged (', CAST(duplicates_flagged AS VARCHAR), ')') END,
  CASE WHEN format_errors > 0 THEN concat('Format errors (', CAST(format_errors AS VARCHAR), ')') END, CASE WHEN blank_required > 0 THEN concat('Blank required field (', CAST(blank_required AS VARCHAR), ')') END)"""


@query("a11_issue_classes", _HEALTH_SQL + f"SELECT id, blank_required, duplicates_flagged, format_errors, {_ISSUES_SQL} AS issues FROM health")
def _(t: Tables):
    rows = activity.run_health(t.runs)
    return rows.select("id", "blank_required", "duplicates_flagged", "format_errors", F.array_join("issues", "; ").alias("issues"))


@query("a12_week_comparison", _HEALTH_SQL + """
, sums AS (SELECT issue, coalesce(sum(v) FILTER (WHERE created_at >= TIMESTAMP '2001-07-25 12:00:00'), 0)::BIGINT AS current,
    (sum(v) FILTER (WHERE created_at < TIMESTAMP '2001-07-25 12:00:00' AND created_at >= TIMESTAMP '2001-07-18 12:00:00'))::BIGINT AS previous FROM (
  SELECT 'blank_required' AS issue, created_at, blank_required AS v FROM health UNION ALL SELECT 'duplicates_flagged', created_at, duplicates_flagged FROM health
  UNION ALL SELECT 'format_errors', created_at, format_errors FROM health) x GROUP BY issue)
SELECT *, CASE WHEN previous IS NULL THEN 'no data' WHEN current < previous THEN 'down' WHEN current = previous THEN 'same' ELSE 'up' END AS verdict FROM sums""")
def _(t: Tables):
    return activity.compare_weeks(activity.run_health(t.runs), "2001-08-01 12:00:00")


@query("a13_runs_with_issues", _HEALTH_SQL + """
SELECT id, score FROM health WHERE blank_required + duplicates_flagged + format_errors > 0 ORDER BY created_at DESC, id LIMIT 10 OFFSET 20""")
def _(t: Tables):
    found = activity.run_health(t.runs).filter(F.size("issues") > 0)
    return plan.page_of(found, [F.desc("created_at"), F.asc("id")], 3, 10).select("id", "score")


# ── Jobs ────────────────────────────────────────────────────────────────────
@query("w10_latest_per_user", """
SELECT user_id, id, action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS place FROM logs) x WHERE place = 1""")
def _(t: Tables):
    return activity.latest(t.logs.select("user_id", "id", "action"), "user_id", "id")


@query("w11_job_summary", """
SELECT u.id AS job_id, coalesce(nullif(l.total_rows, 0), u.total_rows, 0) AS total_rows, coalesce(nullif(l.valid_rows, 0), u.rows_imported, 0) AS valid_rows,
  coalesce(nullif(l.invalid_rows, 0), u.rows_rejected, 0) AS invalid_rows, coalesce(l.removed_rows, 0) AS removed_rows
FROM uploads u LEFT JOIN (SELECT * FROM (SELECT *, id % 5000 AS job_id, row_number() OVER (PARTITION BY id % 5000 ORDER BY id DESC) AS place FROM runs) x WHERE place = 1) l ON l.job_id = u.id""")
def _(t: Tables):
    logs = t.runs.withColumn("job_id", c("id") % 5000)
    return activity.job_summary(t.uploads, logs).drop("filename", "status")


@query("st7_stale_uploads", """
SELECT id, CASE WHEN status = 'processing' AND uploaded_at < TIMESTAMP '1999-01-01 00:05:00' - INTERVAL '5' MINUTE THEN 'failed' ELSE status END AS status FROM uploads""")
def _(t: Tables):
    return activity.fail_stale(t.uploads, "1999-01-01 00:05:00").select("id", "status")


# ── Calendars ───────────────────────────────────────────────────────────────
FIRST, LAST = dt.date(2023, 12, 28), dt.date(2024, 2, 2)
_CHANGE_SQL = r"""
changes AS (SELECT user_id, day, max_by(state, rank) AS state FROM (
  SELECT CAST(regexp_extract(action, '\(id=(\d+)\)', 1) AS BIGINT) AS user_id, CAST(created_at AS DATE) AS day, CASE WHEN action LIKE 'Deactivated%' THEN 'deactivated' ELSE 'active' END AS state,
    epoch_us(created_at) AS rank FROM status_logs
  UNION ALL SELECT id, CAST(deactivated_at AS DATE), 'deactivated', 9000000000000000 FROM accounts WHERE status = 'deactivated') x GROUP BY user_id, day)"""
_STATE_SQL = f"""{_CHANGE_SQL},
spine AS (SELECT id AS user_id, CAST(unnest(generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-02', INTERVAL '1' DAY)) AS DATE) AS day FROM accounts),
states AS (SELECT s.user_id, s.day, coalesce(c.state, 'active') AS state FROM spine s ASOF LEFT JOIN changes c ON s.user_id = c.user_id AND s.day >= c.day),
days AS (SELECT s.*, w.user_id IS NOT NULL AS worked, CAST(a.created_at AS DATE) AS born FROM states s JOIN accounts a ON a.id = s.user_id
  LEFT JOIN (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM logs) w ON w.user_id = s.user_id AND w.day = s.day)"""


@query("w14_status_changes", f"WITH {_CHANGE_SQL} SELECT user_id, CAST(day AS VARCHAR) AS day, state FROM changes")
def _(t: Tables):
    return activity.status_changes(t.status_logs, t.accounts).withColumn("day", c("day").cast("string"))


@query("j6_state_as_of", f"WITH {_STATE_SQL} SELECT user_id, CAST(day AS VARCHAR) AS day, state FROM states")
def _(t: Tables):
    states = activity.daily_state(t.accounts, activity.status_changes(t.status_logs, t.accounts), FIRST, LAST)
    return states.withColumn("day", c("day").cast("string"))


@query("w12_daily_calendar", f"""
WITH {_STATE_SQL} SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN day < born THEN 'not_created' WHEN worked THEN 'work' ELSE state END AS status FROM days""")
def _(t: Tables):
    days = activity.calendar(t.accounts, t.logs, t.status_logs, FIRST, LAST)
    return days.select("user_id", c("day").cast("string").alias("day"), "status")


_PARTS_SQL = """
parts AS (SELECT user_id, day, (place - 1) // 200 AS part, count(*) AS n, string_agg(action, ', ' ORDER BY place) AS actions FROM (
  SELECT user_id, CAST(created_at AS DATE) AS day, action, row_number() OVER (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY created_at, id) AS place FROM logs) x GROUP BY 1, 2, 3)"""


@query("a19_daily_actions", f"WITH {_PARTS_SQL} SELECT user_id, CAST(day AS VARCHAR) AS day, part, n, actions FROM parts")
def _(t: Tables):
    return activity.daily_actions(t.logs).withColumn("day", c("day").cast("string"))


@query("w13_calendar_report", f"""
WITH {_STATE_SQL}, {_PARTS_SQL} SELECT d.user_id, CAST(d.day AS VARCHAR) AS "Date", coalesce(p.part, 0) AS "Part", CASE WHEN state = 'deactivated' THEN 'Deactivated' ELSE 'Active' END AS "User Status",
  CASE WHEN worked THEN 'Yes' ELSE 'No' END AS "Work Done", coalesce(p.actions, '') AS "Activities Recorded" FROM days d LEFT JOIN parts p ON p.user_id = d.user_id AND p.day = d.day WHERE d.day >= d.born""")
def _(t: Tables):
    days = activity.calendar(t.accounts, t.logs, t.status_logs, FIRST, LAST)
    return activity.calendar_report(days, activity.daily_actions(t.logs))


# ── Failed attempts ─────────────────────────────────────────────────────────
@query("w15_rolling_failures", """
SELECT username, attempted_at, fails, first_fail, fails >= 5 AS blocked FROM (
  SELECT DISTINCT username, attempted_at, count(*) OVER w AS fails, min(attempted_at) OVER w AS first_fail FROM login_attempts WHERE success = 0
  WINDOW w AS (PARTITION BY username ORDER BY attempted_at RANGE BETWEEN INTERVAL '599.999999' SECOND PRECEDING AND CURRENT ROW)) x""")
def _(t: Tables):
    return activity.rolling_failures(t.login_attempts)


@query("w15b_login_block", """
SELECT username, fails, fails >= 5 AS blocked, CASE WHEN fails >= 5 THEN greatest(CAST(ceil((epoch_us(first_fail) + 600000000 - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 60000000.0) AS BIGINT), 1) ELSE 0 END AS minutes_left
FROM (SELECT username, count(*) AS fails, min(attempted_at) AS first_fail FROM login_attempts WHERE success = 0 AND attempted_at > TIMESTAMP '2024-01-15 11:50:00' AND attempted_at <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY username) x""")
def _(t: Tables):
    return activity.login_block(t.login_attempts, "2024-01-15 12:00:00")
