"""Streaming queries: the stream runs to its end and must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.catalog.activity import _COUNTS, _NOTICE_SQL, _ORPHAN_SQL
from gleanset.catalog.base import Tables, query
from gleanset.catalog.records import _INGEST_MAP, _MAP_SQL, _TABLE
from gleanset.fixtures import stream_view
from gleanset.operators.rules import Rule
from gleanset.session import scratch_path
from gleanset.streaming import jobs, ordered

c = F.col


def streamed(t: Tables, name: str, table: str) -> DataFrame:
    """A derived view over the stream of its base table."""
    return stream_view(t.spark, name, table, jobs.stream_table(t.spark, t.sf_dir, table))


@query("st1_file_drop_ingestion", rf"""
WITH {_MAP_SQL},
incoming AS (SELECT *, concat_ws('|', coalesce(phone, ''), lower(coalesce(email_address, '')), lower(coalesce(first_name, '')), lower(coalesce(last_name, ''))) AS k FROM mapped
  WHERE coalesce(phone, email_address, first_name, last_name) IS NOT NULL)
SELECT min(record_id) AS record_id FROM incoming GROUP BY k""")
def _(t: Tables):
    root = scratch_path(t.spark, "ingest")
    files = streamed(t, "contacts", "customer").withColumn("file_id", F.lit("drop"))
    jobs.ingest_stream(files, _INGEST_MAP, _TABLE, "record_id", root).awaitTermination()
    return t.spark.read.option("mergeSchema", True).parquet(f"{root}/master").filter("batch_id >= 0").select("record_id")


@query("st2_stream_cleaning", r"""
SELECT record_id, CASE WHEN email IS NULL OR trim(email) = '' THEN 'invalid' WHEN NOT regexp_matches(trim(email), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') THEN 'invalid' ELSE 'cleaned' END AS outcome, trim(email) AS email FROM contacts""")
def _(t: Tables):
    rules = [Rule("trim_whitespace", "email"), Rule("handle_missing", "email"), Rule("validate_email", "email")]
    cleaned = jobs.clean_stream(streamed(t, "contacts", "customer").select("record_id", "email"), rules, {"email": "email"})
    rows = cleaned.select("record_id", c("__outcome").alias("outcome"), "email")
    return jobs.run_append(rows, scratch_path(t.spark, "clean"))


def _tumbling(name: str, unit: str, expression: str):
    @query(name, f"SELECT CAST({expression} AS VARCHAR) AS period, count(*) AS total, {_COUNTS} FROM logs GROUP BY 1")
    def _(t: Tables):
        counts = jobs.tumbling_counts(streamed(t, "logs", "events"), unit)
        return jobs.run_update(counts, ["period"], scratch_path(t.spark, "counts")).withColumn("period", c("period").cast("string"))


_tumbling("st3_tumbling_days", "day", "CAST(created_at AS DATE)")
_tumbling("st3b_tumbling_weeks", "week", "CAST(date_trunc('week', created_at) AS DATE)")


@query("st4_failure_alerts", """
SELECT username, attempted_at, max(fifth) AS fifth_last FROM (
  SELECT username, attempted_at, lag(attempted_at, 4) OVER (PARTITION BY username ORDER BY attempted_at) AS fifth FROM login_attempts WHERE success = 0) x
GROUP BY username, attempted_at HAVING max(fifth) > attempted_at - INTERVAL '600' SECOND""")
def _(t: Tables):
    """Exact trailing ten minutes; failures of the last hour come from the state."""
    alerts = jobs.failure_alerts(streamed(t, "login_attempts", "events"))
    found = jobs.run_to_end(alerts, scratch_path(t.spark, "alerts"), ordered.open_failures)
    return found.select("username", *[c(n).cast("timestamp_ntz").alias(n) for n in ("attempted_at", "fifth_last")])


@query("st5_stream_dedup", "SELECT DISTINCT user_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day FROM logs")
def _(t: Tables):
    rows = streamed(t, "logs", "events").select("user_id", F.to_date("created_at").cast("string").alias("day"), "created_at")
    first = jobs.first_seen(rows, ["user_id", "day"], "created_at", "2 days").select("user_id", "day")
    return jobs.run_append(first, scratch_path(t.spark, "dedup"))


def _requests(logs: DataFrame) -> DataFrame:
    return logs.filter(c("action").like("Exported%")).select(
        "id", "user_id", F.to_date("created_at").cast("string").alias("day"), c("created_at").alias("at"), c("total_rows").alias("n"), F.lit(120).cast("bigint").alias("active_limit"))


_WALK_SQL = """
WITH RECURSIVE asked AS (SELECT id, user_id, CAST(created_at AS DATE) AS day, total_rows AS n, row_number() OVER (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY id) AS place FROM logs WHERE action LIKE 'Exported%'),
walk AS (SELECT id, user_id, day, n, place, n <= 120 AS accepted, CASE WHEN n <= 120 THEN n ELSE 0 END AS used FROM asked WHERE place = 1
  UNION ALL SELECT a.id, a.user_id, a.day, a.n, a.place, w.used + a.n <= 120, w.used + CASE WHEN w.used + a.n <= 120 THEN a.n ELSE 0 END FROM walk w JOIN asked a ON a.user_id = w.user_id AND a.day = w.day AND a.place = w.place + 1)
SELECT id, user_id, CAST(day AS VARCHAR) AS day, n, accepted FROM walk"""


@query("st6_quota_stream", _WALK_SQL.replace("ORDER BY id)", "ORDER BY created_at, id)"))
def _(t: Tables):
    """Closed days as the stream decides them, the last ones at the end of the input."""
    root = scratch_path(t.spark, "quota")
    jobs.quota_stream(_requests(streamed(t, "logs", "events")), root).awaitTermination()
    return jobs.quota_verdicts(t.spark, root, ended=True)


@query("st6b_quota_in_order", _WALK_SQL)
def _(t: Tables):
    return jobs.quota_in_order(_requests(t.logs).drop("at"), ["id"])


@query("st7b_stale_timer", """
WITH said AS (SELECT event_id % 997 AS id, CASE WHEN event_id % 3 = 0 THEN 'processing' ELSE 'completed' END AS status, ts AS moment FROM events),
ordered AS (SELECT *, CASE WHEN status = lag(status) OVER (PARTITION BY id ORDER BY moment, status) THEN 0 ELSE 1 END AS opens FROM said),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY moment, status) AS nr FROM ordered),
stays AS (SELECT id, nr, status, min(moment) AS since FROM numbered GROUP BY id, nr, status),
ended AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY id ORDER BY nr), (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1' HOUR FROM events)) AS until FROM stays)
SELECT id, 'failed' AS status, since AS processing_since FROM ended WHERE status = 'processing' AND until >= since + INTERVAL '5' MINUTE""")
def _(t: Tables):
    """Uploads in event time: a third never leaves processing."""
    events = jobs.stream_table(t.spark, t.sf_dir, "events").select(
        (c("event_id") % 997).alias("id"), F.when(c("event_id") % 3 == 0, "processing").otherwise("completed").alias("status"), c("ts").alias("at"))
    stale = jobs.run_append(jobs.stale_uploads(events), scratch_path(t.spark, "stale"))
    return stale.withColumn("processing_since", c("processing_since").cast("timestamp_ntz"))


@query("st8_activity_sessions", """
WITH ordered AS (SELECT user_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens FROM logs),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY created_at) AS nr FROM ordered),
closed AS (SELECT user_id, nr, min(created_at) AS session_start, max(created_at) + INTERVAL '30' MINUTE AS session_end, count(*) AS events FROM numbered GROUP BY user_id, nr)
SELECT user_id, session_start, session_end, events FROM closed""")
def _(t: Tables):
    """Sessions that a pause has closed, and those open at the end."""
    found = jobs.run_to_end(jobs.sessions(streamed(t, "logs", "events")), scratch_path(t.spark, "sessions"), ordered.open_sessions)
    return found.select("user_id", c("start").cast("timestamp_ntz").alias("session_start"), c("end").cast("timestamp_ntz").alias("session_end"), "events")


@query("st9_notice_stream", _NOTICE_SQL + _ORPHAN_SQL)
def _(t: Tables):
    root = scratch_path(t.spark, "notices")
    jobs.notice_stream(streamed(t, "logs", "events"), lambda: t.users, root).awaitTermination()
    return t.spark.read.parquet(f"{root}/notices").drop("batch_id")
