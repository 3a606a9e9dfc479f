"""Activity-log analytics: categories, time buckets, calendars, health, limits."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions.scalars import json_map, minute_text, percent, run_file

# Actions of one user and day are listed in parts of this many.
PART_ACTIONS = 200


# ── Categories and buckets ──────────────────────────────────────────────────
def categories(action: Column) -> dict[str, Column]:
    """Overlapping action classes, as the report counts them."""
    text = F.lower(action)
    has = text.contains
    return {
        "exports": has("export"),
        "imports": has("upload") | has("ingest") | (has("import") & ~has("export")),
        "cleans": has("cleaned file"),
        "searches": has("search") | has("filter"),
        "logins": has("login"),
        "deletes": has("delete") | has("removed"),
    }


def category_counts(action: Column) -> list[Column]:
    return [F.count_if(hit).alias(name) for name, hit in categories(action).items()]


def activity_stats(logs: DataFrame) -> DataFrame:
    """One row: events, events per category, distinct users."""
    return logs.agg(
        F.count(F.lit(1)).alias("total_events"), *category_counts(F.col("action")),
        F.count_distinct("user_id").alias("unique_users"),
    )


def bucket(ts: Column, unit: str) -> Column:
    """Start date of the day, Monday week or month of a timestamp."""
    return F.to_date(F.date_trunc(unit, ts)) if unit != "day" else F.to_date(ts)


def bucket_counts(logs: DataFrame, unit: str, first: dt.date, last: dt.date) -> DataFrame:
    inside = logs.filter(
        (F.col("created_at") >= F.lit(first).cast("timestamp_ntz"))
        & (F.col("created_at") < F.lit(last + dt.timedelta(days=1)).cast("timestamp_ntz"))
    )
    return inside.groupBy(bucket(F.col("created_at"), unit).alias("period")).agg(
        F.count(F.lit(1)).alias("total"), *category_counts(F.col("action"))
    )


@dataclass(frozen=True)
class Period:
    """Unit and date range of a report; ``first`` is the first bucket's start."""

    unit: str
    first: dt.date
    last: dt.date


def period(name: str, as_of: dt.date, first: dt.date | None = None, last: dt.date | None = None) -> Period:
    """week: 7 days; month: 30 days by week; year: 12 months; custom: by length."""
    if name == "custom" and first and last:
        length = (last - first).days
        if length > 89:
            return Period("month", first.replace(day=1), last)
        if length > 14:
            return Period("week", first - dt.timedelta(days=first.weekday()), last)
        return Period("day", first, last)
    if name == "month":
        start = as_of - dt.timedelta(days=29)
        return Period("week", start - dt.timedelta(days=start.weekday()), as_of)
    if name == "year":
        months = as_of.year * 12 + as_of.month - 12
        return Period("month", dt.date(months // 12, months % 12 + 1, 1), as_of)
    return Period("day", as_of - dt.timedelta(days=6), as_of)


def stats_range(name: str, as_of: dt.date, first: dt.date | None = None, last: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Date range of the summary cards; their year starts on 1 January."""
    if name == "custom" and first and last:
        return first, last
    if name == "year":
        return as_of.replace(month=1, day=1), as_of
    return as_of - dt.timedelta(days=29 if name == "month" else 6), as_of


def spine(spark: SparkSession, span: Period) -> DataFrame:
    """Every bucket of a period with its label."""
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[span.unit]
    starts = spark.range(1).select(
        F.explode(F.sequence(F.lit(span.first), F.lit(span.last), F.expr(step))).alias("period"))
    day = F.col("period")
    label = {
        "day": F.date_format(day, "EEE dd MMM"),
        "week": F.concat(F.date_format(day, "dd MMM"), F.lit("–"), F.date_format(F.date_add(day, 6), "dd MMM")),
        "month": F.date_format(day, "MMM yyyy"),
    }[span.unit]
    return starts.withColumn("label", label)


def chart(logs: DataFrame, span: Period) -> DataFrame:
    """Counts of every bucket, zero where nothing happened."""
    counts = bucket_counts(logs, span.unit, span.first, span.last)
    names = ["total", *categories(F.lit(""))]
    joined = spine(logs.sparkSession, span).join(counts, "period", "left")
    return joined.select("period", "label", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def events_in_periods(logs: DataFrame, periods: DataFrame) -> DataFrame:
    """(name, events) of named date ranges, which may overlap.

    Events are first counted per day, so the range join meets days, not events.
    """
    days = logs.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    joined = days.join(periods, F.col("day").between(F.col("first"), F.col("last")))
    return joined.groupBy("name").agg(F.sum("n").alias("events"))


def top_users(logs: DataFrame, users: DataFrame, n: int = 5) -> DataFrame:
    """Most active users; counted before the join."""
    counts = logs.groupBy("user_id").agg(F.count(F.lit(1)).alias("event_count"))
    named = counts.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
    return named.select("username", "event_count").orderBy(F.desc("event_count"), "username").limit(n)


def active_dates(logs: DataFrame, user_id: int, n: int = 50) -> DataFrame:
    mine = logs.filter(F.col("user_id") == user_id).select(F.to_date("created_at").alias("active_date"))
    return mine.distinct().orderBy(F.desc("active_date")).limit(n)


def dashboard(logs: DataFrame, users: DataFrame, day: str) -> DataFrame:
    """Cleaned files, rows, active users, uploads of a day, last upload."""
    upload = F.col("action").like("Uploaded file%")
    on_day = F.to_date("created_at") == F.lit(day).cast("date")
    acts = logs.agg(
        F.count_if(F.col("action").like("Cleaned file%")).alias("cleaned_files"),
        F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"),
        F.count_if(upload & on_day).alias("uploads_on_day"),
        F.coalesce(minute_text(F.max_by("created_at", F.when(upload, F.col("id")))), F.lit("No recent uploads")).alias("last_upload"),
    )
    return acts.withColumn("active_users", users.agg(F.count_if(F.col("is_active") == 1)).scalar())


# ── Calendars ───────────────────────────────────────────────────────────────
def status_changes(status_logs: DataFrame, accounts: DataFrame) -> DataFrame:
    """(user_id, day, state): last status change of each user and day.

    The id comes from the action text; a deactivated account adds its own
    date, which follows the logged changes of that day.
    """
    action = F.lower("action")
    logged = status_logs.filter(
        F.col("action").like("Deactivated user%(id=%)%") | F.col("action").like("Activated user%(id=%)%")
    ).select(
        F.regexp_extract("action", r"\(id=(\d+)\)", 1).cast("bigint").alias("user_id"),
        F.to_date("created_at").alias("day"),
        F.when(action.contains("deactivated"), "deactivated").otherwise("active").alias("state"),
        F.struct(F.lit(0).alias("source"), "created_at", "id").alias("place"),
    )
    current = accounts.filter("status = 'deactivated' and deactivated_at is not null").select(
        F.col("id").cast("bigint").alias("user_id"), F.to_date("deactivated_at").alias("day"), F.lit("deactivated").alias("state"),
        F.struct(F.lit(1).alias("source"), F.col("deactivated_at").alias("created_at"), F.col("id").cast("bigint").alias("id")).alias("place"),
    )
    return logged.unionByName(current).groupBy("user_id", "day").agg(F.max_by("state", "place").alias("state"))


def daily_state(accounts: DataFrame, changes: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """(user_id, day, state) for each user and day: the last change on or before it.

    Changes are one per user and day, so a window holds days, never raw events.
    """
    days = accounts.select(
        F.col("id").cast("bigint").alias("user_id"),
        F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY"))).alias("day"),
        F.lit(None).cast("string").alias("state"), F.lit(1).alias("wanted"),
    )
    known = changes.filter(F.col("day") <= F.lit(last)).withColumn("wanted", F.lit(0))
    upto = W.partitionBy("user_id").orderBy("day", "wanted").rowsBetween(W.unboundedPreceding, 0)
    filled = days.unionByName(known).withColumn("state", F.last("state", ignorenulls=True).over(upto))
    return filled.filter("wanted = 1").select("user_id", "day", F.coalesce("state", F.lit("active")).alias("state"))


def daily_actions(logs: DataFrame, part: int = PART_ACTIONS) -> DataFrame:
    """(user_id, day, part, n, actions): actions of a day in time order, as text.

    Long days are listed in parts, so no list grows with the data. Positions
    come from counts per minute: a window over the minutes of a day gives each
    minute its offset, a window inside a minute the rest.
    """
    timed = logs.select("id", "user_id", "action", "created_at", F.date_trunc("minute", "created_at").alias("minute"))
    minutes = timed.groupBy("user_id", "minute").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("user_id", F.to_date("minute")).orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    offsets = minutes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    within = F.row_number().over(W.partitionBy("user_id", "minute").orderBy("created_at", "id"))
    placed = timed.join(offsets, ["user_id", "minute"]).withColumn("place", F.col("__before") + within)
    listed = F.array_sort(F.collect_list(F.struct("place", "action")))
    return placed.groupBy(
        "user_id", F.to_date("minute").alias("day"), F.floor((F.col("place") - 1) / part).alias("part")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda a: a["action"]), ", ").alias("actions")
    )


def calendar(
    accounts: DataFrame, logs: DataFrame, status_logs: DataFrame, first: dt.date, last: dt.date
) -> DataFrame:
    """(user_id, day, status, state, work): not_created, work, else the as-of state."""
    states = daily_state(accounts, status_changes(status_logs, accounts), first, last)
    work = logs.select(F.col("user_id").cast("bigint").alias("user_id"), F.to_date("created_at").alias("day")).distinct().withColumn("worked", F.lit(True))
    born = accounts.select(F.col("id").cast("bigint").alias("user_id"), F.to_date("created_at").alias("born"))
    joined = states.join(work, ["user_id", "day"], "left").join(born, "user_id")
    status = (
        F.when(F.col("day") < F.col("born"), "not_created").when(F.col("worked"), "work").otherwise(F.col("state"))
    )
    return joined.select("user_id", "day", "state", F.coalesce("worked", F.lit(False)).alias("worked"), "born", status.alias("status"))


def calendar_report(days: DataFrame, actions: DataFrame) -> DataFrame:
    """Export of a calendar: days since creation with state, work flag and activities."""
    lived = days.filter(F.col("day") >= F.col("born"))
    joined = lived.join(actions.select("user_id", "day", "part", "actions"), ["user_id", "day"], "left")
    return joined.select(
        "user_id", F.col("day").cast("string").alias("Date"), F.coalesce("part", F.lit(0)).alias("Part"),
        F.when(F.col("state") == "deactivated", "Deactivated").otherwise("Active").alias("User Status"),
        F.when(F.col("worked"), "Yes").otherwise("No").alias("Work Done"),
        F.coalesce("actions", F.lit("")).alias("Activities Recorded"),
    )


# ── Failed attempts ─────────────────────────────────────────────────────────
def login_block(attempts: DataFrame, now: str) -> DataFrame:
    """Users with failures in the ten minutes before ``now``: blocked, minutes left."""
    at = F.unix_micros(F.lit(now).cast("timestamp"))
    micros = F.unix_micros(F.col("attempted_at").cast("timestamp"))
    span = fixed.LOGIN_WINDOW_SECONDS * 1_000_000
    recent = attempts.filter((F.col("success") == 0) & (micros > at - span) & (micros <= at))
    left = F.ceil((F.min(micros) + span - at) / 60_000_000)
    return recent.groupBy("username").agg(F.count(F.lit(1)).alias("fails"), left.alias("__left")).select(
        "username", "fails", (F.col("fails") >= fixed.LOGIN_FAILURES).alias("blocked"),
        F.when(F.col("fails") >= fixed.LOGIN_FAILURES, F.greatest("__left", F.lit(1).cast("bigint"))).otherwise(0).alias("minutes_left"),
    )


def rolling_failures(attempts: DataFrame) -> DataFrame:
    """Failures of the trailing ten minutes at each failure time of each user.

    Attempts are counted per instant and cut into ten-minute buckets; a bucket
    also sees the one before it, so a window spans twenty minutes at most.
    """
    span = fixed.LOGIN_WINDOW_SECONDS
    instants = attempts.filter("success = 0").groupBy("username", "attempted_at").agg(F.count(F.lit(1)).alias("n"))
    micros = F.unix_micros(F.col("attempted_at").cast("timestamp"))
    cut = instants.withColumns({"micros": micros, "own": F.floor(micros / (span * 1_000_000))})
    seen = cut.withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    trailing = W.partitionBy("username", "bucket").orderBy("micros").rangeBetween(-(span * 1_000_000 - 1), 0)
    counted = seen.withColumns({"fails": F.sum("n").over(trailing), "first_fail": F.min("attempted_at").over(trailing)})
    return counted.filter("bucket = own").select(
        "username", "attempted_at", "fails", "first_fail", (F.col("fails") >= fixed.LOGIN_FAILURES).alias("blocked")
    )


# ── Data health ─────────────────────────────────────────────────────────────
def run_health(runs: DataFrame) -> DataFrame:
    """Score, issue classes and issue labels of every cleaning run."""
    counts = json_map(F.col("rule_counts"), None).cast("map<string,int>")
    rows = runs.filter(F.col("action").like("Cleaned file%")).withColumn("counts", counts)

    def total(*rules: str) -> Column:
        return sum((F.coalesce(F.try_element_at("counts", F.lit(r)), F.lit(0)) for r in rules), F.lit(0))

    formats = F.aggregate(
        F.map_values(F.map_filter("counts", lambda k, v: k.startswith("validate_") & (k != "validate_not_empty"))),
        F.lit(0), lambda a, v: a + v)
    labels = F.create_map(*[F.lit(x) for pair in fixed.ISSUE_LABELS.items() for x in pair])
    found = F.array_sort(F.map_entries(F.map_filter("counts", lambda k, v: v > 0)))
    issues = F.transform(found, lambda e: F.concat(
        F.coalesce(F.try_element_at(labels, e["key"]), F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" ")))),
        F.lit(" ("), e["value"].cast("string"), F.lit(")")))
    return rows.select(
        "id", "user_id", "created_at", run_file(F.col("action")).alias("file_name"),
        minute_text(F.col("created_at")).alias("processed_at"), "total_rows", "valid_rows", "invalid_rows", "removed_rows",
        percent(F.col("valid_rows"), F.col("total_rows")).alias("score"),
        total("validate_not_empty", "handle_missing").alias("blank_required"),
        total("duplicate_identifier", "fuzzy_duplicate", "duplicate_removal").alias("duplicates_flagged"),
        formats.alias("format_errors"), issues.alias("issues"),
    )


ISSUES = ("blank_required", "duplicates_flagged", "format_errors")


def overall_health(health: DataFrame) -> DataFrame:
    return health.agg(
        percent(F.sum("valid_rows"), F.sum("total_rows")).alias("overall_score"),
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ISSUES],
    )


def compare_weeks(health: DataFrame, now: str) -> DataFrame:
    """(issue, current, previous, verdict): this seven days against the seven before."""
    at = F.lit(now).cast("timestamp_ntz")
    this = F.col("created_at") >= at - F.expr("INTERVAL 7 DAYS")
    last = (F.col("created_at") >= at - F.expr("INTERVAL 14 DAYS")) & ~this
    recent = health.filter(F.col("created_at") >= at - F.expr("INTERVAL 14 DAYS"))
    sums = recent.agg(*[
        F.struct(
            F.lit(n).alias("issue"), F.coalesce(F.sum(F.when(this, F.col(n))), F.lit(0)).cast("bigint").alias("current"),
            F.sum(F.when(last, F.col(n))).cast("bigint").alias("previous"),
        ).alias(n) for n in ISSUES
    ])
    rows = sums.select(F.inline(F.array(*ISSUES)))
    verdict = (
        F.when(F.col("previous").isNull(), "no data").when(F.col("current") < F.col("previous"), "down")
        .when(F.col("current") == F.col("previous"), "same").otherwise("up")
    )
    return rows.withColumn("verdict", verdict)


# ── Jobs and uploads ────────────────────────────────────────────────────────
def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key; one candidate per task and key is shuffled."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__row")).select(key, "__row.*")


def job_summary(uploads: DataFrame, logs: DataFrame) -> DataFrame:
    """Ledger row with the latest log of its job, field by field."""
    def pick(*columns: str) -> Column:
        # zero counts as missing, as the status call reads it
        return F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in columns[:-1]], F.col(columns[-1]), F.lit(0))

    newest = latest(logs, "job_id", "id").select("job_id", *[F.col(c).alias(f"log_{c}") for c in ("total_rows", "valid_rows", "invalid_rows", "removed_rows")])
    return uploads.join(newest, uploads["id"] == newest["job_id"], "left").select(
        F.col("id").alias("job_id"), "filename", "status",
        pick("log_total_rows", "total_rows").alias("total_rows"), pick("log_valid_rows", "rows_imported").alias("valid_rows"),
        pick("log_invalid_rows", "rows_rejected").alias("invalid_rows"), F.coalesce("log_removed_rows", F.lit(0)).alias("removed_rows"),
    )


def fail_stale(uploads: DataFrame, now: str) -> DataFrame:
    """Uploads still processing after five minutes have failed."""
    late = F.col("uploaded_at") < F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 5 MINUTES")
    return uploads.withColumn("status", F.when((F.col("status") == "processing") & late, "failed").otherwise(F.col("status")))
