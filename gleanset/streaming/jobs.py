"""Structured Streaming forms of ingestion, cleaning, counting and alerting.

Event time is a TIMESTAMP in UTC with one lateness policy: rows more than an
hour behind the newest are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.operators.access import notifications
from gleanset.operators.activity import category_counts
from gleanset.operators.mapping import map_rows
from gleanset.operators.rules import Rule
from gleanset.operators.skew import attach
from gleanset.plans.cleaning import clean_values, flag_missing, validate_rows
from gleanset.plans.ingest import Ingested, digest, duplicate_key, ingest
from gleanset.streaming.ordered import Failures, Stays, by_stretch, in_order

LATENESS = "1 hour"
SESSION_GAP = "30 minutes"
# Folders of the index of stored keys.
KEY_BUCKETS = 64


def event_time(rows: DataFrame, column: str, lateness: str = LATENESS) -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def _naive(column: str):
    return F.col(column).cast("timestamp_ntz")


# ── Running a stream to its end ─────────────────────────────────────────────
def run_append(stream: DataFrame, path: str) -> DataFrame:
    """Write everything available to a parquet table and read it back."""
    started = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/rows")
    )
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_to_end(stream: DataFrame, path: str, left: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """:func:`run_append`, with what the state still holds at the end of the input: ``left`` reads it from the checkpoint."""
    done = run_append(stream, path)
    return done.unionByName(left(stream.sparkSession, f"{path}/checkpoint"))


def run_update(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The newest row of each key of an aggregation.

    A batch writes the rows it has changed to a folder of its own, so a repeated
    batch replaces its own rows. Windows behind the watermark leave the state,
    and open ones are in the result with what they have so far.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch_id=-1")
    started = (
        stream.writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).start()
    )
    started.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    rest = F.struct(*[c for c in stream.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(rest, "batch_id").alias("row")).select(*keys, "row.*")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


# ── Jobs ────────────────────────────────────────────────────────────────────
def key_index(spark: SparkSession, root: str, mapping: dict[str, str], columns: list[str]) -> str:
    """The folder of the digests of the master table's keys under this mapping: ``bucket=*/batch_id=*``.

    Keys follow the mapped targets, so each set of targets has an index of its
    own. A new one is made from the master rows, once; batches then add to it.
    """
    targets = ",".join([*sorted({t for t in mapping.values() if t and ":" in t}), *sorted(columns)])
    path = f"{root}/keys/{hashlib.sha256(targets.encode()).hexdigest()[:16]}"
    made = spark.createDataFrame([(path,)], "path string")
    done = spark.read.schema("path string").option("recursiveFileLookup", True).parquet(f"{root}/indexes")
    if done.join(made, "path", "left_semi").isEmpty():
        stored = spark.read.schema(_known(columns)).parquet(f"{root}/master").filter(F.col("batch_id") >= 0)
        _write_keys(stored.select("batch_id", digest(duplicate_key(mapping, columns)).alias("digest")), path)
        made.write.mode("append").parquet(f"{root}/indexes")
    return path


def _known(columns: list[str]) -> str:
    return ", ".join([*[f"`{c}` string" for c in columns], "custom_fields map<string,string>", "batch_id int"])


def _write_keys(keys: DataFrame, path: str) -> None:
    """Write (batch_id, digest), one file for each bucket of a batch; a batch replaces its own."""
    bucket = F.pmod(F.xxhash64("digest"), F.lit(KEY_BUCKETS)).cast("int")
    placed = keys.withColumn("bucket", bucket).repartition("bucket", "batch_id").sortWithinPartitions("bucket", "digest")
    placed.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch_id", "bucket").parquet(path)


def ingest_batch(
    batch: DataFrame, batch_id: int, mapping: dict[str, str], columns: list[str], row_id: str, index: str, user: str = "stream"
) -> Ingested:
    """One batch against the key index: only the buckets that the batch's keys fall into are read, and no master row."""
    spark = batch.sparkSession
    mapped = map_rows(batch, mapping, columns, [])
    bucket = F.pmod(F.xxhash64(digest(duplicate_key(mapping, columns))), F.lit(KEY_BUCKETS)).cast("int")
    # At most KEY_BUCKETS numbers reach the driver.
    buckets = [r[0] for r in mapped.select(bucket.alias("b")).distinct().collect()]
    keys = spark.read.schema("digest binary, batch_id int, bucket int").parquet(index)
    stored = keys.filter((F.col("batch_id") != batch_id) & F.col("bucket").isin(buckets)).select("digest")
    return ingest(batch, mapping, stored, columns, row_id, user=user)


def ingest_stream(
    files: DataFrame, mapping: dict[str, str], columns: list[str], row_id: str, root: str, user: str = "stream"
):
    """Map, dedupe and append every batch of new files; returns the started query.

    Each batch owns the folder of its id in the master, reject, ledger and key
    tables, so a repeated batch replaces its own rows and nothing else.
    """
    spark = files.sparkSession
    spark.createDataFrame([], _known(columns).rsplit(",", 1)[0]).write.mode("overwrite").parquet(f"{root}/master/batch_id=-1")
    spark.createDataFrame([], "path string").write.mode("append").parquet(f"{root}/indexes")
    index = key_index(spark, root, mapping, columns)

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        done = ingest_batch(kept, batch_id, mapping, columns, row_id, index, user)
        for rows, table in ((done.accepted, "master"), (done.rejected, "rejected"), (done.ledger, "ledger")):
            rows.write.mode("overwrite").parquet(f"{root}/{table}/batch_id={batch_id}")
        added = spark.read.schema(done.accepted.schema).parquet(f"{root}/master/batch_id={batch_id}")
        keys = added.select(F.lit(batch_id).alias("batch_id"), digest(duplicate_key(mapping, columns)).alias("digest"))
        _write_keys(keys, index)
        kept.unpersist()

    return (
        files.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(handle).start()
    )


def clean_stream(rows: DataFrame, rules: list[Rule], types: dict[str, str]) -> DataFrame:
    """Row-local cleaning and validation with outcome; same expressions as the batch run.

    Rules that need other rows (duplicates, median, mean) are refused.
    """
    for rule in rules:
        if rule.name == "duplicate_identifier" or rule.strategy in ("median", "mean"):
            raise ValueError(f"{rule.name} needs all rows and cannot run on a stream")
    frame, flags = clean_values(rows, rules, types)
    checked = validate_rows(flag_missing(frame, flags), rules)
    return checked.withColumn("__outcome", F.coalesce("__outcome", F.lit("cleaned")))


def tumbling_counts(logs: DataFrame, unit: str) -> DataFrame:
    """Activity counts per day or Monday week; months are summed from days."""
    span = F.window("created_at", "1 day") if unit == "day" else F.window("created_at", "7 days", "7 days", "4 days")
    counted = event_time(logs, "created_at").groupBy(span.alias("w")).agg(
        F.count(F.lit(1)).alias("total"), *category_counts(F.col("action")))
    return counted.select(F.to_date("w.start").alias("period"), *[c for c in counted.columns if c != "w"])


def failure_alerts(attempts: DataFrame) -> DataFrame:
    """(username, attempted_at, fifth_last) of every moment of a failure whose trailing ten minutes hold five or more.

    A user's stretches of time are keys of their own, so many tasks work on one
    user and none holds more than a stretch.
    """
    failed = event_time(attempts.filter("success = 0"), "attempted_at")
    events = failed.select("username", F.col("attempted_at").alias("at"), F.lit("").alias("what"))
    return in_order(by_stretch(events, fixed.LOGIN_WINDOW_SECONDS * 1_000_000), ["username", "stretch"], Failures())


def first_seen(rows: DataFrame, keys: list[str], column: str, lateness: str = LATENESS) -> DataFrame:
    """First row per key; later ones within the watermark go."""
    return event_time(rows, column, lateness).dropDuplicatesWithinWatermark(keys)


def sessions(logs: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """Activity sessions per user, closed after a pause of ``gap``.

    Sessions are merged inside each task before the shuffle, so a very active
    user sends sessions and not events.
    """
    logs.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    grouped = event_time(logs, "created_at").groupBy("user_id", F.session_window("created_at", gap).alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(
        "user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def notice_stream(logs: DataFrame, read_users: Callable[[], DataFrame], root: str):
    """Notices of the activity stream to managers, or to the admins; returns the started query.

    Users are read anew for every batch, so an admin added since the start is
    told, too. A batch owns the folder of its id below ``root/notices``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        notifications(batch, read_users()).write.mode("overwrite").parquet(f"{root}/notices/batch_id={batch_id}")

    return (
        logs.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(handle).start()
    )


VERDICT = "id long, user_id long, day string, n long, accepted boolean"
REQUEST = "id long, user_id long, at timestamp, n long, active_limit long"


def decided(requests: DataFrame) -> DataFrame:
    """(id, user_id, day, n, accepted): accept while used + n <= limit, in the order of (at, id) within a user's day.

    Days whose sum is within the limit are accepted as they are, without an
    order; the others pass through :func:`quota_in_order`. A refused request
    does not count.
    """
    keys = ["user_id", "day"]
    sums = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"),
        ((F.sum("n") <= F.min("active_limit")) & (F.min("n") >= 0)).alias("__fits"),
    )
    met = attach(requests, sums, keys, "__rows", "id")
    whole = met.filter("__fits").select("id", *keys, "n", F.lit(True).alias("accepted"))
    rest = met.filter("__fits IS NOT TRUE").select("id", *keys, "at", "n", "active_limit")
    return whole.unionByName(quota_in_order(rest, ["at", "id"]))


def quota_stream(requests: DataFrame, root: str, lateness: str = LATENESS):
    """Decide export requests of closed days; returns the started query.

    ``requests`` has id, user_id, at, n and active_limit. Tables below ``root``
    are the state: a batch writes its requests by day, and verdicts of the days
    that the watermark (the newest time less ``lateness``) has passed with it.
    Requests of a day that was closed before go to ``late``. Every batch owns
    the folders of its id, so a repeated one replaces its own rows. What a day
    says does not depend on files, batches or partitions.
    """
    spark = requests.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("id", "user_id", F.col("at").cast("timestamp").alias("at"), "n", "active_limit").withColumn("day", F.to_date("at").cast("string"))
        kept = rows.persist()
        kept.agg(F.max("at").alias("newest")).write.mode("overwrite").parquet(f"{root}/marks/batch_id={batch_id}")
        before, now = _closed_before(spark, root, batch_id, lateness), _closed_before(spark, root, batch_id + 1, lateness)
        kept.filter(F.col("day") < before).write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
        kept.filter(F.col("day") >= before).write.mode("overwrite").partitionBy("day").parquet(f"{root}/requests/batch_id={batch_id}")
        closing = _stored(spark, root).filter((F.col("batch_id") <= batch_id) & (F.col("day") >= before) & (F.col("day") < now))
        decided(closing).write.mode("overwrite").parquet(f"{root}/verdicts/batch_id={batch_id}")
        kept.unpersist()

    return (
        requests.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(handle).start()
    )


def _stored(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{REQUEST}, batch_id long, day string").option("basePath", f"{root}/requests").parquet(f"{root}/requests")


def _closed_before(spark: SparkSession, root: str, batch_id: int, lateness: str) -> str:
    """The first day that is still open before a batch: the day of the watermark that earlier batches have set."""
    marks = spark.read.schema("newest timestamp, batch_id long").parquet(f"{root}/marks").filter(F.col("batch_id") < batch_id)
    open_ = F.to_date(F.max("newest") - F.expr(f"INTERVAL {lateness}"))
    return marks.agg(F.coalesce(open_.cast("string"), F.lit(""))).first()[0]


def quota_verdicts(spark: SparkSession, root: str, lateness: str = LATENESS, ended: bool = False) -> DataFrame:
    """Verdicts of a :func:`quota_stream`; with ``ended`` also those of the days that were open when the input ended."""
    done = spark.read.schema(f"{VERDICT}, batch_id long").parquet(f"{root}/verdicts").drop("batch_id")
    if not ended:
        return done
    first = _closed_before(spark, root, 1 << 62, lateness)
    return done.unionByName(decided(_stored(spark, root).filter(F.col("day") >= first)))


def quota_in_order(requests: DataFrame, order: list[str]) -> DataFrame:
    """Accept while used + n <= limit, in the given order within a user's day.

    A user's day is one sorted run inside a partition; batches pass through
    one after the other and only the running total is kept.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used = None, 0
        for batch in batches:
            verdicts = []
            rows = zip(batch["user_id"], batch["day"], batch["n"], batch["active_limit"])
            for user, day, n, limit in rows:
                if (user, day) != key:
                    key, used = (user, day), 0
                fits = used + n <= limit
                used += n if fits else 0
                verdicts.append(fits)
            yield batch.assign(accepted=verdicts)[["id", "user_id", "day", "n", "accepted"]]

    sorted_rows = requests.repartition("user_id", "day").sortWithinPartitions("user_id", "day", *order)
    return sorted_rows.mapInPandas(run, "id long, user_id long, day string, n long, accepted boolean")


def stale_uploads(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Uploads that stay in processing for five minutes of event time, once per stay.

    ``events`` has id, status and at. The stay begins with the first processing
    event and ends with the next other status by event time; further processing
    events do not move it. What is open fires when the watermark passes the five
    minutes. An upload that left processing has no state.
    """
    timed = event_time(events, "at", lateness)
    return in_order(timed.select("id", "at", F.col("status").alias("what")), ["id"], Stays())
