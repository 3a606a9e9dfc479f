import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.operators.activity import rolling_failures
from gleanset.operators.rules import Rule
from gleanset.plans import cleaning as plan
from gleanset.sources import readers, writers
from gleanset.streaming import jobs, ordered
from gleanset.streaming.ordered import open_failures, open_sessions

START = dt.datetime(2024, 1, 1, 12, 0)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def drop(spark, rows, schema, folder, name):
    """One file per call, as uploads arrive."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_late_rows_are_dropped_in_append_mode(spark, folder):
    schema = "user_id bigint, created_at timestamp_ntz, action string"
    drop(spark, [(1, START, "login"), (1, START + dt.timedelta(days=1, hours=5), "login")], schema, folder, "a")
    drop(spark, [(2, START + dt.timedelta(days=1, hours=4), "in time")], schema, folder, "b")
    drop(spark, [(2, START - dt.timedelta(hours=3), "late")], schema, folder, "c")
    drop(spark, [(3, START + dt.timedelta(days=3), "login")], schema, folder, "d")
    got = jobs.run_append(jobs.tumbling_counts(stream(spark, schema, folder), "day"), f"{folder}-out")
    assert {r["period"]: r["total"] for r in got.collect()} == {dt.date(2024, 1, 1): 1, dt.date(2024, 1, 2): 2}


def test_weeks_start_on_monday(spark, folder):
    schema = "user_id bigint, created_at timestamp_ntz, action string"
    drop(spark, [(1, dt.datetime(2024, 1, 7, 23, 59), "x"), (1, dt.datetime(2024, 1, 8), "x")], schema, folder, "a")
    got = jobs.run_update(jobs.tumbling_counts(stream(spark, schema, folder), "week"), ["period"], f"{folder}-out")
    assert {r["period"] for r in got.collect()} == {dt.date(2024, 1, 1), dt.date(2024, 1, 8)}


def test_first_seen_across_batches(spark, folder):
    schema = "k string, at timestamp_ntz, n int"
    drop(spark, [("a", START, 1)], schema, folder, "1")
    drop(spark, [("a", START + dt.timedelta(minutes=5), 2), ("b", START, 3)], schema, folder, "2")
    got = jobs.run_append(jobs.first_seen(stream(spark, schema, folder), ["k"], "at"), f"{folder}-out")
    assert {(r["k"], r["n"]) for r in got.collect()} == {("a", 1), ("b", 3)}


QUOTA = "id bigint, user_id bigint, at timestamp_ntz, n bigint, active_limit bigint"


def test_quota_stream_does_not_depend_on_files_and_batches(spark, folder):
    sizes = [60, 50, 50, 30, 40, 30, 1, 20]
    asks = [(i, i % 2, START + dt.timedelta(minutes=i), n, 100) for i, n in enumerate(sizes)]
    asks += [(50 + i, 7, START + dt.timedelta(days=1, minutes=i), 1, 1000) for i in range(40)]
    batch = spark.createDataFrame(asks, QUOTA).withColumn("day", F.to_date("at").cast("string"))
    expected = rows_of(jobs.quota_in_order(batch.drop("at"), ["id"]))
    for seed, parts in ((1, 1), (2, 3), (3, 5)):
        mixed = asks.copy()
        random.Random(seed).shuffle(mixed)
        # Days one after the other, so that no request is late; within a day in any order.
        mixed.sort(key=lambda r: r[2].date())
        cut = -(-len(mixed) // parts)
        for k in range(parts):
            drop(spark, mixed[k * cut:(k + 1) * cut], QUOTA, f"{folder}-{parts}", f"in{k}")
        root = f"{folder}-{parts}-state"
        jobs.quota_stream(stream(spark, QUOTA, f"{folder}-{parts}"), root).awaitTermination()
        assert rows_of(jobs.quota_verdicts(spark, root, ended=True)) == expected
        closed = {r["day"] for r in jobs.quota_verdicts(spark, root).collect()}
        assert closed == {"2024-01-01"}
    # user 0 asks 60, 50, 40, 1 and user 1 asks 50, 30, 30, 20 of 100
    assert [r[0] for r in expected if not r[-1]] == [2, 5, 6]


def test_late_requests_are_kept_apart(spark, folder):
    for name, rows in (
        ("a", [(1, 1, START, 5, 10)]), ("b", [(2, 1, START + dt.timedelta(days=2), 5, 10)]),
        ("c", [(3, 1, START, 5, 10), (4, 1, START + dt.timedelta(days=2), 6, 10)]),
    ):
        drop(spark, rows, QUOTA, folder, name)
    jobs.quota_stream(stream(spark, QUOTA, folder), f"{folder}-state").awaitTermination()
    got = {r["id"]: r["accepted"] for r in jobs.quota_verdicts(spark, f"{folder}-state", ended=True).collect()}
    assert got == {1: True, 2: True, 4: False}
    assert [r["id"] for r in spark.read.parquet(f"{folder}-state/late").collect()] == [3]


def test_days_within_the_limit_need_no_order(spark):
    rows = [(i, 1, START, 1, 5000) for i in range(3000)] + [(9000 + i, 2, START + dt.timedelta(seconds=i), 2, 5) for i in range(4)]
    frame = spark.createDataFrame(rows, QUOTA).withColumn("day", F.to_date("at").cast("string"))
    got = {r["id"]: r["accepted"] for r in jobs.decided(frame).collect()}
    assert all(got[i] for i in range(3000)) and [got[9000 + i] for i in range(4)] == [True, True, False, False]


def test_admins_added_after_the_start_are_told(spark, folder):
    schema = "id bigint, user_id bigint, action string"
    users = [(1, "ann", "user", None), (2, "root", "admin", None)]
    known = "id bigint, username string, role string, manager_id bigint"
    spark.createDataFrame(users, known).write.parquet(f"{folder}-users")
    for k in range(2):
        drop(spark, [(10 + k, 1, "Exported 5 records")], schema, folder, f"in{k}")
    seen = []

    def read():
        if len(seen) == 1:
            spark.createDataFrame([(3, "new", "admin", None)], known).write.mode("append").parquet(f"{folder}-users")
        seen.append(1)
        return spark.read.schema(known).parquet(f"{folder}-users")

    jobs.notice_stream(stream(spark, schema, folder), read, f"{folder}-out").awaitTermination()
    rows = spark.read.parquet(f"{folder}-out/notices").collect()
    assert sorted((r["id"], r["recipient_id"]) for r in rows) == [(10, 2), (11, 2), (11, 3)]


def in_batches(spark, folder, rows, schema, parts, last, build):
    """Rows of a stream that gets ``rows`` shuffled in ``parts`` batches, then the rows of ``last`` one by one."""
    root = f"{folder}-{parts}"
    mixed = rows.copy()
    random.Random(parts).shuffle(mixed)
    for k in range(parts):
        drop(spark, mixed[k::parts], schema, root, f"in{k}")
    for k, row in enumerate(last):
        drop(spark, [row], schema, root, f"z{k}")
    return build(stream(spark, schema, root), f"{root}-out")


def test_stays_do_not_depend_on_batches(spark, folder):
    """The order of the finding that led here, and random events within the lateness: one batch and five shuffled ones agree."""
    schema = "id bigint, status string, at timestamp_ntz"
    minutes = lambda n: START + dt.timedelta(minutes=n)
    rows = [(1, "processing", minutes(0)), (1, "completed", minutes(2)), (1, "processing", minutes(10)), (1, "completed", minutes(11))]
    pick = random.Random(5)
    rows += [(2 + pick.randrange(6), pick.choice(["processing", "completed", "failed"]), minutes(pick.randrange(55))) for _ in range(120)]
    expected = set()
    for upload in range(1, 8):
        since = None
        for at, status in [*sorted((r[2], r[1]) for r in rows if r[0] == upload), (minutes(240), "end")]:
            if since is not None and at - since >= dt.timedelta(minutes=5) and (upload, since) not in expected:
                expected.add((upload, since))
            since = None if status != "processing" else since or at
    last = [(99, "completed", minutes(300))]
    for parts in (1, 5):
        got = in_batches(spark, folder, rows, schema, parts, last, lambda s, out: jobs.run_append(jobs.stale_uploads(s), out)).collect()
        assert {(r["id"], r["processing_since"].replace(tzinfo=None)) for r in got} == expected and len(got) == len(expected)
    assert not any(i == 1 for i, _ in expected)


def test_bursts_across_minutes_equal_the_batch_rule(spark, folder):
    schema = "username string, attempted_at timestamp_ntz, success int"
    pick = random.Random(8)
    rows = [(f"u{pick.randrange(3)}", START + dt.timedelta(seconds=pick.randrange(3300)), pick.choice([0, 0, 1])) for _ in range(150)]
    rows += [("burst", START + dt.timedelta(seconds=595 + 2 * k, microseconds=k), 0) for k in range(5)]
    rows += [("same", START, 0)] * 5 + [("edge", START + dt.timedelta(seconds=150 * k), 0) for k in range(5)]
    batch = rolling_failures(spark.createDataFrame(rows, schema)).filter("fails >= 5").collect()
    expected = {(r["username"], r["attempted_at"]) for r in batch}
    assert ("burst", START + dt.timedelta(seconds=603, microseconds=4)) in expected and ("same", START) in expected
    assert not any(u == "edge" for u, _ in expected)
    for parts, last in ((1, []), (5, []), (3, [("x", START + dt.timedelta(hours=5), 0)])):
        def build(s, out):
            return jobs.run_to_end(jobs.failure_alerts(s), out, open_failures)

        got = in_batches(spark, f"{folder}{len(last)}", rows, schema, parts, last, build).collect()
        assert {(r["username"], r["attempted_at"].replace(tzinfo=None)) for r in got} == expected and len(got) == len(expected)


def test_failures_of_a_user_wait_by_stretches_of_time(spark, folder):
    """No key of the state holds more than a stretch and the ten minutes before it, and bursts across stretches are found."""
    schema = "username string, attempted_at timestamp_ntz, success int"
    pick = random.Random(3)
    rows = [("ann", START + dt.timedelta(seconds=pick.randrange(40 * 3600)), 0) for _ in range(1200)]
    rows += [("ann", dt.datetime(2024, 1, 2) + dt.timedelta(seconds=40 * k - 80), 0) for k in range(5)] + [("bob", START, 0), (None, START, 0), ("bob", None, 0)]
    batch = rolling_failures(spark.createDataFrame([r for r in rows if r[0] == "ann"], schema)).filter("fails >= 5").collect()
    expected = {(r["username"], r["attempted_at"]) for r in batch}
    assert ("ann", dt.datetime(2024, 1, 2) + dt.timedelta(seconds=80)) in expected
    got = in_batches(spark, folder, rows, schema, 1, [], lambda s, out: jobs.run_to_end(jobs.failure_alerts(s), out, open_failures)).collect()
    assert {(r["username"], r["attempted_at"].replace(tzinfo=None)) for r in got} == expected and len(got) == len(expected)
    state = spark.read.format("statestore").option("stateVarName", "waiting").option("batchId", 0).load(f"{folder}-1-out/checkpoint")
    held = state.filter("key.username = 'ann'").groupBy("key").agg((F.max("list_element.at") - F.min("list_element.at")).alias("span"), F.count(F.lit(1)).alias("n")).collect()
    assert len(held) >= 7 and max(r["n"] for r in held) < 400
    assert all(r["span"] < ordered.STRETCH + fixed.LOGIN_WINDOW_SECONDS * 1_000_000 for r in held)


class Held:
    """A state variable of one key, in memory; the longest list it was given at once is in ``most``."""

    def __init__(self):
        self.value, self.most = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.most = max(self.most, len(rows))
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.value = None


class Handle:
    registerTimer = deleteTimer = staticmethod(lambda at: None)

    def getListState(self, name, schema):
        return Held()

    getValueState = getListState


@pytest.mark.parametrize("rule, key, names", [(ordered.Failures, ("u", 0), [""]), (ordered.Stays, (1,), ["processing"] * 20 + ["completed", None])])
def test_rules_get_their_events_in_slices(monkeypatch, rule, key, names):
    """Slices of any length give the same rows, state and timer, also where a moment with several events is cut."""
    pick = random.Random(4)
    events = [(pick.randrange(40) * 60_000_000, pick.choice(names)) for _ in range(120)]
    seen, longest = [], []

    class Watched(rule):
        def follow(self, key, memory, events, *rest):
            longest.append(len(events))
            return super().follow(key, memory, events, *rest)

    class Values:
        getCurrentWatermarkInMs = staticmethod(lambda: 30 * 60_000)

    for size in (1, 7, 1000):
        monkeypatch.setattr(ordered, "SLICE", size)
        del longest[:]
        made = Watched()
        made.init(Handle())
        made.waiting.value = list(events)
        rows = [tuple(r) for frame in made.handleExpiredTimer(key, Values, None) for r in frame.itertuples(index=False)]
        assert max(longest) <= size and made.waiting.most <= size
        seen.append((rows, made.waiting.value, made.memory.value, made.timer.value))
    assert seen[0] == seen[1] == seen[2] and seen[0][0] and len(seen[0][1]) == sum(e[0] > 30 * 60_000_000 for e in events)


def test_sessions_open_at_the_end_come_out(spark, folder):
    schema = "user_id bigint, created_at timestamp_ntz"
    minutes = lambda n: START + dt.timedelta(minutes=n)
    drop(spark, [(1, minutes(0)), (1, minutes(20)), (1, minutes(200)), (2, minutes(190))], schema, folder, "a")
    got = jobs.run_to_end(jobs.sessions(stream(spark, schema, folder)), f"{folder}-out", open_sessions).collect()
    assert sorted((r["user_id"], r["events"]) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_stale_upload_fires_once_the_watermark_passes(spark, folder):
    schema = "id bigint, status string, at timestamp_ntz"
    drop(spark, [(1, "processing", START), (2, "processing", START)], schema, folder, "a")
    drop(spark, [(2, "completed", START + dt.timedelta(minutes=2)), (9, "completed", START + dt.timedelta(hours=5))], schema, folder, "b")
    drop(spark, [(9, "completed", START + dt.timedelta(hours=9))], schema, folder, "c")
    got = jobs.run_append(jobs.stale_uploads(stream(spark, schema, folder)), f"{folder}-out")
    assert [(r["id"], r["status"]) for r in got.collect()] == [(1, "failed")]


def test_later_and_late_events_do_not_move_a_stay(spark, folder):
    schema = "id bigint, status string, at timestamp_ntz"
    minutes = lambda n: START + dt.timedelta(minutes=n)
    drop(spark, [(1, "processing", minutes(0)), (2, "processing", minutes(10))], schema, folder, "a")
    drop(spark, [(1, "processing", minutes(4)), (2, "completed", minutes(8))], schema, folder, "b")
    drop(spark, [(9, "completed", minutes(68))], schema, folder, "c")
    drop(spark, [(1, "processing", minutes(69)), (9, "completed", minutes(300))], schema, folder, "d")
    drop(spark, [(9, "completed", minutes(600))], schema, folder, "e")
    got = jobs.run_append(jobs.stale_uploads(stream(spark, schema, folder)), f"{folder}-out").collect()
    assert sorted((r["id"], r["processing_since"].replace(tzinfo=None)) for r in got) == [(1, minutes(0)), (2, minutes(10))]


def test_ingest_stream_survives_a_restart(spark, folder):
    schema = "rid bigint, file_id string, mail string"
    target = {"mail": "master:email"}
    drop(spark, [(1, "a", "x@y"), (2, "a", "X@Y ")], schema, folder, "a")
    root = f"{folder}-root"
    jobs.ingest_stream(stream(spark, schema, folder), target, ["email"], "rid", root).awaitTermination()
    drop(spark, [(3, "b", " x@y"), (4, "b", "new@y")], schema, folder, "b")
    jobs.ingest_stream(stream(spark, schema, folder), target, ["email"], "rid", root).awaitTermination()
    jobs.ingest_stream(stream(spark, schema, folder), target, ["email"], "rid", root).awaitTermination()
    kept = [spark.read.parquet(f"{root}/master/batch_id={b}") for b in (0, 1)]
    assert [sorted(r["rid"] for r in k.collect()) for k in kept] == [[1], [4]]
    assert sum(spark.read.parquet(f"{root}/ledger/batch_id={b}").agg(F.sum("rows_rejected")).collect()[0][0] for b in (0, 1)) == 2


def test_batches_meet_the_key_index_and_no_master_row(spark, folder):
    schema = "rid bigint, file_id string, mail string"
    target, root = {"mail": "master:email"}, f"{folder}-root"
    drop(spark, [(i, "a", f"m{i}@x") for i in range(50)], schema, folder, "a")
    jobs.ingest_stream(stream(spark, schema, folder), target, ["email"], "rid", root).awaitTermination()
    index = jobs.key_index(spark, root, target, ["email"])
    batch = spark.createDataFrame([(90, "b", " M7@X "), (91, "b", "new@x"), (92, "b", None)], schema)
    done = jobs.ingest_batch(batch, 1, target, ["email"], "rid", index)
    read = done.accepted.inputFiles()
    plan = done.accepted._jdf.queryExecution().executedPlan().toString()
    assert read and all("/keys/" in f for f in read) and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r["rid"] for r in done.accepted.collect()] == [91]
    # A repeated batch does not meet its own keys.
    again = jobs.ingest_batch(spark.createDataFrame([(1, "a", "m1@x")], schema), 0, target, ["email"], "rid", index)
    assert again.accepted.count() == 1
    # Under another mapping keys differ: their index is made from the master rows.
    wider = jobs.key_index(spark, root, {**target, "tier": "custom:3"}, ["email"])
    assert wider != index and spark.read.parquet(wider).count() == 50
    assert jobs.key_index(spark, root, target, ["email"]) == index and spark.read.parquet(index).count() == 50


def test_stream_cleaning_equals_batch(spark, folder):
    schema = "rid bigint, email string, name string"
    rows = [(1, " a@b.co ", "x"), (2, "bad", None), (3, None, "z")]
    rules = [Rule("trim_whitespace", "email"), Rule("handle_missing", "name", "drop"), Rule("validate_email", "email")]
    kinds = {"email": "email", "name": "text"}
    drop(spark, rows, schema, folder, "a")
    got = jobs.run_append(jobs.clean_stream(stream(spark, schema, folder), rules, kinds), f"{folder}-out")
    batch = plan.clean(spark.createDataFrame(rows, schema), rules, "rid", types=kinds).classified
    assert rows_of(got.select("rid", "email", "__outcome")) == rows_of(batch.select("rid", "email", "__outcome"))
    with pytest.raises(ValueError):
        jobs.clean_stream(batch, [Rule("handle_missing", "name", "median")], kinds)


def test_delimiter_is_sniffed(spark, folder):
    spark.createDataFrame([("a;b;c",), ("1;x,y;",)], "value string").coalesce(1).write.text(folder)
    rows = readers.read_csv(spark, folder)
    assert rows.columns == ["a", "b", "c"] and tuple(rows.collect()[0]) == ("1", "x,y", None)


def test_row_ids_are_stable(spark, folder):
    spark.range(100).withColumn("r", F.rand(1)).write.parquet(folder)
    rows = readers.with_row_id(spark.read.parquet(folder).repartition(7))
    assert rows_of(rows) == rows_of(rows) and rows.select("__row_id").distinct().count() == 100


def test_split_sink_leaves_out_empty_outcomes(spark, folder):
    rows = spark.createDataFrame([(1, "a@b.co"), (2, "bad")], "rid bigint, email string")
    writers.write_split(plan.clean(rows, [Rule("validate_email", "email")], "rid", types={"email": "email"}), folder)
    assert {r["outcome"]: r["n"] for r in spark.read.parquet(folder).groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {"cleaned": 1, "invalid": 1}
