import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gleanset.operators import access, activity


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_periods():
    day = dt.date(2024, 3, 7)
    assert activity.period("week", day) == activity.Period("day", dt.date(2024, 3, 1), day)
    assert activity.period("month", day) == activity.Period("week", dt.date(2024, 2, 5), day)
    assert activity.period("year", day) == activity.Period("month", dt.date(2023, 4, 1), day)
    assert activity.period("year", dt.date(2024, 12, 31)).first == dt.date(2024, 1, 1)
    assert activity.period("custom", day, dt.date(2024, 1, 1), dt.date(2024, 1, 15)).unit == "day"
    assert activity.period("custom", day, dt.date(2024, 1, 1), dt.date(2024, 1, 16)).unit == "week"
    assert activity.period("custom", day, dt.date(2024, 1, 20), dt.date(2024, 5, 1)) == activity.Period("month", dt.date(2024, 1, 1), dt.date(2024, 5, 1))
    assert activity.stats_range("year", day) == (dt.date(2024, 1, 1), day)


def test_labels(spark):
    week = activity.spine(spark, activity.period("week", dt.date(2024, 7, 3))).collect()
    assert week[-1]["label"] == "Wed 03 Jul" and len(week) == 7
    month = activity.spine(spark, activity.period("month", dt.date(2024, 7, 30))).collect()
    assert month[0]["label"] == "01 Jul–07 Jul"
    assert activity.spine(spark, activity.period("year", dt.date(2026, 7, 1))).collect()[-1]["label"] == "Jul 2026"


def test_day_lists_are_cut_into_parts(spark):
    base = dt.datetime(2024, 1, 1, 23, 0)
    times = [base + dt.timedelta(seconds=(i * 37) % 7200) for i in range(500)]
    rows = [(i, 1, f"a{i}", t) for i, t in enumerate(times)]
    logs = spark.createDataFrame(rows, "id bigint, user_id bigint, action string, created_at timestamp_ntz").repartition(5)
    got = {(r["day"], r["part"]): r["actions"] for r in activity.daily_actions(logs, part=60).collect()}
    wanted = {}
    for day in {t.date() for t in times}:
        ordered = [a for _, _, a, t in sorted(rows, key=lambda r: (r[3], r[0])) if t.date() == day]
        for p in range(math.ceil(len(ordered) / 60)):
            wanted[(day, p)] = ", ".join(ordered[p * 60:(p + 1) * 60])
    assert got == wanted


def test_rolling_failures_against_brute_force(spark):
    random.seed(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"u{random.randint(0, 2)}", start + dt.timedelta(seconds=random.randint(0, 9000), microseconds=random.choice([0, 0, 1])), random.choice([0, 0, 0, 1])) for _ in range(400)]
    rows += [("u0", start, 0), ("u0", start + dt.timedelta(minutes=10), 0)]
    frame = spark.createDataFrame(rows, "username string, attempted_at timestamp_ntz, success int")
    got = {(r["username"], r["attempted_at"]): (r["fails"], r["first_fail"]) for r in activity.rolling_failures(frame).collect()}
    for user, at in {(u, t) for u, t, s in rows if s == 0}:
        seen = [t for u, t, s in rows if u == user and s == 0 and at - dt.timedelta(minutes=10) < t <= at]
        assert got[(user, at)] == (len(seen), min(seen))


def test_login_block_minutes(spark):
    now = dt.datetime(2024, 1, 1, 12, 0)
    rows = [("a", now - dt.timedelta(minutes=m), 0) for m in (9, 4, 3, 2, 1)] + [("b", now - dt.timedelta(minutes=10), 0)]
    frame = spark.createDataFrame(rows, "username string, attempted_at timestamp_ntz, success int")
    assert rows_of(activity.login_block(frame, "2024-01-01 12:00:00")) == [("a", 5, True, 1)]


def test_status_as_of(spark):
    logs = spark.createDataFrame([
        (1, "Deactivated user bob (id=7)", dt.datetime(2024, 1, 2, 9)), (2, "Activated user bob (id=7) again", dt.datetime(2024, 1, 4, 9)),
        (3, "Disabled user (id=7, username=bob)", dt.datetime(2024, 1, 3, 9))], "id bigint, action string, created_at timestamp_ntz")
    accounts = spark.createDataFrame([(7, dt.datetime(2024, 1, 2), "deactivated", dt.datetime(2024, 1, 6)), (8, dt.datetime(2024, 1, 1), "active", None)],
                                     "id bigint, created_at timestamp_ntz, status string, deactivated_at timestamp_ntz")
    work = spark.createDataFrame([(1, 7, "x", dt.datetime(2024, 1, 3, 5))], "id bigint, user_id bigint, action string, created_at timestamp_ntz")
    days = activity.calendar(accounts, work, logs, dt.date(2024, 1, 1), dt.date(2024, 1, 6))
    got = {(r["user_id"], r["day"].day): r["status"] for r in days.collect()}
    assert [got[(7, d)] for d in range(1, 7)] == ["not_created", "deactivated", "work", "active", "active", "deactivated"]
    assert {got[(8, d)] for d in range(1, 7)} == {"active"}


def test_visibility(spark):
    users = spark.createDataFrame([(0, "admin", None), (1, "manager", 0), (2, "team_lead", 1), (3, "user", 2), (4, "user", 1), (5, "team_lead", 9)],
                                  "id bigint, role string, manager_id bigint")
    pairs = {}
    for viewer, seen in rows_of(access.visible_users(users)):
        pairs.setdefault(viewer, set()).add(seen)
    assert pairs == {0: {0}, 1: {1, 2, 3}, 2: {2, 3}, 3: {3}, 4: {4}, 5: {5}}
    logs = spark.createDataFrame([(i, i) for i in range(6)], "id bigint, user_id bigint")
    assert access.visible_rows(logs, users, 0, "admin").count() == 6
    assert sorted(r["id"] for r in access.visible_rows(logs, users, 1, "manager").collect()) == [1, 2, 3]


def test_notices_go_to_the_manager_or_all_other_admins(spark):
    users = spark.createDataFrame([(0, "root", "admin", None), (1, "ann", "admin", None), (2, "bob", "user", 1)], "id bigint, username string, role string, manager_id bigint")
    logs = spark.createDataFrame([(10, 0, "Exported 5"), (11, 2, "Uploaded file x"), (12, 2, "Logged in"), (13, 2, "Cleaned file y")], "id bigint, user_id bigint, action string")
    got = rows_of(access.notifications(logs, users).select("id", "recipient_id", "message"))
    assert got == [(10, 1, "root exported records: Exported 5"), (11, 1, "bob uploaded a spreadsheet: Uploaded file x"),
                   (13, 1, "bob cleaned spreadsheet data: Cleaned file y")]


def test_feed_puts_missing_times_last(spark):
    one = spark.createDataFrame([(1, "pending", dt.datetime(2024, 1, 1))], "id bigint, status string, requested_at timestamp_ntz")
    none = spark.createDataFrame([(2, "pending", None)], "id bigint, status string, created_at timestamp_ntz")
    note = spark.createDataFrame([(3, "hi", dt.datetime(2024, 1, 2))], "id bigint, message string, created_at timestamp_ntz")
    assert [r["id"] for r in access.newest_first(access.inbox(one, none, note)).collect()] == [3, 1, 2]


def test_health(spark):
    runs = spark.createDataFrame([
        (1, 1, dt.datetime(2024, 1, 10), "Cleaned file a b.csv using rules: x", 0, 0, 0, 0, None),
        (2, 1, dt.datetime(2024, 1, 2), "Cleaned file c.csv", 8, 7, 1, 0, '{"handle_missing":2,"validate_url":1,"own_rule":3,"validate_email":0}')],
        "id int, user_id int, created_at timestamp_ntz, action string, total_rows int, valid_rows int, invalid_rows int, removed_rows int, rule_counts string")
    health = activity.run_health(runs)
    got = {r["id"]: r for r in health.collect()}
    assert got[1]["score"] == 0.0 and got[1]["issues"] == [] and got[1]["file_name"] == "a b.csv"
    assert got[2]["score"] == 87.5 and got[2]["issues"] == ["Blank required field (2)", "Own Rule (3)", "Format errors (1)"]
    weeks = {r["issue"]: (r["current"], r["previous"], r["verdict"]) for r in activity.compare_weeks(health, "2024-01-15 00:00:00").collect()}
    assert weeks["blank_required"] == (0, 2, "down") and weeks["duplicates_flagged"] == (0, 0, "same")
    alone = {r["issue"]: r["verdict"] for r in activity.compare_weeks(health.filter("id = 1"), "2024-01-15 00:00:00").collect()}
    assert set(alone.values()) == {"no data"}


def test_day_filter_is_a_plain_range(spark):
    from gleanset.operators.filters import days
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 5, 23, 59, 59, 999999),), (dt.datetime(2024, 1, 6),)], "t timestamp_ntz")
    assert rows.filter(days("t", "2024-01-05", "2024-01-05")).count() == 1


@pytest.mark.parametrize("unit, wanted", [("week", dt.date(2024, 1, 1)), ("month", dt.date(2024, 1, 1)), ("day", dt.date(2024, 1, 7))])
def test_buckets(spark, unit, wanted):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 7, 23),)], "t timestamp_ntz")
    assert rows.select(activity.bucket(F.col("t"), unit)).collect()[0][0] == wanted
