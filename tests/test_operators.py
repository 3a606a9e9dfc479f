import difflib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gleanset.functions.keys import letter_bound
from gleanset.operators import dedup, mapping, skew, typing
from gleanset.operators.medians import exact_medians


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def hot(spark):
    keys = ["hot"] * 40 + [None] * 20 + [f"k{i % 7}" for i in range(30)]
    return spark.createDataFrame(list(enumerate(keys)), "rid bigint, k string").repartition(5)


@pytest.mark.parametrize("hot_rows, hot_keys", [(5, 100), (5, 1), (10_000, 100), (0, 100)])
def test_attach_equals_a_plain_join(hot, hot_rows, hot_keys):
    facts = hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first"))
    got = skew.attach(hot, facts, ["k"], "n", "rid", hot_rows, hot_keys)
    plain = hot.alias("r").join(facts.alias("f"), skew.same("r", "f", ["k"]), "left").select("r.rid", "r.k", "f.n", "f.first")
    assert rows_of(got) == rows_of(plain)


def test_lookup_leaves_null_keys_unmatched(spark, hot):
    table = spark.createDataFrame([("hot", 1), ("k3", 2), (None, 3)], "k string, v int")
    got = {r["rid"]: r["v"] for r in skew.lookup(hot, table, ["k"]).collect()}
    wanted = {"hot": 1, "k3": 2}
    assert got == {r["rid"]: wanted.get(r["k"]) for r in hot.collect()}


def test_heaviest_is_bounded(hot):
    facts = hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in skew.heaviest(facts, "n", 3, 2).collect()} == {("hot", 40), (None, 20)}


def test_repeated_flags_every_occurrence(hot):
    got = {r["rid"]: r["twice"] for r in dedup.repeated(hot, ["k"], "rid", "twice", hot_rows=5).collect()}
    assert all(got.values())


def test_winners_prefer_score_then_lowest_id(spark):
    rows = spark.createDataFrame([(5, "a", 2), (-3, "a", 2), (9, "a", 1), (7, None, 0), (2**62, None, 0), (-(2**62), "b", 3)], "rid bigint, k string, s int")
    assert rows_of(dedup.key_winners(rows, ["k"], "s", "rid")) == rows_of(spark.createDataFrame([(-3,), (7,), (-(2**62),)], "rid bigint"))


def test_medians_match_brute_force(spark):
    random.seed(5)
    a = [random.choice([None, random.randint(0, 50) / 4, random.gauss(0, 1e6)]) for _ in range(2001)]
    b = [float(i % 10) for i in range(2000)] + [None]
    rows = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(6)
    wanted = (statistics.median([x for x in a if x is not None]), statistics.median([x for x in b if x is not None]))
    for accuracy in (50, 1000, 1_000_000):
        assert tuple(exact_medians(rows, ["a", "b"], accuracy).collect()[0]) == pytest.approx(wanted)


def test_median_of_nothing_is_null(spark):
    rows = spark.createDataFrame([(None,)], "a double")
    assert exact_medians(rows, ["a"]).collect()[0][0] is None


def test_numbered_is_dense_and_repeatable(spark):
    rows = spark.createDataFrame([(f"w{i}",) for i in range(500)], "w string")
    one = {r["w"]: r["nr"] for r in mapping.numbered(rows.repartition(3), "w", F.lit(10), "nr").collect()}
    two = {r["w"]: r["nr"] for r in mapping.numbered(rows.repartition(9), "w", F.lit(10), "nr").collect()}
    assert one == two and sorted(one.values()) == list(range(11, 511))


def test_standalone_dedup_reason(spark):
    rows = spark.createDataFrame([(0, "A@x.com", None), (1, " a@x.com", "n"), (2, None, "n"), (3, None, "m")], "rid bigint, email string, name string")
    got = {r["rid"]: r["removal_reason"] for r in dedup.drop_duplicates(rows, ["email"], {"email": "email"}, "rid").collect()}
    assert got == {0: "Duplicate of row 3 (based on email)", 1: None, 2: None, 3: "Duplicate of row 4 (based on email)"}
    single = dedup.drop_duplicates(rows, ["email", "name"], {"email": "email"}, "rid", mode="first")
    assert single.filter("kept").count() == 2


def test_golden_record(spark):
    rows = spark.createDataFrame([
        (1, "c", "Bob", None), (2, "c", "Robert", ""), (3, "c", "Bob", "nan"), (4, "d", "abc", "x"), (5, "d", "xyz", "yy"), (6, "e", None, None)],
        "rid bigint, cluster string, name string, note string")
    assert rows_of(dedup.golden_records(rows, "cluster", ["name", "note"], "rid")) == [("c", "Bob", None), ("d", "abc", "yy"), ("e", None, None)]


def test_types_by_name_and_sample(spark):
    rows = spark.createDataFrame([(i, "a@b.co", f"Room {i}", f"{i % 28 + 1:02d} Jan 2024", f"55512345{i:02d}", None) for i in range(40)],
                                 "rid bigint, e string, room string, day string, num string, nothing string")
    columns = ["e", "room", "day", "num", "nothing"]
    assert typing.column_types(rows, columns, "rid") == {"e": "email", "room": "numeric", "day": "numeric", "num": "phone", "nothing": "text"}
    assert typing.column_types(rows, ["e"], "rid", {"e": "text"}) == {"e": "text"}


def test_name_detectors():
    assert typing.is_identifier("email id") and typing.is_identifier("paid") and not typing.is_identifier("paid", "token")
    assert typing.is_identifier("user_id", "token")
    assert typing.alias_type(" Work Email ") == "email" and typing.alias_type("nothing") is None
    assert typing.type_or_text("nothing") == "text"
    assert typing.identifier_columns(["Customer Id", "name", "s.no"]) == ["Customer Id", "s.no"]
    assert [typing.stored_type(n, d) for n, d in (("x", "bigint"), ("x", "timestamp"), ("home_phone", "string"), ("my_url", "string"), ("x", "string"))] == [
        "numeric", "date", "phone", "url", "text"]


def test_sample_takes_the_first_non_null_rows(spark):
    rows = spark.createDataFrame([(i, None if i < 60 else str(i)) for i in range(200)], "rid bigint, v string").repartition(8)
    got = sorted(int(r["value"]) for r in typing.sample(rows, ["v"], "rid", 25).collect())
    assert got == list(range(60, 85))


def test_letter_bound_is_never_too_low(spark):
    pick = random.Random(4)
    pairs = [("".join(pick.choices("abé 1", k=pick.randint(0, 9))), "".join(pick.choices("abé 1", k=pick.randint(0, 9)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", letter_bound(F.col("a"), F.col("b")).alias("bound")).collect()
    assert all(r["bound"] >= difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() - 1e-9 for r in rows)


@pytest.mark.parametrize("accuracy, most", [(10_000, 1_000_000), (50, 20), (20, 1)])
def test_medians_in_narrowing_passes(spark, accuracy, most):
    pick = random.Random(8)
    cells = [(pick.gauss(0, 100), float(pick.randrange(5)), 3.0, None, pick.random() if i % 3 else None) for i in range(3001)]
    rows = spark.createDataFrame(cells, "a double, b double, c double, d double, e double")
    got = exact_medians(rows, list("abcde"), accuracy, most).first()
    for i, name in enumerate("abcde"):
        own = [r[i] for r in cells if r[i] is not None]
        assert got[name] == (statistics.median(own) if own else None)
