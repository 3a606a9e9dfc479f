import difflib
import re

import pytest
from pyspark.sql import functions as F

from gleanset.operators.rules import Rule, register_rule, REGISTRY
from gleanset.plans import cleaning as plan

CONTACTS = [
    (1, "Ann Lee", " ann@x.com ", "5551234567", "10"),
    (2, "Ann Lee", "ann@x.com", "5551234567", None),
    (3, None, "bad", "123", "20"),
    (4, "Bob", None, "5550000000", "x"),
    (5, "Ann Leee", "ann@x.com", "555-123-4567", "1"),
    (6, "Cid", "cid@x.com", None, "2"),
    (7, "Cid", "cid@x.com", None, "3"),
    (8, "", "zed@x.com", "5559999999", "40"),
]
TYPES = {"name": "text", "email": "email", "phone": "phone", "amount": "numeric"}


@pytest.fixture
def contacts(spark):
    return spark.createDataFrame(CONTACTS, "rid bigint, name string, email string, phone string, amount string")


def outcomes(result):
    return {r["rid"]: r["__outcome"] for r in result.classified.collect()}


def test_rows_leave_at_the_first_stage_that_claims_them(contacts):
    rules = [Rule("trim_whitespace", "email"), Rule("handle_missing", "email", "flag"), Rule("handle_missing", "name", "drop"),
             Rule("validate_email", "email"), Rule("validate_numeric", "amount")]
    run = plan.clean(contacts, rules, "rid", ["email", "phone"], TYPES)
    assert outcomes(run) == {1: "cleaned", 2: "removed", 3: "removed", 4: "invalid", 5: "removed", 6: "cleaned", 7: "removed", 8: "removed"}
    reasons = {r["rid"]: (r[plan.RULES_FAILED], r[plan.FAILURE_REASON]) for r in run.removed.collect()}
    assert reasons[2] == ("Duplicate", "Removed during deterministic deduplication")
    assert reasons[8] == ("handle_missing", "Dropped: missing value in 'name'")
    # row 3 has a bad address too, but it was dropped before validation
    assert reasons[3][0] == "handle_missing"


def test_parts_add_up_and_run_is_idempotent(contacts):
    rules = [Rule("trim_whitespace", "email"), Rule("validate_email", "email"), Rule("normalize_currency", "amount")]
    run = plan.clean(contacts, rules, "rid", ["email"], TYPES).materialise()
    total = run.summary.collect()[0]
    assert total["total_rows"] == total["clean_rows"] + total["invalid_rows"] + total["duplicate_rows_removed"] == 8
    again = plan.clean(run.cleaned, rules, "rid", ["email"], TYPES)
    assert sorted(run.cleaned.collect()) == sorted(again.cleaned.collect())


def test_result_does_not_depend_on_partitions(contacts):
    rules = [Rule("handle_missing", "amount", "median"), Rule("validate_phone", "phone")]
    seen = [sorted(map(str, plan.clean(contacts.repartition(n), rules, "rid", ["name", "email", "phone"], TYPES).classified.collect())) for n in (1, 7)]
    assert seen[0] == seen[1]


def test_median_sees_the_column_at_its_own_position(spark):
    rows = spark.createDataFrame([(1, "1"), (2, None), (3, "9"), (4, "junk")], "rid bigint, amount string")
    filled = plan.clean(rows, [Rule("handle_missing", "amount", "median")], "rid", types={"amount": "numeric"})
    assert {r["rid"]: r["amount"] for r in filled.cleaned.collect()} == {1: "1", 2: "5.0", 3: "9", 4: "junk"}
    later = plan.clean(rows, [Rule("clean_special_chars", "amount"), Rule("handle_missing", "amount", "mean")], "rid", types={"amount": "numeric"})
    assert {r["rid"]: r["amount"] for r in later.cleaned.collect()} == {1: "1", 2: "5.0", 3: "9", 4: "5.0"}


def test_identifier_check_ignores_rows_already_gone(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, None, "x"), (5, None, "x")], "rid bigint, code string, name string")
    rules = [Rule("handle_missing", "name"), Rule("duplicate_identifier", "code")]
    run = plan.clean(rows, rules, "rid", types={"code": "identifier", "name": "text"})
    assert outcomes(run) == {1: "cleaned", 2: "invalid", 3: "cleaned", 4: "invalid", 5: "invalid"}


def test_incompatible_rules_become_warnings(contacts):
    rules = [Rule("validate_email", "phone"), Rule("trim_whitespace", "rid_code"), Rule("no_such_rule", "email")]
    rows = contacts.withColumn("rid_code", F.lit("x"))
    run = plan.clean(rows, rules, "rid", types=TYPES)
    assert sorted(r["message"] for r in run.warnings.collect()) == [
        "Identifier columns cannot have cleaning rules applied", "Incompatible rule 'validate_email' for column type 'phone'"]
    assert set(outcomes(run).values()) == {"cleaned"}


def test_user_rule_with_pandas_udf(contacts):
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def reverse(s: pd.Series) -> pd.Series:
        return s.str[::-1]

    register_rule("reverse", lambda c, kind: reverse(c), "cleaning", ("text",))
    try:
        run = plan.clean(contacts, [Rule("reverse", "name")], "rid", types=TYPES)
        assert {r["rid"]: r["name"] for r in run.cleaned.collect()}[4] == "boB"
    finally:
        del REGISTRY["reverse"]


def test_fuzzy_dedup_against_brute_force(spark):
    names = ["john smith", "john smyth", "jon smith", "mary jones", "Mary  Jones!", "", " ", "zed"]
    rows = [(i, f"p{i % 3}" if i < 60 else "crowd", names[(i * 7) % len(names)] + ("" if i % 4 else " jr"), "x" if i % 5 else None) for i in range(90)]
    rows = [(i, p + str(i // 12) if p != "crowd" else p, n, e) for i, p, n, e in rows]
    df = spark.createDataFrame(rows, "rid bigint, phone string, name string, extra string")
    kinds = {"phone": "text", "name": "text", "extra": "text"}
    run = plan.clean(df, [], "rid", ["phone", "name"], {**kinds, "phone": "email"})
    got = {r["rid"]: r["__outcome"] for r in run.classified.collect()}

    def canon(s):
        return re.sub(r"\s+", " ", s.strip().lower())

    def fuzzy(s):
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", s.lower())).strip()

    order = sorted(rows, key=lambda r: (-(sum(v is not None for v in r[1:]) + 2), r[0]))
    kept, seen = [], set()
    for r in order:
        if (r[1], canon(r[2])) not in seen:
            seen.add((r[1], canon(r[2])))
            kept.append(r)
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    for phone in {r[1] for r in kept}:
        block = [r for r in kept if r[1] == phone]
        if 1 < len(block) <= 20:
            gone |= {r[0] for r in block[1:] if difflib.SequenceMatcher(None, fuzzy(block[0][2]), fuzzy(r[2])).ratio() >= 0.92}
    assert {i for i, o in got.items() if o == "removed"} == gone


def test_fuzzy_message(spark):
    rows = spark.createDataFrame([(1, "5551234567", "customer number twelve smith"), (2, "5551234567", "customer number twelve smyth")], "rid bigint, phone string, name string")
    run = plan.clean(rows, [], "rid", ["phone", "name"], {"phone": "phone", "name": "text"})
    removed = run.removed.collect()
    ratio = round(difflib.SequenceMatcher(None, "customer number twelve smith", "customer number twelve smyth").ratio(), 3)
    assert [r["rid"] for r in removed] == [2]
    assert removed[0][plan.RULES_FAILED] == "Duplicate (Fuzzy Match)"
    assert removed[0][plan.FAILURE_REASON] == f"name matched with similarity {ratio}; Removed during deterministic deduplication"
    assert {r["rule"]: r["n"] for r in run.rule_counts.collect()} == {"fuzzy_duplicate": 1, "duplicate_removal": 1}


def test_no_rules_leave_everything(contacts):
    assert set(outcomes(plan.clean(contacts, [], "rid")).values()) == {"cleaned"}


def test_identifier_columns_are_no_dedup_keys(contacts):
    run = plan.clean(contacts.withColumn("paid", F.lit("x")), [], "rid", ["paid"])
    assert set(outcomes(run).values()) == {"cleaned"}


def test_discard_and_sheets(contacts):
    sheets = {"a": contacts, "b": contacts.filter("rid < 4")}
    mapping = {"email": "master:email_address", "amount": "__discard__"}
    runs = plan.clean_sheets(sheets, "rid", {"a": mapping, "b": mapping}, {"master:email_address": [("handle_missing", "drop")]}, TYPES)
    assert "amount" not in runs["a"].columns
    totals = {r["sheet"]: (r["total_rows"], r["duplicate_rows_removed"]) for r in plan.sheet_totals(runs).collect()}
    assert totals == {"a": (8, 1), "b": (3, 0), None: (11, 1)}


def test_canonical_key_of_dedup_column(spark):
    rows = spark.createDataFrame([(1, "a.b+z@gmail.com"), (2, "AB@gmail.com"), (3, None), (4, None)], "rid bigint, email string")
    run = plan.clean(rows, [], "rid", ["email"], {"email": "email"})
    assert outcomes(run) == {1: "cleaned", 2: "removed", 3: "cleaned", 4: "removed"}


def test_workbook_equals_its_sheets(spark):
    """Like sheets are one run: medians, repeated identifiers, exact and fuzzy duplicates stay within a sheet."""
    cells = []
    for i in range(60):
        name = "abc"[i % 3]
        amount = None if i % 7 == 0 else str(i * i) if name != "c" else "word"
        cells.append((i, name, f"Person Number {i // 12}" + "x" * (i % 2), f"p{i // 9}@x.com" if i % 10 else "bad", amount, str(i if i % 5 else i % 15)))
    rows = spark.createDataFrame(cells, "rid bigint, sheet string, who string, mail string, grade string, code string")
    mapping = {"who": "master:full_name", "mail": "master:email_address", "grade": "custom:1", "code": "custom:2"}
    other = {"who": "__discard__", "mail": "master:email_address", "grade": "custom:1"}
    saved = {"master:full_name": [("drop_duplicates",)], "master:email_address": [("validate_email",), ("drop_duplicates",)],
             "custom:1": [("handle_missing", "median")], "custom:2": [("duplicate_identifier",)]}
    types = {"who": "text", "mail": "email", "code": "identifier"}
    mappings = {"a": mapping, "b": mapping, "c": mapping, "d": other}
    runs = plan.clean_workbook(rows, "sheet", "rid", mappings, saved, types)
    # "c" holds words, so its grades are of another type; "d" has no rows
    assert [r.columns for r in runs] == [["sheet", "who", "mail", "grade", "code"]] * 2 + [["sheet", "mail", "grade"]]
    def seen(result):
        return {r["rid"]: (r["__outcome"], r["grade"], [tuple(e) for e in r["__errors"]]) for r in result.classified.collect()}
    together = {}
    for run in runs:
        together.update(seen(run))
    sheets = {n: rows.filter(F.col("sheet") == n).drop("sheet") for n in "abc"}
    alone = {}
    for run in plan.clean_sheets(sheets, "rid", mappings, saved, types).values():
        alone.update(seen(run))
    assert together == alone and len(alone) == 60
    assert {e[1] for _, _, errors in alone.values() for e in errors} >= {"validate_email", "duplicate_identifier", "duplicate_removal", "fuzzy_duplicate"}
    totals = {r["sheet"]: r["total_rows"] for r in plan.workbook_totals(runs, "sheet").collect()}
    assert totals == {"a": 20, "b": 20, "c": 20, None: 60}


def test_scans_do_not_grow_with_sheets_and_fuzzy_dedup_reads_twice(spark, tmp_path, contacts):
    path = str(tmp_path / "t")
    contacts.withColumn("sheet", F.concat(F.lit("s"), F.col("rid") % 4)).write.parquet(path)
    rows = spark.read.parquet(path)
    def scans(df):
        return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")
    mapping = {"email": "master:email_address", "phone": "custom:2"}
    saved = {"master:email_address": [("trim_whitespace",)], "custom:2": [("drop_duplicates",)]}
    counts = [
        scans(plan.workbook_totals(plan.clean_workbook(rows, "sheet", "rid", {f"s{i}": mapping for i in range(n)}, saved, TYPES), "sheet"))
        for n in (1, 4)]
    assert counts[0] == counts[1] <= 2
    assert scans(plan.clean(rows.drop("sheet"), [], "rid", ["email", "phone", "name"], TYPES).classified) == 2
