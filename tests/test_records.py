from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gleanset.functions.scalars import json_map, map_json
from gleanset.operators import access, completeness, enrich, filters, mapping
from gleanset.plans import ingest, paging, records as plan
from gleanset.plans.records import RecordQuery


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark):
    return spark.createDataFrame([
        (1, "Ann", None, "ann@x.com", "100%", '{"1":"gold","9":"z"}'), (2, "bob", "Ray", None, "a_b", None),
        (3, "", "", "cy@y.org", "ab", "broken"), (4, None, "Fox", "--", "", '{"1":""}')],
        "id bigint, first_name string, last_name string, email_address string, company_name string, custom_fields string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_wildcards_and_literals(table):
    assert ids(RecordQuery(fields={"company": "a_"}).matching(table)) == [2, 3]
    assert ids(table.filter(filters.contains(F.col("company_name"), "a_", literal=True))) == [2]
    assert ids(table.filter(filters.contains(F.col("company_name"), "%", literal=True))) == [1]


def test_case_modes_and_exact(table):
    assert ids(RecordQuery(fields={"first_name": "ANN"}).matching(table)) == [1]
    assert ids(RecordQuery(fields={"first_name": "ANN"}, ignore_case=False).matching(table)) == []
    assert ids(RecordQuery(fields={"first_name": "BOB"}, exact=True).matching(table)) == [2]
    assert ids(RecordQuery(name="o").matching(table)) == [2, 4]


def test_bad_integer_is_an_error(table):
    with pytest.raises(ValueError, match="Invalid integer"):
        RecordQuery(file_id="x").predicate(table)


def test_missing_modes(table):
    assert ids(RecordQuery(missing_field="email_address").matching(table)) == [2]
    assert ids(RecordQuery(missing_field="email_address", missing_dashes=True).matching(table)) == [2, 4]


def test_delete_keeps_rows_with_null_conditions(table):
    kept, count = plan.delete_matching(table, RecordQuery(fields={"email": "x.com"}))
    assert ids(kept) == [2, 3, 4] and count.collect()[0]["deleted"] == 1


def test_paging(spark):
    rows = spark.range(45).withColumnRenamed("id", "id")
    assert [r["id"] for r in RecordQuery(page=3, per_page=20).rows(rows).collect()] == [4, 3, 2, 1, 0]
    assert tuple(RecordQuery(page=9, per_page=20).info(rows).collect()[0]) == (45, 3, 3, 41, 45)
    assert tuple(RecordQuery().info(rows.filter("id < 0")).collect()[0]) == (0, 0, 1, 0, 0)
    assert RecordQuery(per_page=5000).rows(spark.range(300)).count() == 300
    assert RecordQuery().export(spark.range(60_000)).count() == 60_000


def test_unknown_sort_column_falls_back_to_id(table):
    assert [r["id"] for r in RecordQuery(sort_by="password").rows(table).collect()] == [4, 3, 2, 1]


def test_export_within_quota_books_what_it_takes(spark, table):
    limits = spark.createDataFrame([(7, "user", 3), (8, "user", 100)], "id int, role string, active_limit bigint")
    usage = spark.createDataFrame([(7, "2024-01-10", 1), (7, "2024-01-09", 99)], "user_id int, export_date string, rows_count bigint").withColumn(
        "export_date", F.col("export_date").cast("date"))
    def ask(user):
        return plan.export_within_quota(table, RecordQuery(), ["master:first_name"], {}, user, limits, usage, "2024-01-10")
    rows, booked = ask(8)
    assert rows.count() == 4 and [(r["user_id"], r["rows_count"]) for r in booked.collect()] == [(8, 4)]
    for user in (7, 9):
        rows, booked = ask(user)
        assert rows.count() == 0 and booked.count() == 0


def test_clients_search_seven_columns(table):
    assert ids(plan.client_export(table, RecordQuery(), RecordQuery(search="nobody"), 10)) == []


def test_client_cannot_widen_approved_filters(table):
    approved = RecordQuery(fields={"email": "x.com"})
    assert ids(plan.client_export(table, approved, RecordQuery(fields={"email": "y.org"}), 10)) == []
    assert ids(plan.client_export(table, approved, RecordQuery(), 10)) == [1]


def test_filters_reach_the_scan(spark, tmp_path, table):
    path = str(tmp_path / "t")
    table.withColumn("created_at", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).write.parquet(path)
    found = RecordQuery(created=("2024-01-01 00:00:00", "2024-02-01 00:00:00")).matching(spark.read.parquet(path)).select("id")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in text
    assert "ReadSchema: struct<id:bigint,created_at:timestamp_ntz>" in text


def test_json_is_tolerant(table):
    got = {r["id"]: r["m"] for r in table.select("id", json_map(F.col("custom_fields")).alias("m")).collect()}
    assert got == {1: {"1": "gold", "9": "z"}, 2: {}, 3: {}, 4: {"1": ""}}
    texts = {r["id"]: r["t"] for r in table.select("id", map_json(json_map(F.col("custom_fields"))).alias("t")).collect()}
    assert texts == {1: '{"1":"gold","9":"z"}', 2: None, 3: None, 4: '{"1":""}'}


def test_promote_then_demote_is_the_identity(table):
    rows = ingest.from_stored(table)
    there = mapping.promote(rows, "1", "tier")
    assert {r["id"]: (r["tier"], r["custom_fields"]) for r in there.collect()} == {
        1: ("gold", {"9": "z"}), 2: (None, None), 3: (None, None), 4: ("", None)}
    back = mapping.demote(there, "tier", "1")
    assert {r["id"]: r["custom_fields"] for r in back.collect()} == {1: {"9": "z", "1": "gold"}, 2: None, 3: None, 4: None}
    with pytest.raises(ValueError):
        mapping.demote(rows, "id", "5")


def test_schema_guards(table):
    with pytest.raises(ValueError):
        mapping.add_column(table, "First Name")
    with pytest.raises(ValueError):
        mapping.drop_column(table, "custom_fields")
    with pytest.raises(ValueError):
        mapping.rename_column(table, "company_name", "last name")
    assert "middle_name!" in mapping.add_column(table, "Middle Name!").columns


def test_aliases_follow_a_promoted_field(spark):
    aliases = spark.createDataFrame([(1, "T", "custom", "1"), (2, "U", "custom", "2")], "id int, alias string, target_type string, target_identifier string")
    got = mapping.repoint_aliases(aliases, ("custom", "1"), ("master", "tier"))
    assert rows_of(got) == [(1, "T", "master", "tier"), (2, "U", "custom", "2")]
    fields = spark.createDataFrame([(1, 1), (2, 1)], "id int, is_active int")
    assert rows_of(mapping.set_active(fields, 2, False)) == [(1, 1), (2, 0)]


def test_map_rows(spark):
    df = spark.createDataFrame([(1, " Ann  Lee ", "nan", " g "), (2, None, " NULL ", None), (3, "x", "a@b", "")], "rid bigint, who string, mail string, tier string")
    got = mapping.map_rows(df, {"who": "master:full_name", "mail": "master:email", "tier": "custom:1"}, ["first_name", "last_name", "email"], ["rid"])
    assert {r["rid"]: (r["first_name"], r["last_name"], r["email"], r["custom_fields"]) for r in got.collect()} == {
        1: ("Ann", "Lee", None, {"1": "g"}), 3: ("x", None, "a@b", {"1": ""})}


def test_new_headers_get_dense_ids(spark):
    headers = spark.createDataFrame([(i, h) for i, h in enumerate(["First Name", "Blood Type", "blood-type", "Shoe", "E-mail", "Fax", "###"])], "file_id bigint, header string")
    aliases = spark.createDataFrame([(1, "E-mail", "custom", "3")], "id int, alias string, target_type string, target_identifier string")
    registry = spark.createDataFrame([(3, "E-mail In", "e_mail_in", 1), (4, "Fax", "fax", 0)], "id int, field_name string, normalized_name string, is_active int")
    resolved, grown = mapping.resolve_headers(headers, aliases, registry)
    got = {r["header"]: (r["target"], r["is_new"]) for r in resolved.collect()}
    assert got["First Name"] == ("master:first_name", False) and got["E-mail"] == ("custom:3", False) and got["Fax"] == ("custom:4", False)
    assert got["Blood Type"] == got["blood-type"] and {got["Shoe"][0], got["Blood Type"][0]} == {"custom:5", "custom:6"} and "###" not in got
    assert sorted((r["id"], r["uses"]) for r in grown.collect()) == [(3, 1), (4, 1), (5, 1), (6, 1)]
    suggested = {r["header"]: r["target"] for r in mapping.suggest_mapping(headers, aliases, registry).collect()}
    assert suggested["Fax"] == "create_new" and suggested["E-mail"] == "custom:3"


def test_ingest_refuses_repeats_and_stored_rows(spark):
    df = spark.createDataFrame([(1, 1, "Ann", "a@x"), (2, 1, "ann ", "A@X"), (3, 2, "Bob", "b@x"), (4, 2, None, None), (5, 2, "Cy", None)],
                               "rid bigint, file_id bigint, first string, mail string")
    target = {"first": "master:first_name", "mail": "custom:2"}
    stored = spark.createDataFrame([("BOB", {"2": " b@x "}), ("cy", {"2": "other"}), ("Dee", None)], "first_name string, custom_fields map<string,string>")
    done = ingest.ingest(df, target, stored, ["first_name"], "rid")
    assert [r["rid"] for r in done.accepted.orderBy("rid").collect()] == [1, 5]
    wide = ingest.read_rejects(done.rejected, ["first_name"])
    assert rows_of(wide.select("file_id", "first_name", mapping.custom_value("2"))) == [(1, "ann", "A@X"), (2, "Bob", "b@x")]
    assert {r["file_id"]: (r["total_rows"], r["rows_imported"], r["rows_rejected"]) for r in done.ledger.collect()} == {1: (2, 1, 1), 2: (3, 1, 1)}
    assert ingest.ingest(df, target, stored, ["first_name"], "rid", dedupe=False).accepted.count() == 4


def test_ingestion_makes_fields_and_counts_uses(spark):
    registry = spark.createDataFrame([(3, "Tier", "tier", 1), (8, "Fax", "fax", 0)], "id int, field_name string, normalized_name string, is_active int")
    df = spark.createDataFrame([(1, 1, "Ann", "gold", "x", "y"), (2, 1, None, None, None, None), (3, 1, "ann", "GOLD", "X", "Y")],
                               "rid bigint, file_id bigint, name string, Tier string, `New one` string, `new-one` string")
    stored = spark.createDataFrame([], "first_name string, custom_fields map<string,string>")
    target = {"name": "master:first_name", "Tier": "create_new", "New one": "create_new", "new-one": "create_new", "gone": "ignore"}
    done = ingest.ingest_mapped(df, target, registry, stored, ["first_name"], "rid")
    # Both headers of one name are one field; the later one's value counts.
    assert [(r["rid"], r["custom_fields"]) for r in done.accepted.collect()] == [(1, {"3": "gold", "9": "y"})]
    fields = {r["id"]: (r["field_name"], r["uses"]) for r in done.registry.collect()}
    assert fields == {3: ("Tier", 1), 8: ("Fax", 0), 9: ("New one", 3)}
    assert [tuple(r)[1:4] for r in done.ledger.collect()] == [(3, 1, 1)]
    # Nothing is imported: new fields exist, no use is counted for them but their own.
    none = ingest.ingest_mapped(df.filter("rid = 2"), target, registry, stored, ["first_name"], "rid")
    assert {r["id"]: r["uses"] for r in none.registry.collect()} == {3: 0, 8: 0, 9: 1}
    assert [tuple(r)[1:4] for r in none.ledger.collect()] == [(1, 0, 0)]


def test_unmapped_ingestion_resolves_headers(spark):
    registry = spark.createDataFrame([(3, "Tier", "tier", 1)], "id int, field_name string, normalized_name string, is_active int")
    aliases = spark.createDataFrame([(1, "Mail", "master", "email_address"), (2, "Level", "custom", "3")], "id int, alias string, target_type string, target_identifier string")
    df = spark.createDataFrame([(1, 1, "Ann", "a@x", "gold", "n"), (2, 1, "Ann", "a@x", "gold", "n"), (3, 1, None, None, None, None)],
                               "rid bigint, file_id bigint, `First Name` string, mail string, level string, Extra string")
    done = ingest.ingest_unmapped(df, aliases, registry, ["first_name", "email_address"], "rid")
    assert [(r["rid"], r["first_name"], r["email_address"], r["custom_fields"]) for r in done.accepted.orderBy("rid").collect()] == [
        (i, "Ann", "a@x", {"3": "gold", "4": "n"}) for i in (1, 2)]
    assert {r["id"]: (r["field_name"], r["uses"]) for r in done.registry.collect()} == {3: ("Tier", 1), 4: ("Extra", 1)}
    assert [tuple(r)[1:4] for r in done.ledger.collect()] == [(3, 2, 0)]


def test_final_mapping():
    assert ingest.final_mapping({"a": "create_new", "b": "ignore", "c": "master:x", "d": "__discard__", "e": ""}, {"a": 9}) == {"a": "custom:9", "c": "master:x"}


def test_completeness_of_an_empty_table(table):
    got = completeness.missing_stats(table.filter("id < 0"), ["first_name"]).collect()[0]
    assert (got["missing"], got["total"], got["percentage"]) == (0, 0, 0.0)


def test_quota_chain(spark):
    users = spark.createDataFrame([(1, "admin", None), (2, "manager", None), (3, "user", 7), (4, "user", None), (5, "client", None)], "id bigint, role string, export_limit bigint")
    roles = spark.createDataFrame([("user", 40)], "role_name string, default_limit bigint")
    assert {r["id"]: r["active_limit"] for r in plan.export_limits(users, roles).collect()} == {1: 1_000_000, 2: 100_000, 3: 7, 4: 40, 5: 50_000}


def test_enrich_fills_only_blank_fields(spark):
    people = spark.createDataFrame([("P@x.com", "Pat", "Poe", "", None, "Boss", "Rome", "", "site.org", 2_000_000.0)],
                                   "email string, first_name string, last_name string, raw_phone string, clean_phone string, job_title string, city string, website_url string, primary_domain string, annual_revenue double")
    records = spark.createDataFrame([
        (1, "p@X.com", "--", "", None, "Old", "old", "old"), (2, None, "Pat", "Poe", "Chef", "Oslo", "old", "old"), (3, "no@x.com", "Pat", "Poe", None, None, None, None),
        (4, "p@x.com", "A", "B", "C", "D", "old", "old")],
        "id bigint, email_address string, first_name string, last_name string, job_title string, city string, lead_source string, record_status string")
    got = {r["id"]: r for r in enrich.enrich(records, people).collect()}
    assert [got[i]["enrich_status"] for i in (1, 2, 3, 4)] == ["enriched", "enriched", "no_match", "skipped"]
    assert (got[1]["first_name"], got[1]["city"], got[1]["record_status"]) == ("Pat", "Old", "Enriched")
    assert got[2]["email_address"] == "P@x.com" and got[2]["enriched_fields"] == ["email_address"]
    assert got[3]["lead_source"] is None and got[4]["lead_source"] == "old"


@pytest.mark.parametrize("column,ascending", [("country", True), ("country", False), ("id", False), ("id", True)])
def test_pages_by_key_equal_pages_by_offset(spark, column, ascending):
    """A value of half the rows, NULL values, ids in no order, ranges cut more than once."""
    n = 300
    cells = [(i * 37 % n, None if i % 11 == 0 else "hot" if i % 2 else f"c{i % 7}", "a" if i % 3 else "b") for i in range(n)]
    rows = spark.createDataFrame(cells, "id bigint, country string, city string").repartition(5)
    asked = RecordQuery(fields={"city": "a"}, sort_by=column, ascending=ascending, per_page=40)
    index = paging.page_index(rows, asked, ranges=4)
    whole = [tuple(r) for r in asked.matching(rows).orderBy(*asked.order(rows)).collect()]
    pages = -(-len(whole) // asked.per_page)
    for page in (1, 3, pages, pages + 50):
        got = paging.page_at(rows, replace(asked, page=page), index, ranges=4, small=8)
        assert [tuple(r) for r in got.collect()] == whole[(page - 1) * asked.per_page:page * asked.per_page]
    seen, cursor = [], None
    for _ in range(pages):
        page = paging.page_after(rows, asked, cursor).collect()
        seen += [tuple(r) for r in page]
        cursor = paging.cursor_of(asked, rows, page[-1])
    assert seen == whole


def test_paging_without_rows_and_without_offset(spark, table):
    none = table.filter("id < 0")
    asked = RecordQuery(sort_by="company_name")
    index = paging.page_index(none, asked)
    assert paging.page_at(none, replace(asked, page=9), index).count() == 0
    plan_text = paging.page_after(table, asked, paging.Cursor("x", 3))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan_text and "offset" not in plan_text.lower()


def test_viewer_sees_self_direct_and_next_level(spark):
    users = spark.createDataFrame(
        [(1, "admin", None), (2, "manager", 1), (3, "team_lead", 2), (4, "user", 3), (5, "user", 2), (6, "manager", 2), (7, "user", 6), (8, "team_lead", 3), (9, "user", 8), (10, "team_lead", 10)],
        "id bigint, role string, manager_id bigint")
    pairs = {}
    for r in access.visible_users(users).collect():
        pairs.setdefault(r["viewer"], set()).add(r["visible"])
    for viewer in range(1, 11):
        got = [r["id"] for r in access.seen_by(users, viewer).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs[viewer]
    assert pairs[2] == {2, 3, 4}
