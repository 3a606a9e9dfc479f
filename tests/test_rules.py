import difflib

import pytest
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions import cleaning, keys, scalars, text, validation
from gleanset.operators import rules as rule_ops


def test_canonical_values(column):
    assert column(["  John.Doe+test@gmail.com  ", None, "a.b+c@corp.com", "plain"], lambda c: keys.canonical(c, "email")) == [
        "johndoe@gmail.com", None, "a.b+c@corp.com", "plain"]
    assert column(["+91 98765-43210", "9112345", "910000000000"], lambda c: keys.canonical(c, "phone")) == [
        "9876543210", "9112345", "0000000000"]
    assert column(["  HELLO   WORLD  "], lambda c: keys.canonical(c, "text")) == ["hello world"]
    assert column([" x  y "], lambda c: keys.canonical(c, "date")) == ["x  y"]


def test_canonical_email_uses_the_first_at_sign(column):
    assert column(["A.b+x@y@gmail.com"], lambda c: keys.canonical(c, "email")) == ["a.b+x@y@gmail.com"]


def test_trim_keeps_null_and_strips_unicode(column):
    assert column([" a ", None, "\t　b c\n"], cleaning.trim_whitespace) == ["a", None, "b c"]


@pytest.mark.parametrize("kind, value, wanted", [
    ("text", "hello@world!", "helloworld"), ("text", "O'Neil & Co. - x", "O'Neil & Co. - x"), ("text", "é", None),
    ("numeric", "$1,250.50", "125050"), ("phone", "+1 (555) 0-1", "+155501"), ("email", "a b+c@x.y", "abc@x.y"),
    ("url", "http://a.b/c?d=e#f", "http://a.b/c?d=ef"), ("date", "1/2/2024!", "1/2/2024!"), ("identifier", "a-b c", "ab c"),
])
def test_special_chars(column, kind, value, wanted):
    assert column([value], lambda c: cleaning.clean_special_chars(c, kind)) == [wanted]


def test_currency(column):
    values = ["$1,250.50", "₹500", "5C", "2.5 lakhs", "Rs. 3 Cr", "USD 12bn", "-5K", "1.5 million", "65k", ",", "n/a", None, " 7 "]
    assert column(values, cleaning.normalize_currency) == [
        "1250.5", "500.0", "50000000.0", "250000.0", "30000000.0", "12000000000.0", "-5K", "1500000.0", "65000.0", ",", "n/a", None, "7.0"]


def test_shorthand_parser_knows_fewer_units(column):
    values = ["5 lakh", "2Cr", "3M", "4mn", "12bn", "USD 5", "1 thousand", "$1,000"]
    assert column(values, cleaning.shorthand_number) == [500000.0, 2e7, 3e6, 4e6, None, None, None, 1000.0]


def test_placeholder(column):
    assert column(["A", None, " "], lambda c: cleaning.fill_placeholder(c, "text")) == ["A", "Unknown", "Unknown"]
    assert column([None], lambda c: cleaning.fill_placeholder(c, "email")) == [None]


def test_title_case_like_title(column):
    values = ["o'neil-smith JOHN", "a1b two", "ÉCOLE", " ", None]
    assert column(values, cleaning.title_name) == ["O'Neil-Smith John", "A1B Two", "École", " ", None]


@pytest.mark.parametrize("rule, value, fails", [
    ("validate_email", "a@b.co", False), ("validate_email", " a@b.co ", False), ("validate_email", "a@b", True),
    ("validate_email_domain", "a@b", True), ("validate_email_domain", "a@b@c.d", False), ("validate_email_domain", "none", False),
    ("validate_phone", "+1 (555) 123-4567", False), ("validate_phone", "1+5551234567", False), ("validate_phone", "+1+5551234567", True),
    ("validate_phone", "12345", True), ("validate_url", "example.org/x y", True), ("validate_url", "https://www.a-b.com/x", False),
    ("validate_numeric", "₹ 1,000%", False), ("validate_numeric", "1d", True), ("validate_numeric", "nan", True), ("validate_numeric", "1e5", False),
    ("validate_date", "31/01/2024", False), ("validate_date", "01/31/2024", False), ("validate_date", "2024-02-30", True),
    ("validate_date", "5 Jan 2024", False), ("validate_date", "Jan 5, 2024", False), ("validate_date", "2024-01-05T10:00:00", False),
    ("validate_not_empty", " ", True),
])
def test_validation(column, rule, value, fails):
    check = getattr(validation, rule)
    assert column([value], lambda c: check(c)[0]) == [fails]
    if rule != "validate_not_empty":
        assert column([None], lambda c: check(c)[0]) == [False]


def test_range_needs_bounds(column):
    values = ["5", " 15 ", "x"]
    assert column(values, lambda c: validation.validate_numeric_range(c)[0]) == [False] * 3
    assert column(values, lambda c: validation.validate_numeric_range(c, 0, 10)[0]) == [False, True, False]


def test_messages(column):
    assert column([" bad "], lambda c: validation.validate_email(c)[1]) == ["Invalid email format: bad"]
    assert column([" 12 "], lambda c: validation.validate_phone(c)[1]) == ["Invalid phone:  12 "]


def test_normalized_keys(column):
    assert column(["001-23"], lambda c: keys.normalized(c, "phone")) == ["123"]
    assert column(["Example.org/A/?q=1", "http://x.y/p;v=1#f"], lambda c: keys.normalized(c, "url")) == ["https://example.org/a", "http://x.y/p"]
    assert column(["65k", "1.5 million", "2 hundred", "$1,0", "abc"], lambda c: keys.normalized(c, "numeric")) == [
        "65000.0", "1000000.0", "200.0", "10.0", "abc"]


def test_similarity_is_ratcliff_obershelp(spark):
    pairs = [("john smith", "john smyth"), ("", ""), ("abc", "xyz"), ("a" * 300, "a" * 299 + "b")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(9, None, "x")], "i int, a string, b string")
    found = {r["i"]: r for r in rows.select("i", keys.similarity(F.col("a"), F.col("b")).alias("s"),
                                            keys.similarity_bound(F.col("a"), F.col("b")).alias("u")).collect()}
    for i, (a, b) in enumerate(pairs):
        exact = difflib.SequenceMatcher(None, a, b).ratio()
        assert found[i]["s"] == pytest.approx(exact)
        assert found[i]["u"] >= exact - 1e-12
    assert found[9]["s"] == 0.0


def test_fuzzy_text(column):
    assert column(["  O'Neil,  JOHN ", None], keys.fuzzy_text) == ["o neil john", ""]


def test_registry_entries_are_complete():
    assert len(rule_ops.REGISTRY) == 14
    for rule in rule_ops.REGISTRY.values():
        assert rule.label and rule.allowed_types and rule.kind in ("cleaning", "validation", "dedupe")


def test_unknown_rule_kind_is_refused():
    with pytest.raises(ValueError):
        rule_ops.register_rule("x", None, "other", ("text",))


def test_request_entries_split():
    rules, dedupe = rule_ops.from_request([("drop_duplicates", "email"), ("handle_missing", "age", "median"), ("validate_email", "email")])
    assert dedupe == ["email"]
    assert [(r.name, r.column, r.strategy) for r in rules] == [("handle_missing", "age", "median"), ("validate_email", "email", "flag")]


def test_names_and_headers(column):
    assert column(["  Ann  Lee Fox ", "Cher", " "], scalars.first_name) == ["Ann", "Cher", None]
    assert column(["  Ann  Lee Fox ", "Cher", " "], scalars.last_name) == ["Lee Fox", None, None]
    values = [" State / Province ", "E-mail", "__x__"]
    assert column(values, scalars.normal_header) == [scalars.header_name(v) for v in values] == ["state_province", "e_mail", "x"]
    assert scalars.column_label("company_name") == "Company Name" and scalars.column_label("odd_one") == "Odd One"


def test_revenue_text(spark):
    rows = spark.createDataFrame([(1_234,), (2_500_000,), (7_100_000_000,)], "n bigint")
    assert [r[0] for r in rows.select(scalars.revenue_text(F.col("n"))).collect()] == ["$1,234", "$2.5M", "$7.1B"]


def test_number_text(spark):
    rows = spark.createDataFrame([(1250.5,), (5e7,), (0.25,), (-3.0,)], "n double")
    assert [r[0] for r in rows.select(text.number_text(F.col("n"))).collect()] == ["1250.5", "50000000.0", "0.25", "-3.0"]


def test_whitespace_set_matches_strip():
    assert all(ch.isspace() for ch in fixed.WHITESPACE)
    assert {chr(i) for i in range(0x3001) if chr(i).isspace()} == set(fixed.WHITESPACE)
