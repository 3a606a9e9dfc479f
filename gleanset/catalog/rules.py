"""Cleaning, validation, key and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.catalog.base import Tables, query
from gleanset.functions import cleaning, keys, scalars, validation
from gleanset.functions.text import number_text
from gleanset.operators.dedup import repeated
from gleanset.operators.medians import exact_medians
from gleanset.operators.rules import Rule
from gleanset.plans.cleaning import clean_values, default_rules, flag_missing, clean_batch, validate_rows

c = F.col


# ── Cleaning ────────────────────────────────────────────────────────────────
@query("c1_trim_whitespace", "SELECT record_id, trim(full_name) AS full_name, trim(email) AS email FROM contacts")
def _(t: Tables):
    return t.contacts.select(
        "record_id", cleaning.trim_whitespace(c("full_name")).alias("full_name"),
        cleaning.trim_whitespace(c("email")).alias("email"))


def _special(name: str, view: str, key: str, column: str, kind: str, pattern: str):
    sql = f"SELECT {key}, nullif(regexp_replace({column}, '{pattern}', '', 'g'), '') AS cleaned FROM {view}"

    @query(name, sql)
    def _(t: Tables):
        return getattr(t, view).select(key, cleaning.clean_special_chars(c(column), kind).alias("cleaned"))


_special("c2_special_chars_numeric", "contacts", "record_id", "revenue", "numeric", r"[^\d]")
_special("c3_special_chars_phone", "contacts", "record_id", "phone", "phone", r"[^\d+]")
_special("c4_special_chars_email", "contacts", "record_id", "email", "email", r"[^a-zA-Z0-9@._\-]")
_special("c5_special_chars_url", "pages", "page_id", "url", "url", r"[^a-zA-Z0-9:/._\-?=&]")
_special("c6_special_chars_text", "documents", "doc_id", "text", "text", r"[^a-zA-Z0-9\s\-''.&]")
_special("c7_special_chars_other", "contacts", "record_id", "website", "identifier", r"[^a-zA-Z0-9\s]")


@query("c7b_special_chars_date", "SELECT record_id, joined AS cleaned FROM contacts")
def _(t: Tables):
    return t.contacts.select("record_id", cleaning.clean_special_chars(c("joined"), "date").alias("cleaned"))


@query("c8_empty_to_null", """
SELECT count(*) AS total, count(*) FILTER (WHERE revenue IS NULL) AS null_before,
  count(*) FILTER (WHERE nullif(regexp_replace(revenue, '[^\\d]', '', 'g'), '') IS NULL) AS null_after FROM contacts""")
def _(t: Tables):
    after = cleaning.clean_special_chars(c("revenue"), "numeric")
    return t.contacts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c("revenue").isNull()).alias("null_before"),
        F.count_if(after.isNull()).alias("null_after"))


_AMOUNT_SQL = r"""
CASE WHEN regexp_matches(trim(revenue), '(?i)^[\d,]+\.?\d*\s*(lakhs?|lacs?|l)\s*$') THEN 1e5
     WHEN regexp_matches(trim(revenue), '(?i)^[\d,]+\.?\d*\s*(crores?|cr|c)\s*$') THEN 1e7
     WHEN regexp_matches(trim(revenue), '(?i)^[\d,]+\.?\d*\s*(billions?|b|bn)\s*$') THEN 1e9
     WHEN regexp_matches(trim(revenue), '(?i)^[\d,]+\.?\d*\s*(millions?|m|mn)\s*$') THEN 1e6
     WHEN regexp_matches(trim(revenue), '(?i)^[\d,]+\.?\d*\s*(thousands?|k)\s*$') THEN 1e3 ELSE 1 END
 * try_cast(replace(regexp_extract(trim(revenue), '^\$?([\d,]+\.?\d*|-?[\d,]+\.?\d*)', 1), ',', '') AS DOUBLE)"""


@query("c9_normalize_currency", f"""
SELECT record_id, round({_AMOUNT_SQL}, 6) AS amount, CASE WHEN revenue IS NULL THEN NULL WHEN ({_AMOUNT_SQL}) IS NULL THEN revenue ELSE 'number' END AS kept
FROM contacts""")
def _(t: Tables):
    cleaned = cleaning.normalize_currency(c("revenue"))
    number = cleaned.try_cast("double")
    return t.contacts.select(
        "record_id", F.round(number, 6).alias("amount"),
        F.when(number.isNotNull(), "number").otherwise(cleaned).alias("kept"))


def _missing(name: str, strategy: str, outcome: str, said: str):
    @query(name, f"""
SELECT record_id, CASE WHEN email IS NULL OR trim(email) = '' THEN '{outcome}' END AS outcome,
  CASE WHEN email IS NULL OR trim(email) = '' THEN '{said}: missing value in ''email''' END AS message FROM contacts""")
    def _(t: Tables):
        frame, flags = clean_values(
            t.contacts.select("record_id", "email"), [Rule("handle_missing", "email", strategy)], {"email": "email"})
        return flag_missing(frame, flags).select(
            "record_id", c("__outcome").alias("outcome"), F.try_element_at("__errors", F.lit(1))["message"].alias("message"))


_missing("c10_missing_flag", "flag", "invalid", "Invalid")
_missing("c11_missing_drop", "drop", "removed", "Dropped")

# The contacts' shorthand parses alike in both parsers; blanks do not occur.
_PARSED_SQL = f"SELECT record_id, revenue, {_AMOUNT_SQL} AS amount FROM contacts"


def _filled(name: str, strategy: str, aggregate: str):
    @query(name, f"""
SELECT p.record_id, p.revenue IS NULL AS was_missing, round(CASE WHEN p.revenue IS NULL THEN round(s.v, 2) ELSE try_cast(p.revenue AS DOUBLE) END, 4) AS value
FROM ({_PARSED_SQL}) p, (SELECT {aggregate}(amount) AS v FROM ({_PARSED_SQL}) q) s""")
    def _(t: Tables):
        raw = t.contacts.select("record_id", "revenue", c("revenue").isNull().alias("was_missing"))
        frame, _ = clean_values(raw, [Rule("handle_missing", "revenue", strategy)], {"revenue": "numeric"})
        return frame.select("record_id", "was_missing", F.round(c("revenue").try_cast("double"), 4).alias("value"))


_filled("c12_missing_median", "median", "median")
_filled("c13_missing_mean", "mean", "avg")


@query("c14_missing_placeholder", """
SELECT record_id, coalesce(nullif(trim(website), ''), 'Unknown') AS website, email FROM contacts""")
def _(t: Tables):
    rules = [Rule("handle_missing", "website", "placeholder"), Rule("handle_missing", "email", "placeholder")]
    frame, _ = clean_values(t.contacts.select("record_id", "website", "email"), rules, {"website": "url", "email": "email"})
    return frame


@query("c15_shorthand_number", f"SELECT record_id, round({_AMOUNT_SQL}, 6) AS amount FROM contacts")
def _(t: Tables):
    return t.contacts.select("record_id", F.round(cleaning.shorthand_number(c("revenue")), 6).alias("amount"))


@query("c15b_exact_medians", """
SELECT median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice, median(l_discount) AS l_discount FROM lineitem""")
def _(t: Tables):
    return exact_medians(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query("c16_lower_email", "SELECT record_id, lower(regexp_replace(email, '\\s+', '', 'g')) AS email FROM contacts")
def _(t: Tables):
    return t.contacts.select("record_id", cleaning.lower_email(c("email")).alias("email"))


# ── Validation ──────────────────────────────────────────────────────────────
def _check(name: str, rule: str, view: str, key: str, column: str, fails: str, message: str, **params):
    @query(name, f"""
SELECT {key}, coalesce({fails}, false) AS failed, CASE WHEN coalesce({fails}, false) THEN {message} END AS message FROM {view}""")
    def _(t: Tables):
        failed, said = getattr(validation, rule)(c(column), **params)
        flag = F.coalesce(failed, F.lit(False))
        return getattr(t, view).select(key, flag.alias("failed"), F.when(flag, said).alias("message"))


_check("v1_validate_email", "validate_email", "contacts", "record_id", "email",
       r"NOT regexp_matches(trim(email), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')",
       "concat('Invalid email format: ', trim(email))")
_check("v2_validate_email_domain", "validate_email_domain", "contacts", "record_id", "email",
       "contains(email, '@') AND NOT contains(string_split(trim(email), '@')[-1], '.')",
       "concat('Invalid domain: ', string_split(trim(email), '@')[-1])")
_check("v3_validate_phone", "validate_phone", "contacts", "record_id", "phone",
       r"NOT regexp_matches(CASE WHEN starts_with(trim(phone), '+') THEN regexp_replace(substr(trim(phone), 2), '[\s\-()]', '', 'g') ELSE regexp_replace(trim(phone), '[\s+\-()]', '', 'g') END, '^\d{7,15}$')",
       "concat('Invalid phone: ', phone)")
_check("v4_validate_url", "validate_url", "contacts", "record_id", "website",
       r"NOT regexp_matches(trim(website), '^(https?://)?(www\.)?[A-Za-z0-9\-]+\.[A-Za-z]{2,}(\S*)?$')",
       "concat('Invalid URL: ', website)")
_check("v4b_validate_page_url", "validate_url", "pages", "page_id", "url",
       r"NOT regexp_matches(trim(url), '^(https?://)?(www\.)?[A-Za-z0-9\-]+\.[A-Za-z]{2,}(\S*)?$')",
       "concat('Invalid URL: ', url)")
_check("v5_validate_numeric", "validate_numeric", "contacts", "record_id", "revenue",
       r"NOT regexp_matches(regexp_replace(revenue, '[₹$€£¥%,\s]', '', 'g'), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')",
       "concat('Not numeric: ', revenue)")
_check("v6_validate_numeric_range", "validate_numeric_range", "contacts", "record_id", "revenue",
       "try_cast(revenue AS DOUBLE) < 0 OR try_cast(revenue AS DOUBLE) > 5000",
       "concat('Out of range: ', revenue)", min_val=0, max_val=5000)
_check("v7_validate_date", "validate_date", "contacts", "record_id", "joined",
       "try_strptime(joined, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y']) IS NULL", "concat('Invalid date: ', joined)")
_check("v8_validate_not_empty", "validate_not_empty", "contacts", "record_id", "email",
       "email IS NULL OR trim(email) = ''", "'Empty value'")


@query("v9_duplicate_identifier", """
SELECT record_id, count(*) OVER (PARTITION BY phone) > 1 AS failed,
  CASE WHEN count(*) OVER (PARTITION BY phone) > 1 THEN 'Repeated identifier in column ''phone''' END AS message FROM contacts""")
def _(t: Tables):
    marked = repeated(t.contacts.select("record_id", "phone"), ["phone"], "record_id", "failed")
    return marked.select("record_id", "failed", F.when(c("failed"), "Repeated identifier in column 'phone'").alias("message"))


# ── Canonical and normalised keys ───────────────────────────────────────────
_DOMAIN = "substr(lower(trim(email)), instr(lower(trim(email)), '@') + 1)"
_LOCAL = "string_split(lower(trim(email)), '@')[1]"


@query("k1_canonical_email", f"""
SELECT record_id, CASE WHEN email IS NULL THEN NULL WHEN NOT contains(email, '@') THEN lower(trim(email))
  WHEN {_DOMAIN} IN ('gmail.com', 'googlemail.com', 'yahoo.com', 'hotmail.com')
  THEN concat(replace(string_split({_LOCAL}, '+')[1], '.', ''), '@', {_DOMAIN})
  ELSE concat({_LOCAL}, '@', {_DOMAIN}) END AS canonical FROM contacts""")
def _(t: Tables):
    return t.contacts.select("record_id", keys.canonical(c("email"), "email").alias("canonical"))


@query("k1b_canonical_phone", r"""
SELECT record_id, CASE WHEN starts_with(d, '91') AND length(d) > 10 THEN substr(d, 3) ELSE d END AS canonical
FROM (SELECT record_id, regexp_replace(phone, '[^\d]', '', 'g') AS d FROM contacts) x""")
def _(t: Tables):
    return t.contacts.select("record_id", keys.canonical(c("phone"), "phone").alias("canonical"))


@query("k1c_canonical_text", r"""
SELECT record_id, lower(regexp_replace(trim(full_name), '\s+', ' ', 'g')) AS name, lower(trim(website)) AS site, trim(joined) AS joined FROM contacts""")
def _(t: Tables):
    return t.contacts.select(
        "record_id", keys.canonical(c("full_name"), "text").alias("name"),
        F.when(c("website").isNotNull(), keys.canonical(c("website"), "url")).alias("site"),
        keys.canonical(c("joined"), "date").alias("joined"))


@query("n1_normalized_email", r"SELECT record_id, lower(regexp_replace(trim(email), '\s+', '', 'g')) AS normalized FROM contacts")
def _(t: Tables):
    return t.contacts.select("record_id", keys.normalized(c("email"), "email").alias("normalized"))


@query("n2_normalized_phone", r"SELECT record_id, ltrim(regexp_replace(phone, '\D', '', 'g'), '0') AS normalized FROM contacts")
def _(t: Tables):
    return t.contacts.select("record_id", keys.normalized(c("phone"), "phone").alias("normalized"))


@query("n3_normalized_url", r"""
SELECT page_id, concat(regexp_extract(u, '^(https?://[^/?#]*)', 1),
  regexp_replace(regexp_replace(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '')) AS normalized
FROM (SELECT page_id, CASE WHEN regexp_matches(lower(trim(url)), '^https?://') THEN lower(trim(url)) ELSE concat('https://', lower(trim(url))) END AS u FROM pages) x""")
def _(t: Tables):
    return t.pages.select("page_id", keys.normalized(c("url"), "url").alias("normalized"))


@query("n4_normalized_text", r"""
SELECT doc_id, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS normalized FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", keys.normalized(c("text"), "text").alias("normalized"))


@query("n5_normalized_numeric", r"""
SELECT record_id, round(CASE WHEN regexp_matches(v, '^\d+(\.\d+)?k') THEN CAST(regexp_extract(v, '^(\d+(\.\d+)?)k', 1) AS DOUBLE) * 1000
  WHEN contains(v, 'thousand') AND regexp_matches(v, '\d') THEN CAST(regexp_extract(v, '(\d+)', 1) AS DOUBLE) * 1000
  WHEN contains(v, 'hundred') AND regexp_matches(v, '\d') THEN CAST(regexp_extract(v, '(\d+)', 1) AS DOUBLE) * 100
  WHEN contains(v, 'million') AND regexp_matches(v, '\d') THEN CAST(regexp_extract(v, '(\d+)', 1) AS DOUBLE) * 1000000
  WHEN contains(v, 'lakh') AND regexp_matches(v, '\d') THEN CAST(regexp_extract(v, '(\d+)', 1) AS DOUBLE) * 100000
  ELSE try_cast(v AS DOUBLE) END, 6) AS number, CASE WHEN v IN ('5 cr', '3m', 'n/a') THEN v END AS unchanged
FROM (SELECT record_id, regexp_replace(lower(trim(revenue)), '[₹$,]', '', 'g') AS v FROM contacts) x""")
def _(t: Tables):
    value = keys.normalized(c("revenue"), "numeric")
    number = value.try_cast("double")
    return t.contacts.select(
        "record_id", F.round(number, 6).alias("number"), F.when(number.isNull(), value).alias("unchanged"))


@query("x1_fuzzy_text", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS fuzzy FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", keys.fuzzy_text(c("text")).alias("fuzzy"))


@query("x2_similarity_null_guard", """
SELECT record_id, CASE WHEN full_name IS NULL THEN 0.0 ELSE 1.0 END AS score FROM contacts""")
def _(t: Tables):
    return t.contacts.select("record_id", keys.similarity(c("full_name"), c("full_name")).alias("score"))


@query("x3_similarity")
def _(t: Tables):
    """How much of a contact's name its e-mail address repeats."""
    pairs = t.contacts.select("record_id", keys.fuzzy_text(c("full_name")).alias("name"), keys.fuzzy_text(c("email")).alias("mail"))
    return pairs.select("record_id", F.round(keys.similarity(c("name"), c("mail")), 6).alias("score"))


# ── Other scalars ───────────────────────────────────────────────────────────
@query("x4_revenue_text", """
SELECT id, CASE WHEN revenue >= 1e9 THEN concat('$', CAST(CAST(round(revenue / 1e9, 1) AS DECIMAL(18,1)) AS VARCHAR), 'B')
  WHEN revenue >= 1e6 THEN concat('$', CAST(CAST(round(revenue / 1e6, 1) AS DECIMAL(18,1)) AS VARCHAR), 'M')
  ELSE concat('$', format('{:,}', revenue)) END AS shown
FROM (SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN CAST(abs(round(c_acctbal)) AS BIGINT) * 250000 + c_custkey ELSE CAST(abs(round(c_acctbal)) AS BIGINT) * 31 END AS revenue FROM customer) x""")
def _(t: Tables):
    balance = F.abs(F.round("c_acctbal")).cast("bigint")
    revenue = F.when(c("c_nationkey") % 2 == 0, balance * 250000 + c("c_custkey")).otherwise(balance * 31)
    return t.customer.select(c("c_custkey").alias("id"), scalars.revenue_text(revenue).alias("shown"))


@query("x5_best_phone", """
SELECT email, coalesce(nullif(raw_phone, ''), nullif(clean_phone, ''), 'none') AS phone FROM people""")
def _(t: Tables):
    numbers = F.array(F.struct(c("raw_phone").alias("raw_number"), c("clean_phone").alias("sanitized_number")))
    return t.people.select("email", scalars.best_phone(numbers, F.lit("none")).alias("phone"))


@query("x6_website", """
SELECT email, coalesce(nullif(website_url, ''), concat_null, '') AS website
FROM (SELECT *, CASE WHEN primary_domain IS NULL THEN NULL ELSE concat('https://', primary_domain) END AS concat_null FROM people) x""")
def _(t: Tables):
    return t.people.select("email", scalars.website(c("website_url"), c("primary_domain")).alias("website"))


@query("x8_days_since", """
SELECT id, greatest(0, CAST(floor((epoch_us(date_trunc('second', TIMESTAMP '2024-01-20 12:00:00')) - epoch_us(date_trunc('second', created_at))) / 86400000000.0) AS BIGINT)) AS days
FROM logs WHERE created_at <= TIMESTAMP '2024-01-20 12:00:00'
UNION ALL SELECT id, 0 FROM logs WHERE created_at > TIMESTAMP '2024-01-20 12:00:00'""")
def _(t: Tables):
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return t.logs.select("id", scalars.days_since(c("created_at"), as_of).alias("days"))


@query("x9_notice_kind", """
SELECT id, CASE WHEN contains(lower(action), 'export') THEN 'export' WHEN contains(lower(action), 'upload') OR contains(lower(action), 'ingest') THEN 'import'
  WHEN contains(lower(action), 'cleaned file') THEN 'clean' END AS kind FROM logs""")
def _(t: Tables):
    return t.logs.select("id", scalars.notice_kind(c("action")).alias("kind"))


@query("x10_json_map", """
SELECT id, CAST(coalesce(len(json_keys(custom_fields)), 0) AS INT) AS n, json_extract_string(custom_fields, '$."1"') AS first_value FROM records""")
def _(t: Tables):
    fields = scalars.json_map(c("custom_fields"))
    return t.records.select("id", F.size(fields).alias("n"), F.try_element_at(fields, F.lit("1")).alias("first_value"))


@query("x11_timestamp_text", """
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS shown, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM logs""")
def _(t: Tables):
    return t.logs.select("id", scalars.minute_text(c("created_at")).alias("shown"), scalars.iso_text(c("created_at")).alias("iso"))


@query("x12_percent", """
SELECT id, CASE WHEN total_rows > 0 THEN round(valid_rows / total_rows * 100, 1) ELSE 0.0 END AS score, CAST(ceil(total_rows / 20.0) AS BIGINT) AS pages FROM runs""")
def _(t: Tables):
    return t.runs.select(
        "id", scalars.percent(c("valid_rows"), c("total_rows")).alias("score"), scalars.page_count(c("total_rows"), 20).alias("pages"))
