"""Typing, rule catalogue, dedup, golden records and cleaning runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanset.catalog.base import Tables, query
from gleanset.catalog.rules import _AMOUNT_SQL
from gleanset.functions import scalars
from gleanset.functions.keys import canonical
from gleanset.operators import dedup, rules as rule_ops, typing
from gleanset.operators.mapping import resolve_headers, suggest_mapping
from gleanset.operators.rules import Rule
from gleanset.plans import cleaning as plan

c = F.col

CONTACT_TYPES = {"full_name": "text", "revenue": "numeric", "joined": "date", "segment": "text"}
CONTACT_RULES = [
    Rule("trim_whitespace", "full_name"),
    Rule("trim_whitespace", "email"),
    Rule("clean_special_chars", "email"),
    Rule("handle_missing", "email", "flag"),
    Rule("handle_missing", "full_name", "drop"),
    Rule("handle_missing", "revenue", "median"),
    Rule("normalize_currency", "revenue"),
    Rule("validate_email", "email"),
    Rule("validate_phone", "phone"),
    Rule("validate_numeric", "revenue"),
]


def contact_run(t: Tables, dedupe=("email", "phone")):
    return plan.clean(t.contacts, CONTACT_RULES, "record_id", list(dedupe), CONTACT_TYPES)


# The same run in SQL: cleaned cells, then the outcome of each stage.
_RUN_SQL = rf"""
WITH parsed AS (SELECT *, {_AMOUNT_SQL} AS amount FROM contacts),
cleaned AS (
  SELECT record_id, trim(full_name) AS full_name, nullif(regexp_replace(trim(email), '[^a-zA-Z0-9@._\-]', '', 'g'), '') AS email, phone, website,
    joined, segment, CASE WHEN revenue IS NULL THEN (SELECT round(median(amount), 2) FROM parsed) ELSE amount END AS revenue, revenue AS raw_revenue
  FROM parsed),
missing AS (SELECT *, email IS NULL AS no_email, full_name IS NULL OR full_name = '' AS no_name FROM cleaned),
checked AS (SELECT *, NOT no_email AND NOT no_name AS alive,
    NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}$') AS bad_email,
    coalesce(NOT regexp_matches(regexp_replace(phone, '[\s+\-()]', '', 'g'), '^\d{{7,15}}$'), false) AS bad_phone, revenue IS NULL AS bad_revenue FROM missing),
keyed AS (SELECT *, alive AND NOT bad_email AND NOT bad_phone AND NOT bad_revenue AS valid,
    CASE WHEN split_part(lower(email), '@', 2) IN ('gmail.com', 'googlemail.com', 'yahoo.com', 'hotmail.com')
      THEN concat(replace(split_part(split_part(lower(email), '@', 1), '+', 1), '.', ''), '@', split_part(lower(email), '@', 2)) ELSE lower(email) END AS k_email,
    CASE WHEN starts_with(regexp_replace(phone, '\D', '', 'g'), '91') AND length(regexp_replace(phone, '\D', '', 'g')) > 10
      THEN substr(regexp_replace(phone, '\D', '', 'g'), 3) ELSE regexp_replace(phone, '\D', '', 'g') END AS k_phone FROM checked),
ranked AS (SELECT *, CASE WHEN valid THEN row_number() OVER (PARTITION BY valid, k_email, k_phone
    ORDER BY CASE WHEN phone IS NULL THEN 0 ELSE 2 END + CASE WHEN website IS NULL THEN 0 ELSE 1 END DESC, record_id) END AS place FROM keyed),
labelled AS (
  SELECT record_id, email, phone, round(revenue, 4) AS revenue,
    CASE WHEN no_email THEN 'invalid' WHEN no_name THEN 'removed' WHEN NOT valid THEN 'invalid' WHEN place > 1 THEN 'removed' ELSE 'cleaned' END AS outcome,
    list_filter([CASE WHEN no_email THEN ['handle_missing', 'Invalid: missing value in ''email'''] END,
      CASE WHEN no_name THEN ['handle_missing', 'Dropped: missing value in ''full_name'''] END,
      CASE WHEN alive AND bad_email THEN ['validate_email', concat('Invalid email format: ', email)] END,
      CASE WHEN alive AND bad_phone THEN ['validate_phone', concat('Invalid phone: ', phone)] END,
      CASE WHEN alive AND bad_revenue THEN ['validate_numeric', concat('Not numeric: ', raw_revenue)] END,
      CASE WHEN place > 1 THEN ['duplicate_removal', 'Removed during deterministic deduplication'] END], lambda e: e IS NOT NULL) AS errors
  FROM ranked)
"""


@query("m1_cleaning_run", _RUN_SQL + """
SELECT record_id, outcome, email, phone, revenue,
  CASE WHEN outcome = 'cleaned' THEN NULL WHEN list_contains(list_transform(errors, lambda e: e[1]), 'duplicate_removal') THEN 'Duplicate'
    WHEN len(errors) = 2 AND errors[1][1] = errors[2][1] THEN errors[1][1] ELSE array_to_string(list_transform(errors, lambda e: e[1]), ', ') END AS rules_failed,
  CASE WHEN outcome <> 'cleaned' THEN array_to_string(list_transform(errors, lambda e: e[2]), '; ') END AS reason FROM labelled""")
def _(t: Tables):
    rows = plan.with_error_text(contact_run(t).classified)
    failed = c("__outcome") != "cleaned"
    return rows.select(
        "record_id", c("__outcome").alias("outcome"), "email", "phone", F.round(c("revenue").try_cast("double"), 4).alias("revenue"),
        F.when(failed, c(f"`{plan.RULES_FAILED}`")).alias("rules_failed"),
        F.when(failed, c(f"`{plan.FAILURE_REASON}`")).alias("reason"))


@query("m1b_cleaning_run_fuzzy")
def _(t: Tables):
    """E-mail, phone and name as dedupe columns: exact, then fuzzy inside blocks."""
    kinds = {"full_name": "text", "email": "email", "phone": "phone"}
    rules = [Rule("trim_whitespace", "full_name"), Rule("trim_whitespace", "email")]
    run = plan.clean(t.contacts, rules, "record_id", ["phone", "full_name"], kinds)
    rows = plan.with_error_text(run.classified)
    return rows.select("record_id", c("__outcome").alias("outcome"), c(f"`{plan.FAILURE_REASON}`").alias("reason")).filter("outcome = 'removed'")


@query("a7_rule_counts", _RUN_SQL + "SELECT e[1] AS rule, count(*) AS n FROM (SELECT unnest(errors) AS e FROM labelled) x GROUP BY 1")
def _(t: Tables):
    return contact_run(t).rule_counts


@query("a8_error_breakdown", _RUN_SQL + "SELECT e[2] AS message, count(*) AS n FROM (SELECT unnest(errors) AS e FROM labelled) x GROUP BY 1")
def _(t: Tables):
    return contact_run(t).error_breakdown


@query("a8b_reported_summary", _RUN_SQL + """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE outcome = 'cleaned') AS valid_rows, count(*) FILTER (WHERE outcome <> 'cleaned') AS invalid_rows FROM labelled""")
def _(t: Tables):
    return plan.reported_summary(contact_run(t))


@query("a9_cleaning_summary", _RUN_SQL + """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE outcome = 'cleaned') AS clean_rows, count(*) FILTER (WHERE outcome = 'invalid') AS invalid_rows,
  count(*) FILTER (WHERE outcome = 'removed') AS duplicate_rows_removed FROM labelled""")
def _(t: Tables):
    return contact_run(t).summary


@query("w4_error_columns", _RUN_SQL + """
SELECT record_id, array_to_string(list_transform(errors, lambda e: e[2]), '; ') AS reason FROM labelled WHERE outcome = 'invalid'""")
def _(t: Tables):
    return contact_run(t).invalid.select("record_id", c(f"`{plan.FAILURE_REASON}`").alias("reason"))


@query("w3_removed_rows", _RUN_SQL + """
SELECT record_id, CASE WHEN place > 1 THEN 'Duplicate' ELSE 'handle_missing' END AS rules_failed FROM labelled JOIN ranked USING (record_id) WHERE outcome = 'removed'""")
def _(t: Tables):
    return contact_run(t).removed.select("record_id", c(f"`{plan.RULES_FAILED}`").alias("rules_failed"))


@query("u1_union_of_failures", _RUN_SQL + "SELECT outcome, count(*) AS n, sum(record_id)::BIGINT AS ids FROM labelled WHERE outcome <> 'cleaned' GROUP BY 1")
def _(t: Tables):
    run = contact_run(t)
    both = run.invalid.withColumn("outcome", F.lit("invalid")).unionByName(
        run.removed.withColumn("outcome", F.lit("removed")), allowMissingColumns=True)
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"))


@query("u3_rows_not_surviving", _RUN_SQL + "SELECT record_id, full_name FROM contacts WHERE record_id NOT IN (SELECT record_id FROM labelled WHERE outcome = 'cleaned')")
def _(t: Tables):
    return t.contacts.join(contact_run(t).cleaned, "record_id", "left_anti").select("record_id", "full_name")


@query("a23_rules_per_column", """
SELECT id, 'email' AS col, CASE WHEN id % 2 = 0 THEN 'email (Whitespace Check, Validate Email)' ELSE 'email (Validate Email)' END AS display FROM presets
UNION ALL SELECT id, 'phone', 'phone (Handle Missing Values)' FROM presets WHERE id % 2 = 0
UNION ALL SELECT id, 'revenue', 'revenue (Handle Missing Values, Normalize Currency / Number Format)' FROM presets WHERE id % 2 = 1""")
def _(t: Tables):
    """Display text of the rules of every stored preset."""
    selected = rule_ops.preset_rules(t.presets.select("id", "rules_json"))
    return rule_ops.rules_display(selected, ["id"]).withColumnRenamed("column", "col")


# ── Other runs ──────────────────────────────────────────────────────────────
@query("m5_clean_batch", r"""
SELECT record_id, CASE WHEN bad THEN 'invalid' ELSE 'cleaned' END AS outcome, CASE WHEN bad THEN NULL ELSE coalesce(email, '') END AS email,
  CASE WHEN bad THEN NULL ELSE coalesce(name, '') END AS full_name
FROM (SELECT record_id, nullif(regexp_replace(lower(regexp_replace(email, '\s+', '', 'g')), '[^a-zA-Z0-9@._\-]', '', 'g'), '') AS email, trim(full_name) AS raw,
    coalesce(NOT regexp_matches(nullif(regexp_replace(lower(regexp_replace(email, '\s+', '', 'g')), '[^a-zA-Z0-9@._\-]', '', 'g'), ''),
       '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'), false) AS bad,
    replace(replace(replace(lower(trim(full_name)), 'customer', 'Customer'), 'smith', 'Smith'), 'smyth', 'Smyth') AS name FROM contacts) x""")
def _(t: Tables):
    run = plan.clean_batch(t.contacts.select("record_id", "full_name", "email"), {"full_name": "text", "email": "email"}, "record_id")
    shown = plan.without_nulls(run.cleaned, "record_id")
    return run.classified.select("record_id", c("__outcome").alias("outcome")).join(shown, "record_id", "left").select(
        "record_id", "outcome", "email", "full_name")


@query("p4_title_case_names", """
SELECT record_id, CASE WHEN full_name IS NULL OR trim(full_name) = '' THEN full_name
  ELSE replace(replace(replace(lower(trim(full_name)), 'customer', 'Customer'), 'smith', 'Smith'), 'smyth', 'Smyth') END AS full_name FROM contacts""")
def _(t: Tables):
    from gleanset.functions.cleaning import title_name
    return t.contacts.select("record_id", title_name(c("full_name")).alias("full_name"))


_SHEET_SQL = r"""
WITH rows AS (SELECT segment, record_id, trim(email) AS email, phone,
    coalesce(NOT regexp_matches(trim(email), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'), false) AS bad FROM contacts),
ranked AS (SELECT *, CASE WHEN NOT bad THEN row_number() OVER (PARTITION BY segment, bad, regexp_replace(lower(regexp_replace(phone, '\D', '', 'g')), '^91(\d{9,})$', '\1') ORDER BY
    CASE WHEN email IS NULL THEN 0 ELSE 1 END + CASE WHEN phone IS NULL THEN 0 ELSE 2 END DESC, record_id) END AS place FROM rows)
"""


@query("m6_clean_sheets", _SHEET_SQL + """
SELECT segment AS sheet, count(*) AS total_rows, count(*) FILTER (WHERE NOT bad AND place = 1) AS clean_rows, count(*) FILTER (WHERE bad) AS invalid_rows,
  count(*) FILTER (WHERE NOT bad AND place > 1) AS duplicate_rows_removed FROM ranked GROUP BY ROLLUP (segment)""")
def _(t: Tables):
    """One sheet per segment, with the rules saved for the fields their columns map to."""
    contacts = t.contacts.select("record_id", "email", "phone", "website", c("segment").alias("sheet"))
    # sheets of one workbook: a handful by nature
    names = sorted(r["sheet"] for r in contacts.select("sheet").distinct().collect())
    mapping = {"email": "master:email_address", "phone": "custom:2", "website": "__discard__"}
    saved = {"master:email_address": [("trim_whitespace",), ("validate_email",)], "custom:2": [("drop_duplicates",)]}
    runs = plan.clean_workbook(contacts, "sheet", "record_id", {n: mapping for n in names}, saved, {"email": "email", "phone": "phone"})
    return plan.workbook_totals(runs, "sheet")


@query("a22_totals_over_sheets", """
SELECT sheet, sum(total_rows)::BIGINT AS total_rows, sum(rows_imported)::BIGINT AS rows_imported, sum(rows_rejected)::BIGINT AS rows_rejected
FROM uploads GROUP BY ROLLUP (sheet)""")
def _(t: Tables):
    return t.uploads.rollup("sheet").agg(*[F.sum(n).alias(n) for n in ("total_rows", "rows_imported", "rows_rejected")])


@query("p1_discard_columns", "SELECT record_id, full_name, phone FROM contacts")
def _(t: Tables):
    kept = t.contacts.select("record_id", "full_name", "email", "phone")
    return plan.discard_columns(kept, {"email": "__discard__", "phone": "master:primary_phone_number"})


@query("m4_clean_stored_table", """
SELECT id, CASE WHEN new_first IS DISTINCT FROM coalesce(first_name, '') THEN nullif(new_first, '') END AS first_name,
  CASE WHEN new_last IS DISTINCT FROM coalesce(last_name, '') THEN nullif(new_last, '') END AS last_name
FROM (SELECT id, first_name, last_name, n, full_name, regexp_extract(n, '^(\\S+)', 1) AS new_first, regexp_extract(n, '^\\S+\\s+(.*)$', 1) AS new_last
  FROM (SELECT *, trim(concat(coalesce(first_name, ''), ' ', coalesce(last_name, ''))) AS full_name, replace(replace(lower(trim(concat(coalesce(first_name, ''), ' ', coalesce(last_name, '')))), 'ann', 'Ann'), 'lee', 'Lee') AS n FROM
    (SELECT id, CASE WHEN id % 4 = 0 THEN upper(first_name) ELSE first_name END AS first_name, nullif(last_name, '') AS last_name FROM records) r) q) p
WHERE n <> full_name AND (new_first IS DISTINCT FROM coalesce(first_name, '') OR new_last IS DISTINCT FROM coalesce(last_name, ''))""")
def _(t: Tables):
    shouted = F.when(c("id") % 4 == 0, F.upper("first_name")).otherwise(c("first_name"))
    table = t.records.withColumns({"first_name": shouted, "last_name": F.nullif(c("last_name"), F.lit(""))})
    _, updates = plan.clean_stored(table, [Rule("trim_whitespace", "name")])
    return updates.select("id", "first_name", "last_name")


@query("j11_changed_values", """
SELECT record_id, CASE WHEN trim(full_name) IS DISTINCT FROM clean_name THEN clean_name END AS full_name,
  CASE WHEN clean_phone IS DISTINCT FROM phone THEN clean_phone END AS phone
FROM (SELECT record_id, full_name, phone, upper(trim(full_name)) AS clean_name, nullif(regexp_replace(phone, '[^0-9+]', '', 'g'), '') AS clean_phone FROM contacts) x
WHERE trim(full_name) IS DISTINCT FROM clean_name OR clean_phone IS DISTINCT FROM phone""")
def _(t: Tables):
    from gleanset.functions.cleaning import clean_special_chars
    old = t.contacts.select("record_id", "full_name", "phone")
    new = old.withColumns({"full_name": F.upper("full_name"), "phone": clean_special_chars(c("phone"), "phone")})
    return plan.changed_values(new, old, ["full_name", "phone"], "record_id").drop("changed")


# ── Dedup ───────────────────────────────────────────────────────────────────
@query("w1_exact_dedup", r"""
SELECT record_id, row_number() OVER (PARTITION BY lower(trim(email)), regexp_replace(phone, '\D', '', 'g')
  ORDER BY (CASE WHEN full_name IS NULL THEN 0 ELSE 1 END + CASE WHEN website IS NULL THEN 0 ELSE 1 END + CASE WHEN revenue IS NULL THEN 0 ELSE 1 END) DESC, record_id) = 1 AS kept FROM contacts""")
def _(t: Tables):
    columns = ["full_name", "website", "revenue"]
    keyed = t.contacts.select(
        "record_id", canonical(c("email"), "text").alias("k1"), F.regexp_replace("phone", r"\D", "").alias("k2"),
        dedup.completeness(columns).alias("score"))
    return dedup.mark_kept(keyed, ["k1", "k2"], "score", "record_id").select("record_id", "kept")


@query("w1b_document_dedup", """
SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1 AS kept FROM documents""")
def _(t: Tables):
    keyed = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("digest"), F.lit(1).alias("score"))
    return dedup.mark_kept(keyed, ["lang", "digest"], "score", "doc_id").select("doc_id", "kept")


@query("w2_fuzzy_dedup")
def _(t: Tables):
    rows = t.contacts.select(
        "record_id", "full_name", canonical(c("phone"), "phone").alias("k_phone"), dedup.completeness(["full_name", "email", "website"]).alias("score"))
    return dedup.fuzzy_duplicates(rows, ["k_phone"], ["full_name"], "score", "record_id").select(
        "record_id", c("column"), F.round("score", 3).alias("score"))


@query("j12_identity_blocks", r"""
SELECT record_id, first_value(record_id) OVER (PARTITION BY k ORDER BY record_id) AS base_id, n AS block_rows
FROM (SELECT record_id, k, count(*) OVER (PARTITION BY k) AS n FROM (SELECT record_id, regexp_replace(regexp_replace(phone, '\D', '', 'g'), '^91(\d{9,})$', '\1') AS k FROM contacts) a WHERE k IS NOT NULL) b WHERE n >= 2""")
def _(t: Tables):
    """Base row of every phone block with rows to compare."""
    from gleanset.operators.skew import attach
    rows = t.contacts.select("record_id", canonical(c("phone"), "phone").alias("k")).dropna()
    blocks = rows.groupBy("k").agg(F.count(F.lit(1)).alias("block_rows"), F.min("record_id").alias("base_id"))
    met = attach(rows, blocks, ["k"], "block_rows", "record_id")
    return met.filter("block_rows >= 2").select("record_id", "base_id", "block_rows")


@query("w5_standalone_dedup", r"""
SELECT record_id, record_id = m AS kept, CASE WHEN record_id <> m THEN concat('Duplicate of row ', CAST(m + 2 AS VARCHAR), ' (based on email, phone)') END AS removal_reason
FROM (SELECT record_id, first_value(record_id) OVER (PARTITION BY k ORDER BY s DESC, record_id) AS m FROM (SELECT record_id,
    concat(coalesce(lower(regexp_replace(trim(email), '\s+', '', 'g')), 'nan'), '|', coalesce(ltrim(regexp_replace(phone, '\D', '', 'g'), '0'), 'nan')) AS k,
    CASE WHEN full_name IS NULL THEN 0 ELSE 1 END + CASE WHEN website IS NULL THEN 0 ELSE 1 END + CASE WHEN revenue IS NULL THEN 0 ELSE 1 END AS s FROM contacts) a) b""")
def _(t: Tables):
    marked = dedup.drop_duplicates(t.contacts, ["email", "phone"], {"email": "email", "phone": "phone"}, "record_id")
    return marked.select("record_id", "kept", "removal_reason")


@query("w6_completeness_score", """
SELECT record_id, CASE WHEN full_name IS NULL THEN 0 ELSE 1 END + CASE WHEN email IS NULL THEN 0 ELSE 1 END + CASE WHEN phone IS NULL THEN 0 ELSE 1 END
  + CASE WHEN website IS NULL THEN 0 ELSE 1 END + CASE WHEN revenue IS NULL THEN 0 ELSE 1 END AS score FROM contacts""")
def _(t: Tables):
    return t.contacts.select("record_id", dedup.completeness(["full_name", "email", "phone", "website", "revenue"]).alias("score"))


_BEST_SQL = """
SELECT phone, col, val AS value FROM (
  SELECT phone, col, val, row_number() OVER (PARTITION BY phone, col ORDER BY val IS NULL, n DESC, length(val) DESC, first_id) AS place FROM (
    SELECT phone, col, val, count(*) AS n, min(record_id) AS first_id FROM (
      SELECT phone, record_id, 'full_name' AS col, nullif(nullif(full_name, ''), 'nan') AS val FROM contacts
      UNION ALL SELECT phone, record_id, 'email', nullif(nullif(email, ''), 'nan') FROM contacts
      UNION ALL SELECT phone, record_id, 'website', nullif(nullif(website, ''), 'nan') FROM contacts
      UNION ALL SELECT phone, record_id, 'revenue', nullif(nullif(revenue, ''), 'nan') FROM contacts) a GROUP BY phone, col, val) b) d WHERE place = 1"""


@query("w8_best_values", _BEST_SQL)
def _(t: Tables):
    best = dedup.best_values(t.contacts, "phone", ["full_name", "email", "website", "revenue"], "record_id")
    return best.select("phone", c("column").alias("col"), "value")


@query("w9_golden_records", f"""
SELECT phone, max(CASE WHEN col = 'full_name' THEN value END) AS full_name, max(CASE WHEN col = 'email' THEN value END) AS email,
  max(CASE WHEN col = 'website' THEN value END) AS website, max(CASE WHEN col = 'revenue' THEN value END) AS revenue FROM ({_BEST_SQL}) best GROUP BY phone""")
def _(t: Tables):
    return dedup.golden_records(t.contacts, "phone", ["full_name", "email", "website", "revenue"], "record_id")


# ── Typing, headers, rules ──────────────────────────────────────────────────
@query("t1_normal_header", r"""
SELECT file_id, trim(regexp_replace(regexp_replace(lower(trim(header)), '[^a-z0-9\s_\-]', '', 'g'), '[\s_\-]+', '_', 'g'), '_') AS header FROM headers""")
def _(t: Tables):
    return t.headers.select("file_id", scalars.normal_header(c("header")).alias("header"))


@query("t1b_new_field_header", r"SELECT file_id, trim(regexp_replace(lower(trim(header)), '[\s_\-]+', '_', 'g'), '_') AS header FROM headers")
def _(t: Tables):
    return t.headers.select("file_id", scalars.normal_header(c("header"), keep_symbols=True).alias("header"))


_SAMPLE_SQL = r"""
WITH cells AS (SELECT 'full_name' AS col, record_id, full_name AS v FROM contacts UNION ALL SELECT 'email', record_id, email FROM contacts UNION ALL
  SELECT 'phone', record_id, phone FROM contacts UNION ALL SELECT 'website', record_id, website FROM contacts UNION ALL SELECT 'revenue', record_id, revenue FROM contacts
  UNION ALL SELECT 'joined', record_id, joined FROM contacts UNION ALL SELECT 'segment', record_id, segment FROM contacts),
first_cells AS (SELECT col, trim(v) AS v FROM cells WHERE v IS NOT NULL),
rates AS (SELECT col, avg(CASE WHEN regexp_matches(v, '^[\w\.-]+@[\w\.-]+\.\w+$') THEN 1 ELSE 0 END) AS e,
  avg(CASE WHEN regexp_matches(v, '^\+?\d{7,15}$') THEN 1 ELSE 0 END) AS p,
  avg(CASE WHEN regexp_matches(v, '^(https?://)?(www\.)?[A-Za-z0-9-]+\.[A-Za-z]{2,}(\S*)?$') THEN 1 ELSE 0 END) AS u,
  avg(CASE WHEN regexp_matches(regexp_replace(v, '[^\d.\-]', '', 'g'), '^[+-]?(\d+\.?\d*|\.\d+)$') THEN 1 ELSE 0 END) AS n,
  avg(CASE WHEN try_strptime(v, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y']) IS NOT NULL THEN 1 ELSE 0 END) AS d FROM first_cells GROUP BY col),
inferred AS (SELECT *, CASE WHEN e >= 0.6 THEN 'email' WHEN p >= 0.6 THEN 'phone' WHEN u >= 0.6 THEN 'url' WHEN n >= 0.6 THEN 'numeric' WHEN d >= 0.8 THEN 'date' ELSE 'text' END AS kind FROM rates),
resolved AS (SELECT *, CASE col WHEN 'email' THEN 'email' WHEN 'phone' THEN 'phone' WHEN 'website' THEN 'url' ELSE kind END AS semantic_type,
  CASE WHEN col IN ('email', 'phone', 'website') THEN 'alias' ELSE 'inference' END AS matched_by FROM inferred)
"""
_COLUMNS = ["full_name", "email", "phone", "website", "revenue", "joined", "segment"]


@query("t4_inferred_types", _SAMPLE_SQL + "SELECT col, kind AS inferred, round(n, 4) AS numeric_rate FROM inferred")
def _(t: Tables):
    found = typing.profile(t.contacts, _COLUMNS, "record_id")
    return found.select(c("column").alias("col"), "inferred", F.round("numeric_rate", 4).alias("numeric_rate"))


@query("t5_resolved_types", _SAMPLE_SQL + "SELECT col, semantic_type, matched_by, round(e, 2) AS email_rate, round(d, 2) AS date_rate FROM resolved")
def _(t: Tables):
    found = typing.resolve(t.contacts, _COLUMNS, "record_id")
    return found.select(c("column").alias("col"), "semantic_type", "matched_by", "email_rate", "date_rate")


_ALIASED = {"record_id": "text", "full_name": "text", "email": "email", "phone": "phone", "website": "url", "revenue": "text", "joined": "text", "segment": "text"}


def _filled(rows, kinds: dict[str, str]):
    """(col, kind, filled): the values that are there in each column, in one aggregate."""
    counts = rows.agg(*[F.struct(F.lit(n).alias("col"), F.lit(k).alias("kind"), F.count(f"`{n}`").alias("filled")).alias(n) for n, k in kinds.items()])
    return counts.select(F.inline(F.array(*[f"`{n}`" for n in kinds])))


@query("t3_alias_types", " UNION ALL ".join(f"SELECT '{n}' AS col, '{k}' AS kind, count({n}) AS filled FROM contacts" for n, k in _ALIASED.items()))
def _(t: Tables):
    """Columns typed by their alias, text where none is known."""
    return _filled(t.contacts, {n: typing.type_or_text(n) for n in t.contacts.columns})


@query("t6_identifier_columns", " UNION ALL ".join(
    f"SELECT '{n}' AS col, count(DISTINCT {n}) AS n_values FROM uploads" for n in ("id", "user_id")))
def _(t: Tables):
    """Identifier columns by the second detector, with their distinct values."""
    found = typing.identifier_columns(t.uploads.columns)
    counts = t.uploads.agg(*[F.count_distinct(n).alias(n) for n in found])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("col"), F.col(n).alias("n_values")) for n in found])))


_STORED_SQL = """SELECT '{0}' AS col, CASE WHEN typeof(any_value({0})) IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN typeof(any_value({0})) LIKE 'TIMESTAMP%' THEN 'date'
  WHEN '{0}' LIKE '%phone%' THEN 'phone' WHEN '{0}' LIKE '%email%' THEN 'email' WHEN '{0}' LIKE '%url%' THEN 'url' ELSE 'text' END AS kind, count({0}) AS filled FROM records"""


@query("t8_stored_types", " UNION ALL ".join(_STORED_SQL.format(n) for n in ("id", "email_address", "primary_phone_number", "job_title", "lead_source", "created_at")))
def _(t: Tables):
    """Columns of the stored table typed by their SQL type and name."""
    rows = t.records.select("id", "email_address", "primary_phone_number", "job_title", "lead_source", "created_at")
    return _filled(rows, {n: typing.stored_type(n, d) for n, d in rows.dtypes})


_RULES_SQL = """(VALUES ('validate_email', 'email'), ('validate_email_domain', 'email'), ('validate_phone', 'phone'), ('validate_url', 'url'), ('validate_numeric', 'numeric'),
  ('validate_numeric_range', 'numeric'), ('validate_date', 'date'), ('validate_not_empty', '*'), ('trim_whitespace', '*'), ('clean_special_chars', '*'),
  ('handle_missing', '*'), ('normalize_currency', 'numeric'), ('drop_duplicates', '*'), ('duplicate_identifier', 'identifier')) AS r(rule, allowed)"""


@query("t9_offered_rules", _SAMPLE_SQL + f"""
SELECT col, semantic_type, rule FROM resolved, {_RULES_SQL} WHERE allowed = semantic_type OR (allowed = '*' AND semantic_type <> 'identifier')""")
def _(t: Tables):
    types = typing.resolve(t.contacts, _COLUMNS, "record_id").select(c("column").alias("col"), "semantic_type")
    return rule_ops.offered_rules(types).select("col", "semantic_type", "rule")


@query("k2_registered_rule", """
SELECT record_id, CASE WHEN length(segment) > 9 THEN 'invalid' ELSE 'cleaned' END AS outcome, CASE WHEN length(segment) > 9 THEN concat('Too long: ', segment) END AS message FROM contacts""")
def _(t: Tables):
    """A user's own rule runs like the built-in ones."""
    rule_ops.register_rule("validate_length", lambda x: (F.length(x) > 9, F.concat(F.lit("Too long: "), x)), "validation", ("text",), "Length")
    run = plan.clean(t.contacts.select("record_id", "segment"), [Rule("validate_length", "segment")], "record_id", types={"segment": "text"})
    del rule_ops.REGISTRY["validate_length"]
    return run.classified.select("record_id", c("__outcome").alias("outcome"), F.try_element_at("__errors", F.lit(1))["message"].alias("message"))


@query("k3_preset_rules", """
SELECT id, user_id, 'email' AS col, 0 AS position, 'trim_whitespace' AS rule, NULL AS strategy FROM presets WHERE id % 2 = 0
UNION ALL SELECT id, user_id, 'email', 1, 'validate_email', NULL FROM presets WHERE id % 2 = 0
UNION ALL SELECT id, user_id, 'phone', 0, 'handle_missing', 'flag' FROM presets WHERE id % 2 = 0
UNION ALL SELECT id, user_id, 'revenue', 0, 'handle_missing', 'median' FROM presets WHERE id % 2 = 1
UNION ALL SELECT id, user_id, 'revenue', 1, 'normalize_currency', NULL FROM presets WHERE id % 2 = 1
UNION ALL SELECT id, user_id, 'email', 0, 'validate_email', NULL FROM presets WHERE id % 2 = 1""")
def _(t: Tables):
    listed = rule_ops.preset_rules(t.presets.select("id", "user_id", "rules_json"))
    return listed.select("id", "user_id", c("column").alias("col"), "position", "rule", "strategy")


@query("k3b_save_presets", """
SELECT id, user_id, name, CASE WHEN user_id = 3 THEN '{}' ELSE rules_json END AS rules_json FROM presets""")
def _(t: Tables):
    saved = t.presets.filter("user_id = 3").withColumn("rules_json", F.lit("{}"))
    return rule_ops.save_presets(t.presets, saved)


@query("k4_rule_catalogue", f"""
SELECT rule, count(*) AS uses FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'numeric' WHEN 2 THEN 'identifier' ELSE 'text' END AS kind FROM orders) o, {_RULES_SQL}
WHERE allowed = kind OR (allowed = '*' AND kind <> 'identifier') GROUP BY rule""")
def _(t: Tables):
    """How many uploaded columns each rule is offered for; columns are counted by type first."""
    kind = F.element_at(F.array(*map(F.lit, ["email", "numeric", "identifier", "text"])), (c("o_orderkey") % 4 + 1).cast("int"))
    kinds = t.orders.groupBy(kind.alias("semantic_type")).agg(F.count(F.lit(1)).alias("n"))
    return rule_ops.offered_rules(kinds).groupBy("rule").agg(F.sum("n").alias("uses"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9\s_\-]', '', 'g'), '[\s_\-]+', '_', 'g'), '_')"
_MASTER_SQL = """(VALUES ('first_name', 'First Name'), ('last_name', 'Last Name'), ('email_address', 'Email Address'), ('primary_phone_number', 'Primary Phone Number'),
  ('company_name', 'Company Name'), ('job_title', 'Job Title'), ('state_province', 'State / Province'), ('postal_zip_code', 'Postal / ZIP Code')) AS m(col, label)"""


@query("t10_suggested_mapping", f"""
WITH h AS (SELECT file_id, header, {_NORM.format('header')} AS norm FROM headers)
SELECT file_id, header, coalesce(
  (SELECT concat(a.target_type, ':', a.target_identifier) FROM field_aliases a WHERE lower(trim(a.alias)) = lower(trim(h.header)) OR {_NORM.format('a.alias')} = h.norm ORDER BY a.id LIMIT 1),
  (SELECT concat('master:', m.col) FROM {_MASTER_SQL} WHERE m.col = h.norm OR lower(m.label) = lower(trim(h.header)) OR {_NORM.format('m.label')} = h.norm LIMIT 1),
  (SELECT concat('custom:', CAST(f.id AS VARCHAR)) FROM field_registry f WHERE f.is_active = 1 AND (f.normalized_name = h.norm OR {_NORM.format('f.field_name')} = h.norm) ORDER BY f.id LIMIT 1),
  'create_new') AS target FROM h""")
def _(t: Tables):
    return suggest_mapping(t.headers, t.field_aliases, t.field_registry).select("file_id", "header", "target")


@query("t11_resolved_headers", f"""
WITH h AS (SELECT file_id, header, {_NORM.format('header')} AS norm FROM headers),
known AS (SELECT file_id, header, norm, CASE WHEN norm IN ('first_name', 'last_name', 'email_address', 'primary_phone_number', 'company_name', 'job_title', 'state_province', 'postal_zip_code') THEN concat('master:', norm)
  ELSE coalesce((SELECT concat(a.target_type, ':', a.target_identifier) FROM field_aliases a WHERE {_NORM.format('a.alias')} = h.norm ORDER BY a.id LIMIT 1),
   (SELECT concat('custom:', CAST(f.id AS VARCHAR)) FROM field_registry f WHERE f.normalized_name = h.norm ORDER BY f.id LIMIT 1)) END AS target FROM h),
fresh AS (SELECT norm, 4 + row_number() OVER (ORDER BY substr(md5(norm), 1, 3), norm) AS new_id FROM (SELECT DISTINCT norm FROM known WHERE target IS NULL) x)
SELECT file_id, header, coalesce(target, concat('custom:', CAST(new_id AS VARCHAR))) AS target, target IS NULL AS is_new FROM known LEFT JOIN fresh USING (norm)""")
def _(t: Tables):
    return resolve_headers(t.headers, t.field_aliases, t.field_registry)[0].select("file_id", "header", "target", "is_new")


@query("t11b_field_usage", f"""
WITH h AS (SELECT {_NORM.format('header')} AS norm FROM headers)
SELECT CAST(f.id AS BIGINT) AS id, count(*) AS uses FROM h JOIN (SELECT f.id, f.normalized_name AS norm FROM field_registry f WHERE f.normalized_name NOT IN (SELECT {_NORM.format('a.alias')} FROM field_aliases a)
  UNION ALL SELECT CAST(min(a.target_identifier) AS INT), {_NORM.format('a.alias')} FROM field_aliases a WHERE target_type = 'custom' AND a.id <> 6 GROUP BY 2) f USING (norm) GROUP BY 1""")
def _(t: Tables):
    used = resolve_headers(t.headers, t.field_aliases, t.field_registry)[0].filter("not is_new and target like 'custom:%'")
    return used.groupBy(F.substring_index("target", ":", -1).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
