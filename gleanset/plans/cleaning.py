"""The cleaning run: rules, three-way routing, dedup, error text and summary."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.functions import cleaning
from gleanset.functions.keys import canonical
from gleanset.functions.text import missing, strip
from gleanset.operators.dedup import completeness, fuzzy_duplicates, key_winners, repeated
from gleanset.operators.medians import exact_medians
from gleanset.operators.rules import REGISTRY, Rule, default_rules
from gleanset.operators.typing import column_types, sheet_types
from gleanset.session import settle

RULES_FAILED = "Rule(s) Failed"
FAILURE_REASON = "Failure Reason"
DEDUP_MESSAGE = "Removed during deterministic deduplication"
ERRORS = "array<struct<seq:int,rule:string,column:string,message:string,score:double>>"


@dataclass(frozen=True)
class CleaningResult:
    """All rows once, with ``__errors`` and ``__outcome``; every output is a view of it."""

    classified: DataFrame
    warnings: DataFrame
    columns: list[str]
    row_id: str

    def materialise(self) -> CleaningResult:
        """Compute the classified rows once, before several outputs are written."""
        return replace(self, classified=settle(self.classified))

    def _rows(self, outcome: str) -> DataFrame:
        return self.classified.filter(F.col("__outcome") == outcome)

    @property
    def cleaned(self) -> DataFrame:
        return self._rows("cleaned").select(self.row_id, *[F.col(f"`{c}`") for c in self.columns])

    @property
    def invalid(self) -> DataFrame:
        return with_error_text(self._rows("invalid")).drop("__errors", "__outcome")

    @property
    def removed(self) -> DataFrame:
        return with_error_text(self._rows("removed")).drop("__errors", "__outcome")

    @property
    def errors(self) -> DataFrame:
        """Long error table: row id, rule, column, message, score."""
        return self.classified.select(self.row_id, F.inline("__errors"))

    @property
    def rule_counts(self) -> DataFrame:
        return self.errors.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))

    @property
    def error_breakdown(self) -> DataFrame:
        return self.errors.groupBy("message").agg(F.count(F.lit(1)).alias("n"))

    @property
    def summary(self) -> DataFrame:
        return summarise(self.classified)


def summarise(classified: DataFrame, *by: str | Column) -> DataFrame:
    """Row counts per outcome."""
    outcome = F.col("__outcome")
    return classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(outcome == "cleaned").alias("clean_rows"),
        F.count_if(outcome == "invalid").alias("invalid_rows"),
        F.count_if(outcome == "removed").alias("duplicate_rows_removed"),
    )


def reported_summary(result: CleaningResult) -> DataFrame:
    """The report's own split, where everything not valid is invalid."""
    totals = result.summary
    return totals.select(
        "total_rows",
        F.col("clean_rows").alias("valid_rows"),
        (F.col("total_rows") - F.col("clean_rows")).alias("invalid_rows"),
    )


def with_error_text(rows: DataFrame) -> DataFrame:
    """Distinct rules and messages of a row in event order."""
    rules = F.array_distinct(F.transform("__errors", lambda e: e["rule"]))
    messages = F.array_distinct(F.transform("__errors", lambda e: e["message"]))
    label = (
        F.when(F.array_contains(rules, "fuzzy_duplicate"), "Duplicate (Fuzzy Match)")
        .when(F.array_contains(rules, "duplicate_removal") | (F.size(rules) == 0), "Duplicate")
        .otherwise(F.array_join(rules, ", "))
    )
    text = F.when(F.size(messages) == 0, DEDUP_MESSAGE).otherwise(F.array_join(messages, "; "))
    return rows.withColumn(RULES_FAILED, label).withColumn(FAILURE_REASON, text)


def _error(seq: int, rule: str, column: str, message: Column | str, score: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(seq).alias("seq"), F.lit(rule).alias("rule"), F.lit(column).alias("column"),
        text.alias("message"), (F.lit(None) if score is None else score).cast("double").alias("score"),
    )


def compatible_rules(
    rules: list[Rule], types: dict[str, str]
) -> tuple[list[Rule], list[tuple[str, str, str]]]:
    """Usable rules and a warning for each rule its column type does not allow."""
    usable, warnings = [], []
    for rule in rules:
        known = REGISTRY.get(rule.name)
        if known is None or rule.column not in types:
            continue
        kind = types[rule.column]
        if kind == "identifier" and rule.name != "duplicate_identifier":
            warnings.append((rule.name, rule.column, "Identifier columns cannot have cleaning rules applied"))
        elif kind not in known.allowed_types:
            warnings.append((rule.name, rule.column, f"Incompatible rule '{rule.name}' for column type '{kind}'"))
        else:
            usable.append(rule)
    return usable, warnings


def _layers(rules: list[tuple[int, Rule]]) -> list[list[tuple[int, Rule]]]:
    """Rules in selection order per column; one layer holds one rule per column."""
    depth: dict[str, int] = {}
    layers: list[list[tuple[int, Rule]]] = []
    for seq, rule in rules:
        level = depth.get(rule.column, 0)
        depth[rule.column] = level + 1
        if level == len(layers):
            layers.append([])
        layers[level].append((seq, rule))
    return layers


def _statistics(
    frame: DataFrame, rules: list[tuple[int, Rule]], by: str | None = None, parts: tuple[str, ...] = ()
) -> dict[int, Column]:
    """The median or mean each fill rule of a layer needs.

    Computed here, once per run: one number per rule, and per value of ``by`` if
    there is one, comes to the driver and enters every output as a literal instead
    of being worked out again in each.
    """
    sections = [(None, None)] if by is None else [(p, F.col(f"`{by}`") == p) for p in parts]
    names = {(seq, i): f"__stat{seq}_{i}" for seq, _ in rules for i in range(len(sections))}
    strategies = {name: rule.strategy for seq, rule in rules for (s, _), name in names.items() if s == seq}
    cells = []
    for seq, rule in rules:
        number = cleaning.shorthand_number(F.col(f"`{rule.column}`"))
        for i, (_, inside) in enumerate(sections):
            cells.append((number if inside is None else F.when(inside, number)).alias(names[seq, i]))
    parsed = frame.select(*cells)
    medians = [n for n, strategy in strategies.items() if strategy == "median"]
    means = [n for n, strategy in strategies.items() if strategy == "mean"]
    found = {}
    if medians:
        found.update(exact_medians(parsed, medians).first().asDict())
    if means:
        found.update(parsed.agg(*[F.avg(n).alias(n) for n in means]).first().asDict())
    statistics = {}
    for seq, _ in rules:
        numbers = [F.lit(found[names[seq, i]]).cast("double") for i in range(len(sections))]
        chosen = numbers[0]
        if by is not None:
            chosen = F.coalesce(*[F.when(inside, n) for (_, inside), n in zip(sections, numbers)])
        statistics[seq] = chosen
    return statistics


def clean_values(
    df: DataFrame, rules: list[Rule], types: dict[str, str], by: str | None = None, parts: tuple[str, ...] = ()
) -> tuple[DataFrame, list[tuple[int, str, str, str]]]:
    """Apply the cleaning rules; returns the frame and its missing-value flags.

    Each layer is one select. A median or mean is taken over all rows at the
    rule's own position, or over those of each of ``parts``, the values of ``by``.
    """
    ruled = {r.column for r in rules}
    frame = df.select(
        *[F.col(f"`{c}`").cast("string").alias(c) if c in ruled else F.col(f"`{c}`") for c in df.columns]
    )
    chosen = [(i, r) for i, r in enumerate(rules) if REGISTRY[r.name].kind == "cleaning"]
    flags: list[tuple[int, str, str, str]] = []
    for layer in _layers(chosen):
        fills = [
            (s, r) for s, r in layer
            if r.name == "handle_missing" and r.strategy in ("median", "mean") and types[r.column] == "numeric"
        ]
        statistics = _statistics(frame, fills, by, parts) if fills else {}
        changed: dict[str, Column] = {}
        added: list[Column] = []
        for seq, rule in layer:
            cell, kind = F.col(f"`{rule.column}`"), types[rule.column]
            if rule.name != "handle_missing":
                changed[rule.column] = REGISTRY[rule.name].builder(cell, kind)
            elif rule.strategy in ("flag", "drop"):
                outcome = "invalid" if rule.strategy == "flag" else "removed"
                flags.append((seq, rule.column, outcome, f"__miss{seq}"))
                added.append(missing(cell).alias(f"__miss{seq}"))
            elif rule.strategy == "placeholder":
                changed[rule.column] = cleaning.fill_placeholder(cell, kind)
            elif seq in statistics:
                changed[rule.column] = cleaning.fill_statistic(cell, statistics[seq])
        frame = frame.select(
            *[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in frame.columns], *added
        )
    return frame, sorted(flags)


def flag_missing(frame: DataFrame, flags: list[tuple[int, str, str, str]]) -> DataFrame:
    """Turn missing-value flags into errors and the first outcome; invalid wins."""
    said = {"invalid": "Invalid", "removed": "Dropped"}
    errors = [
        F.when(F.col(flag), _error(seq, "handle_missing", column, f"{said[outcome]}: missing value in '{column}'"))
        for seq, column, outcome, flag in flags
    ]
    outcome = F.lit(None).cast("string")
    for wanted in ("removed", "invalid"):
        for _, _, found, flag in flags:
            if found == wanted:
                outcome = F.when(F.col(flag), F.lit(wanted)).otherwise(outcome)
    no_errors = F.array().cast(ERRORS)
    return frame.select(
        *[F.col(f"`{c}`") for c in frame.columns if not c.startswith("__miss")],
        (F.array_compact(F.array(*errors)) if errors else no_errors).alias("__errors"),
        outcome.alias("__outcome"),
    )


def validate_rows(frame: DataFrame, rules: list[Rule], row_id: str | None = None, by: str | None = None) -> DataFrame:
    """Append the errors of every validation rule to rows still alive."""
    alive = F.col("__outcome").isNull()
    found, helpers = [], []
    for seq, rule in enumerate(rules):
        known = REGISTRY[rule.name]
        if known.kind != "validation":
            continue
        at = len(rules) + seq
        if rule.name == "duplicate_identifier":
            name = f"__repeated{seq}"
            # rows that left earlier count as a group of their own
            frame = frame.withColumn("__alive", alive)
            frame = repeated(frame, ["__alive", *([by] if by else []), rule.column], row_id, name).drop("__alive")
            helpers.append(name)
            fails, message = F.col(name), F.lit(f"Repeated identifier in column '{rule.column}'")
        else:
            fails, message = known.builder(F.col(f"`{rule.column}`"), **rule.params)
        found.append(F.when(alive & fails, _error(at, rule.name, rule.column, message)))
    if not found:
        return frame
    checked = frame.withColumn("__found", F.array_compact(F.array(*found)))
    return checked.select(
        *[F.col(f"`{c}`") for c in frame.columns if c not in ("__errors", "__outcome", *helpers)],
        F.concat("__errors", "__found").alias("__errors"),
        F.when(alive & (F.size("__found") > 0), "invalid").otherwise(F.col("__outcome")).alias("__outcome"),
    )


def remove_duplicates(
    frame: DataFrame, dedupe: list[str], types: dict[str, str], columns: list[str], row_id: str, seq: int,
    block_rows: int | None = None, by: str | None = None,
) -> DataFrame:
    """Exact dedup on canonical keys, then fuzzy dedup inside e-mail / phone blocks of at most ``block_rows``.

    With ``by``, a column without NULLs, rows compete with rows of the same value only.
    """
    used = [c for c in dedupe if types[c] != "identifier"]
    if not used:
        return frame
    keys = {c: f"__key{i}" for i, c in enumerate(used)}
    apart = [by] if by else []
    keyed = frame.select(
        row_id, F.col("__outcome").isNull().alias("__alive"), *[F.col(f"`{c}`") for c in columns],
        *[canonical(F.col(f"`{c}`"), types[c]).alias(k) for c, k in keys.items()],
    )
    names = [*apart, *keys.values()]
    scored = keyed.withColumn("__score", completeness([*columns, *keys.values()]))
    identity = [keys[c] for c in used if types[c] in ("email", "phone")]
    texts = [c for c in used if types[c] == "text"]
    if identity and texts:
        narrow = scored.select(row_id, "__alive", "__score", *dict.fromkeys([*names, *texts]))
        lost = _fuzzy_verdicts(narrow, names, [*apart, *identity], texts, row_id, seq, block_rows)
        marked = frame.join(lost, row_id, "left")
        fuzzy, beaten = F.col("__fuzzy"), F.col("__fuzzy").isNotNull()
    else:
        winners = key_winners(scored, names, "__score", row_id, "__alive")
        marked = frame.join(winners.withColumn("__won", F.lit(True)), row_id, "left")
        fuzzy, beaten = F.array().cast(ERRORS), F.col("__won").isNull()
    gone = F.col("__outcome").isNull() & beaten
    removal = _error(seq + len(texts), "duplicate_removal", ", ".join(dedupe), DEDUP_MESSAGE)
    return marked.select(
        *[F.col(f"`{c}`") for c in frame.columns if c not in ("__errors", "__outcome")],
        F.when(gone, F.concat("__errors", fuzzy, F.array(removal))).otherwise(F.col("__errors")).alias("__errors"),
        F.when(gone, "removed").otherwise(F.col("__outcome")).alias("__outcome"),
    )


def _fuzzy_verdicts(
    narrow: DataFrame, names: list[str], identity: list[str], texts: list[str], row_id: str, seq: int,
    block_rows: int | None,
) -> DataFrame:
    """(row_id, __fuzzy) of alive rows that exact or fuzzy dedup removes; no entries for exact duplicates.

    The cleaned keys and texts are written once; winners, blocks and pairs read
    them, and every output of a run reads the verdicts instead of finding them anew.
    """
    narrow = settle(narrow)
    winners = key_winners(narrow, names, "__score", row_id, "__alive")
    won = settle(narrow.drop("__alive").join(winners, row_id, "left_semi"))
    near = fuzzy_duplicates(won, identity, texts, "__score", row_id, block_rows=block_rows)
    shown = F.round("score", 3)
    error = F.struct(
        (F.lit(seq) + F.col("position")).alias("seq"), F.lit("fuzzy_duplicate").alias("rule"), F.col("column"),
        F.concat(F.col("column"), F.lit(" matched with similarity "), shown.cast("string")).alias("message"),
        shown.alias("score"),
    )
    # at most one entry per text column
    resembling = near.groupBy(row_id).agg(F.array_sort(F.collect_list(error)).cast(ERRORS).alias("__fuzzy"))
    beaten = narrow.filter("__alive").select(row_id).join(won.select(row_id), row_id, "left_anti")
    return settle(beaten.withColumn("__fuzzy", F.array().cast(ERRORS)).unionByName(resembling))


def clean(
    df: DataFrame,
    rules: list[Rule],
    row_id: str,
    dedupe: list[str] | None = None,
    types: dict[str, str] | None = None,
    block_rows: int | None = None,
    by: str | None = None,
    parts: tuple[str, ...] = (),
) -> CleaningResult:
    """Run the rules over every row and classify it as cleaned, invalid or removed.

    ``block_rows`` bounds the blocks of the fuzzy dedup; by default all are compared.
    With ``by``, a column without NULLs that holds ``parts``, every part is cleaned as if
    it were alone: duplicates, repeated identifiers and fill values are its own.

    A row leaves at the first stage that claims it: missing values, validation,
    exact duplicates, fuzzy duplicates.
    """
    columns = [c for c in df.columns if c != row_id]
    worked = [c for c in columns if c != by]
    dedupe = [c for c in dedupe or [] if c in worked]
    used = {r.column for r in rules}.union(dedupe)
    kinds = column_types(df, [c for c in worked if c in used], row_id, types)
    usable, warned = compatible_rules(rules, kinds)
    warnings = df.sparkSession.createDataFrame(warned, "rule string, column string, message string")
    frame, flags = clean_values(df, usable, kinds, by, parts)
    checked = validate_rows(flag_missing(frame, flags), usable, row_id, by)
    deduped = remove_duplicates(checked, dedupe, kinds, columns, row_id, 2 * len(usable), block_rows, by)
    classified = deduped.withColumn("__outcome", F.coalesce("__outcome", F.lit("cleaned")))
    return CleaningResult(classified, warnings, columns, row_id)


# ── Runs built on it ────────────────────────────────────────────────────────
def prepare_batch(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Lower e-mails and title-case names before the rules see them."""
    changed = {}
    for column, kind in types.items():
        if column not in df.columns:
            continue
        if kind == "email":
            changed[column] = cleaning.lower_email(F.col(f"`{column}`"))
        elif kind == "text" and column in ("first_name", "last_name", "full_name"):
            changed[column] = cleaning.title_name(F.col(f"`{column}`"))
    return df.withColumns(changed) if changed else df


def clean_batch(
    df: DataFrame, types: dict[str, str], row_id: str, rules: list[Rule] | None = None
) -> CleaningResult:
    """Clean a batch of records; without rules the default set of each type runs."""
    present = {c: k for c, k in types.items() if c in df.columns}
    return clean(prepare_batch(df, types), rules or default_rules(present), row_id, types=present)


def without_nulls(df: DataFrame, row_id: str) -> DataFrame:
    """Cells as text with NULL as the empty string, for display."""
    return df.select(
        row_id,
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns if c != row_id],
    )


def discard_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.drop(*[c for c, target in mapping.items() if target == "__discard__"])


def clean_sheets(
    sheets: dict[str, DataFrame],
    row_id: str,
    mappings: dict[str, dict[str, str]],
    rules_by_target: dict[str, list[tuple]],
    types: dict[str, str] | None = None,
) -> dict[str, CleaningResult]:
    """Clean every sheet with the rules saved for the fields its columns map to."""
    results = {}
    for name, sheet in sheets.items():
        mapping = mappings.get(name, {})
        kept = discard_columns(sheet, mapping)
        rules, dedupe = _saved_rules(kept.columns, mapping, rules_by_target)
        results[name] = clean(kept, rules, row_id, dedupe, types)
    return results


def _saved_rules(
    columns: list[str], mapping: dict[str, str], rules_by_target: dict[str, list[tuple]]
) -> tuple[list[Rule], list[str]]:
    """Rules and dedupe columns saved for the fields that columns map to."""
    rules, dedupe = [], []
    for column in columns:
        for rule, *rest in rules_by_target.get(mapping.get(column, ""), []):
            if rule == "drop_duplicates":
                dedupe.append(column)
            else:
                rules.append(Rule(rule, column, rest[0] if rest else "flag"))
    return rules, dedupe


def clean_workbook(
    rows: DataFrame,
    sheet: str,
    row_id: str,
    mappings: dict[str, dict[str, str]],
    rules_by_target: dict[str, list[tuple]],
    types: dict[str, str] | None = None,
) -> list[CleaningResult]:
    """Clean all sheets of one frame, as :func:`clean_sheets` does; one run per group of like sheets.

    ``rows`` holds every sheet's rows under ids of their own; ``sheet`` names
    their sheet and is never NULL. A sheet has the columns its mapping names
    and is left out if it has no mapping. Sheets of equal mappings and column
    types are one group, so plans grow with the groups and not with the sheets.
    Types come from each sheet's own values, in one pass for all sheets.
    """
    plans = {}
    for name, mapping in mappings.items():
        columns = [c for c in rows.columns if c in mapping and mapping[c] != "__discard__"]
        rules, dedupe = _saved_rules(columns, mapping, rules_by_target)
        plans[name] = columns, rules, dedupe
    used = {name: list(dict.fromkeys([*(r.column for r in rules), *dedupe])) for name, (_, rules, dedupe) in plans.items()}
    kinds = sheet_types(rows, sheet, used, types)
    groups: dict[tuple, list[str]] = {}
    for name, (columns, rules, dedupe) in plans.items():
        like = tuple(columns), tuple((r.name, r.column, r.strategy) for r in rules), tuple(dedupe), tuple(sorted(kinds[name].items()))
        groups.setdefault(like, []).append(name)
    results = []
    for names in groups.values():
        columns, rules, dedupe = plans[names[0]]
        part = rows.filter(F.col(f"`{sheet}`").isin(names)).select(row_id, sheet, *[F.col(f"`{c}`") for c in columns])
        results.append(clean(part, rules, row_id, dedupe, kinds[names[0]], by=sheet, parts=tuple(names)))
    return results


def workbook_totals(results: list[CleaningResult], sheet: str) -> DataFrame:
    """Counts per sheet and, with a NULL sheet, over all of them."""
    counts = reduce(DataFrame.unionByName, [summarise(r.classified, F.col(f"`{sheet}`").alias("sheet")) for r in results])
    return counts.rollup("sheet").agg(*[F.sum(c).alias(c) for c in counts.columns if c != "sheet"])


def sheet_totals(results: dict[str, CleaningResult]) -> DataFrame:
    """Counts per sheet and, with a NULL sheet, over all of them."""
    frames = [
        r.classified.select(F.lit(name).alias("sheet"), "__outcome") for name, r in results.items()
    ]
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.unionByName(more)
    counts = summarise(rows, "sheet")
    totals = counts.rollup("sheet").agg(*[F.sum(c).alias(c) for c in counts.columns if c != "sheet"])
    return totals


STORED_TYPES = {
    "full_name": "text", "first_name": "text", "last_name": "text", "email_address": "email",
    "primary_phone_number": "phone", "alternate_phone_number": "phone", "annual_revenue": "numeric",
    "website_url": "url",
}
STORED_ALIASES = {
    "name": "full_name", "email": "email_address", "revenue": "annual_revenue", "phone": "primary_phone_number",
}


def changed_values(cleaned: DataFrame, original: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """(row_id, changed, column...) of rows where cleaning changed a value.

    ``changed`` lists the columns to update; unchanged columns are NULL.
    """
    new, old = [], []
    for c in columns:
        text = strip(F.col(f"n.`{c}`").cast("string"))
        new.append(F.when(~F.lower(text).isin("nan", "nat", "null"), text))
        old.append(strip(F.col(f"o.`{c}`").cast("string")))
    differs = [~n.eqNullSafe(o) for n, o in zip(new, old)]
    names = F.array_compact(F.array(*[F.when(d, F.lit(c)) for c, d in zip(columns, differs)]))
    joined = cleaned.alias("n").join(original.alias("o"), row_id)
    return joined.select(
        row_id, names.alias("changed"), *[F.when(d, n).alias(c) for c, n, d in zip(columns, new, differs)]
    ).filter(F.size("changed") > 0)


def clean_stored(
    master: DataFrame, rules: list[Rule], row_id: str = "id"
) -> tuple[CleaningResult, DataFrame]:
    """Clean the stored table; returns the run and the rows to update.

    ``full_name`` is built from first and last name, cleaned, and split again.
    """
    rules = [replace(r, column=STORED_ALIASES.get(r.column.lower().strip(), r.column)) for r in rules]
    first, last = F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit(""))
    table = master.withColumn("full_name", strip(F.concat_ws(" ", first, last)))
    used = [r.column for r in rules]
    types = {c: STORED_TYPES[c] for c in used if c in STORED_TYPES}
    result = clean(prepare_batch(table, types), rules, row_id, types=types)
    cleaned = result.cleaned
    plain = [c for c in dict.fromkeys(used) if c != "full_name" and c in master.columns]
    if "full_name" in used:
        same_name = F.coalesce(F.col("full_name"), F.lit("")) == strip(F.concat_ws(" ", first, last))
        parts = F.split(squeeze_first(strip(F.col("full_name"))), "\u0001")
        cleaned = cleaned.withColumns({
            "first_name": F.when(same_name, F.col("first_name")).otherwise(F.nullif(parts[0], F.lit(""))),
            "last_name": F.when(same_name, F.col("last_name")).otherwise(F.try_element_at(parts, F.lit(2))),
        })
        plain = list(dict.fromkeys([*plain, "first_name", "last_name"]))
    return result, changed_values(cleaned, master, plain, row_id)


def squeeze_first(c: Column) -> Column:
    """Mark the first whitespace run, where a full name is split."""
    return F.regexp_replace(c, r"(?sU)^(\S+)\s+(.*)$", "$1\u0001$2")
