"""Rule registry, rule catalogue, presets and default rule sets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.functions import cleaning, validation

VALUE_TYPES = ("email", "phone", "url", "numeric", "date", "text")


@dataclass(frozen=True)
class RuleKind:
    """What a rule is called, what it does and where it may be used.

    A cleaning builder maps ``(column, semantic type)`` to the cleaned column;
    a validation builder maps a column to (failing predicate, message).
    """

    name: str
    label: str
    kind: str
    allowed_types: tuple[str, ...]
    builder: Callable[..., Any] | None = None
    strategies: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """One selected rule: which rule, on which column, with which parameters."""

    name: str
    column: str
    strategy: str = "flag"
    params: dict[str, Any] = field(default_factory=dict)


REGISTRY: dict[str, RuleKind] = {}


def register_rule(
    name: str,
    builder: Callable[..., Any] | None,
    kind: str,
    allowed_types: tuple[str, ...],
    label: str | None = None,
    strategies: tuple[str, ...] = (),
) -> RuleKind:
    """Add a rule; the builder may wrap expressions or a pandas UDF."""
    if kind not in ("cleaning", "validation", "dedupe"):
        raise ValueError(f"unknown rule kind {kind}")
    rule = RuleKind(name, label or name, kind, tuple(allowed_types), builder, strategies)
    REGISTRY[name] = rule
    return rule


register_rule("validate_email", validation.validate_email, "validation", ("email",), "Validate Email")
register_rule("validate_email_domain", validation.validate_email_domain, "validation", ("email",), "Validate Email Domain")
register_rule("validate_phone", validation.validate_phone, "validation", ("phone",), "Validate Phone")
register_rule("validate_url", validation.validate_url, "validation", ("url",), "Validate URL")
register_rule("validate_numeric", validation.validate_numeric, "validation", ("numeric",), "Validate Number Format")
register_rule("validate_numeric_range", validation.validate_numeric_range, "validation", ("numeric",), "Validate Numeric Range")
register_rule("validate_date", validation.validate_date, "validation", ("date",), "Validate Date")
register_rule("validate_not_empty", validation.validate_not_empty, "validation", VALUE_TYPES, "Not Empty Check")
register_rule("trim_whitespace", cleaning.trim_whitespace, "cleaning", VALUE_TYPES, "Whitespace Check")
register_rule("clean_special_chars", cleaning.clean_special_chars, "cleaning", VALUE_TYPES, "Remove Special Characters")
register_rule("handle_missing", None, "cleaning", VALUE_TYPES, "Handle Missing Values",
              ("flag", "median", "mean", "placeholder", "drop"))
register_rule("normalize_currency", cleaning.normalize_currency, "cleaning", ("numeric",), "Normalize Currency / Number Format")
register_rule("drop_duplicates", None, "dedupe", VALUE_TYPES, "Remove Duplicates")
register_rule("duplicate_identifier", None, "validation", ("identifier",), "Check duplicates")


def catalogue(spark: SparkSession) -> DataFrame:
    """The registry as a frame: rule, label, kind, allowed types, strategies."""
    rows = [(r.name, r.label, r.kind, list(r.allowed_types), list(r.strategies)) for r in REGISTRY.values()]
    return spark.createDataFrame(
        rows, "rule string, label string, kind string, allowed_types array<string>, strategies array<string>"
    )


def offered_rules(types: DataFrame) -> DataFrame:
    """Rules each (column, semantic_type) may use."""
    rules = catalogue(types.sparkSession)
    allowed = rules.select(F.explode("allowed_types").alias("semantic_type"), "rule", "label", "kind", "strategies")
    return types.join(allowed, "semantic_type")


def default_rules(types: dict[str, str]) -> list[Rule]:
    """Rules for a batch that comes without any."""
    checks = {
        "numeric": ("normalize_currency", "validate_numeric"),
        "email": ("clean_special_chars", "validate_email"),
        "phone": ("clean_special_chars", "validate_phone"),
        "url": ("clean_special_chars", "validate_url"),
    }
    rules = []
    for column, kind in types.items():
        rules.append(Rule("trim_whitespace", column))
        rules += [Rule(name, column) for name in checks.get(kind, ())]
    return rules


def from_request(entries: list[tuple]) -> tuple[list[Rule], list[str]]:
    """Split request entries into rules and dedupe columns."""
    rules, dedupe = [], []
    for name, column, *rest in entries:
        if name == "drop_duplicates":
            dedupe.append(column)
        else:
            rules.append(Rule(name, column, rest[0] if rest else "flag"))
    return rules, dedupe


_RULE_MAP = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
_STRATEGY_MAP = T.MapType(T.StringType(), T.StringType())


def preset_rules(presets: DataFrame, json: str = "rules_json") -> DataFrame:
    """One row per preset, column and rule; both stored forms are read.

    The newer form nests the rules and carries a strategy per column, the older
    one is the bare ``{column: [rules]}`` object; handle_missing defaults to
    the flag strategy and other rules have none.
    """
    newer = F.get_json_object(json, "$.rules").isNotNull() & F.get_json_object(json, "$.strategies").isNotNull()
    rules = F.when(newer, F.from_json(F.get_json_object(json, "$.rules"), _RULE_MAP)).otherwise(
        F.from_json(json, _RULE_MAP)
    )
    strategies = F.when(newer, F.from_json(F.get_json_object(json, "$.strategies"), _STRATEGY_MAP))
    keys = [c for c in presets.columns if c != json]
    listed = presets.select(*keys, rules.alias("rules"), strategies.alias("strategies"))
    columns = listed.select(*keys, "strategies", F.explode("rules").alias("column", "names"))
    single = columns.select(*keys, "strategies", "column", F.posexplode("names").alias("position", "rule"))
    strategy = F.when(
        F.col("rule") == "handle_missing",
        F.coalesce(F.try_element_at("strategies", F.col("column")), F.lit("flag")),
    )
    return single.select(*keys, "column", "position", "rule", strategy.alias("strategy"))


def save_presets(stored: DataFrame, saved: DataFrame, keys: tuple[str, ...] = ("user_id", "name")) -> DataFrame:
    """Upsert by (user, name): a saved preset replaces the stored one."""
    kept = stored.join(saved.select(*keys), list(keys), "left_anti")
    return kept.unionByName(saved)


def rules_display(selected: DataFrame, by: list[str]) -> DataFrame:
    """``column (Label, Label)`` per column of a selection, labels in selection order."""
    labels = catalogue(selected.sparkSession).select("rule", "label")
    named = selected.join(labels, "rule", "left")
    # a selection holds at most one entry per rule and column
    listed = F.array_sort(F.collect_list(F.struct("position", F.coalesce("label", "rule").alias("label"))))
    texts = named.groupBy(*by, "column").agg(F.array_join(F.transform(listed, lambda s: s["label"]), ", ").alias("labels"))
    return texts.select(*by, "column", F.concat("column", F.lit(" ("), "labels", F.lit(")")).alias("display"))
