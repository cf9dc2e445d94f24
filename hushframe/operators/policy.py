"""What happens to a finding: keep, redact, pseudonymize or block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.row_vault import pseudonymize_row

ACTIONS = ("keep", "redact", "pseudonymize", "block")


def default_action(mode: str) -> str:
    """The default of a mode: ``monitor`` keeps, ``pseudonymize`` replaces."""
    return "keep" if mode == "monitor" else "pseudonymize"


def action_of(label: Column, rules: dict[str, str], default: str) -> Column:
    """Exact rule, else the longest ``PREFIX*`` rule, else the default, as one CASE."""
    exact = {k: v for k, v in rules.items() if not k.endswith("*")}
    prefixes = sorted((k[:-1] for k in rules if k.endswith("*")), key=len, reverse=True)
    out = None
    for name, action in exact.items():
        out = F.when(label == name, action) if out is None else out.when(label == name, action)
    for prefix in prefixes:
        test, action = label.startswith(prefix), rules[prefix + "*"]
        out = F.when(test, action) if out is None else out.when(test, action)
    return F.lit(default) if out is None else out.otherwise(default)


def policy(rules: dict[str, str], mode: str = "pseudonymize") -> Callable[[Column], Column]:
    return lambda label: action_of(label, rules, default_action(mode))


def resolve_actions(labels: DataFrame, rules: DataFrame, default: str, label: str = "label") -> DataFrame:
    """Actions for labels when the rules are a table ``(pattern, action)``.

    Each distinct label lists the patterns that could match it (itself, and each
    prefix with a star) and joins the rules by equality; the longest hit wins and
    an exact one beats all.
    """
    distinct = labels.select(F.col(label).alias("label")).distinct()
    star = F.transform(
        F.sequence(F.lit(0), F.length("label")), lambda n: F.struct(F.concat(F.left(F.col("label"), n), F.lit("*")).alias("pattern"), n.alias("rank"))
    )
    exact = F.array(F.struct(F.col("label").alias("pattern"), (F.length("label") + 1).alias("rank")))
    tried = distinct.select("label", F.explode(F.concat(star, exact)).alias("c")).select(
        "label", F.col("c.pattern").alias("pattern"), F.col("c.rank").alias("rank")
    )
    best = tried.join(rules, "pattern").groupBy("label").agg(F.max_by("action", "rank").alias("action"))
    return distinct.join(best, "label", "left").select("label", F.coalesce("action", F.lit(default)).alias("action"))


def apply_policy(text: Column, chosen: Column, action: Callable[[Column], Column]) -> Column:
    """struct<text, vault, counts, blocked> of one text with its chosen spans.

    Blocked spans stay in the text and are tallied per label in ``blocked``; only
    pseudonymized ones enter the vault.
    """
    done = pseudonymize_row(text, chosen, action)
    return F.when(
        text.isNotNull(),
        F.struct(
            done["text"].alias("text"),
            done["vault"].alias("vault"),
            done["counts"].alias("counts"),
            blocked_counts(chosen, action).alias("blocked"),
        ),
    )


def blocked_counts(spans: Column, action: Callable[[Column], Column]) -> Column:
    """map<label, occurrences> of spans whose action is block."""
    hits = F.filter(spans, lambda s: action(s["label"]) == "block")
    labels = F.array_distinct(F.transform(hits, lambda s: s["label"]))
    return F.map_from_entries(
        F.transform(
            labels,
            lambda x: F.struct(x.alias("k"), F.size(F.filter(hits, lambda s: s["label"] == x)).cast("bigint").alias("v")),
        )
    )


def block_tally(spans: DataFrame, action: Callable[[Column], Column], by: list[str]) -> DataFrame:
    """Occurrences of block-typed findings per group and label."""
    return (
        spans.filter(action(F.col("label")) == "block")
        .groupBy(*by, "label")
        .agg(F.count(F.lit(1)).alias("blocked"))
    )


def verdicts(spans: DataFrame, action: Callable[[Column], Column], by: list[str], mode: str = "pseudonymize") -> DataFrame:
    """Per group: is it refused (any block finding), and the policy recorded for it."""
    return spans.groupBy(*by).agg(
        F.bool_or(action(F.col("label")) == "block").alias("blocked"),
        F.when(F.bool_or(action(F.col("label")) == "block"), "block").otherwise(mode).alias("policy"),
    )


def hook_verdict(event: Column, counts: Column, action: Callable[[Column], Column], block_all: bool = False) -> Column:
    """``allow`` or ``deny`` for an editor hook event; a response event is never denied."""
    labels = F.map_keys(counts)
    denied = F.exists(labels, lambda x: action(x) == "block")
    if block_all:
        denied = denied | (F.size(labels) > 0)
    return F.when((event != "afterAgentResponse") & F.coalesce(denied, F.lit(False)), "deny").otherwise("allow")
