"""Reversible pseudonyms over a whole table.

A vault is a table ``(scope, label, value, n, placeholder, uses)``: one row per
distinct value of a label in a scope, numbered by first appearance. The scope
column decides who shares a numbering: a document, a conversation, the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import splice, value_of
from hushframe.operators.ordered import lookup, number_rows
from hushframe.operators.row_vault import PLACEHOLDER, restore_row
from hushframe.session import materialize


def build_vault(spans: DataFrame, order: list[str], scope: str = "scope") -> DataFrame:
    """Vault of a span table with columns scope, label, value and the ``order`` columns.

    Spans shrink to distinct values first (combined map-side), then each
    (scope, label) is numbered by first position, whatever its size.
    """
    numbered = number_rows(first_uses(spans, order, scope), ["scope", "label"], _places(order), "n")
    # looked up several times in either direction
    return materialize(_entries(numbered))


def _places(order: list[str]) -> list[str]:
    return [f"__o{i}" for i in range(len(order))]


def first_uses(spans: DataFrame, order: list[str], scope: str) -> DataFrame:
    """(scope, label, value, uses, first position): one row per distinct value."""
    firsts = spans.groupBy(F.col(scope).alias("scope"), "label", "value").agg(
        F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])).alias("first"),
        F.count(F.lit(1)).alias("uses"),
    )
    return firsts.select("scope", "label", "value", "uses", *[F.col(f"first.o{i}").alias(f"__o{i}") for i in range(len(order))])


def _entries(numbered: DataFrame) -> DataFrame:
    name = F.concat(F.lit("["), "label", F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    return numbered.select("scope", "label", "value", "n", name.alias("placeholder"), "uses")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def new_entries(vault: DataFrame, spans: DataFrame, order: list[str], scope: str = "scope") -> tuple[DataFrame, DataFrame]:
    """What ``spans`` add to ``vault``: entries for values it lacks, and (scope, label, value, uses) of all their values.

    New values are numbered on from the largest number of their (scope, label), in their own order; what the vault holds
    is neither renumbered nor moved. A scope with a third of all values is spread as in ``build_vault``; where numbers go
    on from meets it as any hot key does (``lookup``).
    """
    firsts = materialize(first_uses(spans, order, scope))
    fresh = firsts.join(vault, _same(firsts, vault, ["scope", "label", "value"]), "left_anti")
    numbered = number_rows(fresh, ["scope", "label"], _places(order), "__n")
    largest = vault.groupBy("scope", "label").agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("uses"))
    going_on = lookup(numbered, largest, ["scope", "label"], "largest").withColumn("n", F.col("__n") + F.coalesce("largest", F.lit(0)))
    return materialize(_entries(going_on)), firsts.select("scope", "label", "value", "uses")


def extend_vault(vault: DataFrame, spans: DataFrame, order: list[str], scope: str = "scope") -> DataFrame:
    """``vault`` grown by ``spans`` that come after all it was built of: the same as one vault built of both."""
    entries, uses = new_entries(vault, spans, order, scope)
    every = entries.drop("uses").unionByName(vault.drop("uses"))
    counted = vault.select("scope", "label", "value", "uses").unionByName(uses).groupBy("scope", "label", "value").agg(F.sum("uses").alias("uses"))
    return materialize(every.join(counted, _same(every, counted, ["scope", "label", "value"])).select(every["*"], "uses"))


def pseudonymize(
    df: DataFrame,
    vault: DataFrame,
    key: list[str],
    scope: str = "scope",
    text: str = "text",
    spans: str = "spans",
    name: str = "anonymized",
) -> DataFrame:
    """Replace the chosen (disjoint, ordered) spans of each row by the vault's placeholders.

    ``key`` is unique per row. Only (key, index, label, value) of the spans meets
    the vault; a row's placeholders come back as one small array.
    """
    s = F.col("__s")
    values = df.select(*key, F.col(scope).alias("scope"), F.col(text).alias("__t"), F.posexplode_outer(spans).alias("__i", "__s")).filter("__s is not null").select(
        *key, "scope", "__i", s["label"].alias("label"), value_of(F.col("__t"), s).alias("value")
    )
    named = lookup(values, vault, ["scope", "label", "value"], "placeholder")
    per_row = named.groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__i", "placeholder"))), lambda p: p["placeholder"]
        ).alias("__names")
    )
    return (
        df.join(per_row, key, "left")
        .withColumn(name, splice(F.col(text), F.col(spans), lambda sp, i: F.get(F.col("__names"), i)))
        .drop("__names")
    )


def restore(
    df: DataFrame, vault: DataFrame, key: list[str], scope: str = "scope", text: str = "anonymized", name: str = "restored"
) -> DataFrame:
    """Put the values back: one pass, unknown placeholders stay.

    Distinct placeholders of a row meet the vault on (scope, placeholder) and
    come back as the row's own map.
    """
    tokens = df.filter(F.col(text).contains("[")).select(
        *key,
        F.col(scope).alias("scope"),
        F.explode_outer(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER), F.lit(0)))).alias("placeholder"),
    ).filter(F.col("placeholder").isNotNull())
    known = lookup(tokens, vault, ["scope", "placeholder"], "value").filter(F.col("value").isNotNull())
    maps = known.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("__map")
    )
    return (
        df.join(maps, key, "left")
        .withColumn(name, F.when(F.col("__map").isNull(), F.col(text)).otherwise(restore_row(F.col(text), F.col("__map"))))
        .drop("__map")
    )


def export_vault(vault: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """placeholder -> value rows; a scope's map is its rows, however many."""
    out = vault.select("scope", "placeholder", "value")
    return out.filter(F.col("scope").isin(scopes)) if scopes is not None else out


def type_counts(spans: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values per label in each group of ``by``; values-free.

    Two-step: distinct rows first, then a count that combines map-side, so a hot
    group is spread over its values.
    """
    return (
        spans.select(*by, "label", "value")
        .distinct()
        .groupBy(*by, "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def counts_map(counts: DataFrame, by: list[str]) -> DataFrame:
    """Fold ``type_counts`` rows to one ``map<label, n>`` per group (one entry per label)."""
    return counts.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("entity_counts")
    )
