"""Pseudonyms whose scope is one row: no shuffle, everything inside the row.

A row may hold one text or several segments (a request body, a telemetry
payload); all segments of the row share one numbering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.spans import find_spans, splice, value_of
from hushframe.functions.text import let, running_counts

_SEP = "\x00"
REDACTED = "[REDACTED]"


def _key(text: Column, s: Column) -> Column:
    return F.concat(s["label"], F.lit(_SEP), value_of(text, s))


def _label(key: Column) -> Column:
    return F.substring_index(key, _SEP, 1)


def keys_of(text: Column, spans: Column) -> Column:
    """The (label, value) keys of spans in reading order."""
    return F.transform(spans, lambda s: _key(text, s))


def number_keys(keys: Column) -> Column:
    """array<struct<key,label,value,n,placeholder>>: first-seen numbering per label."""

    def number(distinct: Column) -> Column:
        def build(labels: Column) -> Column:
            return F.zip_with(distinct, F.zip_with(labels, running_counts(labels), lambda x, n: F.struct(x.alias("label"), n.alias("n"))), entry)

        def entry(k: Column, x: Column) -> Column:
            return F.struct(
                k.alias("key"),
                x["label"].alias("label"),
                F.substring(k, F.length(x["label"]) + 2, F.length(k)).alias("value"),
                x["n"].alias("n"),
                F.concat(F.lit("["), x["label"], F.lit("_"), x["n"].cast("string"), F.lit("]")).alias("placeholder"),
            )

        return let(F.transform(distinct, _label), build)

    return let(F.array_distinct(keys), number)


def placeholder_map(vault: Column) -> Column:
    return F.map_from_arrays(
        F.transform(vault, lambda v: v["key"]), F.transform(vault, lambda v: v["placeholder"])
    )


def value_map(vault: Column) -> Column:
    """placeholder -> value"""
    return F.map_from_arrays(
        F.transform(vault, lambda v: v["placeholder"]), F.transform(vault, lambda v: v["value"])
    )


def counts_of(vault: Column) -> Column:
    """Distinct values per label; holds no values."""

    def count(labels: Column) -> Column:
        return F.map_from_arrays(
            labels,
            F.transform(labels, lambda x: F.size(F.filter(vault, lambda v: v["label"] == x)).cast("bigint")),
        )

    return let(F.array_distinct(F.transform(vault, lambda v: v["label"])), count)


def render(
    text: Column, spans: Column, names: Column, action: Callable[[Column], Column] | None = None
) -> Column:
    """Replace spans by their placeholder in ``names``, or by what the action says."""

    def replacement(s: Column, i: Column) -> Column:
        placeholder = F.try_element_at(names, _key(text, s))
        if action is None:
            return placeholder
        return (
            F.when(action(s["label"]) == "redact", F.lit(REDACTED))
            .when(action(s["label"]) == "pseudonymize", placeholder)
            .otherwise(value_of(text, s))
        )

    return splice(text, spans, replacement)


def pseudonymize_row(
    text: Column, spans: Column, action: Callable[[Column], Column] | None = None
) -> Column:
    """struct<text, vault, counts> for one text. With ``action`` only spans it names enter the vault."""
    kept = spans if action is None else F.filter(spans, lambda s: action(s["label"]) == "pseudonymize")

    def done(vault: Column) -> Column:
        return F.struct(
            let(placeholder_map(vault), lambda names: render(text, spans, names, action)).alias("text"),
            vault.alias("vault"),
            counts_of(vault).alias("counts"),
        )

    return F.when(text.isNotNull(), let(number_keys(keys_of(text, kept)), done))


def pseudonymize_segments(
    segments: Column, action: Callable[[Column], Column] | None = None, counted: Callable[[Column], Column] | None = None
) -> Column:
    """One vault over ``array<struct<text, spans, ...>>`` of a row.

    Gives struct<texts, vault, counts>. ``counted`` limits which segments number
    and count (the rest keep the shared map but add nothing).
    """
    voters = segments if counted is None else F.filter(segments, counted)

    def seg_keys(seg: Column) -> Column:
        spans = seg["spans"]
        if action is not None:
            spans = F.filter(spans, lambda s: action(s["label"]) == "pseudonymize")
        return keys_of(seg["text"], spans)

    def done(vault: Column) -> Column:
        return F.struct(
            let(
                placeholder_map(vault),
                lambda names: F.transform(segments, lambda g: render(g["text"], g["spans"], names, action)),
            ).alias("texts"),
            vault.alias("vault"),
            counts_of(vault).alias("counts"),
        )

    return let(number_keys(F.flatten(F.transform(voters, seg_keys))), done)


def restore_row(text: Column, mapping: Column) -> Column:
    """Replace each placeholder that ``mapping`` knows, in one pass; unknown ones stay."""
    return splice_placeholders(text, lambda p: F.coalesce(F.try_element_at(mapping, p), p))


# A placeholder: label, underscore, number, in square brackets.
PLACEHOLDER = r"\[[^\[\]\s]+_[0-9]+\]"


def splice_placeholders(text: Column, replace: Callable[[Column], Column]) -> Column:
    tokens = find_spans(text, PLACEHOLDER, "", gate=text.contains("["))
    return splice(text, tokens, lambda s, i: replace(value_of(text, s)))
