"""Detectors: functions from a text column to a span column, and reports over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import choose_spans, find_literals, resolve_spans, value_of
from hushframe.functions.text import col
from hushframe.operators.checksum import checksum_spans
from hushframe.operators.row_vault import pseudonymize_row
from hushframe.operators.secrets import rule_spans

Detector = Callable[[Column], Column]


def composite(*detectors: Detector) -> Detector:
    """Union of detectors with overlaps resolved."""
    if not detectors:
        raise ValueError("a composite needs at least one detector")
    return lambda text: resolve_spans(*[d(text) for d in detectors])


def deterministic(text: Column) -> Column:
    """Credential rules and checksum rules together; needs no model."""
    return resolve_spans(rule_spans(text), checksum_spans(text))


def literal_detector(values: dict[str, str]) -> Detector:
    return lambda text: find_literals(text, values)


def with_spans(df: DataFrame, detect: Detector, text: str = "text", name: str = "spans") -> DataFrame:
    return df.withColumn(name, detect(F.col(text)))


def explode_spans(df: DataFrame, text: str = "text", spans: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """One row per span: the kept columns, start, end, label, score, value.

    The outer form of explode is used since the plain one makes Catalyst test
    ``size(spans) > 0`` first, which would run the detection twice.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in (text, spans)]
    s = F.col("s")
    return df.select(*keep, F.col(text).alias("__text"), F.explode_outer(spans).alias("s")).filter(s["start"].isNotNull()).select(
        *keep,
        s["start"].alias("start"),
        s["end"].alias("end"),
        s["label"].alias("label"),
        s["score"].alias("score"),
        value_of(F.col("__text"), s).alias("value"),
    )


def scan_report(df: DataFrame, detect: Detector, key: list[str], text: str = "text") -> DataFrame:
    """One row per finding with its snippet on one line."""
    found = explode_spans(with_spans(df.select(*key, text), detect, text), text, "spans", key)
    return found.select(
        *key, "start", "end", "label", "score", F.translate("value", "\n", " ").alias("snippet")
    )


def preview(df: DataFrame, detect: Detector, text: str = "text") -> DataFrame:
    """Spans, pseudonymized text and distinct counts per label, each row on its own."""
    out = with_spans(df, detect, text).withColumn("__chosen", choose_spans(F.col("spans")))
    out = out.withColumn("__done", pseudonymize_row(F.col(text), F.col("__chosen")))
    return out.select(
        *[c for c in df.columns],
        "spans",
        col("__done")["text"].alias("anonymized"),
        col("__done")["counts"].alias("counts"),
    )
