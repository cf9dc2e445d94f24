"""Telemetry payloads (OTLP/JSON): scrub every string value, report what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import choose_spans, find_spans, splice, value_of
from hushframe.functions.text import once
from hushframe.operators.detectors import Detector
from hushframe.operators.redact import json_escape, json_unescape
from hushframe.operators.row_vault import pseudonymize_segments

# The content of a ``"stringValue": "..."`` member, still JSON-escaped.
STRING_VALUE = r'(?<pre>(?<!\\)"stringValue"\s*+:\s*+")(?<hit>[^"\\]*+(?:\\.[^"\\]*+)*+)(?=")'


def is_object(body: Column) -> Column:
    """True if a text is one JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))


def split_valid(payloads: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(JSON objects, rejects)."""
    return payloads.filter(is_object(F.col(body))), payloads.filter(~is_object(F.col(body)))


def scrub_payloads(payloads: DataFrame, detect: Detector, body: str = "body") -> DataFrame:
    """``body`` with every string value pseudonymized, plus ``counts`` (distinct values per label).

    One vault per payload, numbered in document order; all of it inside the row.
    """
    b = F.col(body)
    leaves = payloads.withColumn(
        "__leaves", once(find_spans(b, STRING_VALUE, "", gate=b.contains("stringValue")))
    ).withColumn("__texts", F.transform("__leaves", lambda s: json_unescape(value_of(b, s))))
    found = leaves.withColumn(
        "__segments",
        F.transform("__texts", lambda t: F.struct(t.alias("text"), choose_spans(detect(t)).alias("spans"))),
    )
    done = found.withColumn("__done", once(pseudonymize_segments(F.col("__segments"))))
    return done.select(
        *[c for c in payloads.columns if c != body],
        splice(b, F.col("__leaves"), lambda s, i: json_escape(F.get(F.col("__done")["texts"], i))).alias(body),
        F.col("__done")["counts"].alias("counts"),
    )


def telemetry_interactions(scrubbed: DataFrame, signal: str = "signal") -> DataFrame:
    """Audit rows: log payloads with findings; traces and metrics never."""
    source = F.col("source") if "source" in scrubbed.columns else F.lit(None).cast("string")
    return scrubbed.filter((F.col(signal) == "logs") & (F.size("counts") > 0)).select(
        *[c for c in scrubbed.columns if c not in ("body", "counts", "source", signal)],
        F.coalesce(F.nullif(source, F.lit("")), F.lit("otel")).alias("source"),
        F.lit("otel").alias("wire_format"),
        F.col(signal).alias("model"),
        F.col("counts").alias("entity_counts"),
    )
