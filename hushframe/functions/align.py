"""Recover masked values by comparing a text with its pseudonymized form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import find_spans, value_of
from hushframe.functions.text import let

PLACEHOLDER = r"\[[A-Z_]+_[0-9]+\]"
ITEM = "struct<type:string,placeholder:string,value:string>"


def align(original: Column, anonymized: Column) -> Column:
    """struct<items, ok, has_original>: each placeholder with the value it stood for.

    The literal text between placeholders is found again in the original, left to
    right; what lies before it belongs to the placeholder before. ``ok`` is false
    when placeholders touch or a literal is not found.
    """
    state = f"struct<items:array<{ITEM}>,at:int,end:int,open:boolean,ok:boolean,live:boolean>"

    def item(token: Column, value: Column) -> Column:
        kind = F.regexp_extract(token, r"^\[([A-Z_]+)_[0-9]+\]$", 1)
        return F.struct(kind.alias("type"), token.alias("placeholder"), value.alias("value")).cast(ITEM)

    nothing = F.lit(None).cast("string")

    def step(acc: Column, stop: Column) -> Column:
        # ``stop`` is the next placeholder (a, b, token), or the end of the text (token null)
        literal = F.substring(anonymized, acc["end"] + 1, stop["a"] - acc["end"])
        rest = F.substring(original, acc["at"] + 1, F.length(original))

        def placed(found: Column) -> Column:
            anchored = F.length(literal) > 0
            is_end = stop["token"].isNull()
            drift = acc["live"] & anchored & (found == 0)
            live = acc["live"] & ~drift
            closes = acc["live"] & acc["open"] & (anchored | is_end)
            value = F.when(drift | ~anchored, rest).otherwise(
                F.substring(original, acc["at"] + 1, found - 1 - acc["at"])
            )
            last = F.element_at(acc["items"], -1)
            items = F.when(
                closes,
                F.concat(
                    F.slice(acc["items"], F.lit(1), F.size(acc["items"]) - 1),
                    F.array(item(last["placeholder"], value)),
                ),
            ).otherwise(acc["items"])
            touching = acc["live"] & acc["open"] & ~anchored & ~is_end
            return F.struct(
                F.when(is_end, items).otherwise(F.concat(items, F.array(item(stop["token"], nothing)))).alias("items"),
                F.when(live & anchored, found - 1 + F.length(literal)).otherwise(acc["at"]).alias("at"),
                stop["b"].alias("end"),
                (live & ~is_end).alias("open"),
                (acc["ok"] & ~drift & ~touching).alias("ok"),
                live.alias("live"),
            ).cast(state)

        return let(F.call_function("locate", literal, original, acc["at"] + 1), placed)

    def build(tokens: Column) -> Column:
        size = F.length(anonymized)
        shape = "struct<a:int,b:int,token:string>"
        stops = F.concat(
            F.transform(
                tokens,
                lambda s: F.struct(
                    s["start"].alias("a"), s["end"].alias("b"), value_of(anonymized, s).alias("token")
                ).cast(shape),
            ),
            F.array(F.struct(size.alias("a"), size.alias("b"), nothing.alias("token")).cast(shape)),
        )
        start = F.struct(
            F.array().cast(f"array<{ITEM}>").alias("items"),
            F.lit(0).alias("at"),
            F.lit(0).alias("end"),
            F.lit(False).alias("open"),
            F.lit(True).alias("ok"),
            F.lit(True).alias("live"),
        ).cast(state)

        def finish(acc: Column) -> Column:
            whole = ~F.exists(acc["items"], lambda x: x["value"].isNull())
            return F.struct(
                acc["items"].alias("items"), (acc["ok"] & whole).alias("ok"), F.lit(True).alias("has_original")
            )

        unaligned = F.struct(
            F.transform(tokens, lambda s: item(value_of(anonymized, s), nothing)).alias("items"),
            (F.size(tokens) == 0).alias("ok"),
            original.isNotNull().alias("has_original"),
        )
        return F.when(original.isNull() | (F.size(tokens) == 0), unaligned).otherwise(
            F.aggregate(stops, start, step, finish)
        )

    return let(find_spans(anonymized, PLACEHOLDER, "", gate=anonymized.contains("[")), build)


def values_by_type(aligned: DataFrame, key: list[str], order: list[str], column: str = "aligned") -> DataFrame:
    """(key, type, placeholder, n, value): the first recovered value of each placeholder."""
    rows = aligned.select(*key, *[c for c in order if c not in key], F.posexplode(F.col(column)["items"]).alias("__i", "__x"))
    first = F.min_by(F.struct("__x.value"), F.struct(*order, "__i"))
    return (
        rows.groupBy(*key, F.col("__x.type").alias("type"), F.col("__x.placeholder").alias("placeholder"))
        .agg(first.alias("v"))
        .select(
            *key,
            "type",
            "placeholder",
            F.regexp_extract("placeholder", r"_([0-9]+)\]$", 1).cast("bigint").alias("n"),
            F.col("v.value").alias("value"),
        )
    )
