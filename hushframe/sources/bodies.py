"""JSON bodies rewritten in place: where each text stands in the original, and a splice that leaves all else as it was.

A scanner gives every string value of a body its place, its path and the ``type`` and ``role`` of the objects around it. Which
of them are texts is said by columns over these tokens, one rule per wire format. New texts are spliced into the original
characters, so key order, spacing, numbers, escapes of unchanged strings and unknown fields stay byte for byte.

The scanner is a small Arrow function, since a path is a stack, which a fold in Catalyst copies at every token.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hushframe.functions.spans import splice, value_of
from hushframe.functions.text import let
from hushframe.operators.redact import json_escape
from hushframe.sources.requests import SIGNED_BLOCKS, is_injected

TOKEN = T.StructType(
    [
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("item", T.IntegerType()),
        T.StructField("types", T.ArrayType(T.StringType())), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()),
    ]
)
PLACE = "struct<start:int,end:int,label:string,author:string,novel:boolean,kept:string,text:string>"

# Openings of a system text that the receiver compares; they stay as they are.
VERBATIM_OPENINGS = ("You are Claude Code, Anthropic's official CLI for Claude.",)

_TOKENS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],]', re.S)
_ESCAPED = str.maketrans({"~": "~0", "/": "~1", "*": "~2"})


class _Level:
    """An open object or array: its path, the member or item at hand, and for objects what they say of themselves."""

    __slots__ = ("path", "key", "item", "objects", "said")

    def __init__(self, path: str, item: int, objects: tuple, said: dict | None):
        self.path, self.item, self.said = path, item, said
        self.objects = objects if said is None else (*objects, said)
        self.key: str | int | None = None if said is not None else 0


def scan(body: str) -> list[tuple]:
    """Every string value of a valid JSON text: start, end, path, item, types, roles, text.

    Paths join member names by ``/`` (with ``~``, ``/`` and ``*`` in a name written ``~0``, ``~1``, ``~2``); ``*`` stands
    for the items of an array. ``item`` is the place in the outermost array, -1 outside of any. ``types`` and ``roles``
    are those of the objects around, the outermost first, empty where an object has none.
    """
    found, open_levels = [], []
    for m in _TOKENS.finditer(body):
        sign = m.group()
        level = open_levels[-1] if open_levels else None
        if sign[0] == '"':
            if level is not None and level.said is not None and level.key is None:
                level.key = json.loads(sign, strict=False)
                continue
            text = json.loads(sign, strict=False).encode("utf-8", "replace").decode()
            if level is None:
                found.append((m.start(), m.end(), "", -1, (), text))
                continue
            if level.said is not None and level.key in ("type", "role"):
                level.said[level.key] = text
            name, item = _member(level)
            found.append((m.start(), m.end(), name, item, level.objects, text))
        elif sign in "{[":
            name, item, around = "", -1, ()
            if level is not None:
                name, item = _member(level)
                around = level.objects
            open_levels.append(_Level(name, item, around, {} if sign == "{" else None))
        elif sign == ",":
            if level is not None:
                level.key = None if level.said is not None else level.key + 1
        elif open_levels:
            open_levels.pop()
    return [(a, b, p, i, [o.get("type", "") for o in objects], [o.get("role", "") for o in objects], t) for a, b, p, i, objects, t in found]


def _member(level: _Level) -> tuple[str, int]:
    """Path and item of what stands at the level's present key."""
    if level.said is not None:
        name, item = str(level.key).translate(_ESCAPED), level.item
    else:
        name, item = "*", level.key if level.item < 0 else level.item
    return (f"{level.path}/{name}" if level.path else name), item


_FIELDS = to_arrow_schema(TOKEN)


@F.arrow_udf(T.ArrayType(TOKEN))
def string_tokens(body: pa.Array) -> pa.Array:
    """The string values of each JSON text; a null text has none. Texts are taken to be valid JSON."""
    rows, offsets = [], [0]
    for value in body:
        rows += scan(value.as_py() or "")
        offsets.append(len(rows))
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _FIELDS)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(_FIELDS)))


def with_tokens(df: DataFrame, body: Column, name: str) -> DataFrame:
    """``df`` plus the tokens of ``body``; Catalyst may not move the function into the expressions that use it."""
    return df.withColumn(name, string_tokens.asNondeterministic()(body))


# --- which tokens are texts ----------------------------------------------------


def _type(t: Column, level: int) -> Column:
    return F.coalesce(F.get(t["types"], F.lit(level)), F.lit(""))


def _role(t: Column) -> Column:
    return F.coalesce(F.get(t["roles"], F.lit(1)), F.lit(""))


def _unsigned(t: Column) -> Column:
    return ~F.exists(t["types"], lambda k: k.isin(*SIGNED_BLOCKS))


def _below(path: Column, top: str) -> Column:
    return (path == top) | path.startswith(top + "/")


def _spoken(t: Column) -> Column:
    return F.when((_role(t) == "user") & ~is_injected(t["text"]), "user").otherwise("machine")


def _place(t: Column, author: Column, novel: Column, kept: Column | None = None) -> Column:
    kept = F.lit("") if kept is None else kept
    return F.struct(
        t["start"].alias("start"), t["end"].alias("end"), F.lit("REDACTED").alias("label"), author.alias("author"), novel.alias("novel"),
        kept.alias("kept"), F.substring(t["text"], F.length(kept) + 1, F.length(t["text"])).alias("text"),
    ).cast(PLACE)


def _system_place(t: Column) -> Column:
    opening = F.lit("")
    for known in VERBATIM_OPENINGS:
        opening = F.when(t["text"].startswith(known), F.lit(known)).otherwise(opening)
    return _place(t, F.lit("machine"), F.lit(False), opening)


def _last_said(tokens: Column, *roles: tuple[str, str]) -> Column:
    """Item of the last token that stands at one of the (path, text) pairs; what comes after is new."""

    def at(t: Column) -> Column:
        hit = F.lit(False)
        for path, text in roles:
            hit = hit | ((t["path"] == path) & (t["text"] == text))
        return F.when(hit, t["item"]).otherwise(-1)

    return F.coalesce(F.array_max(F.transform(tokens, at)), F.lit(-1))


def _placed(tokens: Column, rule, place) -> Column:
    return F.transform(F.filter(tokens, rule), place)


def _anthropic_places(tokens: Column) -> Column:
    def own(t: Column) -> Column:
        return (t["path"] == "messages/*/content") | ((t["path"] == "messages/*/content/*/text") & _unsigned(t))

    def result(t: Column) -> Column:
        inside = (t["path"] == "messages/*/content/*/content") | t["path"].rlike(r"^messages/\*/content/\*/content/(?:.*/)?(?:text|content)$")
        return (_type(t, 2) == "tool_result") & inside & _unsigned(t)

    def call(t: Column) -> Column:
        return (_type(t, 2) == "tool_use") & _below(t["path"], "messages/*/content/*/input")

    def place(last: Column):
        return lambda t: _place(
            t,
            F.when(result(t), "tool").when(call(t), "machine").otherwise(_spoken(t)),
            F.when(result(t), t["item"] > last).otherwise(own(t) & (_role(t) == "user") & (t["item"] > last)),
        )

    return F.concat(
        _placed(tokens, lambda t: t["path"].isin("system", "system/*/text"), _system_place),
        let(_last_said(tokens, ("messages/*/role", "assistant")), lambda last: _placed(tokens, lambda t: own(t) | result(t) | call(t), place(last))),
    )


def _chat_places(tokens: Column) -> Column:
    said = lambda t: t["path"].isin("messages/*/content", "messages/*/content/*/text")
    call = lambda t: t["path"] == "messages/*/tool_calls/*/function/arguments"

    def place(last: Column):
        def one(t: Column) -> Column:
            author = F.when(said(t) & (_role(t) == "tool"), "tool").when(said(t), _spoken(t)).otherwise("machine")
            return _place(t, author, said(t) & _role(t).isin("user", "tool") & (t["item"] > last))

        return one

    return let(_last_said(tokens, ("messages/*/role", "assistant")), lambda last: _placed(tokens, lambda t: said(t) | call(t), place(last)))


def _responses_places(tokens: Column) -> Column:
    said = lambda t: t["path"].isin("input/*/content", "input/*/content/*/text")
    result = lambda t: (t["path"] == "input/*/output") & (_type(t, 1) == "function_call_output")
    call = lambda t: (t["path"] == "input/*/arguments") & (_type(t, 1) == "function_call")

    def place(last: Column):
        def one(t: Column) -> Column:
            author = F.when(result(t), "tool").when(said(t), _spoken(t)).otherwise("machine")
            return _place(t, author, (result(t) | (said(t) & (_role(t) == "user"))) & (t["item"] > last))

        return one

    plain = lambda t: _place(t, F.when(is_injected(t["text"]), "machine").otherwise("user"), F.lit(True))
    machine = lambda t: _place(t, F.lit("machine"), F.lit(False))
    boundary = _last_said(tokens, ("input/*/role", "assistant"), ("input/*/type", "function_call"))
    return F.concat(
        _placed(tokens, lambda t: t["path"] == "instructions", machine),
        _placed(tokens, lambda t: t["path"] == "input", plain),
        let(boundary, lambda last: _placed(tokens, lambda t: said(t) | result(t) | call(t), place(last))),
    )


def request_places(wire: Column, tokens: Column) -> Column:
    """The texts of a request body in the order they number pseudonyms: system texts, then messages as they stand."""
    none = F.array().cast(f"array<{PLACE}>")
    return let(
        tokens,
        lambda ts: F.when(wire == "anthropic", _anthropic_places(ts))
        .when(wire == "openai_chat", _chat_places(ts))
        .when(wire == "openai_responses", _responses_places(ts))
        .otherwise(none),
    )


def response_places(wire: Column, tokens: Column) -> Column:
    """The texts of a response body that people read; signed blocks and tool calls are none."""

    def rule(t: Column) -> Column:
        return (
            F.when(wire == "anthropic", (t["path"] == "content/*/text") & _unsigned(t))
            .when(wire == "openai_chat", t["path"] == "choices/*/message/content")
            .when(wire == "openai_responses", t["path"].isin("output/*/content", "output/*/content/*/text", "output_text"))
            .otherwise(F.lit(False))
        )

    return _placed(tokens, rule, lambda t: _place(t, F.lit("assistant"), F.lit(True)))


def respliced(body: Column, places: Column, texts: Column) -> Column:
    """``body`` with the text of each place replaced by the one at its number; equal texts keep their characters."""

    def build(ps: Column) -> Column:
        both = F.array_sort(F.zip_with(ps, texts, lambda p, new: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["label"].alias("label"), p["kept"].alias("kept"), p["text"].alias("text"), new.alias("new"))))

        def replacement(p: Column, i: Column) -> Column:
            fresh = F.concat(F.lit('"'), json_escape(F.concat(p["kept"], p["new"])), F.lit('"'))
            return F.when(p["new"] == p["text"], value_of(body, p)).otherwise(fresh)

        return splice(body, both, replacement)

    return let(places, build)
