"""Spans as columns: ``array<struct<start,end,label,score>>`` beside a text column.

Offsets are code points, ``end`` exclusive. Everything here is one row in, one
row out: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.text import WHITESPACE, before, islands, let, pick, scan

SPAN = "struct<start:int,end:int,label:string,score:double>"
SPANS = f"array<{SPAN}>"

# Marks put around a match, and what such a character becomes if a text holds it.
OPEN, CLOSE = "\ue000", "\ue001"
STAND_INS = "\ue002\ue003"

# Punctuation stripped from a span grown to whole words.
BOUNDARY_PUNCTUATION = ".,;:!?\"'()[]{}"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, label: Column | str, score: Column | float = 1.0) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    score = F.lit(score) if isinstance(score, (int, float)) else score
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        label.alias("label"),
        score.cast("double").alias("score"),
    ).cast(SPAN)


def value_of(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def width(s: Column) -> Column:
    return s["end"] - s["start"]


def mark(text: Column, pattern: str) -> Column:
    """Wrap each match of ``pattern`` (or of its group ``hit``) in OPEN and CLOSE.

    ``pattern`` may hold named groups ``pre`` and ``post`` around ``hit``: they
    are matched but left outside the marks.
    """
    clean = F.when(
        text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, STAND_INS)
    ).otherwise(text)
    if "(?<hit>" not in pattern:
        pattern = f"(?<hit>{pattern})"
    pre = "${pre}" if "(?<pre>" in pattern else ""
    post = "${post}" if "(?<post>" in pattern else ""
    return F.regexp_replace(clean, pattern, f"{pre}{OPEN}${{hit}}{CLOSE}{post}")


def find_spans(
    text: Column,
    pattern: str,
    label: str,
    accept: Callable[[Column], Column] | None = None,
    gate: Column | None = None,
) -> Column:
    """All non-overlapping matches, left to right, as spans with exact offsets.

    ``regexp_replace`` marks the matches, ``split`` cuts at the marks, and the
    lengths of the pieces add up to offsets. ``accept`` keeps a match by its text;
    ``gate`` is a cheap test that must hold before the regex is tried at all.
    """

    def inside(p: Column) -> Column:
        return F.instr(p, CLOSE)

    def cut(pieces: Column) -> Column:
        ends = scan(pieces, 0, lambda at, p: at + F.length(p) - F.when(inside(p) > 0, 1).otherwise(0))

        def build(ends: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                hit = inside(p) > 1
                if accept is not None:
                    hit = hit & accept(F.left(p, inside(p) - 1))
                at = before(ends, i, 0)
                return F.when(hit, span(at, at + inside(p) - 1, label))

            return F.filter(F.transform(pieces, one), lambda s: s.isNotNull())

        return let(ends, build)

    def walk(marked: Column) -> Column:
        return F.when(marked.contains(OPEN), let(F.split(marked, OPEN), cut)).otherwise(no_spans())

    found = let(mark(text, pattern), walk)
    if gate is not None:
        found = F.when(gate, found)
    return F.coalesce(found, no_spans())


def find_literals(text: Column, literals: dict[str, str]) -> Column:
    """Spans of fixed values, ``{value: label}``; the detector used in tests and demos."""
    parts = []
    for value, label in literals.items():
        quoted = "\\Q" + value.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        parts.append(find_spans(text, quoted, label, gate=text.contains(value)))
    return F.concat(*parts) if parts else no_spans()


# --- cleaning and choosing --------------------------------------------------


def trim_spans(text: Column, spans: Column) -> Column:
    """Cut trailing characters that are neither letter nor number; drop what becomes empty."""

    def trim(s: Column) -> Column:
        kept = F.length(F.regexp_replace(value_of(text, s), "[^\\p{L}\\p{N}]++\\z", ""))
        return span(s["start"], s["start"] + kept, s["label"], s["score"])

    return F.filter(F.transform(spans, trim), lambda s: s["end"] > s["start"])


def _sorted_by(spans: Column, *keys: Callable[[Column], Column]) -> Column:
    """Stable sort of spans by the keys; the position in the array breaks ties."""

    def tag(s: Column, i: Column) -> Column:
        fields = [k(s).alias(f"k{n}") for n, k in enumerate(keys)]
        return F.struct(*fields, i.alias("ord"), s.alias("s"))

    return F.transform(F.array_sort(F.transform(spans, tag)), lambda t: t["s"])


def keep_disjoint(ordered: Column) -> Column:
    """Left-to-right pass over ordered spans: skip one that starts before the last kept end."""

    def build(ss: Column) -> Column:
        ends = scan(ss, -1, lambda end, s: F.when(s["start"] >= end, s["end"]).otherwise(end))
        return let(ends, lambda e: F.filter(ss, lambda s, i: s["start"] >= before(e, i, -1)))

    return let(ordered, build)


def dedupe_spans(text: Column, spans: Column, threshold: float = 0.5) -> Column:
    """Drop low scores, trim, then keep the widest of those that start together and skip overlaps."""
    strong = F.filter(spans, lambda s: s["score"] >= threshold)
    return keep_disjoint(
        _sorted_by(trim_spans(text, strong), lambda s: s["start"], lambda s: -width(s))
    )


def choose_spans(spans: Column) -> Column:
    """The spans a placeholder pass replaces: earliest first, the shorter of a tie, none empty."""
    solid = F.filter(spans, lambda s: s["end"] > s["start"])
    return keep_disjoint(_sorted_by(solid, lambda s: s["start"], lambda s: s["end"]))


def resolve_spans(*arrays: Column) -> Column:
    """Union of detector outputs without overlap: secrets first, then wider, then higher score.

    Spans are first cut into clusters that touch each other, so the pairwise test
    runs inside a cluster and a long text with many findings stays linear.
    """

    def tag(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(s["label"].startswith("SECRET_"), 0).otherwise(1).alias("plain"),
            (-width(s)).alias("w"),
            (-s["score"]).alias("sc"),
            i.alias("ord"),
            s.alias("s"),
        )

    tagged = "array<struct<plain:int,w:int,sc:double,ord:int,s:" + SPAN + ">>"

    def clusters(items: Column) -> Column:
        by_start = F.transform(
            F.array_sort(
                F.transform(items, lambda t: F.struct(t["s"]["start"].alias("a"), t["ord"].alias("o"), t.alias("t")))
            ),
            lambda x: x["t"],
        )

        def split(ts: Column) -> Column:
            reach = scan(ts, -1, lambda end, t: F.greatest(end, t["s"]["end"]))

            def parts(ends: Column) -> Column:
                apart = islands(ts, lambda t, i: t["s"]["start"] >= before(ends, i, -1))
                return F.transform(apart, lambda r: pick(ts, r))

            return let(reach, parts)

        return let(by_start, split)

    def best_of(cluster: Column) -> Column:
        return F.aggregate(
            F.array_sort(cluster),
            no_spans(),
            lambda acc, t: F.when(F.exists(acc, lambda k: overlaps(k, t["s"])), acc).otherwise(
                F.concat(acc, F.array(t["s"]))
            ),
        )

    def settle(items: Column) -> Column:
        return F.when(F.size(items) < 2, F.transform(items, lambda t: t["s"])).otherwise(
            F.array_sort(F.flatten(F.transform(clusters(items), best_of)))
        )

    union = F.concat(*[F.coalesce(a, no_spans()) for a in arrays])
    return let(F.transform(union, tag).cast(tagged), settle)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_labels(
    spans: Column, include: list[str] | None = None, exclude: list[str] | None = None
) -> Column:
    """Keep spans whose label is included (when given) and not excluded."""
    if include is not None:
        spans = F.filter(spans, lambda s: s["label"].isin(list(include)))
    if exclude:
        spans = F.filter(spans, lambda s: ~s["label"].isin(list(exclude)))
    return spans


def expand_spans(text: Column, spans: Column) -> Column:
    """Grow each span to the white space around it, then strip boundary punctuation.

    A span of punctuation alone becomes empty and is dropped.
    """

    def grown(blanked: Column) -> Column:
        def grow(s: Column) -> Column:
            lo = F.least(F.greatest(s["start"], F.lit(0)), F.length(text))
            hi = F.greatest(lo, F.least(s["end"], F.length(text)))
            left = lo - F.length(F.substring_index(F.left(blanked, lo), " ", -1))
            right = hi + F.length(F.substring_index(F.substring(blanked, hi + 1, F.length(text)), " ", 1))

            def strip_edges(v: Column) -> Column:
                punct = F.lit(BOUNDARY_PUNCTUATION)
                no_lead = F.ltrim(v, punct)
                a = left + F.length(v) - F.length(no_lead)
                return span(a, a + F.length(F.rtrim(no_lead, punct)), s["label"], s["score"])

            return let(F.substring(text, left + 1, right - left), strip_edges)

        return F.transform(spans, grow)

    grown_spans = let(F.translate(text, WHITESPACE, " " * len(WHITESPACE)), grown)
    return F.filter(grown_spans, lambda s: s["end"] > s["start"])


def merge_spans(spans: Column) -> Column:
    """Join spans that overlap or touch; first label, lowest score."""

    def build(ss: Column) -> Column:
        reach = scan(ss, -1, lambda end, s: F.greatest(end, s["end"]))

        def joined(ends: Column) -> Column:
            def one(r: Column) -> Column:
                first = F.get(ss, r["a"])
                low = F.array_min(F.transform(pick(ss, r), lambda s: s["score"]))
                return span(first["start"], F.get(ends, r["b"] - 1), first["label"], low)

            return F.transform(islands(ss, lambda s, i: (i == 0) | (s["start"] > before(ends, i, -1))), one)

        return let(reach, joined)

    return let(_sorted_by(spans, lambda s: s["start"], lambda s: s["end"]), build)


def splice(text: Column, spans: Column, replacement: Callable[[Column, Column], Column]) -> Column:
    """Replace disjoint, ordered spans; ``replacement(span, index)`` gives each new text.

    Where it gives null, the span's label in brackets stands in: no text is lost and no value stays in the clear.
    """

    def build(ss: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(ss, i - 1)["end"])
            plain = F.concat(F.lit("["), F.coalesce(s["label"], F.lit("REDACTED")), F.lit("]"))
            return F.concat(F.substring(text, begin + 1, s["start"] - begin), F.coalesce(replacement(s, i), plain))

        tail = F.substring(text, F.element_at(ss, -1)["end"] + 1, F.length(text))
        return F.when(F.size(ss) == 0, text).otherwise(
            F.concat(F.array_join(F.transform(ss, piece), ""), tail)
        )

    return let(spans, build)
