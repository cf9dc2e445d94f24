"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Length of the blocks a scan works in: a fold copies what it carries at every
# step, so it carries a list of finished blocks, by reference, and flattens it once.
SCAN_BLOCK = 32


def scan(items: Column, init: int, step: Callable[[Column, Column], Column]) -> Column:
    """array<int>: the state after each element of ``items``, starting from ``init``."""

    def carry(state: Column, out: Column) -> Column:
        return F.struct(state.cast("int").alias("state"), out.alias("out"))

    none = F.array().cast("array<int>")

    def inner(state: Column, block: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            return let(step(acc["state"], x).cast("int"), lambda v: carry(v, F.concat(acc["out"], F.array(v))))

        return F.aggregate(block, carry(state, none), one)

    def outer(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / SCAN_BLOCK).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))
        )

        def join(acc: Column, block: Column) -> Column:
            return let(inner(acc["state"], block), lambda r: carry(r["state"], F.concat(acc["out"], F.array(r["out"]))))

        nothing = F.array().cast("array<array<int>>")
        folded = F.aggregate(blocks, carry(F.lit(init), nothing), join, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(xs) > 0, folded).otherwise(none)

    return let(items, outer)


def before(states: Column, i: Column, init: int) -> Column:
    """The scan state before element ``i``."""
    return F.when(i == 0, F.lit(init)).otherwise(F.get(states, i - 1))


def islands(items: Column, heads: Callable[[Column, Column], Column]) -> Column:
    """array<struct<a,b>>: index ranges [a, b) that begin where ``heads(element, index)`` holds."""
    places = F.filter(F.transform(items, lambda x, i: F.when(heads(x, i), i)), lambda i: i.isNotNull())
    return let(
        places,
        lambda hs: F.transform(
            hs, lambda h, j: F.struct(h.alias("a"), F.coalesce(F.get(hs, j + 1), F.size(items)).alias("b"))
        ),
    )


def pick(items: Column, r: Column) -> Column:
    """The elements of an index range [a, b)."""
    return F.transform(F.sequence(r["a"], r["b"] - 1), lambda x: F.get(items, x))


def running_counts(items: Column) -> Column:
    """For each element, how many equal ones there are up to it; few distinct values assumed."""

    def build(xs: Column) -> Column:
        by_kind = F.sort_array(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def number(rows: Column) -> Column:
            kinds = F.array_distinct(xs)
            # where each kind begins among the sorted elements
            begins = F.transform(kinds, lambda k: F.array_position(F.transform(rows, lambda r: r["x"]), k))

            def place(ks: Column, at: Column) -> Column:
                begin = lambda r: F.get(at, (F.array_position(ks, r["x"]) - 1).cast("int"))
                counted = F.transform(rows, lambda r, p: F.struct(r["i"].alias("i"), (p + 2 - begin(r)).cast("int").alias("n")))
                return F.transform(F.sort_array(counted), lambda r: r["n"])

            return let(kinds, lambda ks: let(begins, lambda at: place(ks, at)))

        return let(by_kind, number)

    return let(items, build)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def once(value: Column) -> Column:
    """A costly column that later projections must not copy into themselves.

    Catalyst merges neighbouring projections by copying expressions into their
    users; it leaves non-deterministic ones alone, so a test that is always true
    keeps the value where it is. Filters do not move below it either: filter first.
    Spark 4 folds ``rand() >= 0`` to true, after which nothing is held back; a sum it does not fold.
    """
    return F.when(F.rand(0) + 1 > 0, value)


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for i, condition in enumerate(conditions):
        out = condition if i == 0 else (out | condition)
    return out


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return any_of(*[text.startswith(p) for p in prefixes])


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    """True if a needle occurs; a byte search, far cheaper than a regex pass."""
    return any_of(*[text.contains(n) for n in needles])


def truncate_title(text: Column, limit: int = 120) -> Column:
    """First line of the stripped text, cut to ``limit`` with an ellipsis; blank gives null."""

    def first_line(stripped: Column) -> Column:
        line = strip(F.get(F.split(stripped, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]", 2), F.lit(0)))
        return (
            F.when(F.length(stripped) == 0, F.lit(None).cast("string"))
            .when(F.length(line) <= limit, line)
            .otherwise(F.concat(rstrip(F.left(line, F.lit(limit - 1))), F.lit("…")))
        )

    return let(strip(text), first_line)


def parse_utc(value: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; without an offset it is UTC; bad text gives null."""
    return F.try_to_timestamp(value)
