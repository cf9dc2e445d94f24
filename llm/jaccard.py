"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

1. Every text becomes its set of distinct five-word shingles (48-bit hashes). ``meeting.meet`` tells each text which of
   its shingles other texts share and in how many texts each stands. Shingles of one text only come first in the rare-first
   order and can match nothing, so the shared ones are all that the join needs.
2. Equal sets are one node. A node with fewer shared shingles than any partner would have to share is out.
3. Prefixes: the shingles that stand first in the order (document count, then hash). Postings of prefix shingles meet by
   shingle; pairs pass the length and the positional filter, are made distinct, and are verified once: first the suffix
   filter on one split, then the whole intersection.
4. A posting list is not turned into all its pairs. While lists are costly and rounds help, rounds of stars (each node
   against pivots that are drawn anew from its longest lists) are verified and joined into components; then only pairs between a list's largest component
   and the rest are left. Pairs inside a component are linked already, so no class is lost.
5. The last round compares those pairs inside the join by bitmaps before any row comes out: a shingle flips one of
   ``64 * WORDS_OF_BITS`` bits, so the bits in which two nodes differ are at most the shingles in which they differ. It is a
   suffix filter over many splits at once, and exact: pairs that it ends cannot link.

Defined results: null, empty and wordless texts have ``n_shingles`` 0 and are their own component; fewer than five words
are one shingle; equal ids and repeated rows are rows of their own and meet like any others; a component's name is its
least id that is not null (null if it has none); other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hushframe.session import materialize
from llm.arrays import Texts, lower_ascii, byte_values, slices, window_hashes
from llm.links import components, dealt
from llm.meeting import bucket_bits, meet, pack, unpack

WORDS = 5
#: Two texts link when 100 * intersection >= LEAST * union.
LEAST = 75
#: Stars go on while the last round would make more than so many pairs for each row of an open list.
FEW = 4
#: In a round a node meets so many pivots in each of so many lists; rounds go on while one part in GAIN of the open components goes.
PIVOTS = 8
LISTS = 3
GAIN = 20
#: Length of a node's bitmap in 64-bit words; it must be a power of two.
WORDS_OF_BITS = 16


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every window of five words; a shorter text is one window."""
    t = Texts(texts)
    starts, ends, of = t.words()
    words = slices(byte_values(lower_ascii(t.data)))(starts, ends)
    count = np.bincount(of, minlength=t.n)
    last = np.cumsum(count)[of]
    at = np.arange(len(starts))
    full = at + WORDS <= last
    first = np.cumsum(count) - count
    short = first[(count > 0) & (count < WORDS)]
    begin = np.concatenate([at[full], short])
    end = np.concatenate([at[full] + WORDS, last[short]])
    return window_hashes(words, begin, end), of[begin]


def _ceil(parts: int, of: np.ndarray | int, whole: int):
    return -((-parts * of) // whole)


def _postings(nodes: DataFrame) -> DataFrame:
    """node, n, h, pos, band for the shingles in the prefix, rare first; ``lead`` marks the shorter prefix that the smaller set of a pair needs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, key = row["n"], unpack(row["keys"])
                order = np.lexsort((key, unpack(row["counts"])))
                alone = n - len(key)
                size = n - _ceil(LEAST, n, 100) + 1 - alone
                lead = n - _ceil(2 * LEAST, n, 100 + LEAST) + 1 - alone
                h = key[order[: max(0, size)]].view(np.int64)
                k = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, row["node"])), pa.array(np.full(k, n)), pa.array(h), pa.array(np.arange(k) + alone), pa.array(np.arange(k) < lead)],
                    ["node", "n", "h", "pos", "lead"],
                )

    return nodes.mapInArrow(work, "node bigint, n bigint, h bigint, pos bigint, lead boolean")


def bitmap(keys: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of the 48-bit ``keys`` falls on it."""
    size = 64 * WORDS_OF_BITS
    odd = np.bincount((keys.astype(np.uint64) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _bitmaps(nodes: DataFrame) -> DataFrame:
    """node, shared (its number of shared shingles), b0.. (its bitmap)."""
    bits = [f"b{i}" for i in range(WORDS_OF_BITS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [unpack(x) for x in batch.column(1).to_pylist()]
            maps = np.array([bitmap(x) for x in lists], np.int64).reshape(len(lists), WORDS_OF_BITS)
            sizes = pa.array([len(x) for x in lists], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *(pa.array(np.ascontiguousarray(c)) for c in maps.T)], ["node", "shared", *bits])

    return nodes.select("node", "keys").mapInArrow(work, "node bigint, shared bigint, " + ", ".join(f"{b} bigint" for b in bits))


def _differ(x: str, y: str) -> F.Column:
    """In how many bits two bitmaps differ."""
    bits = [F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(WORDS_OF_BITS)]
    return sum(bits[1:], bits[0])


def _alike(x: str, y: str) -> F.Column:
    """Bitmap filter: twice the intersection is at most both shared sizes less the bits that differ."""
    most = F.col(f"{x}.shared") + F.col(f"{y}.shared") - _differ(x, y)
    return (100 + LEAST) * most >= 2 * LEAST * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _linked(na: int, nb: int, a: np.ndarray, b: np.ndarray) -> bool:
    """``a`` and ``b``: the shared shingles of two sets of ``na`` and ``nb``, ascending."""
    need = _ceil(LEAST, na + nb, 100 + LEAST)
    if min(len(a), len(b)) < need:
        return False
    # suffix filter: what lies on either side of the larger set's middle can't match across it
    if len(a) < len(b):
        a, b = b, a
    middle = a[len(a) // 2]
    cut = int(np.searchsorted(b, middle))
    if min(len(a) // 2, cut) + min(len(a) - len(a) // 2, len(b) - cut) < need:
        return False
    both = _overlap(a, b)
    return 100 * both >= LEAST * (na + nb - both)


def verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("keys").alias(f"k{s}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, np.ndarray] = {}  # the pairs of one node often come together
            kept = []
            for na, nb, ka, kb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ka", "kb"))):
                if len(seen) > 2000:
                    seen.clear()
                lists = [seen[k] if k in seen else seen.setdefault(k, unpack(k)) for k in (ka, kb)]
                kept.append(_linked(na, nb, *lists))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return full.mapInArrow(work, "a bigint, b bigint")


def _pair(x: str, y: str) -> F.Column:
    """Length filter: the smaller set has at least the needed share of the larger."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return 100 * F.least(nx, ny) >= LEAST * F.greatest(nx, ny)


def _positional(x: str, y: str) -> F.Column:
    """Prefix roles and positional filter: this shingle may be the first common one of a pair that links."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    roles = F.when(nx < ny, F.col(f"{x}.lead")).when(nx > ny, F.col(f"{y}.lead")).otherwise(F.col(f"{x}.lead") & F.col(f"{y}.lead"))
    return roles & ((100 + LEAST) * F.least(nx - px, ny - py) >= LEAST * (nx + ny))


def _distinct_pairs(joined: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(f"{x}.node"), F.col(f"{y}.node")
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def similar(sets: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``sets`` that links with another; ``sets`` is the output of ``meet``."""
    # the nodes: one row per distinct set, with enough shared shingles for any partner
    nodes = sets.where(F.col("keys").isNotNull() & (F.col("n") > 0) & (100 * F.col("shared") >= LEAST * F.col("n")))
    nodes = nodes.select(F.col("sig").alias("node"), "n", "keys", "counts").dropDuplicates(["node"])
    nodes = materialize(nodes)
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / LEAST)))
    # dealt by node once: what joins them by node below shuffles neither side
    post = dealt(_postings(nodes).withColumn("band", band), "node")
    marks = dealt(_bitmaps(nodes), "node")
    comp = dealt(nodes.select("node", F.col("node").alias("comp")), "node")
    tested = None
    round_ = 0
    while True:
        mine = post.join(comp, "node")
        left, cost, rows = _open_lists(mine)
        if cost <= FEW * rows:
            break
        opened = materialize(mine.select("node", "n", "h", "band", "comp").join(left.select("h", "all"), "h"))
        before = opened.agg(F.approx_count_distinct("comp")).first()[0]  # about; it only tells if another round pays
        stars = _stars(opened, marks, round_)
        stars = materialize(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"))
        tested = stars if tested is None else tested.unionByName(stars)
        found = materialize(verify(stars, nodes))
        comp, merged = _joined(comp, found)
        round_ += 1
        if GAIN * merged < before:
            break
    mine = post.join(comp, "node")
    left, _, _ = _open_lists(mine)
    rest = mine.join(left.select("h", "main"), "h").join(marks, "node")
    few = rest.where("comp <> main").alias("x")
    pairs = few.join(rest.alias("y"), F.col("x.h") == F.col("y.h")).where(F.col("x.comp") != F.col("y.comp")).where(_pair("x", "y") & _positional("x", "y") & _alike("x", "y"))
    pairs = _distinct_pairs(pairs, "x", "y")
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    return _joined(comp, materialize(verify(pairs, nodes)))[0]


def _stars(rows: DataFrame, marks: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b) of the nodes in open lists, each against pivots drawn anew from its longest lists, one a component.

    A node has LISTS * PIVOTS pairs at most. Which of them may link is told by the bitmaps.
    """
    band = ["h", "band"]
    drawn = F.row_number().over(W.partitionBy(*band).orderBy(F.xxhash64("node", F.lit(round_)), "node"))
    pivots = rows.withColumn("__n", drawn).where(F.col("__n") <= PIVOTS).select(*band, "node", "n", "comp").join(marks, "node").alias("y")
    longest = F.row_number().over(W.partitionBy("node").orderBy(F.desc("all"), "h"))
    seats = rows.withColumn("__n", longest).where(F.col("__n") <= LISTS).select(*band, "node", "n", "comp").join(marks, "node").alias("x")
    near = seats.join(pivots, (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")))
    near = near.where(F.col("x.comp") != F.col("y.comp")).where(_pair("x", "y") & _alike("x", "y"))
    best = near.select(F.col("x.node").alias("node"), F.col("y.comp").alias("other"), F.col("y.node").alias("pivot"), _differ("x", "y").alias("far"))
    best = best.groupBy("node", "other").agg(F.min(F.struct("far", "pivot")).alias("p"))
    return best.select(F.least("node", "p.pivot").alias("a"), F.greatest("node", "p.pivot").alias("b")).distinct()


def _open_lists(mine: DataFrame) -> tuple[DataFrame, int, int]:
    """The lists that hold several components, with the largest; the pairs the last round would make of them; their rows."""
    by = mine.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k"))
    left = by.groupBy("h").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all")).where("all > top.k")
    left = materialize(left.select("h", F.col("top.comp").alias("main"), F.col("all"), (F.col("all") - F.col("top.k")).alias("few")))
    cost, rows = left.agg(F.sum(F.col("all") * F.col("few")), F.sum("all")).first()
    return left, cost or 0, rows or 0


def _joined(comp: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """(node, comp) after the components that ``links`` connect are one, and how many components went."""
    side = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    edges = links.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    renamed = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    gone = renamed.where("comp <> new").count()
    return dealt(comp.join(renamed, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "node"), gone


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("id"), docs[text].alias("text"))
    sets = materialize(meet(rows, shingles, bucket_bits(rows, "text", 6), once=True))
    return _named(sets, sets).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _named(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (id, n, sig, any other columns) of ``sets`` with the least id of each one's component."""
    comp = similar(sets)
    groups = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("least"))
    named = groups.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = named.join(least, "comp").select("sig", "component_id")
    return rows.join(names, "sig", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose component has a lesser id, and with each (id, text) once. Null ids stay."""
    # rows go by (id, text), so a text of its own stays when another row of its id goes
    key = F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text))
    rows = docs.select(key.alias("id"), F.col(text).alias("text"))
    sets = materialize(meet(rows, shingles, bucket_bits(rows, "text", 6), once=True))
    ids = docs.select(key.alias("key"), F.col(doc_id).cast("bigint").alias("id")).distinct()
    named = _named(sets, sets.select(F.col("id").alias("key"), "n", "sig").join(ids, "key"))
    gone = named.where("component_id < id").select("key").distinct()
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    same = W.partitionBy("key").orderBy("key")
    kept = left.join(gone, "key", "left_anti").withColumn("__n", F.row_number().over(same)).where("__n = 1")
    return kept.select("row.*")


_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS s FROM words),
sized AS (SELECT rid, doc_id, s, len(s) AS n FROM sets),
tokens AS (SELECT rid, n, hash(unnest(s)) AS t FROM sized),
shared AS (SELECT t, count(*) AS k FROM tokens GROUP BY t HAVING count(*) > 1),
hit AS (SELECT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM tokens a JOIN shared USING (t) JOIN tokens b USING (t) WHERE a.rid < b.rid GROUP BY ALL),
links AS (SELECT a, b FROM hit WHERE 100 * common >= 75 * (na + nb - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(rid, other) AS (SELECT rid, rid FROM sized UNION SELECT reach.rid, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(o.doc_id)::BIGINT AS component_id
FROM sized s JOIN reach r ON s.rid = r.rid JOIN sized o ON o.rid = r.other GROUP BY s.rid, s.doc_id, s.n"""


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
SQL = {"op4_jaccard_join": _SQL}
