"""Conversation prefix trie by whole-sequence collapse.

1. Conversations are rebuilt: the first turns of a shared opening, then their own. A turn becomes two 60-bit halves of its
   digest and a length; texts go no further.
2. Whole-sequence collapse. A rebuilt conversation is the sum of hashes of (turn, position), so identical ones meet in one
   grouping that Spark combines before the shuffle, and no sequence is built as an array. Each distinct sequence keeps its
   weight, its smallest conversation and its end list; only the smallest conversation's turns go on.
3. Running sums along these turns name every prefix. Sequences that some other sequence holds as a proper prefix are dropped
   by anti-join; what stays are the leaves.
4. Weighted prefixes are grouped into nodes. A node's own figures (leaf or not, saved tokens) lie on the turn of the
   sequence that owns it, are summed from the end of each sequence backwards, and those sums grouped by prefix give the
   figures of whole subtrees.

Sums run over range partitions with a carry (a conversation with a third of all turns spreads over many tasks). End lists are
written as chunks of ``CHUNK`` ids in order, and a node's digest streams over its chunks; no list is held.

Sequences are equal when four sums of 31-bit hashes are (124 bits). Defined results: rows without conv_id belong to no
conversation and are left out; null role or text is empty; a null turn comes first; turns with equal numbers are ordered by
role, then text, so repeated rows are turns of their own in a fixed order; ids below 0 keep the sign of ``%``; an empty table
gives no rows, not even a root; other columns play no part, whatever their names; a text of any length is hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hushframe.operators.ordered import lookup, number_rows
from hushframe.session import materialize

#: Conversations of this many consecutive ids share an opening, and the opening has fewer turns than ``OPENING``.
FAMILY = 100
OPENING = 6
#: Ids in one row of an end list.
CHUNK = 4096

_SUMS = ["s0", "s1", "s2", "s3"]
_MASK = (1 << 31) - 1


def opening_of(conv_id: Column) -> Column:
    """How many turns a conversation takes from its family's first."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % OPENING).cast("int")


def _digest_of(role: Column, text: Column) -> list[Column]:
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return [F.conv(F.substring(digest, a, 15), 16, 10).cast("bigint") for a in (1, 16)]


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, h0, h1, chars) for every turn of the rebuilt conversations, and a textless row of depth 0 for each."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    h0, h1 = _digest_of(role, text)
    rows = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
        h0.alias("h0"), h1.alias("h1"), F.char_length(text).cast("bigint").alias("chars"),
    )
    numbered = materialize(number_rows(rows, ["conv_id"], ["turn", "role", "text"], "n").drop("turn", "role", "text"))
    ids = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("uses"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("n") < OPENING)).select(F.col("conv_id").alias("family"), "n", "h0", "h1", "chars")
    # an opening has fewer than OPENING turns, a family fewer than 2 * FAMILY conversations
    taken = ids.select("conv_id", family.alias("family"), opening_of(F.col("conv_id")).alias("h")).join(heads, "family").where("n <= h")
    length = heads.groupBy("family").agg(F.count(F.lit(1)).alias("opening"))
    uses = ids.groupBy(family.alias("family")).agg(F.sum("uses").alias("uses")).join(length, "family")
    h = opening_of(F.col("conv_id"))
    own = lookup(numbered.where(F.col("n") > h).withColumn("family", family), uses, ["family"], "opening")
    own = own.select("conv_id", (F.col("n") - h + F.least(h, F.coalesce("opening", F.lit(0)))).cast("bigint").alias("depth"), "h0", "h1", "chars")
    zero = F.lit(0).cast("bigint")
    start = ids.select("conv_id", zero.alias("depth"), zero.alias("h0"), zero.alias("h1"), zero.alias("chars"))
    return own.unionByName(taken.select("conv_id", F.col("n").cast("bigint").alias("depth"), "h0", "h1", "chars")).unionByName(start)


def _terms() -> list[Column]:
    """What a turn adds to the four sums of its prefix; depth 0 adds nothing. 2**32 turns fit a long."""
    a, b = (F.xxhash64(F.lit(i), "h0", "h1", "depth") for i in (1, 2))
    parts = [a.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(a, 32).bitwiseAND(F.lit(_MASK)), b.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(b, 32).bitwiseAND(F.lit(_MASK))]
    return [F.when(F.col("depth") > 0, p).otherwise(F.lit(0)).cast("bigint").alias(s) for p, s in zip(parts, _SUMS)]


def running(df: DataFrame, key: str, order: str, values: list[str], backwards: bool = False) -> DataFrame:
    """``df`` with each of ``values`` summed from the key's first row (last, if ``backwards``) up to this one.

    Rows are range-partitioned by (key, order), summed inside a partition, and a carry from the partitions before is added;
    the carry has fewer rows than there are partitions, since a partition continues one key at most.
    """
    ranged = materialize(df.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()))
    by = F.col(order).desc() if backwards else F.col(order).asc()
    local = W.partitionBy("__part", key).orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("__k").orderBy(F.col("__p").desc() if backwards else F.col("__p").asc()).rowsBetween(W.unboundedPreceding, -1)
    carry = ranged.groupBy(F.col("__part").alias("__p"), F.col(key).alias("__k")).agg(*[F.sum(v).alias(f"__{v}") for v in values])
    # keys that lie in one partition need none
    several = carry.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__k")
    carry = carry.join(several, "__k").select("__p", "__k", *[F.sum(f"__{v}").over(before).alias(f"__{v}") for v in values]).where(F.col(f"__{values[0]}").isNotNull())
    joined = ranged.join(F.broadcast(carry), (F.col("__part") == F.col("__p")) & (F.col(key) == F.col("__k")), "left")
    others = [c for c in df.columns if c not in values]
    return joined.select(*others, *[(F.sum(v).over(local) + F.coalesce(F.col(f"__{v}"), F.lit(0))).alias(v) for v in values])


def _name(sums: list[str], depth: str) -> Column:
    return F.concat_ws(".", F.col(depth), *sums)


def ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the digest of the decimal ids in ascending order, joined by commas."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, done = None, [], []
        for batch in batches:
            for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node or len(ids) == CHUNK:
                    if ids:
                        done.append((node, ids[0], ",".join(map(str, ids))))
                    node, ids = n, []
                ids.append(i)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], ["node", "first", "text"])
                done = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["node", "first", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n == node:
                    state.update(b"," + text.encode())
                else:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ranged = members.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    listed = ranged.mapInArrow(chunks, "node string, first bigint, text string").repartition("node").sortWithinPartitions("node", "first")
    return listed.mapInArrow(digest, "node string, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialize(rebuilt(turns).select("conv_id", "depth", "chars", *_terms()))
    # whole-sequence collapse
    whole = rows.groupBy("conv_id").agg(F.max("depth").alias("size"), F.count(F.lit(1)).alias("uses"), *[F.sum(s).alias(s) for s in _SUMS])
    whole = materialize(whole.select("conv_id", "size", "uses", _name(_SUMS, "size").alias("node")))
    sequences = whole.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("conv_id", "size", "uses")).alias("first"))
    sequences = materialize(sequences.select("node", "weight", "first.*"))
    # the turns of each sequence's smallest conversation, with every prefix named
    chosen = lookup(rows, sequences.select("conv_id", "uses", F.struct("weight", "size").alias("of")), ["conv_id"], "of").where("of IS NOT NULL")
    along = running(chosen.select("conv_id", "depth", "chars", "of", *_SUMS), "conv_id", "depth", _SUMS)
    along = along.select("conv_id", "depth", "chars", "of.*", _name(_SUMS, "depth").alias("node"))
    along = materialize(along)
    proper = along.where("depth < size").select("node").distinct()
    leaves = sequences.select("node").join(proper, "node", "left_anti").withColumn("leaf", F.lit(1).cast("bigint"))
    nodes = along.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("weight").alias("n_convs")
    )
    nodes = materialize(
        nodes.join(leaves, "node", "left").select(
            "node", "conv_id", "depth", "n_convs", F.coalesce("leaf", F.lit(0)).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
        )
    )
    # a node's figures lie on one turn, that of the sequence that owns it
    owned = along.select("conv_id", "depth", "node").join(nodes.select("conv_id", "depth", "n_leaves", "saved_tokens"), ["conv_id", "depth"], "left")
    subtree = running(owned.na.fill(0, ["n_leaves", "saved_tokens"]), "conv_id", "depth", ["n_leaves", "saved_tokens"], backwards=True)
    figures = subtree.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    # an owner's turn above a node is its parent
    above = nodes.where("depth > 0").select("node", "conv_id", (F.col("depth") - 1).alias("depth"))
    parents = above.join(along.select("conv_id", "depth", F.col("node").alias("parent")), ["conv_id", "depth"]).select("node", "parent")
    children = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    by_parent = nodes.join(children, nodes["node"] == children["parent"]).select("parent", F.col("n_children").alias("uses"), F.col("conv_id").alias("parent_conv_id"))
    parents = lookup(parents, by_parent, ["parent"], "parent_conv_id")
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.select("node", "conv_id", "depth", "n_convs")
        .join(figures, "node")
        .join(parents.select("node", "parent_conv_id"), "node", "left")
        .join(children.withColumnRenamed("parent", "node"), "node", "left")
        .join(ends(whole), "node", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 in SQL: the table of the reversed polynomial, then one step a byte.
SQL = {
    "op12_prefix_trie": """
WITH crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || range(8), lambda x, k: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY n) AS turns FROM numbered GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS family, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, crc_table),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM hashed c LEFT JOIN own b ON b.conv_id = c.family),
prefixes AS (
  SELECT conv_id, len(turns) AS size, d AS depth, turns[1:d] AS node, turns[1:d - 1] AS parent FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(node[depth].text) END AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
below AS (
  SELECT y.node[1:d] AS node, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves, sum(y.saved) AS saved_tokens
  FROM full_nodes y, unnest(range(0, y.depth + 1)) AS u(d) GROUP BY 1)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM full_nodes x JOIN below USING (node) LEFT JOIN nodes p ON x.depth > 0 AND p.node = x.parent"""
}
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
