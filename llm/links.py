"""Connected components of links that Spark holds, by least labels and pointer jumps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.session import fixed_plans, materialize

#: So many links are joined at a time in a task.
LINKS_AT_ONCE = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes: every node, but the least of its component, with that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root != root[root]).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def shorten(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as the stars of what each task holds: no more links than before, the same components, short paths."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= LINKS_AT_ONCE:
                yield star(held)
                held, size = [], 0
        if held:
            yield star(held)

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = _stars(*(np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    return edges.mapInArrow(work, "a bigint, b bigint")


def dealt(frame: DataFrame, key: str) -> DataFrame:
    """``frame`` written once, dealt by ``key`` to as many partitions as a shuffle of the session has.

    Frames dealt by the same key join, and group by it, where they lie.
    """
    spark = frame.sparkSession
    with fixed_plans(spark):
        return materialize(frame.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b bigint) to (node, comp): the least node reachable, for every node with an edge.

    A round takes the least label among neighbours, then follows labels once; rounds grow with the logarithm of the
    longest path. Each task first joins the links it holds, so that paths are short when rounds begin. Null ends and loops are
    ignored, repeats are harmless. Links and labels are dealt by node once, so a round shuffles labels only: to the neighbours,
    to the labels that are followed, and home. Every round is written to the checkpoint folder; the result is dealt by node.
    """
    clean = shorten(edges.where("a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")))
    both = dealt(clean.selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))"), "a")
    with fixed_plans(edges.sparkSession):
        label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(label.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
        least = label.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = least.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = dealt(least.join(jump, "comp", "left").select("node", F.least("comp", "further").alias("comp"), "old"), "node")
        done = after.where("comp <> old").isEmpty()
        label = after.select("node", "comp")
        if done:
            return label
