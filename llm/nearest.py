"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted in numpy on at most ``sample`` vectors (chosen by a hash of the id), so its size is bounded by that
parameter; every vector is then dealt to a leaf. A query walks the tree with a priority queue of branches by distance to
their centres and visits the leaves it meets first. How many is calibrated: for at most ``trials`` queries the true
neighbours among all rows are found by a full scan in blocks, and visits are widened until ``recall`` of them lie in the
visited leaves. A query whose leaves hold fewer than ``k`` other ids visits more until they do. Queries and vectors then meet by leaf, in blocks of bounded size on both sides, and distances are computed
in double precision on the original vectors.

Equal vectors are equally near, so of each group of them only the ``k + 1`` with the smallest ids can ever be returned; the
others leave before anything is shuffled by leaf, which keeps a vector that fills a third of the table from filling a leaf.

Defined results: vectors that are null, zero, or hold nulls or non-finite values take no part, nor do null ids and vectors
whose length is not the most frequent one (ties: the longer); rows with the same id and vector count once; rows with the
query's id are never its neighbours; an id with several vectors is as near as its nearest one; with fewer candidates all are returned; ties go to the smaller id; other columns play
no part, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hushframe.session import materialize
from llm.sampling import bounded

SAMPLE = 50_000
BRANCHES = 12
#: A node with at most so many sampled vectors is a leaf.
LEAF = 150
TRIALS = 60
RECALL = 0.97
BLOCK = 4096
QUERY_BLOCK = 1024


@dataclass(frozen=True)
class Tree:
    """Node 0 is the root. ``children[i]`` lists node numbers (empty: a leaf); ``leaf[i]`` numbers the leaves, -1 otherwise."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def deal(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = _nearest(x[rows], self.centres[self.children[node]])
            todo += [(int(c), rows[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and more until the ``sizes`` of the leaves add up to ``least``."""
        found: list[int] = []
        held = 0
        queue = [(0.0, 0)]
        while queue and (len(found) < most or held < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(int(self.leaf[node]))
                held += sizes.get(found[-1], 0) if sizes else 0
                continue
            kids = self.children[node]
            far = ((self.centres[kids] - q) ** 2).sum(1)
            for d, c in zip(far.tolist(), kids.tolist()):
                heapq.heappush(queue, (d, c))
        return found


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2.0 * x @ centres.T).argmin(1)


def grow(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, rounds: int = 8) -> Tree:
    """Split nodes by k-means until they hold ``leaf`` vectors or cannot be split."""
    rng = np.random.default_rng(0)
    centres, children, leaves = [x.mean(0)], [np.zeros(0, np.int64)], [-1]
    todo, count = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        points = x[rows]
        start = np.unique(points[rng.choice(len(rows), min(branches, len(rows)), replace=False)], axis=0) if len(rows) > leaf else points[:0]
        if len(start) < 2:
            leaves[node] = count
            count += 1
            continue
        for _ in range(rounds):
            near = _nearest(points, start)
            used = np.unique(near)
            start = np.stack([points[near == i].mean(0) for i in used])
        near = _nearest(points, start)
        parts = [(c, rows[near == i]) for i, c in enumerate(start) if (near == i).any()]
        if len(parts) < 2:
            leaves[node] = count
            count += 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(parts))
        for centre, part in parts:
            todo.append((len(centres), part))
            centres.append(centre)
            children.append(np.zeros(0, np.int64))
            leaves.append(-1)
    return Tree(np.array(centres), children, np.array(leaves))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id bigint, v array<double> of the rows that take part, each once."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (size[0].n if size else 0))


def _top(q: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query, the rows of ``x`` that are among its ``k`` nearest: query number, row, distance."""
    who, what, how = [], [], []
    for i in range(len(q)):
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        other = np.flatnonzero(ids != own[i])
        if len(other) > k:
            edge = np.partition(d[other], k - 1)[k - 1]
            other = other[d[other] <= edge]
        best = other[np.lexsort((ids[other], d[other]))][:k]
        if len(np.unique(ids[best])) < len(best):  # an id with several vectors counts once
            other = np.flatnonzero(ids != own[i])
            other = other[np.lexsort((ids[other], d[other]))]
            best = other[np.sort(np.unique(ids[other], return_index=True)[1])][:k]
        who.append(np.full(len(best), i))
        what.append(best)
        how.append(d[best])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *who]), np.concatenate([none, *what]), np.concatenate([np.zeros(0), *how])


def search(vectors: DataFrame, queries, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, trials: int = TRIALS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that the condition ``queries`` (on vec_id) picks."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, vec_id, vector))
    # a partial limit per task comes before the shuffle, so equal vectors don't pile up
    first = W.partitionBy("v").orderBy("vec_id")
    kept = rows.dropDuplicates(["vec_id", "v"]).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1).drop("__n")
    kept = materialize(kept)
    chosen = bounded(kept, ["vec_id"], sample).toArrow()  # at most ``sample`` vectors
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not chosen.num_rows:
        return spark.createDataFrame([], schema)
    tree = spark.sparkContext.broadcast(grow(matrix(chosen["v"].combine_chunks())))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.deal(matrix(b.column(1))))], ["vec_id", "v", "leaf"])

    dealt = materialize(kept.mapInArrow(deal, "vec_id bigint, v array<double>, leaf bigint"))
    asked = rows.where(queries(F.col("vec_id"))).dropDuplicates(["vec_id", "v"])
    visits = calibrate(asked, dealt, tree, k, trials, recall)

    sizes = {r.leaf: r.k for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).collect()}  # a row per leaf of the tree
    # each id in one leaf only, so that the sum over leaves is at most their number of distinct ids
    firsts = dealt.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("k"))
    firsts = {r.leaf: r.k for r in firsts.collect()}
    # neighbouring leaves share a cell of at most BLOCK vectors; a larger leaf is a cell of its own, in several blocks
    cell_of, held, cell = {}, 0, 0
    for leaf in sorted(sizes):
        if held and held + sizes[leaf] > BLOCK:
            cell, held = cell + 1, 0
        cell_of[leaf], held = cell, held + sizes[leaf]
    cell_sizes = Counter()
    for leaf, n in sizes.items():
        cell_sizes[cell_of[leaf]] += n

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cells, lists = [], [], []
            for i, q in enumerate(matrix(b.column(1))):
                by_cell: dict[int, list[int]] = {}
                for leaf in tree.value.visit(q, visits, firsts, k + 1):
                    if leaf in cell_of:
                        by_cell.setdefault(cell_of[leaf], []).append(leaf)
                rows += [i] * len(by_cell)
                cells += by_cell.keys()
                lists += by_cell.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(cells, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["vec_id", "v", "cell", "leaves"]
            )

    walked = materialize(asked.mapInArrow(walk, "vec_id bigint, v array<double>, cell bigint, leaves array<bigint>"))
    calls = {r.cell: r.k for r in walked.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).collect()}
    parts = [(int(c), -(-n // BLOCK), -(-calls.get(c, 0) // QUERY_BLOCK)) for c, n in cell_sizes.items()]
    parts = spark.createDataFrame(parts, "cell bigint, vs int, qs int")
    leaves = spark.createDataFrame([(int(leaf), int(c)) for leaf, c in cell_of.items()], "leaf bigint, cell bigint")
    # each block of a cell's vectors meets each block of the queries that visit it; both small tables have a row per leaf at most
    spread = lambda df, own, other: (
        df.join(F.broadcast(parts), "cell")
        .withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        .where(F.col(other) > 0)
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    )

    def meet(found: pa.Table, asking: pa.Table) -> pa.Table:
        found, asking = found.combine_chunks().sort_by("leaf"), asking.combine_chunks()
        who, what, far = [], [], []
        if found.num_rows and asking.num_rows:
            ids, own, leaf = found["vec_id"].to_numpy(), asking["vec_id"].to_numpy(), found["leaf"].to_numpy()
            x, q = (matrix(t.combine_chunks()["v"].combine_chunks()) for t in (found, asking))
            for i, visited in enumerate(asking["leaves"].to_pylist()):
                rows = np.concatenate([np.arange(*np.searchsorted(leaf, [n, n + 1])) for n in visited])
                _, at, d = _top(q[i : i + 1], own[i : i + 1], ids[rows], x[rows], k)
                who.append(np.full(len(at), own[i]))
                what.append(ids[rows[at]])
                far.append(d)
        none = np.zeros(0, np.int64)
        return pa.table({"query_id": np.concatenate([none, *who]), "vec_id": np.concatenate([none, *what]), "score": np.concatenate([np.zeros(0), *far])})

    left = spread(dealt.join(F.broadcast(leaves), "leaf"), "vs", "qs").select("cell", "vs", "qs", "vec_id", "v", "leaf").groupBy("cell", "vs", "qs")
    right = spread(walked, "qs", "vs").select("cell", "vs", "qs", "vec_id", "v", "leaves").groupBy("cell", "vs", "qs")
    near = left.cogroup(right).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(asked: DataFrame, dealt: DataFrame, tree, k: int, trials: int, recall: float) -> int:
    """The least number of leaf visits whose leaves hold ``recall`` of the true neighbours of the trial queries."""
    some = bounded(asked, ["vec_id"], trials, salt=1).toArrow()  # at most ``trials`` rows
    if not some.num_rows:
        return 1
    own, q = some["vec_id"].to_numpy(), matrix(some["v"].combine_chunks())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, what, far = _top(q, own, b.column(0).to_numpy(), matrix(b.column(1)), k)
            yield pa.RecordBatch.from_arrays([pa.array(who), b.column(0).take(pa.array(what)), b.column(2).take(pa.array(what)), pa.array(far)], ["q", "vec_id", "leaf", "far"])

    order = W.partitionBy("q").orderBy("far", "vec_id")
    true = dealt.mapInArrow(scan, "q bigint, vec_id bigint, leaf bigint, far double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    rows = true.select("q", "leaf").collect()  # at most trials * k
    if not rows:
        return 1
    place = [{leaf: n for n, leaf in enumerate(tree.value.visit(v, tree.value.leaves), 1)} for v in q]
    needed = sorted(place[r.q][r.leaf] for r in rows)
    return needed[min(len(needed), int(np.ceil(recall * len(needed)))) - 1]


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)


QUERIES = {"op10_nearest": op10_nearest}
SQL: dict[str, str] = {}
