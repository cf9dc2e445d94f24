"""Centroid clustering (k-means on integers) filtered by n-simplex projection.

1. Vectors are kept as integers. A few of them, the pivots, span a simplex. Every vector's distances to the pivots are
   measured once and cached as the coordinates of an apex over that simplex: its foot in the pivots' span and its height.
2. A centroid gets an apex of the same base in each round. Between two apexes, the distance with both heights on the same
   side is never more than the true distance, and with the heights on opposite sides never less.
3. A vector's least upper bound over all centroids rules out those whose lower bound lies above it (with a slack far beyond
   rounding). The rest are compared by exact integer distances, ties to the smaller number.
4. A round is one pass over the cached vectors: each task gives one row of exact sums per cluster, Spark adds them up, and
   the driver holds k centroids. No vector is shuffled, so repeated vectors make no hot group.

Defined results: vectors with another length, null, or with a null or non-finite component take no part and give no row;
a null id counts as the text ``1:`` in the order of the first centroids and keeps its row; rows of one id are vectors of
their own, and among equal hashes the smaller vector comes first; with fewer vectors than ``k`` all are centroids; an empty
table gives no rows; other columns play no part, whatever their names. A component whose integer is not below 2**28 in size
raises, since its squares would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.session import materialize

K = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
PIVOTS = 8
#: Slack of the bounds, as a share of the squared distances at hand.
SLACK = 1e-6
#: A pivot must stand out of the span of those before it by this share of its squared distance.
STANDS_OUT = 1e-3
_LIMIT = 1 << 28


class Simplex:
    """The base that the pivots span: distances in, apex coordinates (foot, height) out."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS):
        """Of the candidates, in order, those that stand out of the span of the ones before."""
        self.pivots = candidates[:1].astype(np.int64)
        lower = np.zeros((0, 0))
        for v in candidates[1:]:
            if len(self.pivots) == most:
                break
            edges = (self.pivots[1:] - self.pivots[0]).astype(float)
            own = (v - self.pivots[0]).astype(float)
            foot = np.linalg.solve(lower, edges @ own) if len(edges) else np.zeros(0)
            height = own @ own - foot @ foot
            if height > STANDS_OUT * (own @ own):
                grown = np.zeros((len(lower) + 1, len(lower) + 1))
                grown[:-1, :-1], grown[-1, :-1], grown[-1, -1] = lower, foot, np.sqrt(height)
                lower = grown
                self.pivots = np.vstack([self.pivots, v])
        self.lower = lower
        self.edges = ((self.pivots[1:] - self.pivots[0]).astype(float) ** 2).sum(1)

    def measure(self, vectors: np.ndarray) -> np.ndarray:
        """Exact squared distances to all pivots."""
        return np.stack([((vectors - p) ** 2).sum(1) for p in self.pivots], 1)

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """Coordinates from squared distances: the foot in the span of the pivots, then the height, 0 or more."""
        d = squared.astype(float)
        right = (d[:, :1] - d[:, 1:] + self.edges) / 2
        foot = np.linalg.solve(self.lower, right.T).T if len(self.lower) else np.zeros((len(d), 0))
        return np.column_stack([foot, np.sqrt(np.maximum(d[:, 0] - (foot**2).sum(1), 0))])


def nearest(vectors: np.ndarray, apexes: np.ndarray, centers: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its exact squared distance, and how many exact distances that took."""
    over = simplex.apexes(simplex.measure(centers))
    foot = (apexes[:, None, :-1] - over[None, :, :-1]) ** 2
    base = foot.sum(2)
    low = base + (apexes[:, None, -1] - over[None, :, -1]) ** 2
    high = base + (apexes[:, None, -1] + over[None, :, -1]) ** 2
    slack = SLACK * ((apexes**2).sum(1)[:, None] + (over**2).sum(1)[None, :] + 1)
    row, number = np.nonzero(low - slack <= (high + slack).min(1)[:, None])
    exact = ((vectors[row] - centers[number]) ** 2).sum(1)
    # rows ascend and numbers ascend inside a row, so the first of the least is the smaller number
    order = np.lexsort((number, exact, row))
    first = order[np.searchsorted(row[order], np.arange(len(vectors)))]
    return number[first].astype(np.int32), exact[first], len(row)


def _pack(whole: np.ndarray) -> pa.Array:
    """Integers as bytes that sort as the vectors do."""
    return pa.array([x.tobytes() for x in (whole.astype(np.int64) + _LIMIT).astype(">u4")], pa.binary())


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, dimensions).astype(np.int64) - _LIMIT


def kept(table: DataFrame, vec_id: str, embedding: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id and the integers of every vector that takes part, packed."""
    rows = table.select(table[vec_id].cast("bigint").alias("vec_id"), table[embedding].cast("array<double>").alias("v")).where(F.size("v") == dimensions)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # nulls become NaN
            good = np.isfinite(values).all(1)
            whole = np.floor(values[good] * scale)
            if (np.abs(whole) >= _LIMIT).any():
                raise ValueError("a component is too large for exact squared distances in a long")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), _pack(whole)], ["vec_id", "vector"])

    return rows.mapInArrow(work, "vec_id bigint, vector binary")


def _first(vectors: DataFrame, k: int, dimensions: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids; each task brings its ``k`` best."""
    hashed = vectors.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "vector")
    chosen = hashed.orderBy("h", "vector").limit(k).collect()
    return _matrix(pa.array([bytes(r.vector) for r in chosen], pa.binary()), dimensions)


def cluster(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, pivots: int = PIVOTS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, compared) for every vector, and the final centroids; ``compared`` counts exact distances per batch."""
    vectors = materialize(kept(table, vec_id, embedding, dimensions, scale))
    centers = _first(vectors, k, dimensions)
    if not len(centers):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).cast("bigint").alias("compared")), centers
    simplex = Simplex(centers, pivots)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(simplex.measure(_matrix(batch.column(1), dimensions)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in apexes], pa.binary())], ["vec_id", "vector", "apex"])

    cached = materialize(vectors.mapInArrow(project, "vec_id bigint, vector binary, apex binary"))

    def judged(batch: pa.RecordBatch, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        own = _matrix(batch.column(1), dimensions)
        apexes = np.frombuffer(b"".join(batch.column(2).to_pylist()), float).reshape(len(own), -1)
        return own, *nearest(own, apexes, centers, simplex)

    for _ in range(rounds):
        now = centers

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for batch in batches:
                if batch.num_rows:
                    own, number, _, _ = judged(batch, now)
                    np.add.at(total, number, own)
                    count += np.bincount(number, minlength=len(now))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"]
            )

        parts = cached.mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
        added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dimensions)]).collect()  # k rows
        centers = now.copy()
        for r in added:
            centers[r.cluster] = [r[2 + i] // r.n for i in range(dimensions)]
    last = centers

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, number, distance, compared = judged(batch, last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(number), pa.array(distance), pc.fill_null(pa.nulls(batch.num_rows, pa.int64()), compared)],
                    ["vec_id", "cluster", "distance", "compared"],
                )

    return materialize(cached.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint, compared bigint")), centers


def report(assigned: DataFrame, centers: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the digest of the vector's centroid."""
    spark = assigned.sparkSession
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centers.tolist())]
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = inertia.agg(F.sum("cluster_inertia")).first()[0]
    known = digests.join(inertia, "cluster").withColumn("inertia", F.lit(total).cast("bigint"))
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return report(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


_ASSIGN = """
near{n} AS (
  SELECT row_no, arg_min(number, (distance, number)) AS number, min(distance) AS distance FROM (
    SELECT v.row_no, c.number, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::BIGINT AS distance FROM vecs v, centers{n} c)
  GROUP BY row_no)"""
_MOVE = """
sums{n} AS (
  SELECT near{n}.number, i, sum(v.v[i]) AS total, count(*) AS n
  FROM near{n} JOIN vecs v USING (row_no), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
centers{m} AS (
  SELECT c.number, coalesce(s.v, c.v) AS v FROM centers{n} c LEFT JOIN (
    SELECT number, list((total - ((total % n) + n) % n)::BIGINT // n::BIGINT ORDER BY i) AS v FROM sums{n} GROUP BY number) s USING (number))"""

SQL = {
    "op13_centroid_clustering": """
WITH vecs AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
centers0 AS (
  SELECT number, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS number, v FROM vecs) WHERE number < 16),"""
    + ",".join(_ASSIGN.format(n=n) + "," + _MOVE.format(n=n, m=n + 1) for n in range(3))
    + ","
    + _ASSIGN.format(n=3)
    + """
SELECT vec_id, near3.number::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY near3.number)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near3 JOIN vecs USING (row_no) JOIN centers3 c ON c.number = near3.number"""
}
QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
