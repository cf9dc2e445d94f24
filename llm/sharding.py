"""Resharding by minimum-cost flow: from the sizes of old shards and the capacities of new ones to the cheapest transfers.

Rows carry their old shard. New shards get equal capacities (law ``bytes``). The flow of all bytes from the old shards to
the capacities, at cost 0 for bytes that stay and 1 for bytes that move, is solved on a graph of old and new shards only. It
says how many bytes of each old shard stay and how many each new shard takes from others; bytes that move cost the same
wherever they go. A row is large if it holds more than ``1 / FINE`` of a capacity; by arithmetic there are at most ``FINE``
times the number of shards of them, so they come to the driver and are placed whole inside those amounts, the largest first,
each where it is while it fits into what stays, else where most is still to be taken. All other rows move in blocks: the same
flow of what is left of the supplies and capacities. Each old shard's rows are cut, in order of a running sum that Spark
computes without gathering a shard in one task, into the blocks the flow asks for. So the bytes that move are the least
possible but for row boundaries.
``rewrite`` writes the new shards whose content changed and leaves the others alone.

Defined results: a null text has size 8 and the checksum of an empty text; null ids, equal texts and repeated rows are rows of their
own and are moved one by one; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections import deque
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.ordered import number_rows, running_sum
from hushframe.session import materialize

SHARDS = 24
OLD_SHARDS = 16
ROW_OVERHEAD = 8
#: A large row holds more than this part of a capacity.
FINE = 1000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each source to each sink that ships all supplies at the least cost; successive shortest paths."""
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    edges: list[list[int]] = []  # to, room, cost
    at: list[list[int]] = [[] for _ in range(m + n + 2)]

    def add(a: int, b: int, room: int, price: int) -> int:
        at[a].append(len(edges))
        edges.append([b, room, price])
        at[b].append(len(edges))
        edges.append([a, 0, -price])
        return len(edges) - 2

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for j, c in enumerate(capacity):
        add(m + j, sink, c, 0)
    total = sum(supply)
    arcs = {(i, j): add(i, m + j, total, cost[i][j]) for i, j in product(range(m), range(n))}
    while True:
        far = [None] * (m + n + 2)
        far[source], come = 0, [0] * (m + n + 2)
        queue, waiting = deque([source]), {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in at[a]:
                b, room, price = edges[e]
                if room and (far[b] is None or far[a] + price < far[b]):
                    far[b], come[b] = far[a] + price, e
                    if b not in waiting:
                        queue.append(b)
                        waiting.add(b)
        if far[sink] is None:
            return [[edges[arcs[i, j] ^ 1][1] for j in range(n)] for i in range(m)]
        path, b = [], sink
        while b != source:
            path.append(come[b])
            b = edges[come[b] ^ 1][0]
        room = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= room
            edges[e ^ 1][1] += room


def row_size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + ROW_OVERHEAD


def old_shard(doc_id: str, shards: int = OLD_SHARDS) -> Column:
    """The layout that the query starts from: rows dealt by a hash of the id over ``shards`` files."""
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def reshard(rows: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """``rows`` (old int, size bigint, key bigint, any other columns) plus ``shard``.

    ``key`` orders rows inside an old shard. Columns of ``rows`` come back with their names.
    """
    spark = rows.sparkSession
    rows = materialize(rows)
    sums = {r.old: r.total for r in rows.groupBy("old").agg(F.sum("size").alias("total")).collect()}  # a row per old shard
    total = sum(sums.values())
    target = [total // shards + (j < total % shards) for j in range(shards)]
    least = max(1, total // shards // fine)
    # at most shards * fine rows, since each holds more than total / shards / fine bytes
    ranked = number_rows(rows.where(F.col("size") > least), ["old"], ["size", "key"], "__rank") if total else rows.limit(0).withColumn("__rank", F.lit(0))
    large = materialize(ranked)
    olds = sorted(sums)
    home = {o: o if 0 <= o < shards else None for o in olds}
    cost = [[0 if home[o] == j else 1 for j in range(shards)] for o in olds]
    whole = min_cost_flow([sums[o] for o in olds], target, cost) if olds else []
    stay = {o: row[home[o]] for o, row in zip(olds, whole) if home[o] is not None}
    take = [sum(row[j] for o, row in zip(olds, whole) if home[o] != j) for j in range(shards)]
    capacity, chosen = list(target), []
    for r in sorted(large.select("old", "size", "__rank").collect(), key=lambda r: (-r["size"], r["old"], r["__rank"])):
        o, size = r["old"], r["size"]
        j = max(range(shards), key=lambda k: (take[k], -k))
        if o in stay and stay[o] >= min(size, take[j]):
            j = home[o]
            stay[o] -= size
        else:
            take[j] -= size
        capacity[j] -= size
        chosen.append((o, r["__rank"], j))
        sums[o] -= size
    # a row larger than any room leaves less than nothing there, and more room elsewhere than the other rows fill
    capacity = [max(0, x) for x in capacity]
    flow = min_cost_flow([sums[o] for o in olds], capacity, cost) if olds else []
    blocks, last = [], {}
    for o, row in zip(olds, flow):
        begin = 0
        for j, n in sorted(enumerate(row), key=lambda x: (x[0] != home[o], x[0])):
            if n:
                blocks.append((o, begin, begin + n, j))
                begin += n
                last[o] = j
    names = rows.columns
    placed = spark.createDataFrame(chosen or [(None, None, None)], "old int, __rank bigint, shard int")
    large = large.join(F.broadcast(placed), ["old", "__rank"])  # at most shards * fine rows
    small = running_sum(rows.where(F.col("size") <= least), ["old"], ["key", "size"], F.col("size"), "__end")
    table = spark.createDataFrame(blocks or [(None, None, None, None)], "__old int, __from bigint, __to bigint, shard int")
    middle = F.col("__end") - F.expr("size div 2")
    # at most old * new blocks; a row goes where its middle lies
    small = small.join(F.broadcast(table), (F.col("old") == F.col("__old")) & (middle > F.col("__from")) & (middle <= F.col("__to")), "left")
    return large.select(*names, "shard").unionByName(small.select(*names, "shard"))


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", old: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, old, shard, slot for every row of ``docs``."""
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        row_size(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        (old_shard(doc_id) if old is None else old).alias("old"),
        F.xxhash64(doc_id, text).alias("key"),
    )
    return number_rows(reshard(rows, shards), ["shard"], ["doc_id", "key"], "__slot").select(
        "doc_id", "size", "text_crc32", "old", "shard", (F.col("__slot") - 1).alias("slot")
    )


def rewrite(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", old: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """Write the new shards that differ from the old ones under ``path``/shard=N with all columns; returns shard, rows, moved.

    Column names of ``docs`` other than ``shard`` are free.
    """
    key = F.xxhash64(doc_id, text)
    before = old_shard(doc_id) if old is None else old
    rows = docs.select(row_size(text).alias("size"), before.alias("old"), key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    placed = materialize(reshard(rows, shards))
    moved = F.col("old") != F.col("shard")
    into = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(moved.cast("bigint")).alias("moved"))
    out_of = placed.where(moved).select(F.col("old").alias("shard")).distinct().withColumn("lost", F.lit(True))
    changed = materialize(into.join(out_of, "shard", "left").where("moved > 0 OR lost").select("shard", "rows", "moved"))
    body = placed.join(F.broadcast(changed.select("shard")), "shard").select("row.*", "shard")  # a row per shard
    body.write.mode("overwrite").partitionBy("shard").parquet(path)
    return changed


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old")


QUERIES = {"op8_sharding": op8_sharding}
SQL: dict[str, str] = {}
