"""Running sums and numbering inside groups of any size.

A window over ``partitionBy(key)`` sends a whole key to one task; a key with a
third of all rows would sit there alone. Here rows are range-partitioned by
(key, order) so that a big key spreads over many partitions, each partition is
summed on its own, and the sums of earlier partitions are added as a carry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hushframe.session import materialize


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` plus ``name``: the sum of ``value`` from the first row of the key up to this one.

    ``order`` must be total inside a key. The cut into partitions is written
    once (checkpoint), since all later steps must see the same cut.
    """
    ranged = (
        df.withColumn("__v", value.cast("bigint"))
        .repartitionByRange(*keys, *order)
        .withColumn("__part", F.spark_partition_id())
    )
    ranged = materialize(ranged)
    local = (
        W.partitionBy("__part", *keys)
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        ranged.groupBy("__part", *keys)
        .agg(F.sum("__v").alias("__t"))
        .withColumn("__carry", F.sum("__t").over(before))
        .filter(F.col("__carry").isNotNull())
        .select(
            F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__carry"
        )
    )
    # A partition continues at most one key, so the carry has fewer rows than
    # there are partitions: a bound that does not grow with the data.
    match = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (
        ranged.withColumn("__local", F.sum("__v").over(local))
        .join(F.broadcast(carry), match, "left")
        .withColumn(name, F.col("__local") + F.coalesce(F.col("__carry"), F.lit(0)))
        .select(*df.columns, name)
    )


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """1, 2, 3 ... inside each key by ``order``."""
    return running_sum(df, keys, order, F.lit(1), name)


# A key is hot when it has more than this share of all uses; fewer keys than
# this number can be, which bounds what is broadcast.
HOT_PARTS = 1000


def lookup(left: DataFrame, table: DataFrame, on: list[str], take: str) -> DataFrame:
    """Left join of many rows to a table with one row per key and a ``uses`` column; null keys meet null keys.

    Hot keys (at most ``HOT_PARTS`` of them) come by broadcast, and their rows get
    a salted key so that the shuffle join of the rest does not pile them up.
    """
    total = table.agg(F.sum("uses")).first()[0] or 0
    own = [F.col(k).alias(f"__on{i}") for i, k in enumerate(on)]
    match = lambda: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__on{i}")) for i, k in enumerate(on)])
    hot = table.filter(F.col("uses") * HOT_PARTS > F.lit(total)).select(*own, F.col(take).alias("__hot"))
    cold = table.select(
        *own, F.when(F.col("uses") < 0, 1).otherwise(0).cast("long").alias("__cut"), F.col(take).alias("__cold")
    )
    salted = left.join(F.broadcast(hot), match(), "left").select(*left.columns, "__hot").withColumn(
        "__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.abs(F.xxhash64(*left.columns) % 65536) + 1).cast("long")
    )
    return salted.join(cold, match() & (F.col("__salt") == F.col("__cut")), "left").select(
        *left.columns, F.coalesce("__hot", "__cold").alias(take)
    )
