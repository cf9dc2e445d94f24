"""Registered queries over the driver tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

SPREAD = "spark.hushframe.spread"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.

    A run on one machine may ask for ``documents`` to be spread over its cores
    (``SPREAD``), since its tables are single row groups; on a cluster the setting
    is absent and the scan's own splits are used.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get(SPREAD, None)
    return df.repartition(int(spread)) if spread and name == "documents" else df


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that results compare by value."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(
        *[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def query(name: str, covers: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name`` for survey rows ``covers``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        COVERS[name] = covers.split()
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
