"""Dashboard figures kept beside the rows: partial aggregates for each folder, merged when they are read.

``append_audit(..., rolled=True)`` writes them and publishes them with the rows by the same commit. A part belongs to one
folder of rows and has its name, so a delete, which writes the folders concerned anew, makes their parts anew too and leaves
all others. A retried batch takes its parts' place as it takes its rows'. Folders without parts (older writers) are
aggregated from their rows, so the figures are those of a scan of all rows at any time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.plans import audit as q
from hushframe.plans.store import TABLES, evolve
from hushframe.plans.versions import read_rows, read_version

#: Times are kept by the quarter of an hour: the offsets of all time zones in use are whole quarters, so days of any of them are sums of slots.
SLOT_SECONDS = 900
FIELDS = tuple(q.FACETS.values())


def _slots(rows: DataFrame) -> DataFrame:
    slot = F.timestamp_seconds(F.floor(F.unix_micros("created_at") / (SLOT_SECONDS * 1_000_000)) * SLOT_SECONDS)
    return rows.groupBy(slot.alias("slot"), *FIELDS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("entity_total").alias("entities"),
        F.sum("input_tokens").alias("input"),
        F.sum("output_tokens").alias("output"),
    )


def _types(found: DataFrame) -> DataFrame:
    return found.groupBy("entity_type").agg(F.sum("count").alias("total"))


def _conversations(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("conversation_id").isNotNull()).groupBy("conversation_id").agg(
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.count(F.lit(1)).alias("turn_count"),
        F.sum("entity_total").alias("entity_total"),
        F.collect_set("source").alias("sources"),
        F.collect_set("model").alias("models"),
        F.count_if(F.col("kind") != "main").alias("background_count"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )


def _counts(rows: DataFrame) -> DataFrame:
    entries = rows.filter(F.col("conversation_id").isNotNull()).select("conversation_id", F.explode("entity_counts").alias("k", "v"))
    return entries.groupBy("conversation_id", "k").agg(F.sum("v").alias("v"))


@dataclass(frozen=True)
class Part:
    """A kind of partial aggregate: the table it is of, how it is made from rows, and its schema."""

    table: str
    of: Callable[[DataFrame], DataFrame]
    ddl: str


PARTS = {
    "rolled_slot": Part("interaction", _slots, f"slot TIMESTAMP, {', '.join(f'{f} STRING' for f in FIELDS)}, n BIGINT, entities BIGINT, input BIGINT, output BIGINT"),
    "rolled_type": Part("detection", _types, "entity_type STRING, total BIGINT"),
    "rolled_conversation": Part(
        "interaction",
        _conversations,
        "conversation_id STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, turn_count BIGINT, entity_total BIGINT, sources ARRAY<STRING>, "
        "models ARRAY<STRING>, background_count BIGINT, input_tokens BIGINT, output_tokens BIGINT",
    ),
    "rolled_count": Part("interaction", _counts, "conversation_id STRING, k STRING, v BIGINT"),
}


def _rows(spark: SparkSession, path: str, table: str, folders: list[str]) -> DataFrame:
    return evolve(read_rows(spark, path, table, TABLES[table], folders), TABLES[table])


def roll(spark: SparkSession, path: str, name: str, folders: list[str]) -> list[str]:
    """Write the parts ``name`` of some folders; they have the folders' names."""
    for folder in folders:
        PARTS[name].of(_rows(spark, path, PARTS[name].table, [folder])).write.parquet(f"{path}/{name}/{folder}")
    return folders


@dataclass(frozen=True)
class Rollups:
    """The parts of all folders of a version."""

    slot: DataFrame
    type: DataFrame
    conversation: DataFrame
    count: DataFrame


def read_rollups(spark: SparkSession, path: str, version: int | None = None) -> Rollups:
    """The parts under ``path``; folders that have none are aggregated from their rows."""
    now = read_version(spark, path, version)

    def parts(name: str, part: Part) -> DataFrame:
        rolled, folders = set(now.folders(name)), now.folders(part.table)
        kept = read_rows(spark, path, name, part.ddl, [f for f in folders if f in rolled])
        bare = [f for f in folders if f not in rolled]
        return kept.unionByName(part.of(_rows(spark, path, part.table, bare))) if bare else kept

    return Rollups(*[parts(name, part) for name, part in PARTS.items()])


# --- figures ------------------------------------------------------------------


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def summary(r: Rollups) -> DataFrame:
    """(interactions, entities_total) in one row."""
    n = r.slot.agg(_sum("n").alias("interactions"), F.lit(0).cast("bigint").alias("entities_total"))
    e = r.type.agg(F.lit(0).cast("bigint").alias("interactions"), _sum("total").alias("entities_total"))
    return n.unionByName(e).agg(*[F.sum(c).alias(c) for c in n.columns])


def daily_series(r: Rollups) -> DataFrame:
    """Interactions and findings by day of the session's time zone, oldest first."""
    day = F.date_format("slot", "yyyy-MM-dd").alias("date")
    return r.slot.groupBy(day).agg(_sum("n").alias("interactions"), _sum("entities").alias("entities")).orderBy("date")


def group_counts(r: Rollups) -> DataFrame:
    """(facet, value, n) for source, wire_format, policy, model; nulls left out."""
    names = ["source", "wire_format", "policy", "model"]
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in names])
    few = r.slot.groupBy(*names).agg(F.sum("n").alias("n"))
    return few.select("n", F.explode(pairs).alias("p")).filter("p.value IS NOT NULL").groupBy("p.facet", "p.value").agg(F.sum("n").alias("n"))


def token_totals(r: Rollups) -> DataFrame:
    return r.slot.agg(_sum("input").alias("input"), _sum("output").alias("output"))


def ranked_totals(r: Rollups) -> DataFrame:
    """Entity types by total, largest first."""
    return r.type.groupBy("entity_type").agg(F.sum("total").alias("total")).orderBy(F.col("total").desc(), "entity_type")


def distinct_values(r: Rollups) -> DataFrame:
    """(field, value): the values of the seven filters, empty ones left out."""
    return q.distinct_values(q.Audit(r.slot, r.type, r.type))


def summarize_conversations(r: Rollups, ids: DataFrame | None = None) -> DataFrame:
    """One summary per conversation, of all or of the ``ids`` (one column, conversation_id; few enough for a page)."""
    pick = (lambda df: df) if ids is None else (lambda df: df.join(F.broadcast(ids), "conversation_id", "left_semi"))
    # equal sets of a conversation's parts are one before they are united
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    ones = pick(r.conversation).groupBy("conversation_id").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("turn_count").alias("turn_count"),
        F.sum("entity_total").alias("entity_total"),
        united("sources").alias("sources"),
        united("models").alias("models"),
        *[F.sum(c).alias(c) for c in ("background_count", "input_tokens", "output_tokens")],
    )
    sums = pick(r.count).groupBy("conversation_id", "k").agg(F.sum("v").alias("v"))
    merged = sums.groupBy("conversation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("entity_counts"))
    none = F.create_map().cast("map<string,bigint>")
    return ones.join(merged, "conversation_id", "left").withColumn("entity_counts", F.coalesce("entity_counts", none))


def list_conversations(r: Rollups, page: int = 1, size: int = 50, sort: str = "last_seen", order: str = "desc") -> DataFrame:
    """A page of summaries. Filters look at single rows and stay with ``plans.audit.list_conversations``."""
    figures = {"first_seen": F.min, "last_seen": F.max, "turn_count": F.sum, "entity_total": F.sum}
    sort = sort if sort in figures else "last_seen"
    size = q.page_size(size)
    rank = F.col("sort_key").asc() if order == "asc" else F.col("sort_key").desc()
    keys = r.conversation.groupBy("conversation_id").agg(figures[sort](sort).alias("sort_key"))
    keys = keys.orderBy(rank, "conversation_id").offset((max(1, page) - 1) * size).limit(size)
    out = summarize_conversations(r, keys.select("conversation_id")).join(F.broadcast(keys), "conversation_id")
    return out.orderBy(rank, "conversation_id").drop("sort_key")
