"""Import of past sessions into the audit tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import choose_spans
from hushframe.operators.detectors import Detector, explode_spans
from hushframe.operators.ordered import number_rows
from hushframe.operators.vault import build_vault, counts_map, extend_vault, pseudonymize, type_counts
from hushframe.plans.audit import Audit, page_size
from hushframe.plans.store import record_id
from hushframe.session import materialize


@dataclass(frozen=True)
class Imported:
    """New audit rows (None for a dry run), one row of counters, and the vault of the sessions (None for a dry run)."""

    audit: Audit | None
    counters: DataFrame
    vault: DataFrame | None = None


def drop_excluded(sessions: DataFrame, exclude: Sequence[str] | None) -> DataFrame:
    """Leave out deselected ids; a file without an id in its name cannot be deselected."""
    if not exclude:
        return sessions
    return sessions.filter(F.col("session_hint").isNull() | ~F.col("session_hint").isin(list(exclude)))


def new_sessions(sessions: DataFrame, turn_rows: DataFrame, known: DataFrame) -> DataFrame:
    """(path, session_id) to import: not known by file name or by real id, first file of an id.

    ``known`` has one column conversation_id.
    """
    ids = known.select(F.col("conversation_id").alias("session_hint")).filter("session_hint is not null").distinct()
    fresh = sessions.join(ids, "session_hint", "left_anti")
    parsed = turn_rows.select("path", "session_id").distinct()
    real = fresh.join(parsed, "path").join(ids.withColumnRenamed("session_hint", "session_id"), "session_id", "left_anti")
    first = real.groupBy("session_id").agg(
        F.min_by("path", F.struct("source", "modified_at", "path")).alias("path")
    )
    return first.select("path", "session_id")


def import_sessions(
    sessions: DataFrame,
    turn_rows: DataFrame,
    segment_rows: DataFrame,
    known: DataFrame,
    detect: Detector,
    exclude: Sequence[str] | None = None,
    dry_run: bool = False,
    save: str = "anonymized",
    vault: DataFrame | None = None,
) -> Imported:
    """Audit rows of all sessions that are new, one vault per session.

    With ``vault`` (of an earlier import, or kept by ``plans.vaults``) the numbering of a session goes on from it, and what
    it holds keeps its placeholder. Segments stay rows throughout, so neither a session nor a turn has to fit in
    one task, and whole texts are read.
    """
    found = drop_excluded(sessions, exclude)
    # both feed the counters and several joins
    chosen = materialize(new_sessions(found, turn_rows, known))
    turns = materialize(turn_rows.join(chosen.select("path"), "path", "left_semi"))
    failed = unreadable(found, turn_rows, known)
    if dry_run:
        return Imported(None, counters(found, chosen, turns, failed, None))

    segs = segment_rows.join(chosen.select("path"), "path", "left_semi")
    segs = materialize(segs.withColumn("spans", choose_spans(detect(F.col("text")))))
    spans = explode_spans(segs, keep=["session_id", "turn_no", "block", "line", "i"])
    order = ["turn_no", "block", "line", "i", "start"]
    vault = build_vault(spans, order, "session_id") if vault is None else extend_vault(vault, spans, order, "session_id")
    rendered = pseudonymize(segs, vault, ["session_id", "turn_no", "block", "line", "i"], scope="session_id")
    counts = counts_map(type_counts(spans, ["session_id", "turn_no"]), ["session_id", "turn_no"])

    none = F.create_map().cast("map<string,bigint>")
    interaction = turns.join(counts, ["session_id", "turn_no"], "left").select(
        record_id(F.col("session_id"), F.col("turn_no")).alias("id"),
        F.coalesce("ts", F.current_timestamp()).alias("created_at"),
        "source",
        "wire_format",
        F.lit("main").alias("kind"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.lit("imported").alias("policy"),
        F.lit(None).cast("string").alias("language"),
        "input_tokens",
        "output_tokens",
        F.aggregate(F.map_values(F.coalesce("entity_counts", none)), F.lit(0).cast("bigint"), lambda x, y: x + y).alias("entity_total"),
        F.coalesce("entity_counts", none).alias("entity_counts"),
        F.col("session_id").alias("conversation_id"),
    )
    detection = interaction.select("id", F.explode("entity_counts").alias("entity_type", "count")).select(
        record_id(F.col("id"), F.col("entity_type")).alias("id"), F.col("id").alias("interaction_id"), "entity_type", "count"
    )
    saved = rendered if save == "all" else rendered.filter(F.col("text") != F.col("anonymized"))
    saved = saved.select(
        record_id(F.col("session_id"), F.col("turn_no")).alias("interaction_id"),
        "block", "line", "i", "category", F.col("text").alias("original"), "anonymized",
    )
    numbered = number_rows(saved, ["interaction_id"], ["block", "line", "i"], "n")
    text = numbered.select(
        record_id(F.col("interaction_id"), F.col("n")).alias("id"),
        "interaction_id",
        (F.col("n") - 1).cast("int").alias("seq"),
        "category",
        "original",
        "anonymized",
    )
    return Imported(Audit(interaction, detection, text), counters(found, chosen, turns, failed, interaction), vault)


def unreadable(found: DataFrame, turn_rows: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions not known by file name that give no turn."""
    ids = known.select(F.col("conversation_id").alias("session_hint")).filter("session_hint is not null").distinct()
    return found.join(ids, "session_hint", "left_anti").join(turn_rows.select("path").distinct(), "path", "left_anti")


def counters(found: DataFrame, chosen: DataFrame, turns: DataFrame, failed: DataFrame, interaction: DataFrame | None) -> DataFrame:
    """One row: found, skipped, failed, imported, turns, entities."""
    part = lambda name, c, df: df.agg(c.cast("bigint").alias("v")).select(F.lit(name).alias("k"), "v")
    rows = (
        part("found", F.count(F.lit(1)), found)
        .unionByName(part("imported", F.count(F.lit(1)), chosen))
        .unionByName(part("turns", F.count(F.lit(1)), turns))
        .unionByName(part("failed", F.count(F.lit(1)), failed))
    )
    if interaction is not None:
        rows = rows.unionByName(part("entities", F.coalesce(F.sum("entity_total"), F.lit(0)), interaction))
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0))
    return rows.agg(
        pick("found").alias("found"),
        (pick("found") - pick("imported") - pick("failed")).alias("skipped"),
        pick("failed").alias("failed"),
        pick("imported").alias("imported"),
        pick("turns").alias("turns"),
        pick("entities").alias("entities"),
    )


def preview_sources(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """(source, found, new, imported) of discovered session files."""
    ids = known.select(F.col("conversation_id").alias("session_hint")).filter("session_hint is not null").distinct()
    flagged = sessions.join(ids.withColumn("hit", F.lit(True)), "session_hint", "left")
    return flagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("hit").isNull()).alias("new"),
        F.count_if(F.col("hit").isNotNull()).alias("imported"),
    )


def preview_sessions(
    sessions: DataFrame, known: DataFrame, title_rows: DataFrame | None = None, limit: int = 200
) -> DataFrame:
    """The newest ``limit`` sessions with title, project and imported flag.

    ``title_rows`` (path, title, cwd) is given only when plaintext may be shown;
    otherwise titles are null.
    """
    newest = sessions.orderBy(F.col("modified_at").desc(), "path").limit(page_size(limit))
    ids = known.select(F.col("conversation_id").alias("session_hint")).filter("session_hint is not null").distinct()
    out = newest.join(ids.withColumn("imported", F.lit(True)), "session_hint", "left")
    if title_rows is not None:
        out = out.join(title_rows, "path", "left")
        project = F.coalesce("project", "cwd")
        title = F.col("title")
    else:
        project, title = F.col("project"), F.lit(None).cast("string")
    return out.select(
        "source",
        F.col("session_hint").alias("id"),
        title.alias("title"),
        project.alias("project"),
        "modified_at",
        F.coalesce("imported", F.lit(False)).alias("imported"),
    ).orderBy(F.col("modified_at").desc(), "id")


