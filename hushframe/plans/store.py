"""Writing the audit tables: append, evolve, delete, clear, export."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.plans.audit import Audit, all_interactions, expose, filter_interactions, nested_detections
from hushframe.plans.versions import Batches, Version, change, read_rows, read_version, write_rows
from hushframe.session import materialize

# An id is a number of up to 38 digits: two 63-bit hashes, or any smaller number a caller has.
ID = "DECIMAL(38,0)"
INTERACTION = (
    f"id {ID}, created_at TIMESTAMP, source STRING, wire_format STRING, kind STRING, model STRING, policy STRING, "
    "language STRING, input_tokens BIGINT, output_tokens BIGINT, entity_total BIGINT, "
    "entity_counts MAP<STRING,BIGINT>, conversation_id STRING"
)
DETECTION = f"id {ID}, interaction_id {ID}, entity_type STRING, count BIGINT"
TEXT = f"id {ID}, interaction_id {ID}, seq INT, category STRING, original STRING, anonymized STRING"
TABLES = {"interaction": INTERACTION, "detection": DETECTION, "interaction_text": TEXT}

# Defaults of columns that older tables lack, and of columns a record may leave out.
DEFAULTS = {"kind": "main", "policy": "pseudonymize", "category": "user"}


def record_id(*parts: Column) -> Column:
    """A stable positive id of 126 bits from the event's own key, so that a replay gives the same rows."""
    high, low = (F.xxhash64(F.lit(salt), *parts).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).cast("decimal(19,0)") for salt in (1, 2))
    return (high * F.lit(str(1 << 63)).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def to_audit(records: DataFrame) -> Audit:
    """Split captured records into the three tables.

    A record: id, source, wire_format, model, entity_counts, and optionally kind,
    policy, language, input_tokens, output_tokens, conversation_id, created_at,
    texts (array of category/original/anonymized in capture order). Zero counts
    are dropped and a missing time is now. Records are written once (checkpoint),
    as three tables read them.
    """
    records = materialize(records)
    have = set(records.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(DEFAULTS.get(name)).cast(kind)

    counts = F.map_filter(F.col("entity_counts").cast("map<string,bigint>"), lambda k, v: v != 0)
    records = records.withColumn("id", F.col("id").cast(ID))
    base = records.withColumn("__counts", F.coalesce(counts, F.create_map().cast("map<string,bigint>")))
    created = F.coalesce(F.col("created_at"), F.current_timestamp()) if "created_at" in have else F.current_timestamp()
    total = F.aggregate(F.map_values("__counts"), F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    interaction = base.select(
        "id",
        created.alias("created_at"),
        "source",
        "wire_format",
        F.coalesce(col("kind", "string"), F.lit("main")).alias("kind"),
        "model",
        F.coalesce(col("policy", "string"), F.lit("pseudonymize")).alias("policy"),
        col("language", "string").alias("language"),
        col("input_tokens", "bigint").alias("input_tokens"),
        col("output_tokens", "bigint").alias("output_tokens"),
        total.alias("entity_total"),
        F.col("__counts").alias("entity_counts"),
        col("conversation_id", "string").alias("conversation_id"),
    )
    detection = base.select("id", F.explode("__counts").alias("entity_type", "count")).select(
        record_id(F.col("id"), F.col("entity_type")).alias("id"), F.col("id").alias("interaction_id"), "entity_type", "count"
    )
    if "texts" in have:
        rows = base.select("id", F.posexplode("texts").alias("seq", "t"))
        text = rows.select(
            record_id(F.col("id"), F.col("seq")).alias("id"),
            F.col("id").alias("interaction_id"),
            "seq",
            F.coalesce("t.category", F.lit("user")).alias("category"),
            "t.original",
            "t.anonymized",
        )
    else:
        text = records.sparkSession.createDataFrame([], TEXT)
    return Audit(interaction, detection, text)


LAYOUT = {"interaction": ["created_at", "id"], "detection": ["interaction_id", "id"], "interaction_text": ["interaction_id", "seq"]}


def append_audit(a: Audit, path: str, batch: str | None = None, searchable: bool = False, rolled: bool = False) -> Version:
    """Append three tables under ``path`` by one commit.

    All rows are written to new folders before one version names them, so a crash between the tables leaves none of the
    batch. A batch that is written again takes the place of its first writing and no other's, so a retried micro-batch
    leaves one copy. Rows are laid out by time (children by their interaction), so that file and row-group statistics
    prune date filters and look-ups without one small file per day. With ``searchable`` each file of texts gets a
    signature, so that ``plans.search`` opens only the files that can hold a match. With ``rolled`` each folder gets its
    partial aggregates, so that ``plans.rollups`` reads these and not the rows.
    """
    batch = batch or uuid.uuid4().hex
    frames = {"interaction": a.interaction, "detection": a.detection, "interaction_text": a.text}
    folders = {name: write_rows(df, path, name, batch, LAYOUT[name]) for name, df in frames.items()}
    spark = a.interaction.sparkSession
    if searchable:
        folders[SIGNATURES] = _signed(spark, path, folders["interaction_text"])
    if rolled:
        from hushframe.plans.rollups import PARTS, roll

        folders |= {name: roll(spark, path, name, folders[part.table]) for name, part in PARTS.items()}
    return change(spark, path, lambda now: {**now.batches, batch: folders})


SIGNATURES = "text_signature"


def _signed(spark: SparkSession, path: str, folders: list[str]) -> list[str]:
    from hushframe.plans.search import sign_texts

    for folder in folders:
        sign_texts(spark, path, folder)
    return folders


def read_audit(spark: SparkSession, path: str, version: int | None = None) -> Audit:
    """The tables as the newest (or a given) version has them, with columns that older files lack filled by their default."""
    now = read_version(spark, path, version)
    return Audit(*[evolve(read_rows(spark, path, name, ddl, now.folders(name)), ddl) for name, ddl in TABLES.items()])


def evolve(df: DataFrame, ddl: str) -> DataFrame:
    """Bring a frame of an older schema to ``ddl``: added columns get their default."""
    target = df.sparkSession.createDataFrame([], ddl)
    wide = df.unionByName(target, allowMissingColumns=True)
    out = []
    for f in target.schema.fields:
        c = F.col(f.name)
        if f.name in ("kind", "category") and f.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[f.name]))
        out.append(c.cast(f.dataType).alias(f.name))
    return wide.select(*out)


def without(a: Audit, interaction_id: int) -> tuple[Audit, DataFrame]:
    """The tables without one interaction and its children, and a row saying if it was there."""
    gone = F.col("id") == interaction_id
    child = F.col("interaction_id") == interaction_id
    existed = a.interaction.filter(gone).agg((F.count(F.lit(1)) > 0).alias("deleted"))
    return Audit(a.interaction.filter(~gone), a.detection.filter(~child), a.text.filter(~child)), existed


def delete_interaction(spark: SparkSession, path: str, interaction_id: int) -> bool:
    """Delete one interaction and its children from the tables under ``path``; says if it was there.

    Folders that hold it are written again as new ones, and one version puts them in the old ones' place in all tables.
    Signatures and partial aggregates of these folders are made anew.
    """
    from hushframe.plans.rollups import PARTS, roll

    existed = False

    def step(now: Version) -> Batches | None:
        nonlocal existed
        existed, instead = False, {}
        for name, ddl in TABLES.items():
            own = F.col("id" if name == "interaction" else "interaction_id") == interaction_id
            known = now.folders(name)
            rows = read_rows(spark, path, name, ddl, known).filter(own) if known else None
            files = [r[0] for r in rows.select("_metadata.file_path").distinct().collect()] if known else []  # those that hold one interaction
            held = sorted({f.split("/")[-2] for f in files})
            existed |= bool(held) and name == "interaction"
            for folder in held:
                left = read_rows(spark, path, name, ddl, [folder]).filter(~F.coalesce(own, F.lit(False)))
                instead[name, folder] = write_rows(left, path, name, "kept", LAYOUT[name])
        if not instead:
            return None
        # rewritten texts are signed if they were; a signature has its folder's name
        for folder in set(now.folders(SIGNATURES)) & {f for t, f in instead if t == "interaction_text"}:
            instead[SIGNATURES, folder] = _signed(spark, path, instead["interaction_text", folder])
        for part in PARTS:
            for folder in set(now.folders(part)) & {f for t, f in instead if t == PARTS[part].table}:
                instead[part, folder] = roll(spark, path, part, instead[PARTS[part].table, folder])
        return {b: {t: [x for f in folders for x in instead.get((t, f), [f])] for t, folders in tables.items()} for b, tables in now.batches.items()}

    change(spark, path, step)
    return existed


def rewrite(a: Audit, path: str) -> None:
    """Write the tables to a new folder (a delete is a rewrite; the caller switches folders)."""
    append_audit(a, path, batch="rewrite")


def clear_all(spark: SparkSession, path: str, confirm: bool = False) -> int:
    """Empty all tables; gives the number of interactions removed. Needs ``confirm=True``."""
    if confirm is not True:
        raise ValueError("pass confirm=True to clear the whole audit log")
    removed = 0

    def step(now: Version) -> Batches:
        nonlocal removed
        removed = read_audit(spark, path, now.number if now.number >= 0 else None).interaction.count()
        return {}

    change(spark, path, step)
    return removed


# --- exports ----------------------------------------------------------------

# The columns of an export, in order.
EXPORT_COLUMNS = (
    "id", "created_at", "source", "wire_format", "kind", "model", "policy", "language",
    "input_tokens", "output_tokens", "entity_total", "entity_counts",
)


def csv_rows(a: Audit, **filters) -> DataFrame:
    """Export rows, newest first: counts as JSON text, nulls blank, time in ISO form."""
    rows = all_interactions(a, **filters)
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    return rows.select(
        "id",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        "source",
        "wire_format",
        "kind",
        "model",
        "policy",
        blank("language"),
        blank("input_tokens"),
        blank("output_tokens"),
        "entity_total",
        F.to_json("entity_counts").alias("entity_counts"),
    )


def export_csv(a: Audit, path: str, **filters) -> None:
    csv_rows(a, **filters).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


# Texts of one interaction go out in pieces of this many, each its own line, so a
# huge interaction is many lines and not one task.
TEXTS_PER_LINE = 1000


def json_rows(a: Audit, include_texts: bool = False, plaintext: bool = False, **filters) -> DataFrame:
    """Nested export rows: an interaction with its detections and, if asked, its texts.

    ``part`` counts the lines of an interaction; all but very long ones have one.
    """
    rows = filter_interactions(a, **filters)
    out = rows.select(*EXPORT_COLUMNS).join(nested_detections(a.detection), "id", "left")
    if not include_texts:
        return out
    entry = F.struct("seq", "id", "category", "original", "anonymized")
    texts = (
        expose(a.text, plaintext)
        .groupBy(F.col("interaction_id"), F.floor(F.col("seq") / TEXTS_PER_LINE).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("texts"))
        .withColumnRenamed("interaction_id", "id")
    )
    return out.join(texts, "id", "left").withColumn("part", F.coalesce("part", F.lit(0)))


def export_json(a: Audit, path: str, include_texts: bool = False, plaintext: bool = False, **filters) -> None:
    """JSON lines, newest first."""
    df = json_rows(a, include_texts, plaintext, **filters)
    order = [F.col("created_at").desc(), "id"] + (["part"] if include_texts else [])
    df.orderBy(*order).write.mode("overwrite").json(path)
