"""A vault that is kept: batches add to it, nothing in it changes.

Under a path lie two tables, named by versions (``plans.versions``): ``entry`` (scope, label, value, n, placeholder) and
``uses`` (scope, label, value, uses), each batch with its own folders. A batch that is already there adds nothing, so a
retried micro-batch finds the placeholders it gave before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.spans import choose_spans
from hushframe.operators.detectors import Detector, explode_spans
from hushframe.operators.vault import new_entries, pseudonymize
from hushframe.plans.versions import Batches, Version, change, read_rows, read_version, write_rows
from hushframe.session import materialize

ENTRY = "scope STRING, label STRING, value STRING, n BIGINT, placeholder STRING"
USES = "scope STRING, label STRING, value STRING, uses BIGINT"


def _vault(spark: SparkSession, path: str, now: Version) -> DataFrame:
    entry = read_rows(spark, path, "entry", ENTRY, now.folders("entry"))
    uses = read_rows(spark, path, "uses", USES, now.folders("uses"))
    # both have one row a value after the sum, so no key is hot
    summed = uses.groupBy("scope", "label", "value").agg(F.sum("uses").alias("uses"))
    match = [entry[c].eqNullSafe(summed[c]) for c in ("scope", "label", "value")]
    return entry.join(summed, match, "left").select(entry["*"], F.coalesce("uses", F.lit(0)).alias("uses"))


def read_vault(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The vault as the newest (or a given) version has it: scope, label, value, n, placeholder, uses."""
    return _vault(spark, path, read_version(spark, path, version))


def grow_vault(spans: DataFrame, path: str, batch: str, order: list[str], scope: str = "scope") -> Version:
    """Add a batch of spans to the vault under ``path``; they count as later than all that is in it.

    Entries and uses appear together. Of two writers at once, one numbers its batch again on top of the other's.
    """
    spark = spans.sparkSession
    named = spans.withColumn(scope, F.col(scope).cast("string"))

    def step(now: Version) -> Batches | None:
        if batch in now.batches:
            return None
        entries, uses = new_entries(_vault(spark, path, now), named, order, scope)
        keys = ["scope", "label", "value"]
        folders = {"entry": write_rows(entries.drop("uses"), path, "entry", batch, keys), "uses": write_rows(uses, path, "uses", batch, keys)}
        return {**now.batches, batch: folders}

    return change(spark, path, step)


def start_pseudonyms(
    lines: DataFrame, detect: Detector, vault_path: str, out: str, checkpoint: str, key: list[str], order: list[str], scope: str = "scope", text: str = "text", **trigger
):
    """Pseudonymize lines as they arrive with one vault per scope that lives on from batch to batch and from run to run.

    The state is the kept vault and not the stream's: it has no size limit, a scope spreads over many tasks, and batch
    imports can go on from it. Each micro-batch first adds its values, then is rendered by the vault and written to a
    folder named after it, so a retry gives the same lines again. ``key`` is unique per line; ``order`` are its columns in
    reading order, a value's place in the line comes after them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = materialize(batch.withColumn("spans", choose_spans(detect(F.col(text)))))
        spans = explode_spans(found, text, keep=[*dict.fromkeys([scope, *order])])
        grow_vault(spans, vault_path, f"lines-{batch_id}", [*order, "start"], scope)
        named = found.withColumn("__scope", F.col(scope).cast("string"))
        done = pseudonymize(named, read_vault(spark, vault_path), key, "__scope", text)
        done.drop("spans", "__scope", text).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
