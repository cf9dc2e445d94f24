"""Continuous audit: request logs and telemetry as streams into the audit tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.detectors import Detector
from hushframe.operators.telemetry import scrub_payloads, split_valid, telemetry_interactions
from hushframe.plans.live import judge_requests, with_language
from hushframe.plans.store import append_audit, record_id, to_audit
from hushframe.session import materialize


def start_request_audit(
    requests: DataFrame,
    detect: Detector,
    action: Callable[[Column], Column],
    path: str,
    checkpoint: str,
    mode: str = "pseudonymize",
    save: str = "anonymized",
    profiles: DataFrame | None = None,
    rolled: bool = False,
    **trigger,
):
    """Judge requests as they arrive and append them. No state: a request carries its history.

    Folders are named by micro-batch, so a retried batch replaces itself. With
    ``profiles`` (of ``fit_profiles``) a row gets the language of its new texts;
    ``rolled`` keeps the dashboard figures up to date with every micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        records = judge_requests(batch, detect, action, mode, save)
        if profiles is not None:
            records = with_language(records, profiles)
        append_audit(to_audit(records), path, batch=f"requests-{batch_id}", rolled=rolled)

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_telemetry_scrub(
    payloads: DataFrame, detect: Detector, forward: str, path: str, checkpoint: str, rejects: str | None = None, **trigger
):
    """Scrub payloads (payload_id, signal, body): forward all, audit logs with findings, set rejects aside."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_valid(batch)
        done = materialize(scrub_payloads(good, detect))
        done.drop("counts").write.mode("overwrite").parquet(f"{forward}/batch={batch_id}")
        records = telemetry_interactions(done).withColumn("id", record_id(F.col("payload_id")))
        append_audit(to_audit(records), path, batch=f"telemetry-{batch_id}")
        if rejects:
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    return (
        payloads.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def daily_series_stream(interactions: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The daily series over a stream; the watermark that bounds its state is an addition of this library."""
    return (
        interactions.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day"))
        .agg(F.count(F.lit(1)).alias("interactions"), F.coalesce(F.sum("entity_total"), F.lit(0)).alias("entities"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "interactions", "entities")
    )
