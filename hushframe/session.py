"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hushframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    UTC keeps timestamps comparable, AQE coalesces small shuffles and splits
    skewed ones. Cluster sizing (executors, shuffle partitions, checkpoint
    folder) stays with the caller.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it.

    Only where neither the context nor ``spark.checkpoint.dir`` names one (a
    local test) is a temporary folder used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="hushframe-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it back.

    Used where a result feeds several branches and must be the same in each
    (partition numbers, numbering), and so that a lost executor costs a re-read.
    A frame that was written so is not written again.
    """
    if vars(df).get(_WRITTEN):
        return df
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    setattr(kept, _WRITTEN, True)
    return kept


def materialize_wide(df: DataFrame) -> DataFrame:
    """``materialize`` for rows with texts: as squeezed Parquet in the checkpoint folder, of which readers take the columns they need."""
    path = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN = "_hushframe_written"


@contextmanager
def fixed_plans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside are not adapted while they run.

    A checkpoint forgets how an adapted plan dealt its rows and remembers it of a fixed one, so that later joins and
    groups by the same key need no shuffle. For plans of narrow rows, where a frequent key is no burden to its task.
    """
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
