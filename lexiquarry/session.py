"""A session with the settings that the library expects; a cluster's own settings win."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "lexiquarry", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark) -> None:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; on a cluster that is an
    error, as executors would write to their own disks."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="lexiquarry-"))


def bound_batches(spark, most: int = 8 << 20) -> None:
    """Arrow batches of at most ``most`` bytes, unless the caller has set less: a row may be a matrix or a long text, and 10,000 of
    them, Spark's own bound, do not fit a Python process."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    size = int(now.rstrip("kmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if not 0 < size <= most:
        spark.conf.set(name, str(most))


#: Rows of a task where tables are dealt by ``tasks_for``; a quarter of a gigabyte at a few sorts and a hundred bytes a row.
TASK_ROWS = 500_000


def tasks_for(df, rows: int = TASK_ROWS) -> int:
    """Tasks for df at about ``rows`` rows each, one for each core at least. Given as a fixed number: adaptive execution joins
    tasks up to a size in compressed bytes, which says little where rows are much alike. Counts df, which a table's footers answer."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def stored(df, name: str):
    """df written once to the checkpoint folder and read back. Unlike a checkpoint, which holds rows as they are in memory, the
    table is compressed by column."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
