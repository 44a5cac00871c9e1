"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space of every contract: space and 09-0D. ``bytes.split()`` splits at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts handed to a Python function at once, and an Arrow batch on its way to Python, in bytes.
SLICE_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[str] = []
_caches: list[Callable[[], None]] = []


def task_cache(clear: Callable[[], None]) -> None:
    """Registers a process's cache that is emptied when a task ends: workers are reused by other operators."""
    _caches.append(clear)


def release_caches() -> None:
    for clear in _caches:
        clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the whole cluster shares. Where it is unset, a local master gets a folder
    of its own; on a cluster that is an error, as executors would write to their own disks."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lexiquarry-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most SLICE_BYTES, unless the caller has set less: a row may be a long text."""
    now = spark.conf.get(_BATCH_BYTES, "64m")
    scale = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(now.rstrip("bkmg")) * scale.get(now[-1], 1)
    if not 0 < size <= SLICE_BYTES:
        spark.conf.set(_BATCH_BYTES, str(SLICE_BYTES))


def materialize(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and a lost executor costs only the
    tasks that read it."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/lexiquarry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage: shuffle files of stages whose result is written go with the plans that made
    them, instead of staying on the executors' disks until the heap fills. Files that a live plan needs stay."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the tables of materialize() that df reads; for tables whose every reader has been written."""
    found = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in [w for w in _written if any(_name(f) == _name(w) for f in found)]:
        _delete(df.sparkSession, path)
        _written.remove(path)


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def drop_materialized(spark: SparkSession) -> None:
    """Deletes what materialize() wrote; for callers that have stored their result."""
    while _written:
        _delete(spark, _written.pop())


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of doc_id as text, modulo folds, is fold. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def row_bytes(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of rows with at most SLICE_BYTES together, or one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[bytes | None]], list]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    text: str = "text",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Runs a function over whole texts in Arrow batches, without a shuffle.

    make() is called once a task and returns a function from a list of UTF-8 texts (and, when extra columns are asked
    for, their lists) to one list or array per field. The result has a struct ``row`` with the columns in keep (all of
    them by default, so that no name can clash with a field) and then the fields.
    """
    names = docs.columns if keep is None else keep
    extra = extra or {}
    bound_batches(docs.sparkSession)
    within = names.index(text) if text in names and docs.schema[text].dataType == T.StringType() else None
    own = [] if within is not None else [F.col(f"`{text}`").cast("string").cast("binary").alias("text")]  # no text travels twice
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *own, *[c.alias(f"x{i}") for i, c in enumerate(extra.values())])
    first = 1 + len(own)
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType, False), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            texts = b.column(0).field(within).cast(pa.binary()) if within is not None else b.column(1)
            more = [b.column(i) for i in range(first, b.num_columns)]
            for i, j in row_bytes(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)):
                cols = f(*[x.slice(i, j - i).to_pylist() for x in (texts, *more)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *[pa.array(c, type=arrow.field(k + 1).type, from_pandas=True) for k, c in enumerate(cols)]],
                    names=arrow.names,
                )
        release_caches()

    return src.mapInArrow(run, schema)
