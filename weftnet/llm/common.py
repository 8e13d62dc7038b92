"""What the training-data operators share: tables, stored intermediates, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space; a word is a maximal run of other characters.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

#: Text that one step of a vectorised function holds at once.
SLICE_BYTES = 8 << 20
#: Text in an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives lost executors and is cleaned up by Spark with its last user."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Paths of the stored tables that nobody has removed yet.
_stored: list[str] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: compressed, and read again column by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftnet-{label}-{uuid.uuid4().hex}"
    _stored.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession, since: int = 0) -> None:
    """Deletes stored tables, those of all results of this driver unless since gives a number to keep from the start."""
    jvm = spark.sparkContext._jvm
    for path in _stored[since:]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _stored[since:]


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make gives as a stored table; tables that were stored while it was made and written are removed."""
    before = len(_stored)
    out = stored(make(), label)
    last = _stored.pop()
    remove_stored(spark, before)
    _stored.append(last)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that long texts don't add up in a Python worker and in the JVM's buffers.

    A plan reads the setting when it runs, so it stays; a smaller one of the user's is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except (TypeError, ValueError):  # unset, or written with a unit
        now = 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows so that each part has about limit bytes in column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with what Arrow has freed given back to the system after each batch and at the end.

    Arrow's pool keeps freed memory for itself, and a Python worker lives on after its task, so that steps that come later would
    find it taken.
    """

    @wraps(run)
    def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        try:
            for out in run(batches):
                yield out
                del out
                pool.release_unused()
        finally:
            pool.release_unused()

    return given_back


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """fn over slices of Arrow batches; fn gets and returns a record batch."""

    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield fn(part)

    return df.mapInArrow(run, schema)


def word_count(text) -> F.Column:
    """Words of a string column, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
