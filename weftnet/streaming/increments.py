"""A tensor as the running sum of a stream of increments: every linear operation of the engine is additive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..index import Index
from ..tensor import Tensor


def accumulate(stream: DataFrame, indices: tuple[Index, ...], path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch, summed by coordinate, as a batch of its own under path; replays overwrite their batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(*(i.column for i in indices)).agg(F.sum("re").alias("re"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, indices: tuple[Index, ...], path: str) -> Tensor:
    """The tensor that all batches so far add up to."""
    rows = spark.read.parquet(path)
    return Tensor(rows.groupBy(*(i.column for i in indices)).agg(F.sum("re").alias("re")), tuple(indices))
