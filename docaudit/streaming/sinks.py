"""Idempotent batch sinks for streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(rows: DataFrame, path: str, batch_id: int, run: int = 0) -> None:
    """Write one micro-batch as its own partition. A replayed batch replaces itself.

    Batch numbers start anew with every checkpoint, so a job with a new checkpoint takes a higher ``run``.
    """
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")


def start(
    stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process everything that is available, batch by batch, then stop."""
    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def tables_writer(
    split: Callable[[DataFrame], Mapping[str, DataFrame]], root: str, run: int = 0
) -> Callable[[DataFrame, int], None]:
    """Batch function that derives several tables from a batch and writes each, the last one last."""

    def process(batch: DataFrame, batch_id: int) -> None:
        for name, rows in split(batch).items():
            write_batch(rows, f"{root}/{name}", batch_id, run)

    return process


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches of a log, with the numbers of run and batch."""
    number = F.lit(0).cast("int")
    full = spark.createDataFrame([], schema).withColumn("run", number).withColumn("batch", number).schema
    return spark.read.schema(full).parquet(path)
