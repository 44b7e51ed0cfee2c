"""Fields of snapshots as they arrive: a file stream whose micro-batches go through the batch plan, step by step of their own.

A step is written to its own partition by replacement, so a batch that is run again leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kernelfield.sources.sinks import Cube


def stream_fields(spark: SparkSession, path: str, schema: str, make: Callable[[DataFrame], DataFrame], cube: Cube, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Starts a query over Parquet snapshots below path, each file holding whole steps; make turns particles into fields."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            cube.write_steps(make(batch))

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
