"""Incremental annotation as a stream: judgments arrive in batches and are upserted by pair and model.

A batch is merged with the table's newest version and written as the next one, named by the batch, so a batch that is
run again after a failure replaces its own version and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.judge import merged


def versions(spark: SparkSession, path: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p(path)):
        return []
    done = [f.getPath() for f in fs.listStatus(p(path)) if f.getPath().getName().startswith("v") and fs.exists(p(f"{f.getPath()}/_SUCCESS"))]
    return sorted(int(x.getName()[1:]) for x in done)


def upsert(batch: DataFrame, batch_id: int, path: str) -> None:
    """The version batch_id + 1 of the table at path: the newest one before it, with the batch merged in."""
    spark = batch.sparkSession
    old = [v for v in versions(spark, path) if v <= batch_id]
    new = merged(batch.limit(0), batch) if not old else merged(spark.read.parquet(f"{path}/v{old[-1]}"), batch)
    new.write.mode("overwrite").parquet(f"{path}/v{batch_id + 1}")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def annotation_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upserts a stream of (id_query, id_dataset, model, ..., error) into the table at path."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: upsert(b, i, path))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
