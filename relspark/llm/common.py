"""Shared pieces of the training-data operators: the shared work folder, bounded joins, text columns, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import shared_dir

#: Rows that a side may have to be broadcast; each row has at most a few dozen bytes. Larger sides are shuffled.
BROADCAST_ROWS = 200_000
#: Documents in an Arrow batch: a batch of long texts must fit in a Python worker beside its results.
BATCH_ROWS = 256
#: How tables are written where the shared folder is a local path: without checksum files. Hadoop runs a chmod process for
#: each file it makes there, checksum files too, and stages of many small parts make thousands. Other stores ignore these.
LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage is cut, and any executor can read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **LOCAL_FILES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    spark._own_tables = [*getattr(spark, "_own_tables", []), path]
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these tables; nothing may read them any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables that stored() has written in this session; to be called when results have been written."""
    delete(spark, *getattr(spark, "_own_tables", []))
    spark._own_tables = []


def small_or_shuffled(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast df if its counted rows are within limit; else a sort-merge join, which AQE can split."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df.hint("merge")


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sliced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most BATCH_ROWS rows at a time, whatever the session's Arrow batches are (Spark bounds their bytes)."""
    for batch in it:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """df through f, BATCH_ROWS rows at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            if (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
