"""The latest row of each key, kept by a stream: last write wins, and a batch that runs again changes nothing.

A folder holds `changes/batch=N`, the latest rows of each micro-batch, and `base/upto=N`, the latest rows of all batches up
to N. A batch replaces its own folder, so that its repetition is the same as one run; every `compact` batches a new base is
written beside the old one. Readers take the newest finished base and the changes after it, so a base that was cut short
is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.windows import top_per_group


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the finished folders name=N under a path, in order."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = [x.getPath() for x in store.listStatus(folder)]
    done = [p for p in found if p.getName().startswith(f"{name}=") and store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def _rows(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """All rows that may be the latest of their key: the newest base and the changes after it."""
    bases = [n for n in _numbers(spark, f"{path}/base", "upto") if upto is None or n <= upto]
    after = bases[-1] if bases else -1
    folders = [f"{path}/base/upto={after}"] * bool(bases)
    folders += [f"{path}/changes/batch={n}" for n in _numbers(spark, f"{path}/changes", "batch") if n > after and (upto is None or n <= upto)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def store_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: list[Column], compact: int = 10) -> None:
    """Takes one micro-batch into the folder."""
    spark = batch.sparkSession
    bases = _numbers(spark, f"{path}/base", "upto")
    if bases and number <= bases[-1]:
        return  # a batch that the base holds already
    top_per_group(batch, keys, order).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
    if number - (bases[-1] if bases else -1) >= compact:
        top_per_group(_rows(spark, path, batch.schema, number), keys, order).write.mode("overwrite").parquet(f"{path}/base/upto={number}")


def keep_latest(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[Column], compact: int = 10) -> None:
    """Works off what a stream holds and stops. The order's first row of a key is its latest one; it should end in a unique
    column, so that the result does not depend on how rows fall into batches."""
    writer = rows.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, path, keys, order, compact))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(_rows(spark, path, schema), keys, order)
