"""Tables that are kept as folders of appended Parquet files: appends that answer, marks of deletion, logs and bulk loads.

Every function may run again with the same rows and then changes nothing. Keys are compared null-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import stored
from ..operators.ranking import numbered
from ..operators.windows import top_per_group


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows; none where nothing was written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _with_key(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their key as one value that is never null, so that plain joins compare it null-safe."""
    return rows.withColumn(name, F.struct(*[F.struct(F.col(f"`{k}`").isNull().alias("none"), F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")).alias("text")) for k in keys]))


def append(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Appends rows whose key the table does not have yet, of rows with one key the first by `order`, and returns a row for
    each key that was asked for: the table's row, and `duplicate`, whether it was there before."""
    first = _with_key(top_per_group(rows, keys, order), keys, "__key")
    old = _with_key(read(spark, path, rows.schema), keys, "__key")
    known = first.join(old.select("__key"), "__key", "left_semi").select("__key")
    new = stored(first.join(old.select("__key"), "__key", "left_anti"))
    before = stored(old.join(known, "__key", "left_semi").withColumn("duplicate", F.lit(True)))  # before the folder changes
    new.drop("__key").write.mode("append").parquet(path)
    return before.union(new.withColumn("duplicate", F.lit(False)).select(before.columns)).drop("__key")


def mark(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], at: Column, deleted: bool) -> None:
    """Notes that the rows of these keys were deleted, or restored, at a time."""
    marks = rows.select(*keys, at.cast("timestamp").alias("at"), F.lit(deleted).alias("deleted")).distinct()
    append(spark, f"{path}-marks", marks, [*keys, "at", "deleted"], [F.col("at")])


def visible(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The table's rows but for those whose last mark says deleted; of two marks of one time the restoring one counts."""
    fields = [f for f in schema if f.name in keys] + [T.StructField("at", T.TimestampType()), T.StructField("deleted", T.BooleanType())]
    marks = top_per_group(read(spark, f"{path}-marks", T.StructType(fields)), keys, [F.col("at").desc(), F.col("deleted")])
    gone = _with_key(marks.filter("deleted"), keys, "__key").select("__key")
    return _with_key(read(spark, path, schema), keys, "__key").join(gone, "__key", "left_anti").drop("__key")


def bulk_load(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[Column], fault: Column, size: int = 500) -> DataFrame:
    """Takes rows in by batches of `size`, of rows with one key the first, and returns key, batch, status and error: inserted,
    duplicate (the table has the key), or rejected with its fault. A row with a fault rejects itself and not its batch. What
    becomes of each row is written once, before the folder changes; the table and the answer are read from it."""
    first = numbered(top_per_group(rows, keys, order), [], order).withColumn("batch", F.floor((F.col("place") - 1) / size)).withColumn("error", fault).drop("place")
    old = read(spark, path, rows.schema).select(*[F.col(f"`{k}`").alias(f"__{n}") for n, k in enumerate(keys)], F.lit(True).alias("__known"))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__{n}")) for n, k in enumerate(keys)]
    status = F.when(F.col("error").isNotNull(), "rejected").when(F.col("__known"), "duplicate").otherwise("inserted")
    done = stored(first.join(old, same, "left").select(*[f"`{x}`" for x in rows.columns], "batch", status.alias("status"), "error"))
    done.filter("status = 'inserted'").select(rows.columns).write.mode("append").parquet(path)
    return done.select(*keys, "batch", "status", "error")
