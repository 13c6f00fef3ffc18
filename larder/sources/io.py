"""Sinks and sources: upserts, idempotent appends, partition overwrites, retention, CSV and feature sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import top_per_group


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], merge: dict[str, callable] | None = None) -> DataFrame:
    """target with changes by key: new keys are added, old ones replaced; merge maps a column to a function of the old
    and the new value. Keys are unique on both sides; the result is a full-outer join to be written anew."""
    old, new = target.alias("o"), changes.alias("n")
    cols = []
    for name in target.columns:
        a, b = F.col(f"o.`{name}`"), F.col(f"n.`{name}`")
        if name in keys:
            cols.append(F.coalesce(b, a).alias(name))
        elif merge and name in merge:
            cols.append(F.when(F.col("n.__new").isNull(), a).when(F.col("o.__old").isNull(), b).otherwise(merge[name](a, b)).alias(name))
        else:
            cols.append(F.when(F.col("n.__new").isNull(), a).otherwise(b).alias(name))
    old, new = target.withColumn("__old", F.lit(True)).alias("o"), changes.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
    return old.join(new, on, "full").select(*cols)


def append_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows to append: of rows with one key the first by `order`, and none whose key the target has."""
    return top_per_group(rows, keys, order).join(target.select(*keys), keys, "left_anti").select(*rows.columns)


def overwrite_days(df: DataFrame, path: str, day: str) -> None:
    """Replaces the days that df holds and leaves the others: running it twice is the same as once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def retained(df: DataFrame, created: str, now: Column, days: int) -> DataFrame:
    """Rows not older than so many days, at least one."""
    if days < 1:
        raise ValueError("at least one day is kept")
    return df.filter(F.col(created) >= now - F.make_interval(days=F.lit(days)))


def read_csv(spark: SparkSession, path: str, flags: list[str] = []) -> DataFrame:
    """A CSV file with a header; columns in flags become booleans, null where the text is neither yes nor no."""
    df = spark.read.csv(path, header=True)
    for f in flags:
        x = F.lower(F.trim(f))
        df = df.withColumn(f, F.when(x.isin("true", "1", "yes", "y"), True).when(x.isin("false", "0", "no", "n"), False))
    return df


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Stores of a GeoJSON lines file: features with a name, a postcode and a point."""
    schema = "properties struct<name:string, brand:string, `addr:postcode`:string>, geometry struct<type:string, coordinates:array<double>>"
    df = spark.read.schema(schema).json(path)
    point = F.col("geometry.coordinates")
    rows = df.select(F.col("properties.name").alias("name"), F.col("properties.brand").alias("brand"), F.col("properties.`addr:postcode`").alias("zip"), F.get(point, F.lit(0)).alias("lng"), F.get(point, F.lit(1)).alias("lat"), F.size(point).alias("n"))
    return rows.filter("name is not null and zip is not null and n = 2").drop("n")


def validated_prices(rows: DataFrame, most: float = 100.0) -> DataFrame:
    """Rows with a status: inserted, or rejected with the reason."""
    p = F.col("price")
    reason = F.when(p.isNull(), "no price").when(p <= 0, "not positive").when(p > most, "too high")
    return rows.withColumn("error_msg", reason).withColumn("status", F.when(reason.isNull(), "inserted").otherwise("rejected"))
