"""Keys of nested JSON with their paths, at any depth, one level of all documents at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored

c = F.col


def paths_of_keys(docs: DataFrame, key: str, json: str, wanted: list[str]) -> DataFrame:
    """key, path of every wanted key of an object in the documents, such as $.items[2].budget; of equal keys in one object the
    last counts. Text that is no JSON, and null, has none.

    Each round opens the objects and lists of one level and keeps what has levels below, so the rounds are as many as the
    deepest document has levels."""
    spark, found = docs.sparkSession, None
    level = docs.select(c(key).alias("key"), F.try_parse_json(json).alias("v"), F.lit("$").alias("path")).filter("v is not null")
    while True:
        below = level.lateralJoin(spark.tvf.variant_explode(c("v").outer()).toDF("pos", "name", "value"))
        step = F.when(c("name").isNull(), F.concat(F.lit("["), c("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), c("name")))
        below = stored(below.select("key", F.concat("path", step).alias("path"), "name", c("value").alias("v")))
        hits = below.filter(c("name").isin(wanted)).select(c("key").alias(key), "path")
        found = hits if found is None else found.union(hits)
        level = below.filter(F.rlike(F.schema_of_variant("v"), F.lit("^(OBJECT|ARRAY)"))).select("key", "v", "path")
        if not level.limit(1).count():
            return found
