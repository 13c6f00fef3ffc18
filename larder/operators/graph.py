"""Classes of names linked by similarity, and which name stands for a class."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .windows import top_per_group


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in tests, where that is unset, a temporary one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="larder-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df by checkpoint."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back. What follows survives lost executors, and, unlike after a checkpoint,
    the optimizer does not carry on what it has inferred about df, which grows from round to round."""
    path = f"{shared_dir(df.sparkSession)}/larder/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """node, component (its smallest node). Labels take the least of their neighbours', then of their label's, so that
    chains halve; each round is cut by a checkpoint. Raises if labels still change after so many rounds."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).union(edges.select(F.col(b), F.col(a))).filter("node is not null and to is not null").distinct()
    both = cut(both)
    labels = both.groupBy("node").agg(F.least(F.first("node"), F.min("to")).alias("component"))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.least("component", "m").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = cut(step.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component"), ))
        changed = step.join(labels.withColumnRenamed("component", "was"), "node").filter("component <> was").limit(1).count()
        labels = step
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def split_components(members: DataFrame, component: str, name: str, smallest: int = 3, most: int = 5, letters: int = 4, rounds: int = 50) -> DataFrame:
    """members (component, name; distinct) with `part`: components without a word common to all are cut in two by a word
    of at least `letters` letters, again and again.

    The word is in 2 to `most` names, but not in all, and leaves two or more on each side; ten times its names plus the
    smaller side decides, ties go to the smaller word. Parts below `smallest` go. All components are cut at once, a round
    each, by counts of words; what is done leaves the rounds."""
    words = F.array_distinct(text.tokens(F.col(name), 2))
    open_, done, keys = cut(members.select(component, F.col(name), F.lit("").alias("part")).distinct()), None, [component, "part"]
    n, k, word = F.col("__n"), F.col("__k"), F.col("__word")
    for _ in range(rounds):
        sized = open_.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).filter(n >= smallest)
        count = sized.select(*keys, "__n", F.explode(words).alias("__word")).groupBy(*keys, "__word").agg(F.count("*").alias("__k"), F.first("__n").alias("__n"))
        able = (F.length(word) >= letters) & k.between(2, most) & (k < n)
        rank = F.when(able, F.struct((-(k * 10 + F.least(k, n - k))).alias("score"), word.alias("word"), (n - k).alias("rest")))
        best = count.groupBy(*keys).agg(F.max(k == n).alias("__shared"), F.min(rank).alias("__best"))
        cuts = best.filter(~F.col("__shared") & (F.col("__best.rest") >= 2)).select(*keys, F.col("__best.word").alias("__word"))
        step = cut(sized.drop("__n").join(cuts, keys, "left"))
        ended = step.filter(word.isNull()).select(component, name, "part")
        done = ended if done is None else done.union(ended)
        side = F.when(F.array_contains(words, word), F.concat("part", F.lit("+"))).otherwise(F.concat("part", F.lit("-")))
        open_ = step.filter(word.isNotNull()).select(component, name, side.alias("part"))
        if open_.isEmpty():
            return done
    raise RuntimeError(f"components still split after {rounds} rounds")


def survivor(members: DataFrame, component: str, name: str, products: str) -> DataFrame:
    """The member that stands for each component: most products, then the shorter name, then the smaller."""
    return top_per_group(members, [component], [F.col(products).desc(), F.length(name), F.col(name)])


def repointed(facts: DataFrame, key: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """facts with each key that the mapping knows replaced."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return facts.join(m, facts[key] == F.col("__old"), "left").withColumn(key, F.coalesce("__new", key)).select(*facts.columns)
