"""Names consolidated in rounds over written state: near pairs are discovered and logged, those that may merge without review
are merged, references follow, and the next round looks at what is left, until a round merges nothing.

Each round writes the log of its new pairs and then, last, the names with what they stand for. A run that was cut short
starts again at the last finished round, and ends with the same tables as one that ran through, since every step has a
total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching
from . import graph, similarity, vector_pairs

c = F.col
#: Verdicts of `matching.merge_verdict` that need no review.
MERGED = ("same_name", "plural_s", "singular", "near_and_common")


def _finished(spark: SparkSession, path: str) -> int:
    """The last finished round, -1 if there is none."""
    jvm, n = spark.sparkContext._jvm, -1
    done = lambda k: jvm.org.apache.hadoop.fs.Path(f"{path}/names/round={k}/_SUCCESS")
    store = done(0).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while store.exists(done(n + 1)):
        n += 1
    return n


def live_names(state: DataFrame) -> DataFrame:
    """canonical, products of all names that it stands for, and its own category and vector."""
    sums = state.groupBy("canonical").agg(F.sum("products").alias("products"))
    return sums.join(state.select(c("name").alias("canonical"), "category", "vector"), "canonical")


def run_round(state: DataFrame, log: DataFrame, least: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The state after one round, and the pairs that it found and the log does not hold."""
    live = graph.stored(live_names(state))
    found = vector_pairs.cosine_pairs(live, "canonical", "vector", least, recall)
    _, members = vector_pairs.distinct_vectors(live, "canonical", "vector")
    alike = members.filter("key <> of").select(c("of").alias("a"), c("key").alias("b"), F.lit(1.0).alias("cosine"))  # one vector, several names
    pairs = similarity.logged_pairs(found.union(alike).select(c("a").alias("source"), c("b").alias("target"), c("cosine").alias("similarity")))
    new = graph.stored(pairs.join(log, ["source", "target"], "left_anti").select("source", "target", "direction", "similarity"))
    known = log.select("source", "target", "direction", "similarity").union(new)
    ends = [live.select(c("canonical").alias(e), c("category").alias(f"{e}_category"), c("products").alias(f"{e}_products")) for e in ("source", "target")]
    both = known.join(ends[0], "source").join(ends[1], "target")
    verdict = matching.merge_verdict(c("source"), c("target"), c("source_category"), c("target_category"), c("similarity"), c("source_products"), c("target_products"))
    merged = graph.stored(both.filter(verdict.isin(*MERGED)).select(c("source").alias("a"), c("target").alias("b")))
    if not merged.limit(1).count():
        return state, new
    parts = graph.connected(merged).join(live.select(c("canonical").alias("node"), "products"), "node")
    best = graph.survivor(parts, "component", "node", "products").select("component", c("node").alias("survivor"))
    mapping = parts.join(best, "component").filter("node <> survivor").select("node", "survivor")
    return graph.repointed(state, "canonical", graph.stored(mapping), "node", "survivor"), new


def consolidated(names: DataFrame, path: str, least: float = 0.88, recall: float = 0.99, rounds: int = 20, stop_after: int | None = None) -> DataFrame:
    """names (name, unique; products, category, vector) with `canonical`, after as many rounds as merge something. Call it
    again with the same path to go on after a failure; `stop_after` ends it early, after that many rounds of this call.

    A name without a usable vector keeps standing for itself. Raises if there is still something to merge after `rounds`."""
    spark = names.sparkSession
    if (at := _finished(spark, path)) < 0:
        start = names.select("name", c("products").cast("long").alias("products"), "category", c("vector").cast("array<double>").alias("vector"), c("name").alias("canonical"))
        start.write.mode("overwrite").parquet(f"{path}/names/round=0")
        at = 0
    fields = "name string, products long, category string, vector array<double>, canonical string"
    pairs = "source string, target string, direction string, similarity double"
    read = lambda n: spark.read.schema(fields).parquet(f"{path}/names/round={n}")
    first = at
    while stop_after is None or at - first < stop_after:
        if at and read(at).select("name", "canonical").exceptAll(read(at - 1).select("name", "canonical")).limit(1).count() == 0:
            break
        if at >= rounds:
            raise RuntimeError(f"names still merge after {rounds} rounds")
        log = spark.createDataFrame([], pairs)
        for n in range(1, at + 1):
            log = log.union(spark.read.schema(pairs).parquet(f"{path}/log/round={n}"))
        state, new = run_round(read(at), log, least, recall)
        new.write.mode("overwrite").parquet(f"{path}/log/round={at + 1}")
        state.select("name", "products", "category", "vector", "canonical").write.mode("overwrite").parquet(f"{path}/names/round={at + 1}")
        at += 1
    return read(at).select("name", "products", "category", "canonical")
