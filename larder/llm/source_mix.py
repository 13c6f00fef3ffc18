"""Mixing sources to target weights.

Each document gets a hash-random key. Within a source, documents are dealt to ranges of keys; the ranges' word counts
give each range's start (over blocks of ranges first), a window inside a range each document's start, and the source's budget cuts there. A budget
beyond the source's size repeats whole epochs first.

Defined results: a null text has size 0; null is a source of its own. A null id draws its key from the text. Equal keys are ordered by id, and rows that agree
in id and size may swap. A source without words has target 0. An empty table gives an empty result. Further columns are
ignored by `mix_sources`; `mixed_documents` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked, table, written

#: Fixed parameters of the query.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Rows of a source that a range of keys holds on average.
RANGE_ROWS = 2_000
#: Ranges of a block.
BLOCK = 1_024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n_rows, source_size, target. Sources take their weights in order of code point, null last, over and over.

    All budgets are the water level of one equation: a source gets min(most * size, weight * level). Ordered by
    most * size / weight, the level is found where capping the sources so far leaves the next one below its cap.
    """
    s = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    i = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (i % len(weights)) + 1)).withColumn("__cap", most * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everywhere = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    s = s.withColumn("__level", F.when(level * F.col("__w") <= F.col("__cap"), level)).withColumn("__level", F.max("__level").over(everywhere))
    return s.select("source", "n_rows", "source_size", F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__w") * F.col("__level"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """id, size, source_size, target, taken per row; and source, epochs (whole repeats), starts (the part of an epoch begins
    inside the budget) and text_hash."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none:"), F.col("text_hash").cast("string"))))
    sizes = written(sizes.withColumn("key", F.md5(named.cast("binary"))), "mix-sizes")
    goal = targets(sizes, weights, share, most)
    budget = F.round("target").cast("long")
    goal = goal.select(
        "source", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / range_rows)).alias("ranges"),
        F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0).alias("epochs"),
        F.when(F.col("source_size") > 0, F.pmod(budget, F.col("source_size"))).otherwise(0).alias("rest"),
    ).withColumn("source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    goal = written(goal, "mix-targets")
    df = sizes.withColumn("source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))).join(goal, "source")
    u = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    df = df.withColumn("range", F.floor(u * F.col("ranges")).cast("long"))
    starts = written(df.groupBy("source", "range").agg(F.sum("size").alias("n")).withColumn("block", F.expr(f"`range` div {BLOCK}")), "mix-ranges")
    blocks = starts.groupBy("source", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("source", "block", (F.sum("n").over(W.partitionBy("source").orderBy("block")) - F.col("n")).alias("block_start"))
    inside = F.sum("n").over(W.partitionBy("source", "block").orderBy("range")) - F.col("n")
    starts = starts.withColumn("inside", inside).join(blocks, ["source", "block"]).select("source", "range", (F.col("block_start") + F.col("inside")).alias("range_start"))
    df = df.join(starts, ["source", "range"])
    inside = F.sum("size").over(W.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    df = df.withColumn("start", F.col("range_start") + inside)
    taken = F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("start")))
    return df.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), F.when(~F.col("source.none"), F.col("source.name")).alias("source"), "epochs", (F.col("start") < F.col("rest")).alias("starts"), "text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents of the mix, one row for each time one is taken; the document that a budget cuts stays whole. Documents
    are told apart by id, null among them, and text; rows that agree in both are taken as often as the one taken most."""
    plan = mix_sources(docs, id_col, text_col, **params)
    times = plan.groupBy(F.col(id_col).alias("__mix_id"), F.col("text_hash").alias("__mix_hash")).agg(F.max(F.col("epochs") + F.col("starts").cast("int")).cast("int").alias("__mix_times"))
    times = checked(written(times.filter("__mix_times > 0"), "mix-times"))
    out = docs.join(times, docs[id_col].eqNullSafe(F.col("__mix_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__mix_hash")))
    return out.select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__mix_times"))).alias("__mix_turn")).drop("__mix_turn")


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || doc_id) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT *, {MOST} * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT max(lev) FROM l WHERE lev * w <= cap), 1e300)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS b, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN (b // source_size) * size + least(size, greatest(0, b % source_size - start)) ELSE 0 END AS taken FROM p
"""
