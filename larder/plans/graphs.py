"""Similarity graphs, vectors, nearest stores and upserts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, spatial
from ..sources import io
from .catalog import query
from .tables import t

c = F.col


@query("gr1_components", """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS x FROM part), e AS (SELECT a.x AS a, b.x AS b FROM n a JOIN n b ON a.x <> b.x AND split_part(a.x, ' ', 2) = split_part(b.x, ' ', 2)),
    r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a) SELECT node, min(reach) AS component FROM r GROUP BY node""")
def gr1(spark, d):
    """Product names linked by a common head noun; links lead to each head's smallest name, not between all pairs."""
    n = t(spark, d, "part").select("p_name").distinct().withColumn("head", F.element_at(F.split("p_name", " "), 2))
    first = n.groupBy("head").agg(F.min("p_name").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return graph.connected(n.join(first, "head").filter("p_name <> a").select("a", c("p_name").alias("b")))


@query("gr9_survivor", "SELECT DISTINCT ON (split_part(p_name, ' ', 2)) split_part(p_name, ' ', 2) AS head, p_name, n FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) ORDER BY head, n DESC, length(p_name), p_name")
def gr9(spark, d):
    n = t(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).withColumn("head", F.element_at(F.split("p_name", " "), 2))
    return graph.survivor(n, "head", "p_name", "n").select("head", "p_name", "n")


@query("gr11_repoint", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 AND o_custkey + 1 IN (SELECT c_custkey FROM customer) THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders")
def gr11(spark, d):
    """References to merged keys follow the mapping."""
    m = t(spark, d, "customer").select((c("c_custkey") - 1).alias("old"), c("c_custkey").alias("new")).filter("old % 10 = 0 and old >= 0")
    return graph.repointed(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", m, "old", "new")


@query("snk2_upsert", """SELECT coalesce(k, k2) AS user_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT user_id AS k2, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) b ON k = k2""")
def snk2(spark, d):
    """Additive merge of new counts into old ones."""
    e = t(spark, d, "events")
    count = lambda kind: e.filter(c("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    return io.upsert(count("view"), count("click"), ["user_id"], {"n": lambda a, b: a + b})


@query("snk3_append_new", "SELECT min(event_id) AS event_id, user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY user_id")
def snk3(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type")
    return io.append_new(e.filter("event_type = 'error'"), e.filter("event_type = 'click'"), ["user_id"], [c("event_id")]).select("event_id", "user_id")


@query("snk5_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def snk5(spark, d):
    return io.retained(t(spark, d, "events"), "ts", F.expr("timestamp_ntz '2024-01-31'"), 7).select("event_id")


@query("jn14_near_stores", """SELECT * FROM (SELECT c_custkey, s_suppkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY m, s_suppkey) AS INTEGER) AS place FROM (SELECT c_custkey, s_suppkey,
    round(2 * 3958.7613 * asin(sqrt(pow(sin(radians(s_suppkey % 40 - c_custkey % 40) / 2), 2) + cos(radians(c_custkey % 40)) * cos(radians(s_suppkey % 40)) * pow(sin(radians(s_suppkey % 90 - c_custkey % 90) / 2), 2))), 6) AS m
    FROM customer JOIN supplier ON c_nationkey = s_nationkey)) WHERE place <= 3""")
def jn14(spark, d):
    """A customer's three nearest stores of the nation, by great-circle distance (coordinates are made from the keys)."""
    at = lambda key, lat, lng: ((c(key) % 40).cast("double").alias(lat), (c(key) % 90).cast("double").alias(lng))
    s = t(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("c_nationkey"), *at("s_suppkey", "place_lat", "place_lng"))
    x = t(spark, d, "customer").select("c_custkey", "c_nationkey", *at("c_custkey", "lat", "lng"))
    return spatial.nearest(x, s, "c_nationkey", "s_suppkey", 3).select("c_custkey", "s_suppkey", "place")


@query("s12_trigrams")
def s12(spark, d):
    """Product names with a common word, by padded trigrams."""
    n = t(spark, d, "part").select("p_name").distinct().withColumn("x", F.explode(F.split("p_name", " ")))
    pairs = n.select(c("p_name").alias("a"), "x").join(n.select(c("p_name").alias("b"), "x"), "x").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("similarity", F.round(text.trigram_similarity(c("a"), c("b")), 6))


@query("ml_centroid_cosine", """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2)
    SELECT vec_id, round(sum(v * m) / sqrt(sum(v * v)) / sqrt(sum(m * m)), 5) AS cosine FROM x JOIN m USING (label, i) GROUP BY vec_id""")
def ml_centroid(spark, d):
    """Each vector's cosine to the mean of its label: what a medoid is chosen by."""
    e = t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    first = e.select(F.size("v").alias("n")).first()
    mean = e.groupBy("label").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(first["n"] if first else 0)]).alias("m"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.join(mean, "label").select("vec_id", F.round(dot("v", "m") / F.sqrt(dot("v", "v")) / F.sqrt(dot("m", "m")), 5).alias("cosine"))
