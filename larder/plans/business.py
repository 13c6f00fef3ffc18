"""Composite price, basket, budget and feed queries over the driver's tables (roles as in relational)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money
from ..operators import windows
from .catalog import query
from .tables import t

c = F.col
_UNIT = "CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)"


def _unit():
    return money.cents(c("l_extendedprice") / c("l_quantity")).alias("unit_cents")


@query("q1_pricing", f"""SELECT c_mktsegment, l_partkey, s_nationkey, n_offers, best_cents FROM (SELECT c_mktsegment, s_nationkey FROM (SELECT DISTINCT c_mktsegment, c_nationkey AS s_nationkey FROM customer)) u JOIN
    (SELECT l_partkey, s_nationkey, count(*) AS n_offers, min({_UNIT}) AS best_cents FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) USING (s_nationkey)""")
def q1_all(spark, d):
    return _pricing(spark, d, t(spark, d, "customer"))


def _pricing(spark, d, users):
    """Per user group the offers of its preferred banners: an equi-join on the banner, offers summed up before it."""
    u = users.select("c_mktsegment", c("c_nationkey").alias("s_nationkey")).distinct()
    s = t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_nationkey")
    o = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", _unit()).join(s, "l_suppkey").groupBy("l_partkey", "s_nationkey").agg(F.count("*").alias("n_offers"), F.min("unit_cents").alias("best_cents"))
    return u.join(o, "s_nationkey").select("c_mktsegment", "l_partkey", "s_nationkey", "n_offers", "best_cents")


@query("q4_replacement", f"""SELECT p_partkey, other, cents FROM (SELECT a.p_partkey, b.p_partkey AS other, b.cents, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.cents, b.p_partkey) AS rn FROM part a JOIN
    (SELECT p_partkey, p_brand, p_type, min({_UNIT}) AS cents FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3) b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey) WHERE rn <= 2""")
def q4(spark, d):
    """The two cheapest other products of the same brand and type. The three cheapest of each group are enough, so groups
    are cut to three before the join and no pairs of a whole group arise."""
    li = t(spark, d, "lineitem").select(c("l_partkey").alias("p_partkey"), _unit()).groupBy("p_partkey").agg(F.min("unit_cents").alias("cents"))
    part = t(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    best = windows.top_per_group(part.join(li, "p_partkey"), ["p_brand", "p_type"], [c("cents"), c("p_partkey")], 3).select("p_brand", "p_type", c("p_partkey").alias("other"), "cents")
    pairs = part.join(best, ["p_brand", "p_type"]).filter("p_partkey <> other")
    return windows.top_per_group(pairs, ["p_partkey"], [c("cents"), c("other")], 2).select("p_partkey", "other", "cents")


@query("q5_recipe_cost", f"""SELECT o_orderkey, CAST(sum(ceil(l_quantity / p_size)) AS BIGINT) AS packages, CAST(sum(ceil(l_quantity / p_size) * cents) AS BIGINT) AS cost_cents FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN
    (SELECT l_partkey AS k, min({_UNIT}) AS cents FROM lineitem GROUP BY 1) ON k = l_partkey GROUP BY o_orderkey""")
def q5(spark, d):
    """Each order as a recipe: whole packages of each part at its best price."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", _unit())
    best = li.groupBy("l_partkey").agg(F.min("unit_cents").alias("cents"))
    n = money.packages(c("l_quantity"), c("p_size"))
    x = li.join(best, "l_partkey").join(t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").select("l_orderkey", n.alias("n"), (n * c("cents")).alias("x"))
    return x.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum("n").alias("packages"), F.sum("x").alias("cost_cents"))


@query("q8_store_comparison", f"""WITH b AS (SELECT s_nationkey, l_partkey, min({_UNIT}) AS cents FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), g AS (SELECT s_nationkey, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM b GROUP BY 1)
    SELECT n_name, n, (SELECT count(*) FROM part) - n AS missing, total, max(total) OVER () - total AS savings FROM g JOIN nation ON n_nationkey = s_nationkey""")
def q8(spark, d):
    """Per banner: items found, items missing, the best basket, and savings against the dearest banner."""
    s = t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("n_nationkey"))
    b = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", _unit()).join(s, "l_suppkey").groupBy("n_nationkey", "l_partkey").agg(F.min("unit_cents").alias("x"))
    g = b.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.sum("x").alias("total")).join(t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    parts = F.broadcast(t(spark, d, "part").agg(F.count("*").alias("parts")))
    return g.join(parts, F.lit(True)).select("n_name", "n", (c("parts") - c("n")).alias("missing"), "total", (F.max("total").over(W.partitionBy()) - c("total")).alias("savings"))


@query("q12_notifications", """SELECT user_id, event_id, kind FROM (SELECT user_id, event_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id DESC) AS rn FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= CASE WHEN event_type IN ('error', 'purchase') THEN 10 ELSE 20 END) WHERE rn <= 40""")
def q12(spark, d):
    """The newest of each kind (10 or 20), pending kinds first, then the newest; 40 for each user."""
    e = t(spark, d, "events").select("user_id", "event_id", c("event_type").alias("kind"))
    newest = windows.top_per_group(e, ["user_id", "kind"], [c("event_id").desc()], 20, "k").filter(c("k") <= F.when(c("kind").isin("error", "purchase"), 10).otherwise(20))
    return windows.top_per_group(newest, ["user_id"], [F.when(c("kind") == "error", 0).otherwise(1), c("event_id").desc()], 40).select("user_id", "event_id", "kind")


@query("ag11_partition_sums", "SELECT user_id, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS bought, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type <> 'purchase'), 0) AS BIGINT) AS other FROM events GROUP BY user_id")
def ag11(spark, d):
    x, buy = money.cents(c("value")), c("event_type") == "purchase"
    zero = F.lit(0).cast("long")
    return t(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(buy, x).otherwise(zero)).alias("bought"), F.sum(F.when(~buy, x).otherwise(zero)).alias("other"))


@query("ag17_list_merge", "SELECT o_custkey, l_partkey, CAST(sum(greatest(0, CAST(l_quantity AS BIGINT))) AS BIGINT) AS quantity, min(l_orderkey) AS first_order FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1, 2")
def ag17(spark, d):
    """Open baskets of a user as one list: quantities of equal items are added."""
    o = t(spark, d, "orders").filter("o_orderstatus = 'O'").select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(o, "l_orderkey")
    return li.groupBy("o_custkey", "l_partkey").agg(F.sum(F.greatest(F.lit(0).cast("long"), c("l_quantity").cast("long"))).alias("quantity"), F.min("l_orderkey").alias("first_order"))


@query("ag25_stock", "SELECT p_type, count(*) AS total, count(*) FILTER (WHERE p_size <= 3) AS expiring, count(*) FILTER (WHERE p_size > 40) AS large FROM part GROUP BY p_type")
def ag25(spark, d):
    return t(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("total"), F.count_if(c("p_size") <= 3).alias("expiring"), F.count_if(c("p_size") > 40).alias("large"))


@query("wn10_most_frequent", "SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1")
def wn10(spark, d):
    n = t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return windows.top_per_group(n, ["o_custkey"], [c("n").desc(), c("o_orderpriority")])


@query("d2_pending_weeks", "SELECT user_id, CAST(unnest(generate_series(date_trunc('week', min(ts)), date_trunc('week', TIMESTAMP '2024-02-05'), INTERVAL 7 DAY)) AS DATE) AS week FROM events GROUP BY user_id")
def d2(spark, d):
    """The weeks from a user's first event up to the given day's week."""
    first = t(spark, d, "events").groupBy("user_id").agg(money.week_start(F.to_date(F.min("ts"))).alias("a"))
    return first.select("user_id", F.explode(F.sequence("a", money.week_start(F.lit("2024-02-05").cast("date")), F.expr("interval 7 days"))).alias("week"))


@query("d8_buckets", "SELECT CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n <= 3 THEN 'three days' ELSE 'older' END AS bucket, count(*) AS events FROM (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') AS n FROM events WHERE ts < TIMESTAMP '2024-01-31') GROUP BY 1")
def d8(spark, d):
    n = F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("ts"))
    b = F.when(n == 0, "today").when(n == 1, "yesterday").when(n <= 3, "three days").otherwise("older")
    return t(spark, d, "events").filter(c("ts") < F.expr("timestamp_ntz '2024-01-31'")).groupBy(b.alias("bucket")).agg(F.count("*").alias("events"))


@query("ex2_exposures", "SELECT o_orderpriority AS variant, count(DISTINCT o_custkey) AS exposed, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 250000) AS converted FROM orders GROUP BY 1")
def ex2(spark, d):
    """Distinct persons per variant, and those of them who converted: one row per person first, so it is one shuffle deep."""
    p = t(spark, d, "orders").groupBy(c("o_orderpriority").alias("variant"), "o_custkey").agg(F.max((c("o_totalprice") > 250000).cast("int")).alias("hit"))
    return p.groupBy("variant").agg(F.count("*").alias("exposed"), F.sum("hit").alias("converted"))


@query("m18_medoid", """SELECT p_brand, p_name FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY round(0.7 * n / total + 0.2 * n / brand_n + 0.1 * least(1.0, ln(1 + n) / ln(101.0)), 9) DESC, p_name) AS rn FROM
    (SELECT p_brand, p_name, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY p_name))::DOUBLE AS total, (sum(count(*)) OVER (PARTITION BY p_brand))::DOUBLE AS brand_n FROM part GROUP BY 1, 2)) WHERE rn = 1""")
def m18(spark, d):
    """A brand's most typical product name by a weighted score of similarity, purity and size."""
    n = t(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count("*").cast("double").alias("n"))
    share = lambda key: c("n") / F.sum("n").over(W.partitionBy(key))
    n = n.withColumn("score", F.round(money.medoid_score(share("p_name"), share("p_brand"), c("n")), 9))
    return windows.top_per_group(n, ["p_brand"], [c("score").desc(), c("p_name")]).select("p_brand", "p_name")


@query("q6_weekly_basket", f"""WITH need AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag <> 'R') AS want, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'R') AS have, min({_UNIT}) AS cents FROM lineitem GROUP BY 1)
    SELECT l_partkey, CAST(greatest(0, coalesce(want, 0) - coalesce(have, 0)) AS BIGINT) AS short, CAST(ceil(greatest(0, coalesce(want, 0) - coalesce(have, 0)) / p_size) AS BIGINT) AS packages, CAST(ceil(greatest(0, coalesce(want, 0) - coalesce(have, 0)) / p_size) * cents AS BIGINT) AS cost_cents FROM need JOIN part ON p_partkey = l_partkey""")
def q6(spark, d):
    """Demand less stock, in whole packages at the best price; nothing is bought where stock covers the demand."""
    n, q = c("l_returnflag") == "R", c("l_quantity").cast("long")
    zero = F.lit(0).cast("long")
    g = t(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", _unit()).groupBy("l_partkey").agg(F.sum(F.when(~n, q).otherwise(zero)).alias("want"), F.sum(F.when(n, q).otherwise(zero)).alias("have"), F.min("unit_cents").alias("cents"))
    g = g.join(t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").withColumn("short", F.greatest(zero, c("want") - c("have")))
    g = g.withColumn("packages", F.ceil(F.try_divide(c("short"), c("p_size"))).cast("long"))
    return g.select("l_partkey", "short", "packages", (c("packages") * c("cents")).alias("cost_cents"))


@query("ag21_pair_rollup", "SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS event_count, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2, 3")
def ag21(spark, d):
    return t(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id", "event_type").agg(F.count("*").alias("event_count"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("ag23_sensitive_pairs", "SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2 HAVING count(*) >= 5")
def ag23(spark, d):
    return t(spark, d, "events").filter(c("ts") >= F.expr("timestamp_ntz '2024-01-10'")).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).filter("n >= 5")


@query("st4_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def st4(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "event_id")
    return windows.top_per_group(e, ["user_id", "event_type"], [c("event_id")])


@query("st6_common_words", "SELECT p_brand, string_agg(w, ' ' ORDER BY w) AS words FROM (SELECT p_brand, w FROM (SELECT DISTINCT p_brand, p_name, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_brand, w HAVING count(DISTINCT p_name) >= 2) GROUP BY p_brand")
def st6(spark, d):
    """Words that two or more of a brand's names have."""
    w = t(spark, d, "part").select("p_brand", "p_name").distinct().select("p_brand", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    common = w.groupBy("p_brand", "w").agg(F.count("*").alias("n")).filter("n >= 2")
    return common.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("w")), " ").alias("words"))


@query("sr8_nulls_last", "SELECT doc_id, quality FROM (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)) ORDER BY quality ASC NULLS LAST, doc_id LIMIT 50")
def sr8(spark, d):
    x = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return windows.page(x, [c("quality").asc_nulls_last(), c("doc_id")], 0, 50)
