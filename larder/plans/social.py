"""Feeds, suggestions, windows of time, coverage and store queries over the driver's tables (roles as in relational)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import windows
from ..streaming import streaks
from .catalog import query
from .tables import t

c = F.col
_NOW = "TIMESTAMP '2024-01-31'"


@query("q2_pricing_gaps", """WITH u AS (SELECT c_custkey, c_nationkey FROM customer), need AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'),
    offer AS (SELECT DISTINCT s_nationkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) SELECT c_custkey, l_partkey FROM u JOIN need ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM offer WHERE s_nationkey = c_nationkey AND offer.l_partkey = need.l_partkey)""")
def q2_all(spark, d):
    return _pricing_gaps(spark, d, t(spark, d, "customer"))


def _pricing_gaps(spark, d, users):
    """What a user needs and the banner of the user does not offer: equi-joins and one anti join."""
    u = users.select("c_custkey", "c_nationkey")
    o = t(spark, d, "orders").filter("o_orderstatus = 'O'").select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("c_custkey"))
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    need = li.join(o, "l_orderkey").select("c_custkey", "l_partkey").distinct().join(u, "c_custkey")
    s = t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("c_nationkey"))
    offer = li.select("l_suppkey", "l_partkey").distinct().join(s, "l_suppkey").select("c_nationkey", "l_partkey")
    return need.join(offer, ["c_nationkey", "l_partkey"], "left_anti").select("c_custkey", "l_partkey")


@query("q10_feed", """WITH p AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50), f AS (SELECT f.c_custkey FROM customer f JOIN customer v ON v.c_custkey = 7 AND f.c_nationkey = v.c_nationkey),
    r AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS liked, count(*) FILTER (WHERE l_suppkey = 7) AS mine FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_custkey, coalesce(total, 0) AS total, coalesce(liked, 0) AS liked, coalesce(mine, 0) AS mine FROM p LEFT JOIN r ON l_orderkey = o_orderkey WHERE o_custkey = 7 OR o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM f))""")
def q10(spark, d):
    """The 50 newest posts, of which the viewer sees the visible ones, with reactions: all, of one kind, and own."""
    post = windows.page(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), [c("o_orderdate").desc(), c("o_orderkey")], 0, 50)
    cu = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    followed = cu.join(cu.filter("c_custkey = 7").select("c_nationkey"), "c_nationkey").select(c("c_custkey").alias("o_custkey"), F.lit(True).alias("followed"))
    seen = post.join(followed, "o_custkey", "left").filter((c("o_custkey") == 7) | (c("o_orderstatus") == "O") | ((c("o_orderstatus") == "F") & c("followed")))
    li = t(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_suppkey").join(seen.select("o_orderkey"), "o_orderkey", "left_semi")
    r = li.groupBy("o_orderkey").agg(F.count("*").alias("total"), F.count_if(c("l_returnflag") == "A").alias("liked"), F.count_if(c("l_suppkey") == 7).alias("mine"))
    return seen.join(r, "o_orderkey", "left").select("o_orderkey", "o_custkey", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("total", "liked", "mine")])


@query("q11_posts", """WITH f AS (SELECT f.c_custkey FROM customer f JOIN customer v ON v.c_custkey = 7 AND f.c_nationkey = v.c_nationkey), p AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey = 7 OR o_custkey IN (SELECT c_custkey FROM f) ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)
    SELECT o_orderkey, o_custkey, count(l_linenumber) FILTER (WHERE l_linenumber <= 3) AS likes, count(l_linenumber) FILTER (WHERE l_linenumber > 3) AS reposts FROM p LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def q11(spark, d):
    """The 20 newest posts of the viewer and of those followed, with counts of likes and reposts."""
    cu = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    own = cu.join(cu.filter("c_custkey = 7").select("c_nationkey"), "c_nationkey", "left_semi").select(c("c_custkey").alias("o_custkey"))
    post = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(own, "o_custkey", "left_semi")
    post = windows.page(post, [c("o_orderdate").desc(), c("o_orderkey")], 0, 20)
    n = t(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_linenumber").join(post.select("o_orderkey"), "o_orderkey", "left_semi")
    n = n.groupBy("o_orderkey").agg(F.count_if(c("l_linenumber") <= 3).alias("likes"), F.count_if(c("l_linenumber") > 3).alias("reposts"))
    return post.join(n, "o_orderkey", "left").select("o_orderkey", "o_custkey", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("likes", "reposts")])


@query("q13_pantry_recipes", """WITH pantry AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 7 AND l_quantity >= 30),
    m AS (SELECT p_name, EXISTS (SELECT 1 FROM pantry WHERE contains(p_name, w) OR contains(w, p_name)) AS hit FROM (SELECT DISTINCT p_name FROM part))
    SELECT o_orderkey, CAST(floor(100.0 * count(*) FILTER (WHERE hit) / count(*) + 0.5) AS INTEGER) AS percent FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN m USING (p_name) GROUP BY 1 HAVING percent >= 30 ORDER BY percent DESC, o_orderkey LIMIT 6""")
def q13(spark, d):
    """Six recipes that a user's pantry covers best, from 30 percent on. Names match where one contains the other; distinct
    names are matched, against the words of the one pantry."""
    p = t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_name")
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    mine = t(spark, d, "orders").filter("o_custkey = 7").select(c("o_orderkey").alias("l_orderkey"))
    have = li.filter("l_quantity >= 30").join(mine, "l_orderkey", "left_semi").join(p, "l_partkey").agg(F.collect_set(F.element_at(F.split("p_name", " "), 2)).alias("pantry"))
    hit = p.select("p_name").distinct().join(F.broadcast(have), F.lit(True)).select("p_name", F.exists("pantry", lambda w: F.contains(c("p_name"), w) | F.contains(w, c("p_name"))).cast("int").alias("hit"))
    g = li.join(p, "l_partkey").join(hit, "p_name").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum("hit").alias("h"), F.count("*").alias("n"))
    g = g.select("o_orderkey", F.floor(F.try_divide(100.0 * c("h"), c("n")) + 0.5).cast("int").alias("percent")).filter("percent >= 30")
    return windows.page(g, [c("percent").desc(), c("o_orderkey")], 0, 6)


@query("q18_search", """SELECT p_name, CASE WHEN p_name = 'red widget' THEN 'exact' WHEN p_name LIKE '%red%' AND p_name LIKE '%widget%' THEN 'all_words' ELSE 'some_words' END AS match_type, n FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1) WHERE list_has_any(string_split(p_name, ' '), ['red', 'widget'])""")
def q18(spark, d):
    """Names that a search for two words finds, and how: equal, with all words, with some."""
    want = F.array(F.lit("red"), F.lit("widget"))
    n = t(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter(F.arrays_overlap(F.split("p_name", " "), want))
    words = text.tokens(c("p_name"))
    kind = F.when(text.plain_name(c("p_name")) == "red widget", "exact").when(F.size(F.array_except(want, words)) == 0, "all_words").otherwise("some_words")
    return n.select("p_name", kind.alias("match_type"), "n")


@query("flt7_name_or_child", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' OR EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND lower(p_name) LIKE '%red w%')")
def flt7(spark, d):
    """Parents that match by themselves or by a child; one flag per parent, no copies of parents."""
    p = t(spark, d, "part").filter(F.lower("p_name").contains("red w")).select(c("p_partkey").alias("l_partkey"))
    kids = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey", "left_semi").select(c("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return t(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(kids, "o_orderkey", "left").filter(F.lower("o_orderpriority").contains("urgent") | c("hit")).select("o_orderkey")


@query("flt13_importable", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 0 AND l_extendedprice / l_quantity > 0 AND l_extendedprice / l_quantity <= 1000 AND l_returnflag <> 'R'")
def flt13(spark, d):
    """Prices that may be taken over: positive, within bounds, not returned."""
    unit = c("l_extendedprice") / c("l_quantity")
    ok = (c("l_quantity") > 0) & money.sane_price(unit, F.lit(None).cast("double"), most=1000.0) & (c("l_returnflag") != "R")
    return t(spark, d, "lineitem").filter(ok).select("l_orderkey", "l_linenumber")


@query("flt15_unexpired", f"SELECT event_id FROM events WHERE NOT (ts + INTERVAL 7 DAY <= {_NOW})")
def flt15(spark, d):
    return t(spark, d, "events").filter(c("ts") + F.expr("interval 7 days") > F.expr("timestamp_ntz '2024-01-31'")).select("event_id")


@query("d3_week_index", """SELECT day, CAST(isoyear(day) * 100 + weekofyear(day) AS INTEGER) AS iso_week, CAST(year(day) * 100 + CASE WHEN date_trunc('week', make_date(year(day) + 1, 1, 1)) = date_trunc('week', day) THEN 1 ELSE date_diff('day', date_trunc('week', make_date(year(day), 1, 1)), date_trunc('week', day)) // 7 + 1 END AS INTEGER) AS plan_week
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)""")
def d3(spark, d):
    """Two numberings of weeks: ISO, and the planner's, whose first week holds January 1 and whose year is the day's own."""
    return t(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", money.iso_week(c("day")).alias("iso_week"), money.plan_week(c("day")).alias("plan_week"))


@query("d6_rolling", f"""SELECT user_id, count(*) FILTER (WHERE ts >= {_NOW} - INTERVAL 7 DAY) AS d7, count(*) FILTER (WHERE ts >= {_NOW} - INTERVAL 14 DAY) AS d14, count(*) AS d30 FROM events WHERE ts >= {_NOW} - INTERVAL 30 DAY AND ts < {_NOW} GROUP BY 1""")
def d6(spark, d):
    """Rolling windows in one pass; the widest is a filter of the scan."""
    now = F.expr("timestamp_ntz '2024-01-31'")
    back = lambda n: c("ts") >= now - F.expr(f"interval {n} days")
    return t(spark, d, "events").filter(back(30) & (c("ts") < now)).groupBy("user_id").agg(F.count_if(back(7)).alias("d7"), F.count_if(back(14)).alias("d14"), F.count("*").alias("d30"))


@query("ag8_order_groups", "SELECT l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1 ORDER BY best DESC, l_partkey LIMIT 100")
def ag8(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("best"))
    return windows.page(g, [c("best").desc(), c("l_partkey")], 0, 100)


@query("ag15_reactions", "SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS total, string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag || '=' || n) AS by_kind FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def ag15(spark, d):
    """Reactions of a post, in all and by kind."""
    g = t(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    kinds = F.sort_array(F.collect_list(F.concat_ws("=", "l_returnflag", c("n").cast("string"))))
    return g.groupBy("l_orderkey").agg(F.sum("n").alias("total"), F.array_join(kinds, ",").alias("by_kind"))


@query("ag20_batch_summary", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'view') AS cached, count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS scraped FROM events GROUP BY 1")
def ag20(spark, d):
    kind = c("event_type")
    g = t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(kind != "error").alias("successful"), F.count_if(kind == "view").alias("cached"))
    return g.withColumn("scraped", c("successful") - c("cached"))


@query("ag24_purchases", "SELECT o_custkey, l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS items FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def ag24(spark, d):
    """What each user spent at each store."""
    o = t(spark, d, "orders").filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", money.cents(c("l_extendedprice")).alias("x"))
    return li.join(o, "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.sum("x").alias("cents"), F.count("*").alias("items"))


@query("ag28_unit_weights", """SELECT l_partkey, count(*) AS samples, quantile_cont(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT), 0.5) AS unit_cents, CASE WHEN count(*) >= 30 THEN 'high' WHEN count(*) >= 10 THEN 'middle' ELSE 'low' END AS confidence FROM lineitem WHERE l_quantity > 0 GROUP BY 1""")
def ag28(spark, d):
    """The median unit price of each product, its sample and how far to trust it."""
    n = F.count("*")
    unit = F.percentile(money.cents(c("l_extendedprice") / c("l_quantity")), F.lit(0.5))
    return t(spark, d, "lineitem").filter("l_quantity > 0").groupBy("l_partkey").agg(n.alias("samples"), unit.alias("unit_cents"), F.when(n >= 30, "high").when(n >= 10, "middle").otherwise("low").alias("confidence"))


@query("wn3_preferred_store", """SELECT c_nationkey, l_partkey, l_suppkey FROM (SELECT u.c_nationkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY u.c_nationkey, l_partkey ORDER BY (s_nationkey = u.c_nationkey) DESC, p, l_suppkey) AS rn FROM (SELECT DISTINCT c_nationkey FROM customer) u,
    (SELECT l_partkey, l_suppkey, s_nationkey, min(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)) AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)) WHERE rn = 1""")
def wn3_all(spark, d):
    return _preferred_store(spark, d, t(spark, d, "customer"))


def _preferred_store(spark, d, users):
    """Per user group and product the own nation's cheapest store, else the cheapest of all. The best of each nation and
    the best of all are found once; groups then join them, so offers are not multiplied by groups."""
    s = t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("c_nationkey"))
    x = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", money.cents(c("l_extendedprice") / c("l_quantity")).alias("p")).groupBy("l_partkey", "l_suppkey").agg(F.min("p").alias("p")).join(s, "l_suppkey")
    local = windows.top_per_group(x, ["c_nationkey", "l_partkey"], [c("p"), c("l_suppkey")])
    every = windows.top_per_group(local, ["l_partkey"], [c("p"), c("l_suppkey")]).select("l_partkey", c("l_suppkey").alias("any"))
    groups = users.select("c_nationkey").distinct()
    wanted = every.join(groups, F.lit(True))
    return wanted.join(local.select("c_nationkey", "l_partkey", "l_suppkey"), ["c_nationkey", "l_partkey"], "left").select("c_nationkey", "l_partkey", F.coalesce("l_suppkey", "any").alias("l_suppkey"))


@query("wn6_first_rows", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 5")
def wn6(spark, d):
    return windows.top_per_group(t(spark, d, "events").select("event_type", "event_id", "ts"), ["event_type"], [c("ts"), c("event_id")], 5).select("event_type", "event_id")


@query("jn15_fallback_store", """WITH s AS (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY 1), r AS (SELECT n_regionkey, min(k) AS k FROM s JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) SELECT n_nationkey, coalesce(s.k, r.k) AS s_suppkey FROM nation LEFT JOIN s ON s_nationkey = n_nationkey LEFT JOIN r USING (n_regionkey)""")
def jn15(spark, d):
    """Each nation's first store, else the first of its region."""
    n = t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = t(spark, d, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("own"))
    x = n.join(s, "n_nationkey", "left")
    near = x.groupBy("n_regionkey").agg(F.min("own").alias("near"))
    return x.join(near, "n_regionkey", "left").select("n_nationkey", F.coalesce("own", "near").alias("s_suppkey"))


@query("sr3_has_more", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 10 AS has_more FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 10)")
def sr3(spark, d):
    """A page of ten and whether more follow, from the first eleven rows."""
    x = windows.page(t(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey"), [c("o_orderkey")], 0, 11)
    every = W.partitionBy()
    place = F.row_number().over(W.orderBy("o_orderkey"))
    return x.select("o_orderkey", (F.count("*").over(every) > 10).alias("has_more"), place.alias("n")).filter("n <= 10").drop("n")


@query("st2_append", "SELECT 'user' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'store', s_nationkey FROM supplier")
def st2(spark, d):
    a = t(spark, d, "customer").select(F.lit("user").alias("kind"), c("c_nationkey").alias("nation"))
    return a.unionByName(t(spark, d, "supplier").select(F.lit("store").alias("kind"), c("s_nationkey").alias("nation")))


@query("a2_adjacent", "SELECT user_id, event_type AS a, nxt AS b, count(*) AS n FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY 1, 2, 3")
def a2(spark, d):
    """Neighbouring events of a user."""
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, d, "events").select("user_id", c("event_type").alias("a"), nxt.alias("b")).filter("b is not null").groupBy("user_id", "a", "b").agg(F.count("*").alias("n"))


@query("tx4_streaks")
def tx4(spark, d):
    """What became of every user's actions in order, and their streak, tokens and milestones after each."""
    return streaks.folded(streaks.as_actions(t(spark, d, "events")))
