"""Scans, filters, projections, joins, windows, sorts and set operations over the driver's tables.

Roles: part is a product, supplier a store, nation its banner, lineitem an offer or purchase, customer a user, orders a
basket, events an event log. Money is summed in whole cents, so that results do not depend on the order of adding.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money
from ..operators import ranking, windows
from .catalog import query
from .tables import t

c = F.col


@query("src1_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def src1(spark, d):
    return t(spark, d, "lineitem").filter(c("l_quantity") >= 45).select("l_orderkey", "l_linenumber", "l_quantity")


@query("src2_embed", "SELECT o_orderkey, o_orderstatus, count(l_linenumber) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def src2(spark, d):
    """A parent with its children as one ordered list; parents without children stay."""
    kids = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("k"))
    text = F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(kids, c("l_orderkey") == c("o_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce(text, F.lit("")).alias("lines"))


@query("src4_keyed_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity > 40)")
def src4(spark, d):
    keys = t(spark, d, "lineitem").filter((c("l_discount") >= 0.1) & (c("l_quantity") > 40)).select(c("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").select("p_partkey", "p_name").join(keys, "p_partkey", "left_semi")


@query("src5_count", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def src5(spark, d):
    return t(spark, d, "lineitem").filter("l_returnflag = 'R'").agg(F.count("*").alias("n"))


@query("src9_json_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90")
def src9(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k >= 90")


@query("flt1_conjunction", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_totalprice <= 300000 AND o_orderpriority <> '5-LOW'")
def flt1(spark, d):
    return t(spark, d, "orders").filter((c("o_orderstatus") == "F") & (c("o_totalprice") > 100000) & (c("o_totalprice") <= 300000) & (c("o_orderpriority") != "5-LOW")).select("o_orderkey")


@query("flt2_null", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
def flt2(spark, d):
    lab = t(spark, d, "labels").select("doc_id", "toxic")
    return t(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").filter(c("toxic").isNull()).select("doc_id")


@query("flt3_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def flt3(spark, d):
    return t(spark, d, "customer").filter(c("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("flt4_contains_all", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'widget'])")
def flt4(spark, d):
    want = F.array(F.lit("red"), F.lit("widget"))
    return t(spark, d, "part").filter(F.size(F.array_except(want, F.split("p_name", " "))) == 0).select("p_partkey")


@query("flt5_null_or_range", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality >= 1")
def flt5(spark, d):
    lab = t(spark, d, "labels").select("doc_id", "quality")
    return t(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").filter(c("quality").isNull() | (c("quality") >= 1)).select("doc_id")


@query("flt6_ilike_any", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE '%econ%'")
def flt6(spark, d):
    return t(spark, d, "part").filter(c("p_name").ilike("%RED%") | c("p_type").ilike("%econ%")).select("p_partkey", "p_name")


@query("flt8_json_path", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def flt8(spark, d):
    return t(spark, d, "events").filter(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("flt9_active_interval", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-01' AND TIMESTAMP '1997-06-01' <= o_orderdate + INTERVAL 30 DAY")
def flt9(spark, d):
    now = F.expr("timestamp_ntz '1997-06-01'")
    return t(spark, d, "orders").filter((c("o_orderdate") <= now) & (now <= c("o_orderdate") + F.expr("interval 30 days"))).select("o_orderkey")


@query("flt11_null_safe", "SELECT a.doc_id FROM (SELECT doc_id, toxic, quality FROM documents LEFT JOIN labels USING (doc_id)) a WHERE a.toxic IS NOT DISTINCT FROM a.quality")
def flt11(spark, d):
    lab = t(spark, d, "labels")
    return t(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").filter(c("toxic").eqNullSafe(c("quality"))).select("doc_id")


@query("flt12_exact_or_any", """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag = 'A' OR NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = l.l_partkey AND x.l_returnflag = 'A')""")
def flt12(spark, d):
    """Exact rows where the key has one, else any: the existence is one flag per key, joined."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    exact = li.filter("l_returnflag = 'A'").select("l_partkey").distinct().withColumn("exact", F.lit(True))
    return li.join(exact, "l_partkey", "left").filter((c("l_returnflag") == "A") | c("exact").isNull()).select("l_orderkey", "l_linenumber")


@query("flt14_visibility", """SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = 7 OR o.o_orderstatus = 'O' OR (o.o_orderstatus = 'F' AND EXISTS
    (SELECT 1 FROM customer f, customer v WHERE v.c_custkey = 7 AND f.c_custkey = o.o_custkey AND f.c_nationkey = v.c_nationkey))""")
def flt14(spark, d):
    """The owner's rows, public rows, and followers' rows of those the viewer follows (here: customers of one nation)."""
    o, cu = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), t(spark, d, "customer").select("c_custkey", "c_nationkey")
    home = cu.filter("c_custkey = 7").select("c_nationkey")
    followed = cu.join(F.broadcast(home), "c_nationkey").select(c("c_custkey").alias("o_custkey"), F.lit(True).alias("followed"))
    return o.join(followed, "o_custkey", "left").filter((c("o_custkey") == 7) | (c("o_orderstatus") == "O") | ((c("o_orderstatus") == "F") & c("followed"))).select("o_orderkey")


@query("prj1_conditional", "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS class, greatest(p_size, 10) AS size_floor, nullif(p_size, 1) AS size_or_null FROM part")
def prj1(spark, d):
    size = c("p_size")
    return t(spark, d, "part").select("p_partkey", F.when(size > 30, "large").when(size > 10, "middle").otherwise("small").alias("class"), F.greatest(size, F.lit(10)).alias("size_floor"), F.nullif(size, F.lit(1)).alias("size_or_null"))


@query("jn1_inner", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn1(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return t(spark, d, "supplier").join(n, c("s_nationkey") == n["n_nationkey"]).join(r, c("n_regionkey") == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("jn2_composite", "SELECT a.l_orderkey, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey GROUP BY a.l_orderkey")
def jn2(spark, d):
    """Later offers of the same product and store are counted in one window of the key; pairs are never made."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    later = F.count("*").over(W.partitionBy("l_partkey", "l_suppkey").orderBy(c("l_orderkey").desc()).rangeBetween(W.unboundedPreceding, -1))
    return li.withColumn("n", later).groupBy("l_orderkey").agg(F.sum("n").alias("pairs")).filter("pairs > 0")


@query("jn3_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def jn3(spark, d):
    n = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t(spark, d, "customer").join(n, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("jn6_gaps", """SELECT n_nationkey, p_brand FROM nation, (SELECT DISTINCT p_brand FROM part) b WHERE NOT EXISTS
    (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = n_nationkey AND part.p_brand = b.p_brand)""")
def jn6_all(spark, d):
    return _gaps(spark, d, t(spark, d, "lineitem"))


def _gaps(spark, d, offers):
    """Required pairs without an offer: two dimensions of fixed size crossed, less the pairs that occur."""
    want = t(spark, d, "nation").select("n_nationkey").join(t(spark, d, "part").select("p_brand").distinct(), F.lit(True))
    have = offers.select("l_partkey", "l_suppkey")
    have = have.join(t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("n_nationkey")), "l_suppkey")
    return want.join(have.select("n_nationkey", "p_brand").distinct(), ["n_nationkey", "p_brand"], "left_anti")


@query("jn7_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def jn7(spark, d):
    big = t(spark, d, "orders").filter("o_totalprice > 450000").select(c("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("jn8_latest_price", """SELECT p_partkey, l_orderkey AS last_order, l_suppkey AS last_store FROM part LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) x ON l_partkey = p_partkey AND rn = 1""")
def jn8(spark, d):
    li = t(spark, d, "lineitem").select(c("l_partkey").alias("p_partkey"), "l_shipdate", c("l_orderkey").alias("last_order"), "l_linenumber", c("l_suppkey").alias("last_store"))
    order = [c("l_shipdate").desc(), c("last_order"), c("l_linenumber")]
    return windows.latest_lookup(t(spark, d, "part").select("p_partkey"), li, ["p_partkey"], order, ["last_order", "last_store"])


@query("jn12_fallback_key", """SELECT e.event_id, coalesce(a.n_name, b.n_name) AS name FROM events e LEFT JOIN nation a ON a.n_nationkey = e.user_id LEFT JOIN nation b ON b.n_nationkey = e.user_id % 25 WHERE e.event_type = 'purchase'""")
def jn12(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    e = t(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id")
    a = n.select(c("n_nationkey").cast("long").alias("user_id"), c("n_name").alias("a"))
    b = n.select(c("n_nationkey").cast("long").alias("k"), c("n_name").alias("b"))
    return e.join(a, "user_id", "left").withColumn("k", c("user_id") % 25).join(b, "k", "left").select("event_id", F.coalesce("a", "b").alias("name"))


@query("jn16_fifo_pairs", """SELECT a.user_id, a.event_id AS click_id, b.event_id AS purchase_id FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click') a JOIN
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.n = b.n""")
def jn16(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type")
    clicks = e.filter("event_type = 'click'").select("user_id", c("event_id").alias("click_id"))
    buys = e.filter("event_type = 'purchase'").select("user_id", c("event_id").alias("purchase_id"))
    return windows.pair_in_order(clicks, buys, ["user_id"], [c("click_id")], [c("purchase_id")])


@query("wn1_best_offer", """SELECT l_partkey, s_nationkey, l_orderkey, l_linenumber FROM (SELECT l_partkey, s_nationkey, l_orderkey, l_linenumber, row_number() OVER
    (PARTITION BY l_partkey, s_nationkey ORDER BY l_extendedprice / l_quantity, l_orderkey, l_linenumber) AS rn FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) WHERE rn = 1""")
def wn1(spark, d):
    s = t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_nationkey")
    li = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", (c("l_extendedprice") / c("l_quantity")).alias("p")).join(s, "l_suppkey")
    return windows.top_per_group(li, ["l_partkey", "s_nationkey"], [c("p"), c("l_orderkey"), c("l_linenumber")]).select("l_partkey", "s_nationkey", "l_orderkey", "l_linenumber")


@query("wn4_distinct_on", "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def wn4(spark, d):
    cu = t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return windows.top_per_group(cu, ["c_nationkey"], [c("c_acctbal").desc(), c("c_custkey")]).select("c_nationkey", "c_custkey")


@query("wn7_gaps", """SELECT user_id, round(avg(gap), 6) AS avg_gap, CAST(least(35, greatest(10, floor(avg(gap) * 2.5 + 0.5))) AS INTEGER) AS nudge FROM (SELECT user_id, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap
    FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')) WHERE gap IS NOT NULL GROUP BY user_id""")
def wn7(spark, d):
    days = t(spark, d, "events").filter("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(W.partitionBy("user_id").orderBy("day")))
    g = days.select("user_id", gap.alias("gap")).filter("gap is not null").groupBy("user_id").agg(F.avg("gap").alias("a"))
    return g.select("user_id", F.round("a", 6).alias("avg_gap"), money.nudge_days(c("a")).alias("nudge"))


@query("wn9_leaderboard", "SELECT user_id, n, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS place, user_id = 5 AS is_viewer FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def wn9(spark, d):
    """Ranks with equal places for equal counts; what is ordered as a whole are the distinct counts, not users."""
    n = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return ranking.ranked(n, "n").select("user_id", "n", c("place").cast("int").alias("place"), (c("user_id") == 5).alias("is_viewer"))


@query("sr2_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def sr2(spark, d):
    return windows.page(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [c("o_totalprice").desc(), c("o_orderkey")], 40, 20)


@query("sr7_store_order", """SELECT s_suppkey, n_items, missing, CAST(row_number() OVER (ORDER BY missing, total, s_suppkey) AS INTEGER) AS place FROM (SELECT s_suppkey, count(DISTINCT l_partkey) AS n_items, (SELECT count(*) FROM part) - count(DISTINCT l_partkey) AS missing,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey)""")
def sr7(spark, d):
    """Stores by products that they do not sell, then by total; ranked by ranges."""
    li = t(spark, d, "lineitem").select(c("l_suppkey").alias("s_suppkey"), "l_partkey", money.cents(c("l_extendedprice")).alias("x"))
    g = li.groupBy("s_suppkey", "l_partkey").agg(F.sum("x").alias("x")).groupBy("s_suppkey").agg(F.count("*").alias("n_items"), F.sum("x").alias("total"))
    parts = t(spark, d, "part").agg(F.count("*").alias("parts"))
    g = g.join(F.broadcast(parts), F.lit(True)).withColumn("missing", c("parts") - c("n_items"))
    g = ranking.numbered(g, [], [c("missing"), c("total"), c("s_suppkey")])
    return g.select("s_suppkey", "n_items", "missing", c("place").cast("int").alias("place"))


@query("st1_union_distinct", "SELECT p_brand AS word FROM part UNION SELECT c_mktsegment FROM customer")
def st1(spark, d):
    return t(spark, d, "part").select(c("p_brand").alias("word")).union(t(spark, d, "customer").select("c_mktsegment")).distinct()


@query("st5_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def st5(spark, d):
    return t(spark, d, "customer").select("c_custkey").join(t(spark, d, "orders").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").distinct()


@query("st7_dedupe_key", "SELECT DISTINCT CASE WHEN l_suppkey > 0 THEN l_suppkey || '|' || l_partkey || '|' || CAST(round(l_extendedprice * 100) AS BIGINT) END AS key FROM lineitem")
def st7_all(spark, d):
    return _dedupe_keys(t(spark, d, "lineitem"))


def _dedupe_keys(offers):
    key = F.when(c("l_suppkey") > 0, F.concat_ws("|", c("l_suppkey").cast("string"), c("l_partkey").cast("string"), money.cents(c("l_extendedprice")).cast("string")))
    return offers.select(key.alias("key")).distinct()
