"""Aggregations, business queries, text statistics and vectors over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import graph, windows
from ..sources import kept
from .catalog import query
from .tables import t

c = F.col


@query("q3_price_details", """SELECT l_partkey, l_suppkey, last_order, packages, cost_cents, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY cost_cents, l_suppkey) AS INTEGER) AS place FROM (
    SELECT l_partkey, l_suppkey, l_orderkey AS last_order, CAST(greatest(1, ceil(120 / p_size)) AS BIGINT) AS packages, CAST(greatest(1, ceil(120 / p_size)) AS BIGINT) * CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS cost_cents FROM (
    SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE rn = 1)""")
def q3(spark, d):
    """Per product and store the latest offer, the packages that cover a need of 120, their cost, and the store's place."""
    li = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", (c("l_extendedprice") / c("l_quantity")).alias("unit"))
    offers = windows.top_per_group(li, ["l_partkey", "l_suppkey"], [c("l_shipdate").desc(), c("l_orderkey"), c("l_linenumber")])
    offers = offers.join(t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    n = money.packages(F.lit(120.0), c("p_size"))
    offers = offers.select("l_partkey", "l_suppkey", c("l_orderkey").alias("last_order"), n.alias("packages"), (n * money.cents(c("unit"))).alias("cost_cents"))
    return offers.withColumn("place", F.row_number().over(W.partitionBy("l_partkey").orderBy("cost_cents", "l_suppkey")))


@query("q7_daily_usage", """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high, max(value) AS highest, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2""")
def q7(spark, d):
    e = t(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return e.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.count_if(c("value") > 50).alias("n_high"), F.max("value").alias("highest"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("ag1_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2")
def ag1(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(c("l_quantity").cast("long")).alias("quantity"), F.sum(money.cents(c("l_extendedprice"))).alias("cents"), F.max("l_shipdate").alias("last_ship"))


@query("ag5_ordered_list", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
def ag5(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name"), asc=False), ",").alias("names"))


@query("ag7_object", "SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS latest FROM (SELECT user_id, event_type, arg_max(event_id, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY user_id")
def ag7(spark, d):
    """An object per key whose repeated names keep the last value."""
    last = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "v")))
    return last.groupBy("user_id").agg(pairs.alias("p")).select("user_id", F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["event_type"], x["v"].cast("string"))), ";").alias("latest"))


@query("ag9_shortfall", "SELECT p_partkey, CAST(greatest(0, p_size - coalesce(sum(CAST(l_quantity AS BIGINT)), 0)) AS BIGINT) AS short FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY p_partkey, p_size")
def ag9(spark, d):
    have = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(c("l_partkey").alias("p_partkey")).agg(F.sum(c("l_quantity").cast("long")).alias("q"))
    return t(spark, d, "part").select("p_partkey", "p_size").join(have, "p_partkey", "left").select("p_partkey", F.greatest(F.lit(0).cast("long"), c("p_size") - F.coalesce("q", F.lit(0))).alias("short"))


@query("ag10_persons", "SELECT event_type, count(DISTINCT user_id) AS persons FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY event_type")
def ag10(spark, d):
    return t(spark, d, "events").filter(c("ts") >= F.expr("timestamp_ntz '2024-01-10'")).groupBy("event_type").agg(F.countDistinct("user_id").alias("persons"))


@query("ag12_histogram", "SELECT l_partkey, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE l_linenumber = {i}) AS n{i}" for i in range(1, 6)) + " FROM lineitem GROUP BY l_partkey")
def ag12(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), *[F.count_if(c("l_linenumber") == i).alias(f"n{i}") for i in range(1, 6)])


# Tags that count, in the order that breaks ties.
_TAGS = ["widget", "bolt", "gear", "ring", "red", "blue", "green", "small", "large"]


@query("ag13_tags", f"""SELECT tag, n FROM (SELECT tag, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE tag IN ({', '.join(f"'{x}'" for x in _TAGS)}) GROUP BY tag)
    ORDER BY n DESC, list_position([{', '.join(f"'{x}'" for x in _TAGS)}], tag) LIMIT 3""")
def ag13(spark, d):
    """Each tag once per row, those of the list only; of equally frequent ones the earlier of the list."""
    allowed = F.array(*map(F.lit, _TAGS))
    tags = t(spark, d, "part").select(F.explode(F.array_intersect(F.split("p_name", " "), allowed)).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(c("n").desc(), F.array_position(allowed, c("tag"))).limit(3)


@query("ag14_success", "SELECT user_id, s, f, CASE WHEN s + f >= 3 THEN CAST(floor(100.0 * s / (s + f) + 0.5) AS INTEGER) END AS percent FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS s, count(*) FILTER (WHERE event_type = 'error') AS f FROM events GROUP BY user_id)")
def ag14(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg(F.count_if(c("event_type") == "purchase").alias("s"), F.count_if(c("event_type") == "error").alias("f"))
    return g.withColumn("percent", F.when(c("s") + c("f") >= 3, F.floor(F.try_divide(100.0 * c("s"), (c("s") + c("f"))) + 0.5).cast("int")))


@query("ag16_calendar", """SELECT day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) USING (day)""")
def ag16(spark, d):
    days = spark.sql("select explode(sequence(date '2023-12-25', date '2024-02-04')) as day")
    n = t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("ag19_savings", "SELECT l_suppkey, cents, max(cents) OVER () - cents AS savings FROM (SELECT l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1)")
def ag19(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(money.cents(c("l_extendedprice"))).alias("cents"))
    return g.withColumn("savings", F.max("cents").over(W.partitionBy()) - c("cents"))


@query("ag22_bins", "SELECT CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS bin, count(*) AS seen, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted FROM lineitem GROUP BY 1 HAVING count(*) >= 10")
def ag22(spark, d):
    b = F.floor(c("l_discount") * 100 + 0.5).cast("int").alias("bin")
    return t(spark, d, "lineitem").groupBy(b).agg(F.count("*").alias("seen"), F.count_if(c("l_returnflag") == "A").alias("accepted")).filter("seen >= 10")


@query("ag26_profile", "SELECT l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM lineitem GROUP BY 1")
def ag26(spark, d):
    return windows.share_of_total(t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), "n", "percent")


@query("ag27_bands", "SELECT CASE WHEN value IS NULL THEN 'none' WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM events GROUP BY 1")
def ag27(spark, d):
    v = c("value")
    return t(spark, d, "events").groupBy(F.when(v.isNull(), "none").when(v < 10, "low").when(v < 50, "middle").otherwise("high").alias("band")).agg(F.count("*").alias("n"))


@query("d1_week_start", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders")
def d1(spark, d):
    return t(spark, d, "orders").select("o_orderkey", money.week_start(F.to_date("o_orderdate")).alias("week"))


@query("d7_month", "SELECT strftime(o_orderdate, '%Y-%m-01') AS month, count(*) AS n FROM orders GROUP BY 1")
def d7(spark, d):
    return t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("month")).agg(F.count("*").alias("n"))


@query("q14_budget", """SELECT user_id, week, spent, greatest(0, 60000 - spent) AS surplus, least(greatest(0, 60000 - spent), 18000) AS bankable FROM (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS spent FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)""")
def q14(spark, d):
    e = t(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id", money.week_start(F.to_date("ts")).alias("week")).agg(F.sum(money.cents(c("value"))).alias("spent"))
    b = F.lit(60000)
    return e.select("user_id", "week", "spent", money.surplus(b, c("spent")).alias("surplus"), money.bankable(b, c("spent"), 3000).alias("bankable"))


@query("q15_streaks", """SELECT user_id, count(*) AS days, CAST(max(run) AS BIGINT) AS longest FROM (SELECT user_id, day, count(*) OVER (PARTITION BY user_id, island) AS run FROM (SELECT user_id, day, date_diff('day', DATE '2000-01-01', day) - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island
    FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'login' OR event_type = 'click'))) GROUP BY user_id""")
def q15(spark, d):
    """Days in a row, as islands: a day's number less its place is constant along a streak."""
    days = t(spark, d, "events").filter(c("event_type").isin("login", "click")).select("user_id", F.to_date("ts").alias("day")).distinct()
    n = F.row_number().over(W.partitionBy("user_id").orderBy("day"))
    runs = days.select("user_id", (F.datediff("day", F.lit("2000-01-01").cast("date")) - n).alias("island")).groupBy("user_id", "island").agg(F.count("*").alias("run"))
    return runs.groupBy("user_id").agg(F.sum("run").alias("days"), F.max("run").alias("longest"))


@query("m15_calibration", """WITH e AS (SELECT event_id, least(1.0, value / 100) AS raw, event_type = 'purchase' AS ok FROM events), b AS (SELECT least(9, CAST(floor(raw * 10) AS INTEGER)) AS bin, count(*) AS seen, count(*) FILTER (WHERE ok) AS accepted FROM e GROUP BY 1),
    g AS (SELECT sum(accepted)::DOUBLE / sum(seen)::DOUBLE AS overall, sum(seen) AS total FROM b) SELECT bin, seen, accepted, CASE WHEN total < 50 THEN (bin + 0.5) / 10 ELSE round(0.6 * ((bin + 0.5) / 10) + 0.4 * (least(1.0, seen / 60.0::DOUBLE) * (accepted::DOUBLE / seen) + (1 - least(1.0, seen / 60.0::DOUBLE)) * overall), 3) END AS calibrated FROM b, g""")
def m15(spark, d):
    e = t(spark, d, "events").select(F.least(F.lit(1.0), c("value") / 100).alias("raw"), (c("event_type") == "purchase").alias("ok"))
    b = e.groupBy(F.least(F.lit(9), F.floor(c("raw") * 10).cast("int")).alias("bin")).agg(F.count("*").alias("seen"), F.count_if("ok").alias("accepted"))
    every = W.partitionBy()
    overall = F.sum("accepted").over(every).cast("double") / F.sum("seen").over(every).cast("double")
    return b.select("bin", "seen", "accepted", money.calibrated((c("bin") + 0.5).cast("double") / 10, c("accepted"), c("seen").cast("double"), overall, F.sum("seen").over(every)).alias("calibrated"))


@query("s5_name_similarity", """WITH n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part) SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM n a JOIN n b ON a.p_name < b.p_name AND len(list_intersect(a.w, b.w)) > 0""")
def s5(spark, d):
    """Names that share a word, by word sets; pairs come from an equi-join on words, not from a cross join."""
    n = t(spark, d, "part").select("p_name").distinct().withColumn("w", text.tokens(c("p_name")))
    words = n.select("p_name", "w", F.explode(F.array_distinct("w")).alias("x"))
    a, b = words.select(c("p_name").alias("a"), c("w").alias("wa"), "x"), words.select(c("p_name").alias("b"), c("w").alias("wb"), "x")
    pairs = a.join(b, "x").filter("a < b").dropDuplicates(["a", "b"])
    return pairs.select("a", "b", F.round(text.jaccard(c("wa"), c("wb")), 6).alias("jaccard"))


@query("m13_idf", """SELECT word, df, round(ln((n + 1)::DOUBLE / (df + 1)) / ln((n + 1)::DOUBLE), 6) AS idf FROM (SELECT word, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word FROM conversations) GROUP BY word), (SELECT count(*) AS n FROM conversations) WHERE df >= 5 AND word <> ''""")
def m13(spark, d):
    conv = t(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    n = t(spark, d, "conversations").agg(F.count("*").alias("n"))
    df = conv.groupBy("word").agg(F.count("*").alias("df")).filter("df >= 5 and word <> ''")
    return df.join(F.broadcast(n), F.lit(True)).select("word", "df", F.round(F.log((c("n") + 1) / (c("df") + 1)) / F.log(c("n") + 1.0), 6).alias("idf"))


@query("m14_pairs", """SELECT a, b, count(*) AS joint FROM (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(p_name, ' ') AS w FROM part))) GROUP BY 1, 2 HAVING count(*) >= 3""")
def m14(spark, d):
    w = F.split("p_name", " ")
    pairs = F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("a"), F.slice(w, F.lit(2), F.size(w) - 1).alias("b"))
    return t(spark, d, "part").select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("joint")).filter("joint >= 3")


@query("s32_key", "SELECT event_id, lower(trim(event_type)) || ':' || user_id AS key FROM events")
def s32(spark, d):
    return t(spark, d, "events").select("event_id", text.idempotency_key(c("event_type"), c("user_id")).alias("key"))


@query("snk7_idempotent", """SELECT min(event_id) AS event_id, user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) % 2 = 0 AS duplicate FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)""")
def snk7(spark, d):
    """Of events with one key the earliest, and whether an append of them found it there (here: those of even number)."""
    path = f"{graph.shared_dir(spark)}/larder/{uuid.uuid4().hex}"
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    keys, order = ["user_id", "event_type", "day"], [c("event_id")]
    first = windows.top_per_group(e, keys, order)
    kept.append(spark, path, first.filter("event_id % 2 = 0"), keys, order)
    return kept.append(spark, path, e, keys, order)


@query("pc1_label_centres", "SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x1, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS x2 FROM embeddings GROUP BY label")
def pc1(spark, d):
    e = t(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(F.get("embedding", F.lit(i)).cast("double")), 6).alias(f"x{i + 1}") for i in (0, 1)])
