"""Baskets over stores, weekly plans, nearby stores, units, and views of prices and products (roles as in relational)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, standard, text, titles, units
from ..operators import batches, graph, spatial, text_search, windows
from ..sources import io
from .catalog import query
from .tables import t

c = F.col

# -- baskets over stores -------------------------------------------------------------------------------------------------

_BASKET = """WITH demand AS (SELECT c_nationkey AS nation, l_partkey, count(*) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
    basket AS (SELECT nation, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY k DESC, l_partkey) AS r FROM demand) WHERE r <= 30),
    lines AS (SELECT b.nation, l_suppkey, b.l_partkey, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey
        JOIN basket b ON b.nation = s_nationkey AND b.l_partkey = l.l_partkey GROUP BY ALL),
    stores AS (SELECT nation, l_suppkey, count(*) AS n_items, sum(cents) AS total, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey * 13 % 50 END AS miles FROM lines GROUP BY ALL),
    compared AS (SELECT s.*, size - n_items AS missing FROM stores s JOIN (SELECT nation, count(*) AS size FROM basket GROUP BY 1) USING (nation))"""


def _basket(spark, d):
    """A nation's 30 products of most orders: the list that its stores are compared by."""
    cu = t(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), c("c_nationkey").alias("nation"))
    buys = t(spark, d, "orders").select("o_custkey", c("o_orderkey").alias("l_orderkey")).join(cu, "o_custkey")
    demand = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(buys, "l_orderkey").groupBy("nation", "l_partkey").agg(F.count("*").alias("k"))
    return windows.top_per_group(demand, ["nation"], [c("k").desc(), c("l_partkey")], 30).select("nation", "l_partkey")


def _least(spark, d, li):
    """nation, store, product, its least price in cents."""
    s = t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("nation"))
    li = li.select("l_suppkey", "l_partkey", money.cents(c("l_extendedprice")).alias("cents"))
    return li.groupBy("l_suppkey", "l_partkey").agg(F.min("cents").alias("cents")).join(s, "l_suppkey")


def _compared(spark, d):
    basket = _basket(spark, d)
    g = _least(spark, d, t(spark, d, "lineitem")).join(basket, ["nation", "l_partkey"]).groupBy("nation", "l_suppkey").agg(F.count("*").alias("n_items"), F.sum("cents").alias("total"))
    g = g.join(basket.groupBy("nation").agg(F.count("*").alias("size")), "nation").withColumn("missing", c("size") - c("n_items"))
    return g.withColumn("miles", F.when(c("l_suppkey") % 7 > 0, c("l_suppkey") * 13 % 50))


@query("sr7_store_orders", f"""{_BASKET} SELECT nation, l_suppkey, missing, total, CAST(row_number() OVER (PARTITION BY nation ORDER BY missing, total, l_suppkey) AS INTEGER) AS cheapest,
    CAST(row_number() OVER (PARTITION BY nation ORDER BY missing, total / n_items, total, l_suppkey) AS INTEGER) AS best_value,
    CAST(row_number() OVER (PARTITION BY nation ORDER BY missing, miles ASC NULLS LAST, total, l_suppkey) AS INTEGER) AS nearest FROM compared""")
def sr7_orders(spark, d):
    """A list's stores in three orders, each by missing items first: total; price of an item; distance, unknown last."""
    place = lambda *order: F.row_number().over(W.partitionBy("nation").orderBy("missing", *order, "total", "l_suppkey"))
    each = c("total") / c("n_items")
    return _compared(spark, d).select("nation", "l_suppkey", "missing", "total", place().alias("cheapest"), place(each).alias("best_value"), place(c("miles").asc_nulls_last()).alias("nearest"))


@query("q8_cheapest_saving", f"""{_BASKET} SELECT nation, l_suppkey, total, max(total) OVER (PARTITION BY nation) - total AS savings FROM compared WHERE missing = 0 OR n_items >= 2""")
def q8_saving(spark, d):
    """What each of a list's stores saves against its dearest, of stores that have all or at least two of the items."""
    x = _compared(spark, d).filter("missing = 0 or n_items >= 2")
    return x.select("nation", "l_suppkey", "total", (F.max("total").over(W.partitionBy("nation")) - c("total")).alias("savings"))


_PLAN = """WITH sold AS (SELECT c_nationkey AS nation, l_partkey, count(*) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
    pool AS (SELECT nation, l_partkey, kind, r FROM (SELECT nation, l_partkey, p_size % 3 AS kind, row_number() OVER (PARTITION BY nation, p_size % 3 ORDER BY k DESC, l_partkey) AS r FROM sold JOIN part ON p_partkey = l_partkey) WHERE r <= 12),
    taken AS (SELECT DISTINCT o_custkey, o_orderkey % 7 AS day, p_size % 3 AS kind, min(l_partkey) OVER (PARTITION BY o_orderkey) AS dish FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'P'),
    free AS (SELECT c_custkey, c_nationkey AS nation, day, kind, row_number() OVER (PARTITION BY c_custkey, kind ORDER BY day) AS n, count(*) OVER (PARTITION BY c_custkey, kind) AS slots FROM customer, range(7) x(day), range(3) y(kind)
        WHERE NOT EXISTS (SELECT 1 FROM taken WHERE o_custkey = c_custkey AND taken.day = x.day AND taken.kind = y.kind)),
    dish AS (SELECT c_custkey, l_partkey, pool.kind, row_number() OVER (PARTITION BY c_custkey, pool.kind ORDER BY r) AS n FROM (SELECT DISTINCT c_custkey, nation, kind, slots FROM free) f JOIN pool ON pool.nation = f.nation AND pool.kind = f.kind AND r <= slots + 5
        WHERE NOT EXISTS (SELECT 1 FROM taken WHERE o_custkey = c_custkey AND taken.dish = l_partkey)),
    plan AS (SELECT free.c_custkey, free.nation, CAST(day AS BIGINT) AS day, CAST(free.kind AS INTEGER) AS kind, l_partkey FROM free JOIN dish USING (c_custkey, kind, n))"""


def _sized(spark, d):
    """l_partkey, kind. Here and below, tables that grow are merged: their files look small enough to broadcast, their rows
    are not."""
    return t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), (c("p_size") % 3).alias("kind")).hint("merge")


def _pool(spark, d):
    """nation, kind, l_partkey, r: a nation's twelve favourite dishes of each kind, written once."""
    cu = t(spark, d, "customer").select("c_custkey", c("c_nationkey").alias("nation")).hint("merge")
    o = t(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("c_custkey"))
    sold = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(o.join(cu, "c_custkey"), "l_orderkey").groupBy("nation", "l_partkey").agg(F.count("*").alias("k"))
    return graph.stored(windows.top_per_group(sold.join(_sized(spark, d), "l_partkey"), ["nation", "kind"], [c("k").desc(), c("l_partkey")], 12, "r").drop("k"))


def _plan(spark, d, pool):
    """A customer's meals of seven days and three kinds: open slots, in order, take the nation's favourite dishes of their
    kind that the customer has not planned. A dish is of one kind, so the n-th slot of a kind gets its n-th dish.
    Orders of status P stand for meals that are planned; a kind's pool holds five dishes more than it has slots.
    A customer is one row until the end: days taken are bits, and of planned dishes only those of a pool are kept."""
    kinds = range(3)
    o = t(spark, d, "orders").filter("o_orderstatus = 'P'").select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("c_custkey"))
    planned = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey").join(_sized(spark, d), "l_partkey")
    bits = [F.bit_or(F.when(c("kind") == k, F.call_function("shiftleft", F.lit(1), (c("l_orderkey") % 7).cast("int")))).alias(f"taken{k}") for k in kinds]
    order = planned.groupBy("l_orderkey", "c_custkey").agg(F.min("l_partkey").alias("l_partkey"), *bits)
    known = order.join(F.broadcast(pool.select("l_partkey", F.lit(True).alias("pooled")).distinct()), "l_partkey", "left")
    taken = known.groupBy("c_custkey").agg(F.collect_set(F.when(c("pooled"), c("l_partkey"))).alias("planned"), *[F.bit_or(f"taken{k}").alias(f"taken{k}") for k in kinds])
    dishes = pool.groupBy("nation").agg(*[F.array_sort(F.collect_list(F.when(c("kind") == k, F.struct("r", "l_partkey")))).alias(f"pool{k}") for k in kinds])
    week = t(spark, d, "customer").select("c_custkey", c("c_nationkey").alias("nation")).join(taken.hint("merge"), "c_custkey", "left").join(F.broadcast(dishes), "nation")

    def meals(k):
        bit = lambda x: F.coalesce(c(f"taken{k}"), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1), x))
        days = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda x: bit(x) == 0)
        free = F.filter(f"pool{k}", lambda x: (x["r"] <= F.size(days) + 5) & ~F.coalesce(F.array_contains("planned", x["l_partkey"]), F.lit(False)))
        n = F.least(F.size(days), F.size(free))
        return F.zip_with(F.slice(days, F.lit(1), n), F.slice(free, F.lit(1), n), lambda day, x: F.struct(day.cast("long").alias("day"), F.lit(k).alias("kind"), x["l_partkey"].alias("l_partkey")))

    return week.select("c_custkey", "nation", F.inline(F.concat(*map(meals, kinds))))


@query("q17_weekly_plan", f"{_PLAN} SELECT c_custkey, day, kind, l_partkey FROM plan")
def q17(spark, d):
    """Open slots of the week with their dishes, none twice and none planned already."""
    return _plan(spark, d, _pool(spark, d)).drop("nation")


@query("q16_plan_store", f"""{_PLAN}, price AS (SELECT s_nationkey AS nation, l_suppkey, l_partkey, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
    SELECT c_custkey, l_suppkey, n_dishes, total FROM (SELECT c_custkey, l_suppkey, count(*) AS n_dishes, sum(cents) AS total, row_number() OVER (PARTITION BY c_custkey ORDER BY count(*) DESC, sum(cents), l_suppkey) AS r
    FROM plan JOIN price USING (nation, l_partkey) GROUP BY 1, 2) WHERE r = 1""")
def q16(spark, d):
    """For each customer's plan the store of the nation that has most of its dishes, then the cheapest."""
    pool = _pool(spark, d)
    sold = t(spark, d, "lineitem").join(F.broadcast(pool.select("l_partkey").distinct()), "l_partkey", "left_semi")  # of no other dish a price is asked
    prices = text_search.checked(_least(spark, d, sold).join(F.broadcast(pool.select("nation", "l_partkey")), ["nation", "l_partkey"], "left_semi"))
    x = _plan(spark, d, pool).join(prices, ["nation", "l_partkey"]).groupBy("c_custkey", "l_suppkey").agg(F.count("*").alias("n_dishes"), F.sum("cents").alias("total"))
    return windows.top_per_group(x, ["c_custkey"], [c("n_dishes").desc(), c("total"), c("l_suppkey")]).select("c_custkey", "l_suppkey", "n_dishes", "total")


# -- stores in a radius (coordinates are made from the keys) ------------------------------------------------------------

_PLACES = """WITH s AS (SELECT s_suppkey, s_nationkey % 5 AS brand, s_suppkey * 37 % 4000 / 100.0::DOUBLE AS la, s_suppkey * 61 % 9000 / 100.0::DOUBLE AS lo FROM supplier),
    u AS (SELECT c_custkey, c_custkey * 37 % 4000 / 100.0::DOUBLE AS la, c_custkey * 89 % 9000 / 100.0::DOUBLE AS lo FROM customer),
    near AS (SELECT *, 2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin(radians(s.la - u.la) / 2), 2) + cos(radians(u.la)) * cos(radians(s.la)) * pow(sin(radians(s.lo - u.lo) / 2), 2)))) AS miles FROM u, s)"""


def _places(spark, d):
    place = lambda k, times: (k * 37 % 4000 / 100.0, k * times % 9000 / 100.0)
    u, s = place(c("c_custkey"), 89), place(c("s_suppkey"), 61)
    users = t(spark, d, "customer").select("c_custkey", u[0].alias("lat"), u[1].alias("lng"))
    return users, t(spark, d, "supplier").select("s_suppkey", (c("s_nationkey") % 5).alias("brand"), s[0].alias("place_lat"), s[1].alias("place_lng"))


@query("jn14_radius", f"{_PLACES} SELECT c_custkey, s_suppkey, round(miles, 6) AS miles FROM near WHERE miles * 1609.34 <= 500000")
def jn14_radius(spark, d):
    """All stores within 500 km of each customer."""
    users, stores = _places(spark, d)
    return spatial.within(users, stores.drop("brand"), 500_000.0, 6).select("c_custkey", "s_suppkey", "miles")


@query("jn14_first_of_brand", f"""{_PLACES} SELECT c_custkey, brand, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, brand ORDER BY round(miles, 6), s_suppkey) AS n FROM near WHERE miles * 1609.34 <= 500000) WHERE n = 1""")
def jn14_brand(spark, d):
    """Of each brand the nearest store in that radius."""
    return spatial.nearest_within(*_places(spark, d), 500_000.0, "s_suppkey", "brand").select("c_custkey", "brand", "s_suppkey")


# -- units ---------------------------------------------------------------------------------------------------------------

_UNITS = ["oz", "cup", "kg", "dozen", "pinch"]
_SIZES = "(VALUES " + ", ".join(f"('{u}', '{k}', {v}::DOUBLE)" for k, kind in (("mass", units.MASS), ("volume", units.VOLUME), ("count", units.COUNT)) for u, v in kind.items()) + ") AS x(unit, kind, size)"
_UNIT_OF = "list_extract(['oz', 'cup', 'kg', 'dozen', 'pinch'], 1 + CAST(l_partkey % 5 AS INTEGER))"
_WANTED_OF = "list_extract(['g', 'ml', 'g', 'each'], 1 + CAST(l_suppkey % 4 AS INTEGER))"
_pick = lambda key, values: F.element_at(F.array(*map(F.lit, values)), (c(key) % len(values) + 1).cast("int"))


@query("m11_converted", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a.kind = b.kind THEN l_quantity * a.size / b.size WHEN l_tax > 0 AND a.kind = 'mass' AND b.kind = 'volume' THEN l_quantity * a.size / ((0.5 + l_tax) * b.size)
    WHEN l_tax > 0 AND a.kind = 'volume' AND b.kind = 'mass' THEN l_quantity * a.size * (0.5 + l_tax) / b.size END AS quantity FROM lineitem LEFT JOIN {_SIZES.replace('x(', 'a(')} ON a.unit = {_UNIT_OF} LEFT JOIN {_SIZES.replace('x(', 'b(')} ON b.unit = {_WANTED_OF}""")
def m11(spark, d):
    """Quantities in another unit; null where kinds differ and no density is known, or a unit has no size."""
    density = F.when(c("l_tax") > 0, 0.5 + c("l_tax"))
    x = units.converted(c("l_quantity"), _pick("l_partkey", _UNITS), _pick("l_suppkey", ["g", "ml", "g", "each"]), density)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("quantity"))


@query("m12_base_price", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 0 THEN l_extendedprice / (l_quantity * size) END AS price FROM lineitem LEFT JOIN {_SIZES} ON unit = {_UNIT_OF}")
def m12(spark, d):
    """Price of a gram, millilitre or piece."""
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", units.price_per_base_unit(c("l_extendedprice"), c("l_quantity"), _pick("l_partkey", _UNITS)).alias("price"))


@query("s30_unit_hint", """SELECT p_partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN 'fl oz' END, CASE WHEN p_size % 7 = 0 THEN p_type END, CASE WHEN p_partkey % 2 = 0 THEN 'sq. ft' END) AS unit FROM part""")
def s30(spark, d):
    """Scraped fields that hold a unit now and then: the row's own, its unit, its size, the end of a price per unit."""
    own = F.when(c("p_size") % 5 == 0, F.concat(F.lit(" "), "p_brand")).otherwise("N/A")
    fields = [F.when(c("p_size") % 3 == 0, "fl   oz ").otherwise(" none "), F.when(c("p_size") % 7 == 0, c("p_type"))]
    per_unit = F.concat(F.lit("$0.50"), F.when(c("p_partkey") % 2 == 0, " / Sq.  Ft ").otherwise(" each"))
    return t(spark, d, "part").select("p_partkey", units.unit_hint(own, fields, per_unit).alias("unit"))


_ALIASES = {"oz": ["oz", "ounce", "ounces"], "lb": ["lb", "lbs", "pound"], "ml": ["ml"]}


@query("s25_label_fault", """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'no_unit' WHEN p_size % 11 = 0 THEN 'no_quantity' WHEN p_partkey % 4 = 3 THEN CASE WHEN p_size % 2 = 0 AND p_partkey % 10 >= 8 THEN NULL ELSE 'unit_not_shown' END
    WHEN p_partkey % 4 = 2 THEN CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE 'other_unit_shown' END WHEN p_partkey % 3 <> 0 THEN 'other_unit_shown' END AS fault FROM part""")
def s25(spark, d):
    """Proposed units against titles that show ounces, ounces, pounds or none."""
    raw = F.concat("p_name", _pick("p_partkey", [" 12oz", " 3 Ounces", " 2 lbs", " lbzoz"]))
    unit = F.when(c("p_size") % 7 != 0, _pick("p_partkey", ["oz", "lb", "ml"]))
    quantity = F.when(c("p_size") % 11 == 0, 0.0).otherwise(1.0)
    fault = units.checked_label(F.when(c("p_size") % 2 == 0, "recipe").otherwise("scraper"), raw, unit, quantity, (c("p_partkey") % 10) / 10.0, _ALIASES)
    return t(spark, d, "part").select("p_partkey", fault.alias("fault"))


@query("s23_unit_shown", "SELECT p_partkey, p_partkey % 4 IN (0, 2) AS shown FROM part")
def s23(spark, d):
    """A unit of two words, glued to digits or apart; inside of another word it is none."""
    return t(spark, d, "part").select("p_partkey", titles.has_unit(F.concat("p_name", _pick("p_partkey", [" 12Fl oz", " xfl oz", " fl  oz.", " fl ozzy"])), "fl oz").alias("shown"))


@query("s34_batches")
def s34(spark, d):
    """Documents of a source in batches of at most 64 texts and 12,000 characters, in order of id: the greedy cut."""
    x = t(spark, d, "documents").filter("doc_id is not null and text is not null")
    size = F.greatest(F.lit(1), F.length(F.trim(F.regexp_replace("text", r"\s+", " "))))
    return batches.in_order(x.select("source", "doc_id", size.alias("chars")), "source", "doc_id", "chars")


# -- texts ---------------------------------------------------------------------------------------------------------------

_plainly = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query("s1_plain_name", f"SELECT p_partkey, {_plainly.format('''strip_accents(replace(p_name || ' – Crème Brûlée, ' || p_brand, 'ß', 'ss'))''')} AS name FROM part")
def s1(spark, d):
    return t(spark, d, "part").select("p_partkey", text.plain_name(F.concat("p_name", F.lit(" – Crème Brûlée, "), "p_brand")).alias("name"))


_WORDS = ["berries", "tomatoes", "glasses", "boxes", "radishes", "peas", "bus", "molasses", "ties", "grass"]
_ONE = ["berry", "tomato", "glass", "box", "radish", "pea", "bus", "molass", "tie", "grass"]


@query("s2_singular", f"SELECT p_partkey, list_extract({_ONE}, 1 + CAST(p_partkey % 10 AS INTEGER)) AS word FROM part")
def s2(spark, d):
    return t(spark, d, "part").select("p_partkey", text.singular(_pick("p_partkey", _WORDS)).alias("word"))


@query("s4_tokens", "SELECT p_partkey, list_filter(string_split(lower(replace(p_name, 'e', ' ')), ' '), lambda w: len(w) > 1) AS words FROM part")
def s4(spark, d):
    """Words of two letters or more."""
    return t(spark, d, "part").select("p_partkey", text.tokens(F.replace("p_name", F.lit("e"), F.lit("-")), 2).alias("words"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(1, length({0}))), lambda i: substr({0}, i, 2)))"


@query("s6_bigrams", f"""SELECT a, b, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS dice, round(1.0 * len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v))), 6) AS jaccard FROM
    (SELECT a, b, {_GRAMS.format("replace(a, ' ', '')")} AS x, {_GRAMS.format("replace(b, ' ', '')")} AS y, {_GRAMS.format("a")} AS u, {_GRAMS.format("b")} AS v FROM (SELECT p_partkey % 1000 AS k, min(p_name) AS a, max(p_name) AS b FROM part GROUP BY 1))""")
def s6(spark, d):
    """Two similarities by letter pairs: Dice without spaces, Jaccard with them."""
    x = t(spark, d, "part").groupBy((c("p_partkey") % 1000).alias("k")).agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    bare = lambda n: text.grams(F.replace(c(n), F.lit(" "), F.lit("")), 2)
    return x.select("a", "b", F.round(text.dice(bare("a"), bare("b")), 6).alias("dice"), F.round(text.jaccard(text.grams(c("a"), 2), text.grams(c("b"), 2)), 6).alias("jaccard"))


@query("s29_minutes", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size * 60 + 5 WHEN 1 THEN p_size WHEN 2 THEN p_size END AS INTEGER) AS minutes FROM part")
def s29(spark, d):
    """Durations as PT#H#M, PT#M, plain text, and without a number."""
    n = c("p_size").cast("string")
    x = F.when(c("p_partkey") % 4 == 0, F.concat(F.lit("PT"), n, F.lit("H5M"))).when(c("p_partkey") % 4 == 1, F.concat(F.lit("PT"), n, F.lit("M"))).when(c("p_partkey") % 4 == 2, F.concat(F.lit("about "), n, F.lit(" to 99 min"))).otherwise("soon")
    return t(spark, d, "part").select("p_partkey", text.iso_minutes(x).alias("minutes"))


@query("m9_goal", "SELECT c_custkey, CAST(CASE WHEN t <= 0 THEN 0 ELSE least(100, greatest(0, floor(b * 100.0 / t + 0.5))) END AS INTEGER) AS percent FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS b, c_custkey % 5 * 200000 AS t FROM customer)")
def m9(spark, d):
    return t(spark, d, "customer").select("c_custkey", money.goal_percent(money.cents(c("c_acctbal")), c("c_custkey") % 5 * 200000).alias("percent"))


@query("m7_sane_price", """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p > 0 AND p <= 2000 AND (m IS NULL OR p / m BETWEEN 0.1 AND 3), false) AS ok FROM
    (SELECT *, l_extendedprice / l_quantity AS p, CASE WHEN l_partkey % 5 > 0 THEN p_retailprice END AS m FROM lineitem JOIN part ON p_partkey = l_partkey)""")
def m7(spark, d):
    """Unit prices within bounds and within a tenth and three times of the product's known price."""
    x = t(spark, d, "lineitem").join(t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    p = F.try_divide("l_extendedprice", "l_quantity")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", money.sane_price(p, F.when(c("l_partkey") % 5 > 0, c("p_retailprice")), 2000.0).alias("ok"))


# -- scores and views -----------------------------------------------------------------------------------------------------

_TIER = "CASE WHEN n >= 10 THEN 'tested' WHEN n >= 3 THEN 'building' ELSE 'early' END"


@query("q9_success_batch", f"""SELECT p_partkey, n, CASE WHEN n >= 3 THEN CAST(floor(100.0 * s / n + 0.5) AS INTEGER) END AS percent, {_TIER} AS tier FROM (SELECT p_partkey, count(l_partkey) FILTER (WHERE l_returnflag <> 'N') AS n, count(l_partkey) FILTER (WHERE l_returnflag = 'A') AS s
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)""")
def q9(spark, d):
    """Success score and tier of every dish, those without answers too."""
    li = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(c("l_returnflag") != "N").alias("n"), F.count_if(c("l_returnflag") == "A").alias("s"))
    x = t(spark, d, "part").select("p_partkey").join(li.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "left").fillna(0, ["n", "s"])
    percent = F.when(c("n") >= 3, F.floor(F.try_divide(100.0 * c("s"), c("n")) + 0.5).cast("int"))
    return x.select("p_partkey", "n", percent.alias("percent"), F.when(c("n") >= 10, "tested").when(c("n") >= 3, "building").otherwise("early").alias("tier"))


@query("ag16_week_means", "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, round(sum(CAST(round(value * 100) AS BIGINT)) / 7.0, 4) AS a_day FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY user_id")
def ag16_means(spark, d):
    """Sums of a week, and their mean over all seven days, days without events included."""
    e = t(spark, d, "events").filter(c("ts") >= F.expr("timestamp_ntz '2024-01-08'")).filter(c("ts") < F.expr("timestamp_ntz '2024-01-15'"))
    return e.groupBy("user_id").agg(F.sum(money.cents(c("value"))).alias("cents")).withColumn("a_day", F.round(c("cents") / 7.0, 4))


@query("ag20_success_rate", "SELECT event_type, ok, cached, ok - cached AS scraped, printf('%.1f%%', 100.0 * ok / n) AS rate FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id % 3 > 0) AS ok, count(*) FILTER (WHERE user_id % 3 = 1) AS cached FROM events GROUP BY 1)")
def ag20(spark, d):
    """A batch's successful rows, those from the cache, the others, and the rate with one decimal."""
    g = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(c("user_id") % 3 > 0).alias("ok"), F.count_if(c("user_id") % 3 == 1).alias("cached"))
    return g.select("event_type", "ok", "cached", (c("ok") - c("cached")).alias("scraped"), F.format_string("%.1f%%", 100.0 * c("ok") / c("n")).alias("rate"))


@query("flt13_taken_over", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type <> 'PROMO' AND l_returnflag <> 'R' AND l_linestatus = 'F' AND l_extendedprice > 0 AND p_name IS NOT NULL AND length(p_brand) > 0""")
def flt13_full(spark, d):
    """Prices of the right kind and currency (here: flag and status), no copies of others, positive, with code and name."""
    p = t(spark, d, "part").filter("p_type <> 'PROMO' and p_name is not null and length(p_brand) > 0").select(c("p_partkey").alias("l_partkey"))
    return t(spark, d, "lineitem").filter("l_returnflag <> 'R' and l_linestatus = 'F' and l_extendedprice > 0").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("wn9_friends", "SELECT c_custkey, n, CAST(rank() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY n DESC) AS INTEGER) AS place, c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS is_viewer FROM (SELECT c_custkey, c_nationkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)")
def wn9_friends(spark, d):
    """Places among friends (here: of one nation and segment); equal counts share a place."""
    n = t(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    x = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(n, "c_custkey", "left").fillna(0, ["n"])
    circle = W.partitionBy("c_nationkey", "c_mktsegment")
    return x.select("c_custkey", "n", F.rank().over(circle.orderBy(c("n").desc())).alias("place"), (c("c_custkey") == F.min("c_custkey").over(circle)).alias("is_viewer"))


@query("jn13_pantry_counts", """SELECT o_custkey, y.p_name, count(DISTINCT w) AS n FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') JOIN part x ON x.p_partkey = l_partkey
    JOIN (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM (SELECT DISTINCT p_name FROM part)) y ON contains(x.p_name, y.w) GROUP BY 1, 2""")
def jn13(spark, d):
    """Of every customer's pantry and every dish, the ingredients that a name in the pantry contains, each counted once.
    Texts meet as distinct names before customers do."""
    names = t(spark, d, "part").select("p_name").distinct()
    dish = names.select(c("p_name"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    pairs = text_search.contained(dish, "w", names, "p_name").select(c("part").alias("w"), c("whole").alias("own"))
    o = t(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey", c("o_orderkey").alias("l_orderkey"))
    own = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey").join(t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), c("p_name").alias("own")), "l_partkey").select("o_custkey", "own").distinct()
    return own.join(pairs, "own").select("o_custkey", "w").distinct().join(dish, "w").groupBy("o_custkey", "p_name").agg(F.count("*").alias("n"))


@query("q21_price_health", """SELECT l_partkey, n, n_odd, days, n_odd * 10 <= n AND days <= 365 AS healthy FROM (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE NOT (l_extendedprice > 0 AND l_extendedprice / l_quantity / p_retailprice BETWEEN 0.1 AND 3)) AS n_odd,
    date_diff('day', CAST(max(l_shipdate) AS DATE), DATE '2001-01-01') AS days FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)""")
def q21_health(spark, d):
    """Products with too many odd prices or without a recent one (an own definition; only a signature is known)."""
    p = t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_retailprice")
    ok = (c("l_extendedprice") > 0) & F.try_divide(c("l_extendedprice") / c("l_quantity"), c("p_retailprice")).between(0.1, 3)
    g = t(spark, d, "lineitem").join(p, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_odd"), F.max("l_shipdate").alias("last"))
    days = F.date_diff(F.lit("2001-01-01").cast("date"), c("last").cast("date")).cast("long")
    return g.select("l_partkey", "n", "n_odd", days.alias("days"), ((c("n_odd") * 10 <= c("n")) & (days <= 365)).alias("healthy"))


@query("q21_unit_coverage", f"SELECT unit, count(*) AS n, count(size) AS n_known FROM (SELECT {_UNIT_OF} AS unit FROM lineitem) LEFT JOIN (SELECT unit, size FROM {_SIZES}) USING (unit) GROUP BY unit")
def q21_units(spark, d):
    """Rows of each unit, and those of a size that is known."""
    x = t(spark, d, "lineitem").select(_pick("l_partkey", _UNITS).alias("unit"))
    known = units.price_per_base_unit(F.lit(1.0), F.lit(1.0), c("unit")).isNotNull()
    return x.groupBy("unit").agg(F.count("*").alias("n"), F.count_if(known).alias("n_known"))


@query("q21_product_summary", "SELECT p_name, count(DISTINCT p_partkey) AS n_products, count(DISTINCT s_nationkey) AS n_nations, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS least, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS most FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def q21_summary(spark, d):
    """Of each name its products, the nations that sell them, and the range of prices."""
    x = t(spark, d, "part").select("p_partkey", "p_name").join(_prices_range(spark, d), "p_partkey", "left")
    return x.groupBy("p_name").agg(F.countDistinct("p_partkey").alias("n_products"), F.countDistinct("nation").alias("n_nations"), F.min("least").alias("least"), F.max("most").alias("most"))


def _prices_range(spark, d):
    s = t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("nation"))
    li = t(spark, d, "lineitem").select("l_suppkey", c("l_partkey").alias("p_partkey"), money.cents(c("l_extendedprice")).alias("x")).join(s, "l_suppkey")
    return li.groupBy("p_partkey", "nation").agg(F.min("x").alias("least"), F.max("x").alias("most"))


@query("q21_meal_kinds", "SELECT o_custkey, p_size % 3 AS kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_custkey), 2) AS percent FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def q21_meals(spark, d):
    """How a customer's meals divide over the kinds."""
    p, o = t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), (c("p_size") % 3).alias("kind")), t(spark, d, "orders").select("o_custkey", c("o_orderkey").alias("l_orderkey"))
    n = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").join(o, "l_orderkey").groupBy("o_custkey", "kind").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * c("n") / F.sum("n").over(W.partitionBy("o_custkey")), 2))


# -- writes ---------------------------------------------------------------------------------------------------------------


@query("snk4_day_replaced", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def snk4(spark, d):
    """A rollup whose days are replaced: the rows of the days that come anew (here: of the second half of the month, of which
    the table holds wrong counts) take the place of all that the table has of those days."""
    g = t(spark, d, "events").groupBy(c("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))
    path = f"{graph.shared_dir(spark)}/larder/{uuid.uuid4().hex}"
    io.overwrite_days(g.withColumn("n", F.when(F.day("day") > 15, c("n") + 7).otherwise(c("n"))), path, "day")
    for _ in range(2):  # the second run changes nothing
        io.overwrite_days(g.filter(F.day("day") > 15), path, "day")
    return spark.read.schema("event_type string, n long, day date").parquet(path).select("day", "event_type", "n")


@query("snk9_bulk_prices", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p <= 0 OR p > 1500 THEN 'rejected' ELSE 'inserted' END AS status, CASE WHEN p <= 0 THEN 'not positive' WHEN p > 1500 THEN 'too high' END AS error_msg FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_extendedprice / l_quantity END AS p FROM lineitem)""")
def snk9(spark, d):
    """Prices of a bulk insert with what became of each."""
    x = t(spark, d, "lineitem").withColumn("price", F.when(c("l_linenumber") == 7, -1.0).otherwise(c("l_extendedprice") / c("l_quantity")))
    return io.validated_prices(x, 1500.0).select("l_orderkey", "l_linenumber", "l_partkey", "status", "error_msg")


@query("snk9_latest", "SELECT l_suppkey, l_partkey, max_by(CAST(round(l_extendedprice * 100) AS BIGINT), (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS cents FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1, 2")
def snk9_latest(spark, d):
    """The view of latest prices that such an insert refreshes."""
    x = t(spark, d, "lineitem").filter("l_extendedprice > 0")
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return x.groupBy("l_suppkey", "l_partkey").agg(F.max_by(money.cents(c("l_extendedprice")), key).alias("cents"))


# -- standard names --------------------------------------------------------------------------------------------------------

_TAILS = [" tomatoes", " soy sauce", " chips", " noodle soup", " seeds"]


@query("s33_standardised", f"""WITH x AS (SELECT p_partkey, p_partkey % 5 AS k, CASE WHEN split_part(p_name, ' ', 1) IN ('small', 'large') THEN split_part(p_name, ' ', 2) ELSE p_name END AS base FROM part)
    SELECT p_partkey, base || list_extract([' tomato', ' soy sauce', ' chip', ' noodle soup', ' seeds'], 1 + CAST(k AS INTEGER)) AS name, list_extract(['produce', 'condiments', 'snacks', 'pantry_staples', 'produce'], 1 + CAST(k AS INTEGER)) AS category,
    CASE WHEN k IN (1, 3, 4) THEN 0.92 WHEN contains(base, ' ') THEN 0.84 ELSE 0.78 END::DOUBLE AS confidence FROM x""")
def s33(spark, d):
    """Raw names with words of size, plurals, and a form that stays as it is."""
    s = standard.standardised(F.concat("p_name", _pick("p_partkey", _TAILS)), ["seeds"])
    return t(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.name", "s.category", "s.confidence")
