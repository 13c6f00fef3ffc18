"""Offers and their ranking, package arithmetic, titles and units, JSON, stores and writes (roles as in relational)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dirty_json, matching, money, quantities, text, titles
from ..operators import graph, similarity, vector_pairs, windows
from ..sources import kept
from .catalog import query
from .tables import t

c = F.col


def _choice(n, *values):
    """The value at a number, counted round and round."""
    return F.element_at(F.array(*[v if not isinstance(v, (str, int, float, type(None))) else F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


# -- offers and their ranking -------------------------------------------------------------------------------------------

_CANDIDATES = """SELECT l_partkey, s_nationkey, l_suppkey, l_orderkey, l_linenumber, p_size AS need, l_returnflag = 'R' AND l_linenumber = 7 AS chosen,
    l_suppkey = min(l_suppkey) OVER (PARTITION BY s_nationkey) AS exact, CASE WHEN l_tax > 0 THEN l_quantity END AS size, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_extendedprice > 0"""
_RANKED = f"""SELECT *, size IS NULL AS conversion_error, CASE WHEN size > 0 THEN CAST(ceil(need / size) AS BIGINT) ELSE 1 END AS packages FROM ({_CANDIDATES})"""


def _candidates(spark, d):
    """Offers of a product at the nation's preferred store (the one of the smallest key) or, as backup, its other stores.
    An offer without tax has no convertible size; a line numbered 7 that was returned stands for a user's own choice."""
    s = t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_nationkey")
    first = s.groupBy("s_nationkey").agg(F.min("l_suppkey").alias("preferred"))
    li = t(spark, d, "lineitem").filter("l_extendedprice > 0")
    x = li.join(s, "l_suppkey").join(first, "s_nationkey").join(t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), c("p_size").alias("need")), "l_partkey")
    size = F.when(c("l_tax") > 0, c("l_quantity"))
    return x.select(
        "l_partkey", "s_nationkey", "l_suppkey", "l_orderkey", "l_linenumber", ((c("l_returnflag") == "R") & (c("l_linenumber") == 7)).alias("chosen"),
        (c("l_suppkey") == c("preferred")).alias("exact"), size.isNull().alias("conversion_error"), money.cents(c("l_extendedprice")).alias("cents"),
        F.when(size > 0, F.ceil(c("need") / size)).otherwise(1).cast("long").alias("packages"),
    )


_OFFER_KEYS = "l_orderkey, l_linenumber, l_suppkey, cents"


@query("wn1_offer_ranking", f"""SELECT l_partkey, s_nationkey, l_suppkey, packages, conversion_error, NOT exact AS backup, cents * packages AS total_cents FROM
    (SELECT *, row_number() OVER (PARTITION BY l_partkey, s_nationkey ORDER BY chosen DESC, exact DESC, conversion_error, cents * packages, {_OFFER_KEYS}) AS n FROM ({_RANKED})) WHERE n = 1""")
def wn1_offers(spark, d):
    """The best offer of a product and store: a user's choice, the store's own price, a convertible size, total, price."""
    x = _candidates(spark, d)
    order = [c("chosen").desc(), c("exact").desc(), c("conversion_error"), c("cents") * c("packages"), c("l_orderkey"), c("l_linenumber"), c("l_suppkey"), c("cents")]
    best = windows.top_per_group(x, ["l_partkey", "s_nationkey"], order)
    return best.select("l_partkey", "s_nationkey", "l_suppkey", "packages", "conversion_error", (~c("exact")).alias("backup"), (c("cents") * c("packages")).alias("total_cents"))


@query("wn2_store_offer", f"""SELECT l_partkey, s_nationkey, l_suppkey, cents * packages AS total_cents FROM
    (SELECT *, row_number() OVER (PARTITION BY l_partkey, s_nationkey ORDER BY exact DESC, cents * packages, cents, l_orderkey, l_linenumber, l_suppkey) AS n FROM ({_RANKED})) WHERE n = 1""")
def wn2(spark, d):
    """The store's own price first, then total, then price."""
    order = [c("exact").desc(), c("cents") * c("packages"), c("cents"), c("l_orderkey"), c("l_linenumber"), c("l_suppkey")]
    return windows.top_per_group(_candidates(spark, d), ["l_partkey", "s_nationkey"], order).select("l_partkey", "s_nationkey", "l_suppkey", (c("cents") * c("packages")).alias("total_cents"))


@query("q1_offers", f"""SELECT l_partkey, count(*) AS n, string_agg(s_nationkey || ':' || total_cents, ',' ORDER BY total_cents, s_nationkey) AS offers FROM (SELECT l_partkey, s_nationkey, cents * packages AS total_cents,
    row_number() OVER (PARTITION BY l_partkey, s_nationkey ORDER BY chosen DESC, exact DESC, conversion_error, cents * packages, {_OFFER_KEYS}) AS n FROM ({_RANKED})) WHERE n = 1 GROUP BY l_partkey""")
def q1_offers(spark, d):
    """Each product's best offer per store, nested, cheapest first."""
    o = F.array_sort(F.collect_list(F.struct("total_cents", "s_nationkey")))
    x = wn1_offers(spark, d).groupBy("l_partkey").agg(F.count("*").alias("n"), o.alias("o"))
    return x.select("l_partkey", "n", F.array_join(F.transform("o", lambda r: F.concat_ws(":", r["s_nationkey"].cast("string"), r["total_cents"].cast("string"))), ",").alias("offers"))


@query("jn4_items_stores", """WITH s AS (SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) WHERE n <= 2)
    SELECT DISTINCT o_custkey, l_partkey, s_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN s ON s_nationkey = c_nationkey WHERE o_orderstatus = 'O'""")
def jn4(spark, d):
    """Every open item of a user with each of the user's two preferred stores: for all users at once an equi-join."""
    s = windows.top_per_group(t(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], [c("s_acctbal").desc(), c("s_suppkey")], 2)
    o = t(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_custkey", c("o_orderkey").alias("l_orderkey"))
    items = o.join(t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey").select("o_custkey", "l_partkey").distinct()
    stores = t(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), c("c_nationkey").alias("s_nationkey")).join(s, "s_nationkey")
    return items.join(stores, "o_custkey").select("o_custkey", "l_partkey", "s_suppkey")


@query("wn5_latest_membership", """SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate) DESC, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def wn5(spark, d):
    """The first row of each key after sorting by month and time, latest first."""
    o = t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    last = windows.top_per_group(o, ["o_custkey"], [F.date_trunc("month", "o_orderdate").desc(), c("o_orderdate").desc(), c("o_orderkey")])
    return last.join(n, "o_custkey").select("o_custkey", "o_orderpriority", "n")


@query("ag6_lists", "SELECT c_custkey, coalesce(to_json(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL))::VARCHAR, '[]') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def ag6(spark, d):
    o = t(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.to_json(F.sort_array(F.collect_list("o_orderkey"))).alias("orders"))
    return t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit("[]")).alias("orders"))


@query("ag21_rollup_upsert", """SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS event_count, sum(CAST(round(value * 100) AS BIGINT)) AS value_total, min(value) AS value_least, max(value) AS value_most,
    sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_total, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_least, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_most FROM events GROUP BY 1, 2, 3""")
def ag21_upsert(spark, d):
    """Two batches rolled up by day and pair, the second merged into the first: counts and totals add, bounds widen."""
    e = t(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), "user_id", "event_type", "value", money.cents(c("value")).alias("v"), F.from_json("props", "k long")["k"].alias("k"))
    keys = ["day", "user_id", "event_type"]
    roll = lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("event_count"), F.sum("v").alias("value_total"), F.min("value").alias("value_least"), F.max("value").alias("value_most"), F.sum("k").alias("k_total"), F.min("k").alias("k_least"), F.max("k").alias("k_most"))
    old, new = roll(e.filter("event_id % 2 = 0")), roll(e.filter("event_id % 2 = 1"))
    how = {"event_count": F.sum, "value_total": F.sum, "value_least": F.min, "value_most": F.max, "k_total": F.sum, "k_least": F.min, "k_most": F.max}
    return old.unionByName(new).groupBy(*keys).agg(*[f(n).alias(n) for n, f in how.items()])


# -- text search --------------------------------------------------------------------------------------------------------

_SEARCH = """WITH n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part), q AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS q, string_split(lower(p_type) || ' ' || p_name, ' ') AS u FROM part),
    p AS (SELECT DISTINCT q, u, p_name, w FROM (SELECT q, u, unnest(u) AS x FROM q) JOIN (SELECT p_name, w, unnest(w) AS x FROM n) USING (x)),
    s AS (SELECT q, p_name, round(len(list_intersect(u, w)) / len(w)::DOUBLE + 1.6 * len(list_intersect(u, w)) / len(list_distinct(list_concat(u, w)))::DOUBLE + CASE WHEN contains(q, p_name) THEN 0.75 ELSE 0 END + CASE WHEN contains(p_name, q) THEN 0.15 ELSE 0 END, 6) AS score FROM p)"""


def _search(spark, d):
    """Names that share a word with a query, by matched words, common words, and containment either way."""
    n = t(spark, d, "part").select("p_name").distinct().withColumn("w", F.split("p_name", " "))
    q = t(spark, d, "part").select(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("q")).distinct().withColumn("u", F.split("q", " "))
    return similarity.search(q, "q", "u", n, "p_name", "w")


@query("s13_search_score", f"{_SEARCH} SELECT q, p_name, score FROM s WHERE score > 0.1")
def s13(spark, d):
    return _search(spark, d).filter("score > 0.1")


@query("sr5_best_match", f"{_SEARCH} SELECT q, p_name, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, p_name) AS n FROM s) WHERE n = 1")
def sr5(spark, d):
    return windows.top_per_group(_search(spark, d), ["q"], [c("score").desc(), c("p_name")])


@query("sr6_top_25", f"{_SEARCH} SELECT q, p_name, score FROM s ORDER BY score DESC, q, p_name LIMIT 25")
def sr6(spark, d):
    return _search(spark, d).orderBy(c("score").desc(), "q", "p_name").limit(25)


@query("s11_match_all_words", """SELECT doc_id, n_words FROM (SELECT doc_id, len(list_filter(string_split(lower(text), ' '), lambda w: w IN ('the', 'and'))) AS n_words, string_split(lower(text), ' ') AS w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'and')""")
def s11(spark, d):
    """Documents with all words of a query, and how often these occur: plain words instead of stems and weights."""
    w = F.split(F.lower("text"), " ")
    x = t(spark, d, "documents").select("doc_id", F.filter(w, lambda x: x.isin("the", "and")).alias("w"))
    return x.filter(F.array_contains("w", "the") & F.array_contains("w", "and")).select("doc_id", F.size("w").cast("long").alias("n_words"))


# -- vectors ------------------------------------------------------------------------------------------------------------

_NEAR = """WITH q AS (SELECT vec_id AS a, embedding AS x FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT a, vec_id AS b, round(list_cosine_similarity(x::DOUBLE[], embedding::DOUBLE[]), 9) AS cosine FROM q JOIN embeddings ON vec_id <> a),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM s)"""
#: The same for all vectors.
_NEAR_ALL = _NEAR.replace(" WHERE vec_id % 50 = 0", "")


def _near(spark, d, asked="vec_id % 50 = 0", k=25):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    return similarity.nearest_vectors(e, e.filter(asked), "vec_id", "embedding", k)


@query("jn11_nearest_25", f"{_NEAR} SELECT a, b, cosine, place FROM r WHERE place <= 25")
def jn11(spark, d):
    """Of the queries (ids divisible by 50) the 25 nearest of all vectors, in blocks of both."""
    return _near(spark, d)


@query("jn10_new_pairs", """SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
    WHERE x.label <> y.label AND round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) >= 0.2""")
def jn10(spark, d):
    """All pairs of near vectors, each once, but for those that are known already (here: of one label)."""
    e = t(spark, d, "embeddings").filter("label is not null")
    return vector_pairs.all_pairs(e, "vec_id", "embedding", 0.2, apart="label")


# -- packages, quantities, streaks ---------------------------------------------------------------------------------------

@query("m2_line_total", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice > 0 THEN CASE WHEN l_tax = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_discount > 0 THEN greatest(1, CAST(ceil(l_linenumber / l_quantity * p_size) AS BIGINT)) ELSE 1 END
    WHEN l_quantity > 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) * greatest(1, CAST(ceil(p_size / l_quantity) AS BIGINT)) END END AS cents FROM lineitem JOIN part ON p_partkey = l_partkey""")
def m2(spark, d):
    """Untaxed lines cannot be converted; of these, discounted ones have an estimate."""
    x = t(spark, d, "lineitem").join(t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    base = F.when(c("l_discount") > 0, c("l_quantity"))
    total = quantities.line_total(c("p_size"), money.cents(c("l_extendedprice")), c("l_quantity"), c("l_tax") == 0, base, c("l_linenumber"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", total.cast("long").alias("cents"))


@query("m3_package_steps", "SELECT l_orderkey, l_linenumber, l_partkey, round((greatest(1, ceil(l_quantity / 7.5)) + 1) * 7.5, 4) AS more, greatest(7.5, round(greatest(1, greatest(1, ceil(l_quantity / 7.5)) - 1) * 7.5, 4)) AS less FROM lineitem")
def m3(spark, d):
    size = F.lit(7.5)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quantities.one_package_more(c("l_quantity"), size).alias("more"), quantities.one_package_less(c("l_quantity"), size).alias("less"))


@query("m4_half_away", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(-l_quantity * 0.125 AS DECIMAL(18, 3)), 2) * 100 AS BIGINT) AS cents FROM lineitem")
def m4(spark, d):
    """Halves of a cent go away from zero, on decimals."""
    x = F.round((-c("l_quantity") * 0.125).cast("decimal(18,3)"), 2)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (x * 100).cast("long").alias("cents"))


@query("m5_per_serving", "SELECT p_partkey, round(p_retailprice / nullif(p_size % 3, 0), 6) AS per_serving, round(coalesce(p_retailprice / nullif(nullif(p_size % 3, 0), 1), 0), 6) AS quirk FROM part")
def m5(spark, d):
    """Null by zero servings; as the reference has it, also nothing for a base of one."""
    n = F.nullif(c("p_size") % 3, F.lit(0))
    return t(spark, d, "part").select("p_partkey", F.round(c("p_retailprice") / n, 6).alias("per_serving"), F.round(F.coalesce(c("p_retailprice") / F.nullif(n, F.lit(1)), F.lit(0.0)), 6).alias("quirk"))


@query("m6_quantity_fault", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q <= 0 THEN 'not_positive' WHEN q > 10000 THEN 'over_cap' WHEN base > 0 AND q / base > 5 THEN 'inflated' END AS fault FROM (SELECT *, (l_quantity - 3) * CASE WHEN l_linenumber = 1 THEN 300 ELSE 1 END AS q, CASE WHEN l_linenumber > 2 THEN l_linenumber - 3 END AS base FROM lineitem)")
def m6(spark, d):
    q = (c("l_quantity") - 3) * F.when(c("l_linenumber") == 1, 300).otherwise(1)
    base = F.when(c("l_linenumber") > 2, c("l_linenumber") - 3)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quantities.quantity_fault(q, base).alias("fault"))


@query("m21_streak_reason", """SELECT o_orderkey, CASE WHEN f < 0.4 THEN 'low_confidence_needs_confirmation' WHEN p >= 0.7 THEN 'on_plan' WHEN focus = 'budget' AND h >= 0.75 AND b >= 0.5 THEN 'budget_home_cooked' WHEN focus = 'health' AND n >= 0.7 THEN 'nutrition_aligned'
    WHEN focus = 'balanced' AND (p >= 0.55 OR h >= 0.6 OR n >= 0.6) THEN 'balanced_forgiving' ELSE 'requires_user_confirmation' END AS reason FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'budget' WHEN 1 THEN 'health' ELSE 'balanced' END AS focus,
    (o_orderkey % 10) / 10::DOUBLE AS f, (o_custkey % 9) / 10::DOUBLE AS p, (o_custkey % 11) / 10::DOUBLE AS h, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_custkey % 8) / 10::DOUBLE END AS n, (o_orderkey % 7) / 10::DOUBLE AS b FROM orders)""")
def m21(spark, d):
    part = lambda x, n: (c(x) % n) / 10.0
    focus = _choice(c("o_orderkey"), "budget", "health", "balanced", None)
    reason = quantities.streak_reason(focus, part("o_custkey", 9), part("o_custkey", 11), F.when(c("o_orderkey") % 5 != 0, part("o_custkey", 8)), part("o_orderkey", 7), part("o_orderkey", 10))
    return t(spark, d, "orders").select("o_orderkey", reason.alias("reason"))


@query("d4_day_offsets", "SELECT o_orderkey, date_diff('day', m, CAST(o_orderdate AS DATE)) AS day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday FROM orders JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS m FROM orders GROUP BY 1) USING (o_custkey)")
def d4(spark, d):
    """Days since a user's first order, and the day of the week from Monday."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("at"))
    first = o.groupBy("o_custkey").agg(F.min("at").alias("m"))
    return o.join(first, "o_custkey").select("o_orderkey", F.datediff("at", "m").cast("long").alias("day"), F.weekday("at").alias("weekday"))


@query("d5_one_day", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def d5(spark, d):
    return t(spark, d, "events").filter("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-06'").select("event_id")


# -- titles and units ---------------------------------------------------------------------------------------------------

_RECIPE = ["Fresh chopped {}, to taste", "Organic {} 12 oz bag", "large {} plus more", "{}"]
_SHOP = ["{} Tomato Soup 8 Oz", "Brand® {} in extra virgin olive oil", "cold-pressed {} - Good & Fine", "{} 16oz unsalted", "{}, 6 pack", "{} - 14g Protein"]


def _sql_choice(n, values):
    return f"CASE {n} % {len(values)} " + " ".join("WHEN {} THEN '{}'".format(i, v.replace("{}", "' || p_name || '")) for i, v in enumerate(values)) + " END"


def _titles(values):
    return F.replace(_choice(c("p_size"), *values), F.lit("{}"), c("p_name"))


def _recipe_sql(x):
    """The recipe cleaner over words, in SQL."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    plain = f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
    words = f"array_to_string(list_filter(string_split({plain}, ' '), lambda w: w NOT IN ({quoted(titles.PREPARATION)})), ' ')"
    short = f"trim(regexp_replace(' ' || {words} || ' ', ' ({'|'.join(titles.OPTIONAL)}) ', ' ', 'g'))"
    return f"regexp_replace({short}, ' [0-9]+ ?({'|'.join(titles.TAIL_UNITS)})( .*)?$', '')"


#: What the cleaner of shop titles makes of the titles of _SHOP.
_SHOP_NAMES = ["Tomato Soup {}", "Brand {}", "{}", "{}", "{}", "{}"]


@query("s15_recipe_name", f"SELECT p_partkey, {_recipe_sql(_sql_choice('p_size', _RECIPE))} AS name FROM part")
def s15(spark, d):
    return t(spark, d, "part").select("p_partkey", titles.recipe_name(_titles(_RECIPE)).alias("name"))


@query("s16_shop_name", f"SELECT p_partkey, trim({_sql_choice('p_size', _SHOP_NAMES)}) AS name FROM part")
def s16(spark, d):
    return t(spark, d, "part").select("p_partkey", titles.shop_name(_titles(_SHOP)).alias("name"))


_OWN_UNITS = ["fl oz", "oz", "g"]


@query("s19_name_by_context", f"""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN {_recipe_sql(_sql_choice('p_size', _RECIPE))}
    ELSE {_sql_choice('p_size', ["Fresh chopped {}, to taste", "Organic {}", "large {} plus more", "{}"])} END AS name FROM part""")
def s19(spark, d):
    """Names of recipes and pantries, and titles of shops with units of their own."""
    kind = _choice(c("p_partkey"), "recipe", "pantry", "scraper")
    return t(spark, d, "part").select("p_partkey", titles.name_by_context(_titles(_RECIPE), kind, _OWN_UNITS).alias("name"))


@query("s31_fallback_names", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ',' || split_part(p_name, ' ', 2) || ',oz bag,12 oz bag' ELSE split_part(p_name, ' ', 2) || ' soup' END AS names FROM part""")
def s31_fallbacks(spark, d):
    """What is tried for a title with a retail suffix, and for one without."""
    title = F.concat("p_name", _choice(c("p_size"), " 12 oz Bag", " soup"))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.transform(matching.fallback_names(title), lambda r: r["name"]), ",").alias("names"))


@query("s18_real_unit", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'cup' WHEN 3 THEN p_brand END AS unit FROM part")
def s18(spark, d):
    unit = F.when(c("p_size") % 5 == 3, F.concat(F.lit(" "), "p_brand", F.lit(" "))).otherwise(_choice(c("p_size"), "  cup ", "Large", "smaak", "", "  "))
    return t(spark, d, "part").select("p_partkey", titles.real_unit(unit).alias("unit"))


@query("s3_plural_s", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_name || 'ss' ELSE p_name END AS name FROM part")
def s3(spark, d):
    return t(spark, d, "part").select("p_partkey", titles.without_plural_s(F.concat("p_name", _choice(c("p_size"), "s", "ss", ""))).alias("name"))


@query("s21_no_food_part", "SELECT p_partkey, p_size % 4 IN (1, 2) OR contains(p_name, 'hat') OR contains(p_name, 'cap') OR contains(p_name, 'tee') AS hit FROM part")
def s21(spark, d):
    return t(spark, d, "part").select("p_partkey", titles.has_no_food_part(F.concat("p_name", _choice(c("p_size"), " soup", " Steel", " Dish Soap", ""))).alias("hit"))


_ALIASES = {"oz": ["oz", "ounces"], "lb": ["lb", "lbs"], "fl oz": ["fluid ounce"]}


@query("s24_unit_guess", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'oz' WHEN 1 THEN 'lb' WHEN 2 THEN 'oz' END AS unit, CASE WHEN p_size % 4 = 2 THEN 1 ELSE p_size END::DOUBLE AS quantity, CASE WHEN p_size % 4 < 3 THEN 0.35 ELSE 0 END::DOUBLE AS confidence FROM part""")
def s24(spark, d):
    """The first unit that a text names, glued to a number or not, and the first number."""
    size = c("p_size").cast("string")
    raw = _choice(c("p_size"), F.concat(size, F.lit("OZ bag")), F.concat(size, F.lit(" lbs of 3 kinds")), F.lit("some ounces or lb"), F.concat(size, F.lit(" frozen lbx")))
    return t(spark, d, "part").select("p_partkey", titles.unit_guess(raw, _ALIASES).alias("x")).select("p_partkey", "x.*")


@query("s26_search_term", "SELECT p_partkey, lower(p_name) AS term FROM part")
def s26(spark, d):
    """Amounts put around a name, in up to four layers, and taken off again."""
    s = c("p_size").cast("string")
    term = _choice(c("p_size"), F.concat(s, F.lit(" cups "), "p_name"), F.concat(s, F.lit("oz "), "p_name", F.lit(" 2")), F.concat(F.lit("1 1/2 x cup "), "p_name", F.lit(" cup")), F.concat(F.lit("3 4 5 6 "), "p_name"))
    return t(spark, d, "part").select("p_partkey", titles.without_measure(term, ["cups", "cup", "oz"]).alias("term"))


@query("s27_counts_as_package", "SELECT p_partkey, p_size % 2 = 0 AND p_partkey % 3 <> 1 AS packaged FROM part")
def s27(spark, d):
    raw = F.concat("p_name", _choice(c("p_partkey"), "", " 12 oz", " 12 oz jar"))
    return t(spark, d, "part").select("p_partkey", titles.counts_as_package(_choice(c("p_size"), "scraper", "recipe"), raw, ["oz", "lb"]).alias("packaged"))


@query("prj4_price", "SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN p_retailprice END AS price FROM part")
def prj4(spark, d):
    p = c("p_retailprice").cast("decimal(12,2)").cast("string")
    shown = _choice(c("p_size"), F.concat(F.lit("$"), p), F.concat(p, F.lit(" EUR")), F.concat(F.lit("now "), p, F.lit(".9.9")), F.lit("free"))
    return t(spark, d, "part").select("p_partkey", text.price(shown).alias("price"))


@query("prj5_zip", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') ELSE '' END AS zip FROM customer")
def prj5(spark, d):
    z = F.lpad((c("c_custkey") % 100000).cast("string"), 5, "0")
    return t(spark, d, "customer").select("c_custkey", text.zip_code(_choice(c("c_custkey"), F.concat(z, F.lit("-1234")), z, F.concat(F.lit("x"), z))).alias("zip"))


# -- JSON ---------------------------------------------------------------------------------------------------------------

@query("prj2_nested", "SELECT p_partkey, to_json({'name': p_name, 'price': {'cents': CAST(round(p_retailprice * 100) AS BIGINT), 'brand': p_brand}, 'words': string_split(p_name, ' ')})::VARCHAR AS doc FROM part")
def prj2(spark, d):
    doc = F.struct(c("p_name").alias("name"), F.struct(money.cents(c("p_retailprice")).alias("cents"), c("p_brand").alias("brand")).alias("price"), F.split("p_name", " ").alias("words"))
    return t(spark, d, "part").select("p_partkey", F.to_json(doc).alias("doc"))


@query("j5_row_json", "SELECT to_json(nation)::VARCHAR AS doc FROM nation")
def j5(spark, d):
    return t(spark, d, "nation").select(F.to_json(F.struct("*")).alias("doc"))


@query("j2_expand", "SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2, 3")
def j2(spark, d):
    """A JSON array of records per user, expanded again into typed rows."""
    e = t(spark, d, "events").select("user_id", F.struct("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).alias("x"))
    arrays = e.groupBy("user_id").agg(F.to_json(F.collect_list("x")).alias("doc"))
    rows = arrays.select("user_id", F.inline(F.from_json("doc", "array<struct<event_type:string,k:int>>")))
    return rows.groupBy("user_id", "event_type", "k").agg(F.count("*").alias("n"))


@query("j4_unwrapped", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def j4(spark, d):
    """Envelopes, and strings of JSON inside them, up to three layers."""
    p = c("props")
    text_of = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    wrap = lambda key, x: F.concat(F.lit(f'{{"{key}": '), x, F.lit("}"))
    doc = _choice(c("event_id"), p, wrap("data", p), wrap("result", text_of(p)), wrap("pricing_summary", wrap("data", p)), text_of(wrap("data", text_of(p))))
    return t(spark, d, "events").select("event_id", F.get_json_object(dirty_json.unwrapped(doc), "$.k").cast("int").alias("k"))


@query("j6_shareable", "SELECT event_id, event_id % 4 IN (0, 2) AS ok FROM events")
def j6(spark, d):
    """Blocked keys at any depth; the same words as values, or a list instead of an object, are told apart."""
    doc = _choice(c("event_id"), F.lit('{"a": [{"b": {"note": "my \\\\"budget\\\\": 3"}}]}'), F.lit('{"a": [{"b": {"jar_balance": 3}}]}'), F.concat(F.lit('{"kind": "budget", "x": '), "props", F.lit("}")), F.lit('[{"a": 1}]'))
    return t(spark, d, "events").select("event_id", dirty_json.is_shareable(doc).alias("ok"))


@query("prj3_coercions", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN value WHEN 1 THEN -2.5 WHEN 5 THEN 1000 END AS number, CASE event_id % 7 WHEN 0 THEN CASE WHEN value > 0 THEN value END WHEN 5 THEN 1000 END AS positive, CASE event_id % 7 WHEN 2 THEN true WHEN 3 THEN false END AS flag FROM events""")
def prj3(spark, d):
    x = _choice(c("event_id"), c("value").cast("string"), " -2.5 ", " TRUE", "false ", "", "1e3", "n/a")
    return t(spark, d, "events").select("event_id", dirty_json.number(x).alias("number"), dirty_json.positive(x).alias("positive"), dirty_json.boolean(x).alias("flag"))


# -- filters, pages, keys, writes ----------------------------------------------------------------------------------------

@query("flt10_store_range", "SELECT c_custkey FROM customer WHERE lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') BETWEEN '00010' AND '00900' AND c_nationkey = 7 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def flt10(spark, d):
    """Zip codes between two, a state, and a list of cities, which goes before a single one."""
    x = t(spark, d, "customer").select("c_custkey", F.lpad((c("c_custkey") % 100000).cast("string"), 5, "0").alias("zip"), c("c_nationkey").alias("state"), c("c_mktsegment").alias("city"))
    return windows.store_range(x, zip_min="00010", zip_max="00900", state=7, cities=["BUILDING", "MACHINERY"], city="HOUSEHOLD").select("c_custkey")


@query("flt16_review_modes", "SELECT m AS mode, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id), (VALUES ('ingredient'), ('unit'), ('any')) v(m) WHERE CASE m WHEN 'ingredient' THEN (toxic = 0) IS NOT FALSE WHEN 'unit' THEN (toxic = 0) IS TRUE ELSE TRUE END GROUP BY m")
def flt16(spark, d):
    """A flag that may be missing: not false, true, or whatever it is; each mode counted in one pass."""
    x = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", (c("toxic") == 0).alias("flag")), "doc_id", "left")
    n = x.agg(F.count_if(F.coalesce("flag", F.lit(True))).alias("ingredient"), F.count_if("flag").alias("unit"), F.count("*").alias("any"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), c(m).alias("n")) for m in ("ingredient", "unit", "any")]))).filter("n > 0")


@query("flt17_statuses", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS n_open, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done FROM orders WHERE o_orderstatus IN ('O', 'P', 'F') GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) > 0")
def flt17(spark, d):
    is_open = c("o_orderstatus").isin("O", "P")
    x = t(spark, d, "orders").filter(c("o_orderstatus").isin("O", "P", "F")).groupBy("o_custkey").agg(F.count_if(is_open).alias("n_open"), F.count_if(c("o_orderstatus") == "F").alias("n_done"))
    return x.filter("n_open > 0")


@query("sr4_page_then_filter", "SELECT p_partkey, (SELECT count(*) FROM part WHERE contains(p_name, 'red')) AS found FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40 OFFSET 20) WHERE contains(p_name, 'red')")
def sr4(spark, d):
    """The page is cut before the text filter, so it may be short, while the count is of all that match."""
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    match = c("p_name").contains("red")
    n = p.filter(match).agg(F.count("*").alias("found"))
    page = windows.page(p, [c("p_retailprice").desc(), c("p_partkey")], 20, 40).filter(match)
    return page.join(F.broadcast(n), F.lit(True)).select("p_partkey", "found")  # one row


@query("st8_store_key", "SELECT lower(trim(n_name)) || ':' || lower(trim(s_name)) || ':' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 5, '0') AS key, min(s_suppkey) AS s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def st8(spark, d):
    """Stores by brand, name and zip code, whatever their address; the first of a key stays."""
    s = t(spark, d, "supplier").join(t(spark, d, "nation").select(c("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    key = F.concat_ws(":", F.lower(F.trim("n_name")), F.lower(F.trim("s_name")), F.lpad((c("s_suppkey") % 40).cast("string"), 5, "0"))
    return s.groupBy(key.alias("key")).agg(F.min("s_suppkey").alias("s_suppkey"))


@query("snk6_soft_delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 <> 0)")
def snk6(spark, d):
    """Rows marked as deleted, a third of them restored; reads see what is not deleted. All runs twice."""
    path = f"{graph.shared_dir(spark)}/larder/{uuid.uuid4().hex}"
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    closed = o.filter("o_orderstatus = 'F'")
    for _ in range(2):
        kept.append(spark, path, o, ["o_orderkey"], [c("o_orderkey")])
        kept.mark(spark, path, closed, ["o_orderkey"], F.lit("2024-01-01 00:00:00"), True)
        kept.mark(spark, path, closed.filter("o_orderkey % 3 = 0"), ["o_orderkey"], F.lit("2024-01-02 00:00:00"), False)
    return kept.visible(spark, path, o.schema, ["o_orderkey"])


@query("snk8_bulk_ingest", """WITH x AS (SELECT l_suppkey, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_suppkey, l_partkey, cents, (row_number() OVER (ORDER BY l_suppkey, l_partkey, cents) - 1) // 500 AS batch, CASE WHEN cents > 9000000 THEN 'rejected' ELSE 'duplicate' END AS status, CASE WHEN cents > 9000000 THEN 'too high' END AS error FROM x""")
def snk8(spark, d):
    """Of rows with one dedupe key (store, product, price) the first is taken in, by batches; the second run finds them all."""
    path = f"{graph.shared_dir(spark)}/larder/{uuid.uuid4().hex}"
    x = t(spark, d, "lineitem").select("l_suppkey", "l_partkey", money.cents(c("l_extendedprice")).alias("cents"), "l_orderkey")
    load = lambda: kept.bulk_load(spark, path, x, ["l_suppkey", "l_partkey", "cents"], [c("l_suppkey"), c("l_partkey"), c("cents"), c("l_orderkey")], F.when(c("cents") > 9_000_000, "too high"))
    load()
    return load()


@query("snk10_comparison_export", """WITH x AS (SELECT s_nationkey, s_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
    SELECT s_nationkey, to_json({'store_order': list('s' || s_suppkey ORDER BY total, s_suppkey), 'store_mapping': list({'store': 's' || s_suppkey, 'total_cents': total} ORDER BY total, s_suppkey)})::VARCHAR AS doc FROM x GROUP BY s_nationkey""")
def snk10(spark, d):
    """A comparison as one JSON document: the order of stores, and each store's total."""
    s = t(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_nationkey")
    x = t(spark, d, "lineitem").select("l_suppkey", money.cents(c("l_extendedprice")).alias("v")).groupBy("l_suppkey").agg(F.sum("v").alias("total")).join(s, "l_suppkey")
    rows = F.array_sort(F.collect_list(F.struct("total", "l_suppkey")))
    name = lambda r: F.concat(F.lit("s"), r["l_suppkey"].cast("string"))
    x = x.groupBy("s_nationkey").agg(rows.alias("r"))
    doc = F.struct(F.transform("r", name).alias("store_order"), F.transform("r", lambda r: F.struct(name(r).alias("store"), r["total"].alias("total_cents"))).alias("store_mapping"))
    return x.select("s_nationkey", F.to_json(doc).alias("doc"))


@query("snk12_calculation_log", """SELECT o_custkey, to_json({'orders': count(DISTINCT o_orderkey), 'items': count(*)})::VARCHAR AS inputs, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total_cents FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def snk12(spark, d):
    """A row of inputs and result for each calculation of a basket, appended once however often it is sent."""
    li = t(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(money.cents(c("l_extendedprice"))).alias("v"))
    x = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(li, "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("n").alias("items"), F.sum("v").alias("total_cents"))
    x = x.select("o_custkey", F.to_json(F.struct("orders", "items")).alias("inputs"), "total_cents")
    path = f"{graph.shared_dir(spark)}/larder/{uuid.uuid4().hex}"
    for _ in range(2):
        kept.append(spark, path, x, ["o_custkey", "inputs"], [c("total_cents")])
    return kept.read(spark, path, x.schema)
