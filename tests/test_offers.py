"""Titles, units, quantities, JSON, stores and vectors against written-out cases."""

import numpy as np
from pyspark.sql import functions as F

from larder.functions import dirty_json, matching, quantities, text, titles
from larder.operators import similarity, windows


def one(spark, *cols):
    return tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(cols)]).first())


def lit(x):
    return F.lit(x).cast("string")


def test_store_parent(spark):
    for name in matching.CHAINS:
        assert one(spark, matching.store_parent(lit(name.title()))) == (name,)
    got = one(spark, *[matching.store_parent(lit(x)) for x in ("Safeway", "Independent", "Safeway #12", "Fry's Food", "Corner Market", "Oak Hardware", None)])
    assert got == ("safeway", "independent", "albertsons", "kroger", "independent", None, None)


def test_names_that_stand_for_nothing(spark):
    cut = lambda x: matching.without_retail_suffix(lit(x))
    assert one(spark, cut("sauce 2 oz"), cut("Broth 32oz carton"), cut("Deli Meat 1 lb"), cut("Peas and Carrots 12 oz bag"), cut("turkey deli meat 1 lb")) == (None, None, None, None, "turkey deli meat")
    names = one(spark, matching.fallback_names(lit("whole milk 2 l bottle")))[0]
    assert [(r.name, r.source) for r in names] == [("whole milk", "strip_retail_suffix"), ("milk", "strip_retail_suffix_tail_1_token"), ("l bottle", "tail_2_tokens"), ("2 l bottle", "tail_3_tokens")]


def test_idf_floor(spark):
    risk = lambda floor: matching.new_name_risk(lit("rare herb"), lit("other"), F.lit(0.5), F.lit(floor).cast("double"))
    assert one(spark, risk(0.6), risk(0.4), risk(-1.0), risk(None)) == ("idf_token_floor", None, None, None)


def test_lines(spark):
    line = lambda x: matching.ingredient_line(lit(x))
    got = one(spark, line("1 1/2 cups flour"), line("2-3 fl. oz cream"), line("3 tbsp. oil"), line("2 bunches parsley"), line("4 eggs"), line("salt"), line("1/2 lb beef"))
    assert [(r.quantity, r.unit, r.name) for r in got] == [("1 1/2", "cups", "flour"), ("2-3", "fl. oz", "cream"), ("3", "tbsp", "oil"), ("2", "bunches", "parsley"), ("4", "", "eggs"), ("", "", "salt"), ("1/2", "lb", "beef")]


def test_titles(spark):
    got = one(spark, *[titles.shop_name(lit(x)) for x in ("Red Bell Pepper, Garlic Cream Cheese Spread 8 Oz", "Tuna in extra virgin olive oil", "Butter 16oz unsalted", "Seltzer, 6 pack", "Chips - Good & Gather")])
    assert got == ("Cream Cheese Spread Red Bell Pepper, Garlic", "Tuna", "Butter", "Seltzer", "Chips")
    assert one(spark, titles.recipe_name(lit("Fresh chopped Parsley, to taste")), titles.recipe_name(lit("Organic milk 2 l"))) == ("parsley", "milk")
    for bad in titles.NO_UNITS:
        assert one(spark, titles.real_unit(lit(bad.upper()))) == (None,)
    assert one(spark, titles.real_unit(lit("  cup  ")), titles.real_unit(lit(" ")), titles.real_unit(lit(None))) == ("cup", None, None)
    assert one(spark, titles.without_measure(lit("2 cups"), ["cups"]), titles.without_measure(lit("1 1 cup of rice"), ["cup"])) == ("2 cups", "of rice")


def test_quantities(spark):
    q = lambda need, size: F.struct(quantities.covering(F.lit(need), F.lit(size)).alias("n"), quantities.one_package_more(F.lit(need), F.lit(size)).alias("up"), quantities.one_package_less(F.lit(need), F.lit(size)).alias("down"))
    assert [tuple(x) for x in one(spark, q(2.0, 10.0), q(25.0, 10.0), q(0.0, 3.3333))] == [(1, 20.0, 10.0), (3, 40.0, 20.0), (1, 6.6666, 3.3333)]
    fault = lambda x, b: quantities.quantity_fault(F.lit(x).cast("double"), F.lit(b).cast("double"))
    assert one(spark, fault(None, None), fault(float("nan"), 1), fault(float("inf"), 1), fault(0, 1), fault(10_001, None), fault(6, 1), fault(5, 1), fault(6, 0)) == ("not_positive",) * 4 + ("over_cap", "inflated", None, None)
    total = lambda failed, base, packs, price=2.0: quantities.line_total(F.lit(9.0), F.lit(price), F.lit(4.0), F.lit(failed), F.lit(base).cast("double"), F.lit(packs).cast("double"))
    assert one(spark, total(False, None, None), total(True, 3, 1), total(True, None, None), total(False, None, None, 0.0)) == (6.0, 6.0, 2.0, None)


def test_json(spark):
    assert one(spark, *[dirty_json.number(lit(x)) for x in ("1.5", " 2 ", "", "x", None, "1e400", "-.5")]) == (1.5, 2.0, None, None, None, None, -0.5)
    assert one(spark, dirty_json.unwrapped(lit('{"data": "{\\"result\\": {\\"a\\": 1}}"}'))) == ('{"a":1}',)
    safe = lambda x: dirty_json.is_shareable(lit(x))
    assert one(spark, safe('{"a": [1, {"receipt_total" : 2}]}'), safe('{"a": "receipt_total"}'), safe("[1]"), safe('{"budget\\"": 1}'), safe('{"spend": 0}')) == (False, True, False, True, False)


def test_prices_and_zips(spark):
    assert one(spark, *[text.price(lit(x)) for x in ("$4.99", "1.2.3", "free", "-3")]) == (4.99, 1.2, None, -3.0)
    assert one(spark, *[text.zip_code(lit(x)) for x in ("94105-1234", " 94105", "A94105", "941")]) == ("94105", "94105", "", "")


def test_store_range(spark):
    df = spark.createDataFrame([(1, "10000", "CA", "A"), (2, "20000", "CA", "B"), (3, "30000", "NY", "A")], "id int, zip string, state string, city string")
    ids = lambda **k: sorted(r.id for r in windows.store_range(df, **k).collect())
    assert ids() == [1, 2, 3] and ids(zip_min="15000", zip_max="30000") == [2, 3] and ids(state="CA", city="A") == [1] and ids(cities=["B"], city="A") == [2] and ids(cities=[], city="A") == [1, 3]


def test_nearest_vectors_in_parts(spark):
    """Many small parts of both sides give the same rows as one comparison of all."""
    v = np.random.default_rng(3).normal(size=(120, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, [0.0] * 8), (501, None)], "id long, v array<double>")
    got = {}
    for r in similarity.nearest_vectors(df, df.filter("id % 5 = 0"), "id", "v", 4, rows=13, asked=5).orderBy("a", "place").collect():
        got.setdefault(r.a, []).append(r.b)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {a: [int(b) for b in np.lexsort((np.arange(120), -(u @ u[a]).round(9))) if b != a][:4] for a in range(0, 120, 5)}
    assert got == want


def test_traffic_split_draws(spark):
    """The split of fixed draws, computed plainly."""
    import zlib

    df = spark.createDataFrame([("x", v, e, k) for v, e, k in (("a", 100, 10), ("b", 100, 50), ("c", 100, 1))] + [("y", "a", 10, 1)], "experiment string, variant string, exposures long, conversions long")
    got = {r.variant: r.percent for r in similarity.traffic_split(df, "experiment", 7).collect()}
    theta = np.random.default_rng([7, zlib.crc32(b"x")]).beta(np.array([11.0, 51.0, 2.0]), np.array([91.0, 51.0, 100.0]))
    share = np.maximum(theta / theta.sum() * 100, 5)
    share = np.floor(share / share.sum() * 100).astype(int)
    share[share.argmax()] += 100 - share.sum()
    assert got == dict(zip("abc", share.tolist()))
