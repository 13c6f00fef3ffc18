"""Name, recipe and decision rules against plain Python, and graph, PCA and split operators against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from larder.functions import matching, money
from larder.operators import similarity
from larder.plans import catalog

DIR = "/root/testdata/sf0.001"


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def brute_score(a, b):
    """The score for plain, lower-case names, with loops."""
    if a == b:
        return 1.0
    u, v = a.split(), b.split()
    share = set(u) & set(v)
    pairs = lambda w: set(zip(w, w[1:])) if len(w) > 1 else set(w)
    dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 0
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    score = 0.45 * len(share) / len(set(u) | set(v)) + 0.35 * len(share) / min(len(set(u)), len(set(v))) + 0.08 * dice(grams(a.replace(" ", "")), grams(b.replace(" ", "")))
    if len(share) > 1:
        cu, cv = [w for w in u if w in v], [w for w in v if w in u]
        score += 0.07 * dice(pairs(cu), pairs(cv)) + 0.05 * sum(x == y for x, y in zip(cu, cv)) / max(len(cu), len(cv))
    if len(u) > 1 and len(v) > 1 and u[-1] == v[-1] and u[-1] in matching.GENERIC_HEADS and not set(u[:-1]) & set(v[:-1]):
        score -= 0.18
    return max(0.0, score)


def test_name_similarity(spark):
    names = ["milk", "whole milk", "oat milk", "brown sugar", "sugar brown", "olive oil extra virgin", "extra virgin olive oil", "red onion", "red onion soup", "tea"]
    df = spark.createDataFrame(list(itertools.product(names, names)), "a string, b string")
    for r in df.withColumn("s", matching.name_similarity(F.col("a"), F.col("b"))).collect():
        assert abs(r.s - brute_score(r.a, r.b)) < 1e-12, r
    null = F.lit(None).cast("string")
    assert one(spark, matching.name_similarity(F.lit("Tomatoes"), F.lit("tomato")), matching.name_similarity(null, F.lit("x")), matching.name_similarity(F.lit(" !"), F.lit(""))) == (0.995, 0.0, 0.0)
    for r in catalog.queries()["s9_name_score"](spark, DIR).collect():
        assert abs(r.score - brute_score(r.a, r.b)) < 1e-6


def test_remap(spark):
    way = lambda a, b: matching.remap_direction(F.lit(a), F.lit(b))
    assert one(spark, way("milk", "whole milk"), way("whole milk", "milk"), way("organic milk", "whole milk"), way("milk", "milk")) == ("generic_to_specific", "specific_to_generic", "lateral", "lateral")
    ok = lambda d, c, s: matching.remap_allowed(F.lit(d), F.lit(c), F.lit(s))
    assert one(spark, ok("generic_to_specific", 0.96, 0.98), ok("generic_to_specific", 0.94, 0.99), ok("specific_to_generic", 0.92, 0.99), ok("specific_to_generic", 0.92, 0.98)) == (True, False, True, False)


def test_risk_and_titles(spark):
    risk = lambda n, k, p: matching.new_name_risk(F.lit(n), F.lit(k).cast("string"), F.lit(p))
    assert one(spark, risk("vanilla almond milk", None, 0.9), risk("chocolate mix mix", "snacks", 0.91), risk("minute maid lemonade 2 liter", "other", 0.124), risk("minute maid lemonade 2 liter", "other", 0.9)) == (None, "repeated_token_sequence", "dynamic_token_confidence_floor", "retail_title_like")
    food = lambda x: matching.is_non_food(F.lit(x).cast("string"))
    assert one(spark, food("Body & Hand Butter"), food("peanut butter"), food("tooth-paste"), food(None)) == (True, False, True, False)


def test_lines_and_recipes(spark):
    line = lambda x: matching.ingredient_line(F.lit(x).cast("string"))
    got = one(spark, line(" 1 1/2  Cups flour "), line("2 - 3 eggs"), line("1/2 tsp. salt"), line("salt to taste"), line(None), line("2 cloves garlic"))
    assert [tuple(x) for x in got] == [("1 1/2", "Cups", "flour"), ("2-3", "", "eggs"), ("1/2", "tsp", "salt"), ("", "", "salt to taste"), ("", "", ""), ("2", "cloves", "garlic")]
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    q = lambda *x: matching.recipe_quality(*x)
    got = one(spark, q(F.lit("Pancakes"), arr(*[f"ingredient{i}" for i in range(8)]), arr("a", "b", "c", "d", "e")), q(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")), q(F.lit("Soup"), arr("a", "a", "A"), arr("x")))
    assert [(x.score, x.passed) for x in got] == [(1.0, True), (0.1, False), (round(0.15 * 0.3 + 0.35 * 3 / 8 + 0.25 * 0.5, 3), False)]
    assert one(spark, matching.verification(F.lit(None).cast("double")), matching.verification(F.lit(0.85)), matching.verification(F.lit(0.8)), matching.verification(F.lit(1.0), True)) == ("pending", "auto_accepted", "needs_confirmation", "needs_confirmation")
    assert tuple(one(spark, matching.journey(F.lit(None).cast("int"), F.lit(0), F.lit(5)))[0]) == (1, 1, 100, True)
    day = lambda x: F.lit(x).cast("date")
    assert one(spark, money.plan_week(day("2024-12-31")), money.plan_week(day("2024-01-07")), money.plan_week(day("2024-01-08")), money.iso_week(day("2024-12-31"))) == (202401, 202401, 202402, 202501)


def test_communities_and_medoids(spark):
    edges = [("brown sugar", "sugar", 0.98), ("brown sugar", "vanilla sugar", 0.96), ("vanilla sugar", "sugar", 0.97)]
    products = spark.createDataFrame([("sugar", 20), ("brown sugar", 8), ("vanilla sugar", 3)], "name string, n long")
    pairs = spark.createDataFrame(edges, "a string, b string, similarity double")
    members = products.select(F.lit(1).alias("component"), "name").union(spark.createDataFrame([(2, "chicken sausage"), (2, "turkey sausage"), (2, "protein patties"), (3, "a b"), (3, "a c")], "component int, name string"))
    found = similarity.communities(members, "component", "name")
    assert {(r.name, r.cluster_size, r.common) for r in found.collect()} == {(n, 3, 1) for n in ("sugar", "brown sugar", "vanilla sugar")}
    assert {(r.name, r.target) for r in similarity.merge_targets(found, "component", "name", products).collect()} == {("brown sugar", "sugar"), ("vanilla sugar", "sugar")}
    get = lambda *x: tuple(similarity.medoids(found, "component", "name", pairs, products, *x).select("medoid", "reason").first())
    old = spark.createDataFrame([(n, "brown sugar") for n in ("sugar", "brown sugar", "vanilla sugar")], "name string, medoid string")
    assert get() == ("sugar", "initiation_best_score")
    assert get(old, 0.2) == ("brown sugar", "perturbation_retained_previous_medoid")
    assert get(old, 0.01) == ("sugar", "perturbation_promoted_better_candidate")
    assert get(old.limit(0), 0.2)[1] == "perturbation_fallback_to_initiation"
    assert get(old.withColumn("medoid", F.lit("gone")), 0.2) == ("sugar", "perturbation_missing_previous_medoid")


def test_clustering(spark):
    rng = np.random.default_rng(2)
    e = {(a, b) for a, b in rng.integers(0, 30, (120, 2)).tolist() if a != b} | {(0, i) for i in range(1, 30)}
    und = {(min(x), max(x)) for x in e}
    near = {n: {b for a, b in und if a == n} | {a for a, b in und if b == n} for n in range(30)}
    out = similarity.clustering_coefficients(spark.createDataFrame([*e, (4, 4), (None, 1)], "a int, b int")).collect()
    assert len(out) == len([n for n in near if near[n]])
    for r in out:
        links = sum((min(x), max(x)) in und for x in itertools.combinations(near[r.node], 2))
        k = len(near[r.node])
        assert (r.degree, r.triangles) == (k, links) and abs(r.coefficient - (links / (k * (k - 1) / 2) if k > 1 else 0)) < 1e-12


def test_weighted_pca(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(500, 6)) * [5, 3, 1, 1, 1, 0.5], rng.random(500)
    df = spark.createDataFrame([(v.tolist(), float(k)) for v, k in zip(x, w)] + [(None, 1.0), ([9.0] * 6, 0.0), ([9.0] * 6, None)], "v array<double>, w double").repartition(5)
    mean, axes, share = similarity.weighted_pca(df, "v", "w", 3)
    mu = np.average(x, axis=0, weights=w)
    _, s, vt = np.linalg.svd(np.sqrt(w / w.sum())[:, None] * (x - mu), full_matrices=False)
    assert np.allclose(mean, mu) and np.allclose(np.abs((axes * vt[:3]).sum(1)), 1) and np.allclose(share, (s**2 / (s**2).sum())[:3])
    assert similarity.weighted_pca(df.limit(0), "v", "w")[0].size == 0
    out = catalog.queries()["pc1_weighted_projection"](spark, DIR).collect()
    rows = {r.vec_id: r for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    m = np.array([rows[r.vec_id].embedding for r in out], dtype=float)
    w = np.array([r.label + 1.0 for r in out])
    m -= np.average(m, axis=0, weights=w)
    _, _, vt = np.linalg.svd(np.sqrt(w)[:, None] * m, full_matrices=False)
    for k in (0, 1):
        axis = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose([r[f"pc{k + 1}"] for r in out], m @ axis, atol=1e-5)


def test_traffic_split(spark):
    v = spark.createDataFrame([("e", "a", 1000, 100), ("e", "b", 1000, 900), ("e", "c", 60, 0), ("few", "a", 1000, 1), ("few", "b", 49, 1)], "experiment string, variant string, exposures long, conversions long")
    runs = [{(r.experiment, r.variant): r.percent for r in similarity.traffic_split(v.repartition(n), "experiment", 3).collect()} for n in (1, 3)]
    assert runs[0] == runs[1] and set(runs[0]) == {("e", "a"), ("e", "b"), ("e", "c")} and sum(runs[0].values()) == 100 and runs[0]["e", "b"] > 75 and runs[0]["e", "c"] >= 4
    by = {}
    for r in catalog.queries()["ex1_traffic_split"](spark, DIR).collect():
        by[r.experiment] = by.get(r.experiment, 0) + r.percent
    assert set(by.values()) <= {100}


def test_learned_modifiers(spark):
    rows = [("smoked paprika", "paprika", 9), ("red wine", "wine", 2), ("red rice wine", "wine", 2), ("old wine", "wine", 1), ("wine", "wine", 50), ("", "x", 3), (None, None, None)]
    out = similarity.learned_modifiers(spark.createDataFrame(rows, "a string, b string, n long"), "a", "b", "n").collect()
    assert {tuple(r) for r in out} == {("paprika", "smoked", 9, 1), ("wine", "red", 4, 2)}


def test_rerank(spark):
    rows = [("fresh bocconcini mozzarella, sliced", "bocconcini mozzarella", 0.83), ("fresh bocconcini mozzarella, sliced", "Low-Moisture Part-Skim Mozzarella String Cheese", 0.87), ("fresh basil leaves", "basil", 0.82), ("fresh basil leaves", "Italian Whole Peeled Tomatoes with Basil Leaf", 0.87)]
    rows += [("olive oil, plus more", "olive oil", 0.84), ("olive oil, plus more", "Lightly Smoked Sardines in Olive Oil 4.25 Oz", 0.89), ("far", "away", 0.7)]
    df = spark.createDataFrame([(q, None, x, "c", s) for q, x, s in rows], "query string, query_category string, candidate string, candidate_category string, cosine double")
    assert {(r.query.split()[1], r.candidate) for r in similarity.rerank(df, ["leaf", "leaves", "paste"]).collect()} == {("bocconcini", "bocconcini mozzarella"), ("basil", "basil"), ("oil,", "olive oil")}


def test_weighted_words(spark):
    words = spark.createDataFrame([("oil", 9), ("olive", 1)], "word string, df long")
    df = spark.createDataFrame([("olive oil", "olive oil"), ("olive oil", "corn oil"), ("", None)], "a string, b string")
    got = sorted(r.similarity for r in similarity.weighted_word_similarity(df, "a", "b", words, 9).collect())
    assert np.allclose(got, [0, np.log(10 / 10) / (2 * np.log(10 / 2)), 1])


def test_shop_names(spark):
    cut = lambda x: matching.without_retail_suffix(F.lit(x).cast("string"))
    assert one(spark, cut("minute maid lemonade 2 liter"), cut("milk"), cut("2 oz"), cut(None), cut("canned beans 15oz can"), cut("N/A 2 ct")) == ("minute maid lemonade", None, None, None, "canned beans", None)
    of = lambda x: matching.store_parent(F.lit(x).cast("string"))
    assert one(spark, of("Pick 'n Save"), of("Smart & Final"), of("Hardware Market"), of("Joe's Produce"), of("Gym"), of(None), of("SAMSCLUB")) == ("kroger", "smartandfinal", None, "independent", None, None, "samsclub")
