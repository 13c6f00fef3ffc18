"""Batches, splits, radius, units and reranking against plain versions and written-out cases."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from larder.functions import matching, units
from larder.operators import batches, graph, similarity, spatial
from larder.plans import catalog
from larder.streaming import events

DIR = "/root/testdata/sf0.001"


def one(spark, x):
    return spark.range(1).select(x.alias("x")).first().x


def test_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "b", None]), i * i * 7, rng.choice([0, 1, 10, 40, 300])) for i in range(600)]
    got = {(r.q, r.k): r.batch for r in batches.in_order(spark.createDataFrame(rows, "q string, k long, n int"), "q", "k", "n", 5, 100).collect()}
    assert len(got) == 600
    for q in ("a", "b", None):
        at, n, total = None, 0, 0
        for _, k, size in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            if at is None or n == 5 or total + size > 100:
                at, n, total = k, 0, 0
            n, total = n + 1, total + size
            assert got[q, k] == at
    assert batches.in_order(spark.createDataFrame([], "q string, k long, n int"), "q", "k", "n").count() == 0


def test_batches_of_documents(spark):
    docs = pd.read_parquet(f"{DIR}/documents.parquet").dropna(subset=["text"])
    got = catalog.queries()["s34_batches"](spark, DIR).toPandas()
    assert len(got) == len(docs)
    sums = got.groupby(["source", "batch"], dropna=False).chars.agg(["sum", "count"])
    assert (sums["count"] <= 64).all() and ((sums["sum"] <= 12_000) | (sums["count"] == 1)).all()


def _parts(names):
    """Names cut as the operator does, by recursion."""
    if len(names) < 3:
        return []
    words = {n: set(w for w in n.split() if len(w) > 1) for n in names}
    if set.intersection(*words.values()):
        return [names]
    count = {}
    for w in words.values():
        for x in w:
            count[x] = count.get(x, 0) + 1
    able = sorted((-(k * 10 + min(k, len(names) - k)), w) for w, k in count.items() if len(w) >= 4 and 2 <= k <= 5 and k < len(names))
    if not able:
        return [names]
    has, lacks = ([n for n in names if (able[0][1] in words[n]) == side] for side in (True, False))
    return [names] if len(lacks) < 2 else _parts(has) + _parts(lacks)


def test_split_components(spark):
    part = pd.read_parquet(f"{DIR}/part.parquet")
    expected = {frozenset((b, n) for n in p) for b, g in part.groupby("p_brand") for p in _parts(sorted(set(g.p_name)))}
    got = catalog.queries()["gr2_split"](spark, DIR).toPandas()
    assert {frozenset(zip(g.p_brand, g.p_name)) for _, g in got.groupby(["p_brand", "part"])} == expected
    assert len(expected) > got.p_brand.nunique()
    assert graph.split_components(spark.createDataFrame([], "k string, n string"), "k", "n").count() == 0


def test_connected_raises_when_cut_off(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in graph.connected(chain).collect()} == {0}
    try:
        graph.connected(chain, rounds=1)
    except RuntimeError:
        return
    raise AssertionError("an unfinished labelling was returned")


def test_radius_at_poles_and_date_line(spark):
    rng = random.Random(5)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(89.9, 10.0), (89.9, -170.0), (0.0, 179.9), (0.0, -179.9), (None, 1.0)]
    x = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "i long, lat double, lng double")
    y = x.select(F.col("i").alias("j"), F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"))

    def miles(a, b):
        (p, q), (r, s) = (tuple(map(math.radians, v)) for v in (a, b))
        return 2 * 3958.7613 * math.asin(math.sqrt(min(1, math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))

    known = [(i, s) for i, s in enumerate(spots) if s[0] is not None]
    for metres in (25_000.0, 2_000_000.0, 30_000_000.0):
        got = [(r.i, r.j) for r in spatial.within(x, y, metres).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, a in known for j, b in known if miles(a, b) * 1609.34 <= metres}


def test_conversion(spark):
    to = lambda q, a, b, d=None: one(spark, units.converted(F.lit(q), F.lit(a), F.lit(b), F.lit(d).cast("double")))
    assert abs(to(16.0, "oz", "lb") - 1) < 1e-9 and to(2.0, "dozen", "each") == 24 and to(3.0, "pinch", "pinch") == 3
    assert to(1.0, "cup", "g") is None and to(1.0, "l", "g", 0.5) == 500 and to(500.0, "g", "l", 0.5) == 1 and to(1.0, "l", "g", 0.0) is None
    assert to(1.0, "pinch", "g") is None and one(spark, units.price_per_base_unit(F.lit(3.0), F.lit(0.0), F.lit("g"))) is None


def test_hints(spark):
    hint = lambda own, field, per: one(spark, units.unit_hint(F.lit(own).cast("string"), [F.lit(field).cast("string")], F.lit(per).cast("string")))
    assert [hint(" 12  oz ", "lb", None), hint("N/A", "lb", None), hint(None, "null", "$0.50 / Fl  Oz"), hint(None, None, "0.5 each"), hint(None, None, None)] == ["12 oz", "lb", "fl oz", None, None]


def test_retained_names(spark):
    kept = lambda a, b: one(spark, matching.retained_form(F.lit(a), F.lit(b), ["paste", "chicken", "juice"]))
    assert kept("tomato paste", "tomato") == "tomato paste" and kept("big brand hot tomato paste 6oz", "tomato") == "tomato paste"
    assert kept("chicken stew", "soup") == "chicken stew" and kept("apple juice", "pear") is None and kept("tomato paste", "paste tomato") is None
    variety = lambda a, b: one(spark, matching.retained_variety(F.lit(a), F.lit(b), F.array(F.lit("basmati"))))
    assert variety("Basmati Rices", "rice") == "basmati rice" and variety("brown rice", "rice") is None and variety("basmati", "rice") is None


def test_relinking_ignores_tails(spark):
    row = [("olive oil", "a", "olive", "b", 0.5), ("olive oil", "a", "Lightly Smoked Sardines in Olive Oil", "a", 0.5), ("olive oil", "a", "far", "a", 0.39)]
    df = spark.createDataFrame(row, "query string, query_category string, candidate string, candidate_category string, cosine double")
    got = similarity.rerank(df, ["paste"], 5, floor=0.4, tails=False).collect()
    assert [(r.candidate, r.score) for r in sorted(got, key=lambda r: r.place)] == [("olive", 0.53), ("Lightly Smoked Sardines in Olive Oil", 0.5)]


def test_rerank_queries(spark):
    best = catalog.queries()["ml1_rerank"](spark, DIR).toPandas()
    places = catalog.queries()["sr9_rerank_places"](spark, DIR).toPandas()
    top = places[places.place == 1].set_index("query")
    assert len(best) and (best.set_index("query").candidate == top.candidate.reindex(best["query"])).all()
    assert all(g.sort_values("place").score.is_monotonic_decreasing for _, g in places.groupby("query"))


def test_lp_axes(spark):
    rng = np.random.default_rng(2)
    m, w = rng.standard_normal((300, 3)) * [3, 1, 2] + 1, rng.uniform(0.5, 2, 300)
    df = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(m, w)], "v array<double>, w double")
    mean, axes, power = similarity.lp_axes(df, "v", "w", 3.0, 2)
    centred = m - np.average(m, axis=0, weights=w)
    value = lambda a: (w * np.abs(centred @ a) ** 3).sum()
    assert np.allclose(axes @ axes.T, np.eye(2), atol=1e-6) and np.isclose(power[0], value(axes[0]), rtol=1e-5)
    tries = rng.standard_normal((4000, 3))
    assert value(axes[0]) >= max(value(a / np.linalg.norm(a)) for a in tries) * 0.999
    flat = tries - np.outer(tries @ axes[0], axes[0])
    assert value(axes[1]) >= max(value(a / np.linalg.norm(a)) for a in flat) * 0.999
    assert similarity.lp_axes(df.limit(0), "v", "w", 3.0)[1].size == 0


def test_projections(spark):
    e = pd.read_parquet(f"{DIR}/embeddings.parquet")
    m = np.stack(e.embedding).astype(float)
    m -= m.mean(0)
    axes = np.linalg.svd(m, full_matrices=False)[2][:2]
    got = catalog.queries()["pc3_plain_projection"](spark, DIR).toPandas().set_index("vec_id").loc[e.vec_id]
    assert np.allclose(np.abs(got[["pc1", "pc2"]]), np.abs(m @ axes.T), atol=1e-4)
    assert catalog.queries()["pc2_lp_projection"](spark, DIR).count() == len(e)


def test_jaccard_pairs(spark):
    rng = random.Random(8)
    sets = [(i, sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 8))})) for i in range(120)]
    df = spark.createDataFrame(sets, "k long, s array<string>")
    for least in (0.3, 0.5, 0.8, 1.0):
        want = {(i, j) for i, u in sets for j, v in sets if i < j and u and v and len(set(u) & set(v)) / len(set(u) | set(v)) >= least - 1e-9}
        got = [(r.a, r.b) for r in similarity.jaccard_pairs(df, "k", "s", least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_streams(spark, tmp_path):
    d = f"{DIR}/events.parquet"
    spark.read.parquet(d).repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(d)
    events.keep_rollup(events.read_events(spark, str(tmp_path / "in"), 1), str(tmp_path / "roll"), str(tmp_path / "cp"), ["event_type"])
    want = {r.event_type: (r.n, r.cents) for r in table.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).collect()}
    roll = lambda: {r.event_type: (r.n, r.cents) for r in events.read_rollup(spark, str(tmp_path / "roll"), ["event_type"]).collect()}
    assert roll() == want
    events.keep_rollup(events.read_events(spark, str(tmp_path / "in"), 1), str(tmp_path / "roll"), str(tmp_path / "cp"), ["event_type"])
    assert roll() == want
    events.run_available(events.once(events.read_events(spark, str(tmp_path / "in"), 100), ["user_id"], "60 days"), str(tmp_path / "first"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "first")).count() == table.select("user_id").distinct().count()
    events.run_available(events.sessions(events.read_events(spark, str(tmp_path / "in"), 100), "2 hours", "1 second"), str(tmp_path / "runs"), str(tmp_path / "cp3"))
    x = pd.read_parquet(d).sort_values(["user_id", "ts"])
    gap = x.ts - x.groupby("user_id").ts.shift() >= pd.Timedelta("2h")
    runs = x.assign(run=(gap | (x.user_id != x.user_id.shift())).cumsum()).groupby("run").agg(user_id=("user_id", "first"), start=("ts", "min"), n=("ts", "size"))
    known = {(u, str(s)[:19], n) for u, s, n in zip(runs.user_id, runs.start, runs.n)}
    got = {(r.user_id, str(r.start)[:19], r.n) for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert got and got <= known and len(got) >= len(known) * 0.9


def test_week_broadcasts_no_growing_table(spark):
    """Products and customers are merged, however small their files look."""
    for name in ("q17_weekly_plan", "q16_plan_store"):
        lines, sent, at = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n"), [], None
        for line in lines:
            place = len(line) - len(line.lstrip(" :+-"))
            at = None if at is not None and place <= at else at
            at = place if at is None and line.lstrip(" :+-").startswith("BroadcastExchange") else at
            sent += [line] if at is not None else []
        assert sent and not [x for x in sent if "/part.parquet" in x or "/customer.parquet" in x]
