"""Queries of near vectors against their SQL where groups are dealt to many partitions, and which queries they ask."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import similarity, vector_pairs
from larder.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def dealt(spark):
    """Partitions as on large tables: many, and not put together."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "41"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def by_sql(name):
    con = duckdb.connect()
    for x in ("embeddings", "part"):
        con.sql(f"create view {x} as select * from '{DIR}/{x}.parquet'")
    return con.sql(catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["jn11_nearest_25", "ml2_relink", "jn10_new_pairs", "ml4_logged_pairs", "ml5_like_missing"])
def test_same_rows_when_dealt(spark, dealt, name):
    want = by_sql(name)
    got = sorted(tuple(r[x] for x in want.columns) for r in catalog.queries()[name](spark, DIR).collect())
    assert got == sorted(want.fetchall())


def test_all_vectors_are_asked(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    assert {r.a for r in catalog.queries()["ml5_like_missing"](spark, DIR).collect()} == ids
    pairs = catalog.queries()["jn10_new_pairs"](spark, DIR).collect()
    assert {r.a for r in pairs} | {r.b for r in pairs} == ids
    most = max(sum(x in (r.a, r.b) for r in pairs) for x in range(50))
    assert most > 25  # no cut at so many nearest
    query, names = catalog.queries()["ml4_logged_pairs"](spark, DIR), {r.p_name for r in spark.read.parquet(f"{DIR}/part.parquet").collect()}
    assert len({n for r in query.collect() for n in (r.source, r.target)} & names) > len(names) // 2


def test_equal_vectors_tie(spark, dealt):
    """Many equal rows, of other lengths too, have one cosine and come by their keys, in whatever block they stand."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=7)
    v = {i: base.tolist() for i in range(0, 60, 3)} | {i: rng.normal(size=7).tolist() for i in range(60) if i % 3}
    odd = [(90, [float("nan")] * 7), (91, [None] * 7), (92, [0.0] * 7), (93, None), (None, base.tolist())]
    df = spark.createDataFrame([*v.items(), *odd], "id long, v array<double>")
    got = similarity.nearest_vectors(df, df.filter("id in (0, 90, 92)"), "id", "v", 12, rows=11, asked=2).orderBy("place").collect()
    assert [(r.a, r.b, r.cosine) for r in got] == [(0, i, 1.0) for i in range(3, 39, 3)]
    few = similarity.nearest_vectors(df, df.filter("id < 3"), "id", "v", 100, rows=11).collect()
    assert len(few) == 3 * 59


@pytest.mark.parametrize("components", [1 << 22, 90])
def test_all_pairs(spark, dealt, components):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(80, 9))
    m[40] = m[3]
    rows = [(i, x.tolist(), None if i % 7 == 0 else i % 3) for i, x in enumerate(m)]
    rows += [(200, m[0].tolist()[:5], 1), (201, m[1].tolist()[:5], 2), (202, [0.0] * 9, 1), (203, None, 1), (204, (m[2] * 1e-200).tolist(), 0)]
    df = spark.createDataFrame(rows, "k long, v array<double>, l int")
    u = np.vstack([m, m[2]])
    u = u / np.linalg.norm(u, axis=1)[:, None]
    ids = [*range(80), 204]
    label = {k: x for k, _, x in rows}
    want = {(ids[i], ids[j]): round(u[i] @ u[j], 9) for i in range(81) for j in range(i + 1, 81) if round(u[i] @ u[j], 9) >= 0.2}
    narrow = {(200, 201): round(float(m[0, :5] @ m[1, :5] / np.linalg.norm(m[0, :5]) / np.linalg.norm(m[1, :5])), 9)}
    want |= {k: s for k, s in narrow.items() if s >= 0.2}
    pairs = lambda **x: vector_pairs.all_pairs(df, "k", "v", 0.2, components=components, **x).collect()
    got = pairs()
    assert len(got) == len(want) and {(r.a, r.b): r.cosine for r in got} == want
    other = {p for p in want if None in (label[p[0]], label[p[1]]) or label[p[0]] != label[p[1]]}
    assert {(r.a, r.b) for r in pairs(apart="l")} == other != set(want)
    some = sorted(want)[::2]
    log = spark.createDataFrame([(b, a) for a, b in some] + [(None, 1), (5, 5)], "a long, b long")
    assert {(r.a, r.b) for r in pairs(log=log)} == set(want) - set(some)


def test_bands_and_all_pairs(spark):
    """Bands find nearly all pairs of all pairs, and both leave out the log's."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    log = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    pairs = lambda banded, **x: {(r.a, r.b): r.cosine for r in vector_pairs.cosine_pairs(e, "vec_id", "embedding", 0.35, recall=0.97, bucket=60, block=25, banded=banded, **x).collect()}
    whole, found = pairs(False), pairs(True)
    assert set(found) <= set(whole) and len(found) >= 0.9 * len(whole) and pairs(None) == whole
    assert all(abs(whole[p] - s) < 1e-8 for p, s in found.items())
    assert set(pairs(False, log=log)) == {p for p in whole if p[1] - p[0] != 1} and set(pairs(True, log=log)) == {p for p in found if p[1] - p[0] != 1}
