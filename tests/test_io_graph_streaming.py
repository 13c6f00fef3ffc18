import pytest
from pyspark.sql import functions as F

from larder.operators import graph, windows
from larder.sources import io
from larder.streaming import events


def test_upsert_and_append(spark):
    old = spark.createDataFrame([(1, "a", 2), (2, None, 3), (None, "n", 1)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "z", 5), (3, "c", 1), (None, "m", 1)], "k int, s string, n int")
    out = io.upsert(old, new, ["k"], {"n": lambda a, b: a + b})
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", 2), (2, "z", 8), (3, "c", 1), (None, "m", 2)], key=str)
    rows = spark.createDataFrame([(1, "x", 0), (4, "late", 9), (4, "first", 1)], "k int, s string, n int")
    assert [tuple(r) for r in io.append_new(old, rows, ["k"], [F.col("n")]).collect()] == [(4, "first", 1)]


def test_overwrite_and_retention(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "day string, n int")
    for _ in range(2):
        io.overwrite_days(df, str(tmp_path / "t"), "day")
    io.overwrite_days(df.filter("n = 2").withColumn("n", F.lit(9)), str(tmp_path / "t"), "day")
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 9]
    with pytest.raises(ValueError):
        io.retained(df, "day", F.current_timestamp(), 0)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,ok\n1, Yes \n2,no\n3,?\n")
    assert [r.ok for r in io.read_csv(spark, str(tmp_path / "a.csv"), ["ok"]).orderBy("id").collect()] == [True, False, None]
    (tmp_path / "f.json").write_text('{"properties":{"name":"A","addr:postcode":"12345"},"geometry":{"type":"Point","coordinates":[1.5,2.5]}}\n{"properties":{"name":"B"},"geometry":{"coordinates":[1,2]}}\n')
    assert [(r.name, r.lng, r.lat) for r in io.read_features(spark, str(tmp_path / "f.json")).collect()] == [("A", 1.5, 2.5)]
    bad = spark.createDataFrame([(None,), (0.0,), (101.0,), (1.0,)], "price double")
    assert [r.status for r in io.validated_prices(bad).collect()] == ["rejected"] * 3 + ["inserted"]


def test_connected(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    out = {r.node: r.component for r in graph.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_pairs_in_order(spark):
    a, b = spark.createDataFrame([(1, 5), (1, 3), (2, 1)], "k int, x int"), spark.createDataFrame([(1, 30), (1, 10), (1, 20)], "k int, y int")
    assert sorted(map(tuple, windows.pair_in_order(a, b, ["k"], [F.col("x")], [F.col("y")]).collect())) == [(1, 3, 10), (1, 5, 20)]


def test_stream_equals_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(d).repartitionByRange(6, "ts").write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), 2)
    events.run_available(events.daily_counts(stream, "40 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    events.run_available(events.daily_counts(events.read_events(spark, str(tmp_path / "in"), 100), "1 second"), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    want = {(str(r.day), r.event_type): (r.n, r.cents) for r in spark.read.parquet(d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).collect()}
    got = {(str(r.day), r.event_type): (r.n, r.cents) for r in spark.read.schema("day date, event_type string, n long, cents long").parquet(str(tmp_path / "out2")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 5
