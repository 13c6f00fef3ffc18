"""Tables kept as folders: appends that answer, marks of deletion, bulk loads; all of them run twice."""

from pyspark.sql import functions as F

from larder.sources import kept

DDL = "k int, s string, n int"


def table(spark, rows):
    return spark.createDataFrame(rows, DDL)


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    add = lambda rows: sorted((tuple(r) for r in kept.append(spark, path, table(spark, rows), ["k", "s"], [F.col("n")]).collect()), key=str)
    assert add([(1, "a", 5), (1, "a", 3), (None, None, 1), (None, "", 2)]) == sorted([(1, "a", 3, False), (None, None, 1, False), (None, "", 2, False)], key=str)
    for _ in range(2):
        assert add([(1, "a", 9), (2, "b", 4), (None, None, 8)])[-1] == (None, None, 1, True)
    assert sorted((r.n for r in kept.read(spark, path, table(spark, [(1, "", 1)]).schema).collect())) == [1, 2, 3, 4]
    assert add([]) == []


def test_marks(spark, tmp_path):
    path, rows = str(tmp_path / "t"), table(spark, [(1, "a", 1), (2, "b", 1), (3, "c", 1), (None, "d", 1)])
    kept.append(spark, path, rows, ["k"], [F.col("s")])
    seen = lambda: {r.s for r in kept.visible(spark, path, rows.schema, ["k"]).collect()}
    assert seen() == {"a", "b", "c", "d"}
    at = lambda n: F.lit(f"2026-01-0{n} 00:00:00")
    for _ in range(2):
        kept.mark(spark, path, rows.filter("k is null or k < 3"), ["k"], at(1), True)
        kept.mark(spark, path, rows.filter("k = 2"), ["k"], at(2), False)
        assert seen() == {"b", "c"}
    kept.mark(spark, path, rows.filter("k = 2"), ["k"], at(3), True)
    assert seen() == {"c"}


def test_bulk_load(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = table(spark, [(i, "x", i * 7 % 10) for i in range(25)] + [(3, "again", 9)])
    load = lambda: sorted(map(tuple, kept.bulk_load(spark, path, rows, ["k"], [F.col("k"), F.col("s").desc()], F.when(F.col("n") == 0, "zero"), 10).collect()))
    bad = {i for i in range(25) if i * 7 % 10 == 0}
    assert load() == [(i, i // 10, "rejected" if i in bad else "inserted", "zero" if i in bad else None) for i in range(25)]
    assert load() == [(i, i // 10, "rejected" if i in bad else "duplicate", "zero" if i in bad else None) for i in range(25)]
    assert kept.read(spark, path, rows.schema).count() == 25 - len(bad)


def test_bulk_load_writes_once(spark, tmp_path, monkeypatch):
    """Of the rows one copy is written beside the table, each time; null keys are keys, and a fault comes before a duplicate."""
    written, write = [], kept.stored
    monkeypatch.setattr(kept, "stored", lambda df: written.append(1) or write(df))
    path, rows = str(tmp_path / "t"), table(spark, [(None, "x", 1), (1, None, 2), (1, "", 3), (2, "y", 0), (2, "y", 5)])
    load = lambda fault: sorted(map(tuple, kept.bulk_load(spark, path, rows, ["k", "s"], [F.col("k"), F.col("s"), F.col("n")], fault, 2).collect()), key=str)
    zero = F.when(F.col("n") == 0, "zero")
    first = [(None, "x", 0, "inserted", None), (1, None, 0, "inserted", None), (1, "", 1, "inserted", None), (2, "y", 1, "rejected", "zero")]
    assert load(zero) == sorted(first, key=str)
    assert load(F.lit(None).cast("string")) == sorted([(*r[:3], "inserted" if r[4] else "duplicate", None) for r in first], key=str)
    assert {r[3] for r in load(F.lit("all"))} == {"rejected"} and len(written) == 3
