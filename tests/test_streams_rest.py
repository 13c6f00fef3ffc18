"""Streaks as a fold and as a stream, the latest rows of a stream, and a paged service."""

import datetime as dt
import json
import random
import threading
import time
from collections import Counter, defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from larder.functions.streak_rules import Streak
from larder.sources import rest
from larder.streaming import events, latest, streaks

DIR = "/root/testdata/sf0.001"


def day(n):
    return dt.date(2026, 1, 5) + dt.timedelta(days=n)  # a Monday


def test_streak_rules():
    s = Streak()
    got = [s.take("count", day(n)) for n in range(7)]
    assert [m for _, m in got] == [None] * 6 + [7] and (s.current, s.tokens, s.reached) == (7, 1, (7,))
    assert s.take("count", day(6)) == ("already_counted", None) and s.take("grace", day(6)) == ("day_already_counted", None)
    assert s.take("grace", day(7)) == ("grace_applied", None) and s.take("grace", day(9)) == ("grace_already_used", None) and s.take("grace", day(14)) == ("grace_applied", None)
    assert s.take("freeze", day(8)) == ("freeze_used", None) and s.take("freeze", day(8)) == ("no_tokens", None)
    assert s.take("count", day(8)) == ("counted", None) and (s.current, s.longest, s.days[day(8)]) == (1, 7, "counted")
    assert [s.take("count", day(n))[1] for n in range(9, 31)].count(7) == 0 and s.reached == (7, 21)
    with pytest.raises(ValueError):
        s.take("other", day(0))


def plain_streaks(rows):
    """The same rules over separate tables, as a loop."""
    out, current, longest, tokens, last, grace = {}, Counter(), Counter(), Counter(), {}, {}
    status, reached = {}, defaultdict(set)
    for user, ts, key, action in sorted(rows, key=lambda r: (r[1], r[2])):
        d, milestone = ts.date(), None
        if action == "count":
            if status.get((user, d)) == "counted":
                outcome = "already_counted"
            else:
                n = (current[user] if user in last and (d - last[user]).days <= 1 else 0) + 1
                tokens[user] += max(0, n // 7 - current[user] // 7)
                current[user], longest[user], last[user], status[user, d], outcome = n, max(n, longest[user]), d, "counted", "counted"
                if n in (7, 21, 45, 90) and n not in reached[user]:
                    reached[user].add(n)
                    milestone = n
        elif action == "grace":
            week = d.isocalendar()[:2]
            outcome = "grace_already_used" if grace.get(user) == week else "day_already_counted" if status.get((user, d)) == "counted" else "grace_applied"
            if outcome == "grace_applied":
                grace[user], status[user, d] = week, "grace"
        else:
            outcome = "freeze_used" if tokens[user] > 0 else "no_tokens"
            if outcome == "freeze_used":
                tokens[user] -= 1
                status[user, d] = "frozen"
        out[key] = (user, d, action, outcome, current[user], longest[user], tokens[user], milestone)
    return out


def test_fold_equals_loop(spark):
    a = streaks.as_actions(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    rows = [tuple(r) for r in a.select("user_id", "ts", "event_id", "action").collect()]
    got = {r.event_id: (r.user_id, r.day, r.action, r.outcome, r.current, r.longest, r.tokens, r.milestone) for r in streaks.folded(a).collect()}
    want = plain_streaks(rows)
    assert got == want and {x[3] for x in want.values()} >= {"counted", "already_counted", "grace_applied", "freeze_used", "no_tokens"} and any(x[7] for x in want.values())
    assert streaks.folded(a.limit(0)).count() == 0 and streaks.folded(a.limit(3).withColumn("user_id", F.lit(None).cast("long"))).count() == 0


def test_stream_equals_fold(spark, tmp_path):
    src = spark.read.parquet(f"{DIR}/events.parquet")
    for a, b in (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):  # one file after the other
        src.filter(f"ts >= '{a}' and ts < '{b}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # the stream orders files by their time in seconds
    stream = streaks.kept(streaks.as_actions(events.read_events(spark, str(tmp_path / "in"), 1)), "40 days")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.outcome != "lapsed"}
    want = {r.event_id: tuple(r) for r in streaks.folded(streaks.as_actions(src)).collect()}
    assert got == want


def test_lapsed_timer(spark, tmp_path):
    rows = [(1, "2026-01-05 10:00:00", 1, "count"), (1, "2026-01-06 10:00:00", 2, "count"), (2, "2026-01-20 10:00:00", 3, "count"), (2, "2026-01-21 10:00:00", 4, "count")]
    df = spark.createDataFrame(rows, "user_id long, t string, event_id long, action string").select("user_id", F.to_timestamp("t").alias("ts"), "event_id", "action")
    for i in range(2):
        df.filter(f"(event_id - 1) div 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaks.kept(s, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.user_id, r.day, r.current, r.longest) for r in out if r.outcome == "lapsed"] == [(1, dt.date(2026, 1, 6), 0, 2)]
    assert sorted((r.event_id, r.current) for r in out if r.event_id) == [(1, 1), (2, 2), (3, 1), (4, 2)]


def test_latest_prices(spark, tmp_path):
    li = spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    li.repartition(7, "l_orderkey").write.parquet(str(tmp_path / "in"))
    keys, order = ["l_suppkey", "l_partkey"], [F.col(x).desc() for x in ("l_shipdate", "l_orderkey", "l_linenumber")]
    path = str(tmp_path / "t")
    s = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    latest.keep_latest(s, path, str(tmp_path / "cp"), keys, order, compact=3)
    read = lambda: sorted(map(tuple, latest.read_latest(spark, path, li.schema, keys, order).collect()))
    best = {}
    for r in map(tuple, li.collect()):
        if r[:2] not in best or r[2:5] > best[r[:2]][2:5]:
            best[r[:2]] = r
    want = sorted(best.values())
    assert read() == want and latest._numbers(spark, f"{path}/base", "upto") == [2, 5]
    for n in (0, 4, 6):  # batches run again: with the rows they had, in any order
        again = spark.createDataFrame(spark.read.schema(li.schema).parquet(f"{path}/changes/batch={n}").collect()[::-1], li.schema)
        latest.store_batch(again, n, path, keys, order, compact=3)
        assert read() == want
    (tmp_path / "t" / "base" / "upto=6").mkdir()  # a base that was cut short
    assert read() == want
    assert latest.read_latest(spark, str(tmp_path / "none"), li.schema, keys, order).count() == 0


@pytest.fixture
def service():
    """A service of 95 items that fails now and then."""
    items = [{"id": i, "price": i / 4, "name": None if i % 10 == 0 else f"n{i}", "day": f"2026-01-{i % 28 + 1:02}", "place": {"city": f"c{i % 3}"}, "tags": ["a"] * (i % 3)} for i in range(95)]
    asked = []
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            with lock:
                asked.append(q)
                first = sum(x["page"] == q["page"] for x in asked) == 1
            if first and int(q["page"]) % 3 == 2:
                self.send_error(503)
                return
            found = [x for x in items if x["price"] >= float(q.get("price__gte", 0)) and x["id"] == int(q.get("id", x["id"]))]
            n, size = int(q["page"]), int(q["size"])
            body = json.dumps({"items": found[(n - 1) * size : n * size], "pages": -(-len(found) // size)} if "broken" not in q else {"oops": 1}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/items", items, asked
    server.shutdown()


def test_paged_rest(spark, service):
    url, items, asked = service
    rest.register(spark)
    ddl = "id long, price double, name string, day date, place struct<city: string>, tags array<string>"
    read = lambda **o: spark.read.format("paged_rest").schema(ddl).options(url=url, size="10", pushed="price,id", **o).load()
    df = read(partitions="4")
    assert df.rdd.getNumPartitions() == 4
    got = sorted((r.id, r.price, r.name, str(r.day), r.place.city, len(r.tags)) for r in df.collect())
    assert got == [(x["id"], x["price"], x["name"], x["day"], x["place"]["city"], len(x["tags"])) for x in items]
    asked.clear()
    some = read().filter("price >= 20 and name is not null").collect()
    assert {r.id for r in some} == {x["id"] for x in items if x["price"] >= 20 and x["name"]} and all(float(q["price__gte"]) == 20 for q in asked)
    assert len({q["page"] for q in asked}) == 2
    asked.clear()
    assert [r.id for r in read().filter("id = 7").collect()] == [7] and all(q["id"] == "7" for q in asked)
    assert read().filter("id = 1000").count() == 0
    with pytest.raises(Exception, match="no list items"):
        read(**{"param.broken": "1"}, retries="0").collect()
