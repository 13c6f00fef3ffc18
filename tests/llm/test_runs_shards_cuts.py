"""Periodic runs, histogram sharding and fill-in-middle: brute force, odd inputs, round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import common, fill_in_middle, periodic_runs, queries, sharding

from .test_operators import TEXTS

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, ties, columns with names that operators use inside."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id at all here."), (None, None), (3, "one two."), (3, "one two."), (90, "a " * 40_000), (91, " " * 100_000), (92, "x<P>y"), (93, "ab" * 50_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as shard", "'x' as slot", "3L as id", "4 as part", "5L as h", "6 as hash", "array(1) as runs", "7 as `bytes`", "8 as `__text`", "9 as n", "10 as w")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DIR, "documents")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(w, least):
    """(start, length, period) of the runs, from all periods in turn."""
    seen = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                seen.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in seen.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        least, texts = rng.choice([2, 3, 5, 12, 13]), []
        for _ in range(rng.randint(1, 4)):
            some, w = rng.choice([1, 2, 3, 10]), []
            for _ in range(rng.randint(0, 9)):
                p = rng.randint(1, 9)
                w += [w[-p:][i % min(p, len(w))] for i in range(rng.randint(1, 30))] if w and rng.random() < 0.4 else [f"w{rng.randint(0, some)}" for _ in range(p)]
            texts.append(" ".join(w))
        out = periodic_runs._search(least)(texts)
        for t, runs, rest, n in zip(texts, out["runs"], out["collapsed"], out["n_words"]):
            assert runs == plain_runs(t.split(), least) and rest == collapsed(t.split(), runs) and n == len(t.split())


def test_masked_words_hold_no_run():
    codes = np.array([*range(50), *([7, 8, 9] * 6), *range(60, 90)])
    runs, open_ = periodic_runs.runs_of(codes, 12)
    assert runs.tolist() == [[50, 68, 3]] and open_.sum() == 18


def test_runs_odd(odd):
    out = {r.doc_id: r for r in periodic_runs.find_runs(odd).collect()}
    assert periodic_runs.find_runs(odd).count() == odd.count() and periodic_runs.find_runs(odd.limit(0)).count() == 0
    assert [tuple(r) for r in out[90].runs] == [(0, 40_000, 1)] and out[90].collapsed == "a"
    assert out[91].n_words == 0 and out[0].runs == [] and out[0].collapsed == ""
    assert [tuple(r) for r in out[7].runs] == [(0, 240, 8)]
    assert periodic_runs.find_runs(periodic_runs.with_planted_runs(odd)).count() == odd.count()


def test_op11_by_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, d).collect()}
    texts = {r.doc_id: r.text for r in common.table(spark, d, "documents").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for key, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(key).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 1500:
            continue  # too many pairs for this plain version
        runs = plain_runs(w, 12)
        planted += bool(runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else [None] * 4), sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(collapsed(w, runs)))
        r = got[key]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
    assert planted > 50


def plain_splitters(rows, targets, tolerance, probes):
    """The search for splitters over a sorted list of keys."""
    out = []
    for t in targets:
        prefix, low, high, below = (), 0, sharding.SPAN, 0
        while True:
            k, step = len(prefix), -(-(high - low) // probes)
            cell = [r for r in rows if r[0][:k] == prefix and low <= r[0][k] < high]
            buckets = defaultdict(list)
            for r in cell:
                buckets[(r[0][k] - low) // step].append(r)
            for b in sorted(buckets):
                size = sum(r[1] for r in buckets[b])
                if below + size >= t:
                    break
                below += size
            held = buckets[b]
            a, b = min(r[0][k] for r in held), max(r[0][k] for r in held)
            if min(t - below, below + size - t) <= tolerance or len(held) == 1 or a == b and k == 2:
                out.append((*prefix, a if t - below <= below + size - t else b + 1))
                break
            prefix, low, high = ((*prefix, a), 0, sharding.SPAN) if a == b else (prefix, a, b + 1)
    return out


def shares(out, shards):
    """Checks slots; bytes of each shard, and rows by text and shard."""
    slots, size, groups = defaultdict(list), Counter(), defaultdict(Counter)
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        groups[r.text][r.shard] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return size, groups


def test_shards(spark, docs):
    for shards, range_bytes in ((8, 1 << 24), (3, 10_000), (1, 1 << 24)):
        out = sharding.shard_documents(docs, shards, range_bytes=range_bytes).collect()
        size, groups = shares(out, shards)
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert {r.doc_id: r.text for r in out} == texts and len(out) == len(texts)
        assert all(r["size"] == len((r.text or "").encode()) + 1 for r in out)
        mean, longest = sum(size.values()) / shards, max(r["size"] for r in out)
        assert all(abs(n - mean) <= 2 * max(0.01 * mean, longest) for n in size.values())
        assert sum(len(g) > 1 for g in groups.values()) < shards


def test_shards_of_one_hot_text(spark):
    """A third of all rows holds one text: its group is cut where the shards end, and dealt over many ranges."""
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text again and again', concat('text ', id, repeat(' x', cast(id % 9 as int)))) as text")
    out = sharding.shard_documents(df, 8, range_bytes=4000).collect()
    size, groups = shares(out, 8)
    assert max(size.values()) < 1.03 * min(size.values()) and len(groups["the same text again and again"]) > 2
    assert sum(len(g) > 1 for g in groups.values()) == 1
    again = sharding.shard_documents(df.repartition(7), 8, range_bytes=4000).collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.shard) for r in out}


def test_shards_of_one_repeated_row(spark):
    """Rows that agree in id and text are told apart by their place."""
    df = common.written(spark.range(4000).selectExpr("7L as doc_id", "'the very same' as text"), "repeated")
    size, _ = shares(sharding.shard_documents(df, 8, range_bytes=4000).collect(), 8)
    assert len(size) == 8 and max(size.values()) < 1.03 * min(size.values())


def test_shards_small_groups_stay_whole(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "concat('group ', id div 4) as text")
    _, groups = shares(sharding.shard_documents(df, 8).collect(), 8)
    assert len(groups) == 5000 and all(len(g) == 1 for g in groups.values())


def test_splitters_by_brute_force(spark):
    rng = random.Random(3)
    rows = [((rng.choice([5, 9, rng.getrandbits(62)]), rng.getrandbits(40), i), rng.randint(1, 400)) for i in range(300)]
    df = spark.createDataFrame([(*k, s) for k, s in rows], "__text_key long, __id_key long, __row_key long, size long")
    total = sum(s for _, s in rows)
    targets = [total * i / 5 for i in range(1, 5)]
    got = sharding.splitters(df, targets, 0.01 * total / 5)
    want = plain_splitters(sorted(rows), targets, 0.01 * total / 5, sharding.PROBES)
    assert got == want
    for cut, t in zip(got, targets):
        below = sum(s for k, s in rows if k[: len(cut)] < cut)
        assert abs(below - t) <= 400


def test_shards_exchange_texts_once(spark, docs):
    plan = sharding.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_shards_odd(odd):
    out = sharding.shard_documents(odd)
    assert sorted(out.columns) == sorted(odd.columns) and out.count() == odd.count()
    shares(out.collect(), 8)
    assert sharding.shard_documents(odd.limit(0)).count() == 0 and out.filter("doc_id is null").count() == 2


def test_elias_fano():
    rng = np.random.default_rng(2)
    for m, top in ((1, 0), (1, 500), (2, 1), (300, 299), (300, 40_000), (2000, 2100)):
        numbers = np.sort(rng.choice(top + 1, m, replace=False))
        numbers[-1] = top
        low, high = fill_in_middle.elias_fano(numbers)
        assert fill_in_middle.select(low, high, m, top, np.arange(m)).tolist() == numbers.tolist()
        assert 8 * (len(low) + len(high)) <= m * (3 + np.log2(1 + top / m)) + 24
    for text in ("", "abc", "a1b", "½a中 b\n", "Ab[`{z"):
        ends = [0, *np.cumsum([len(x) for x in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)])]
        assert fill_in_middle.boundaries(text).tolist() == ends


def plain_middle(key, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    spm = h[3] % 100 < 20
    return len(tokens), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd, docs):
    for df in (docs, odd):
        for hot in (1_000, 1):
            out = fill_in_middle.fill_in_middle(df, hot_rows=hot).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
            rows = df.select("doc_id", "text").collect()
            want = Counter((r.doc_id, *plain_middle("" if r.doc_id is None else r.doc_id, r.text or ""), r.text or "") for r in rows)
            assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out) == want
    assert fill_in_middle.fill_in_middle(odd.limit(0)).count() == 0
    tricky = spark.createDataFrame([(i, t) for i, t in enumerate(["<<S", "<P", "a<", "<S<M<P", ">S>"] * 40)], "doc_id long, text string")
    out = fill_in_middle.fill_in_middle(tricky)
    assert out.filter(F.col("form") != "plain").count() > 100
    back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert back.exceptAll(tricky).count() == 0


def test_fill_in_middle_moves_texts_once(docs):
    plan = fill_in_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
