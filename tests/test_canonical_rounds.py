"""Rounds of consolidation against a plain loop, and after a stop."""

import numpy as np

from larder.operators import canonical_rounds


def singular(w):
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def plain(rows, least):
    """The same rounds over dictionaries; names here have no marks, and only plurals and nearness merge."""
    stands = {n: n for n, *_ in rows}
    own = {n: (k, cat, v) for n, k, cat, v in rows}
    while True:
        live = sorted(set(stands.values()))
        products = {x: sum(own[n][0] for n in stands if stands[n] == x) for x in live}
        links = []
        for i, a in enumerate(live):
            for b in live[i + 1 :]:
                u, v = (np.array(own[x][2], float) for x in (a, b))
                cos = u @ v / np.sqrt((u @ u) * (v @ v))
                if cos < least - 1e-12 or own[a][1] != own[b][1] or set(a.split()) < set(b.split()) or set(b.split()) < set(a.split()):
                    continue
                if [singular(w) for w in a.split()] == [singular(w) for w in b.split()] or round(cos, 9) >= 0.97 and (products[a] * products[b]) ** 0.5 >= 5:
                    links.append((a, b))
        if not links:
            return stands
        part = {x: x for x in live}
        for _ in live:
            for a, b in links:
                part[a] = part[b] = min(part[a], part[b])
        groups = {}
        for x in {y for link in links for y in link}:
            groups.setdefault(part[x], []).append(x)
        best = {x: min(g, key=lambda y: (-products[y], len(y), y)) for g in groups.values() for x in g}
        stands = {n: best.get(x, x) for n, x in stands.items()}


def test_rounds(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(14):
        base, word = rng.normal(size=8), ["onion", "carrot", "pepper", "lemon", "bean", "plum", "melon"][i % 7]
        for j, name in enumerate([f"{word} type{i}", f"{word}s type{i}", f"{word} sort{i}", f"wild{i} {word} type{i}"]):
            rows.append((name, int(rng.integers(1, 9)), ["food", "drink"][i % 2], (base + 0.12 * rng.normal(size=8)).tolist()))
    df = spark.createDataFrame(rows, "name string, products int, category string, vector array<double>")
    want = plain(rows, 0.88)
    through = canonical_rounds.consolidated(df, str(tmp_path / "a"), recall=0.9999)
    got = {r.name: r.canonical for r in through.collect()}
    assert got == want and len(set(want.values())) < len(rows) - 10
    for _ in range(8):  # stopped after every round
        last = canonical_rounds.consolidated(df, str(tmp_path / "b"), recall=0.9999, stop_after=1)
    assert {r.name: r.canonical for r in last.collect()} == want
    read = lambda p: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{p}/log").drop("round").collect()))
    assert read("a") == read("b")
    assert {tuple(r) for r in canonical_rounds.consolidated(df, str(tmp_path / "a"), recall=0.9999).select("name", "canonical").collect()} == set(want.items())
