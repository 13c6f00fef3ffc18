"""Paths of keys in nested JSON against recursion."""

import json
import random

from larder.operators import json_paths


def plain(value, wanted, path="$"):
    if isinstance(value, list):
        return [p for i, x in enumerate(value) for p in plain(x, wanted, f"{path}[{i}]")]
    if isinstance(value, dict):
        return [p for k, x in value.items() for p in ([f"{path}.{k}"] * (k in wanted) + plain(x, wanted, f"{path}.{k}"))]
    return []


def test_paths(spark):
    rng = random.Random(6)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([None, 1, "budget", True, 2.5, [], {}])
        if kind < 0.6:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["a", "b", "budget", "jar"]): made(depth - 1) for _ in range(rng.randint(0, 3))}

    docs = [made(rng.randint(0, 7)) for _ in range(300)]
    rows = [(i, json.dumps(x)) for i, x in enumerate(docs)] + [(1000, "no json {"), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "id long, doc string").selectExpr("*", "1 as key", "'x' as path", "2 as v", "3 as name")
    got = sorted(map(tuple, json_paths.paths_of_keys(df, "id", "doc", ["budget", "jar"]).collect()))
    assert got == sorted((i, p) for i, x in enumerate(docs) for p in plain(x, ["budget", "jar"])) and max(p.count(".") + p.count("[") for _, p in got) > 4
    assert json_paths.paths_of_keys(df.limit(0), "id", "doc", ["a"]).count() == 0
