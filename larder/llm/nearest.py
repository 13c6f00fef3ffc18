"""Approximate nearest neighbours by cosine, with stable projections and kd-trees.

Unit vectors are projected on Gaussian (2-stable) directions, made orthogonal. A projected squared distance is then the true one times a
chi-square variable, so a vector whose projection lies further off than the chi-square quantile times the k-th squared
distance so far is closer with a chance of less than one minus the confidence, and the search stops there. A kd-tree
fitted on a bounded sample deals all vectors to cells, and cells of many rows to parts; each part is a kd-tree of its own.
A query first searches the cell it lies in, then all cells that its k-th distance does not rule out by the same test. In a
part, leaves come in order of their projected distance, and what passes the test is verified by its true cosine.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with
a null id or another dimension than the most common one, between which there is no cosine. A row repeated with its vector
counts once. An id with several vectors is several queries and candidates, none of which is its own neighbour. Equal
vectors are searched as one, with their k+1 smallest ids, which is all of them that an answer can hold. With fewer than k
candidates a query gets them all. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

#: Fixed parameters of the query.
K = 5
EVERY = 50
DIRECTIONS = 32
#: The search stops when a closer vector is less likely than one minus CONFIDENCE; one closer by less than the factor
#: APPROXIMATION need not be found. Directions are made orthogonal, so projections vary less than the test allows for.
CONFIDENCE = 0.82
APPROXIMATION = 1.0
#: Rows of a part of a cell and of a leaf, on average; bound of the sample that cells are fitted on; queries that one task
#: takes; leaves opened and vectors verified at a time.
CELL_ROWS = 8_192
LEAF_ROWS = 64
LEAVES, VERIFY = 8, 64
SAMPLE = 20_000
TASK_QUERIES = 4_096
SEED = 17


def chi2_cdf(x: float, m: int) -> float:
    """Of the chi-square distribution with an even number m of degrees of freedom."""
    if x == math.inf:
        return 1.0
    h, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= h / i
        total += term
    return 1.0 - math.exp(-h) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


class KdTree:
    """Boxes of points, split at the median of the widest side."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.leaves: list[np.ndarray] = []
        self.nodes: list[tuple] = []  # (low, high, left, right, leaf), low and high of the points inside
        self.cuts: list[tuple] = []  # (side, at) of each inner node
        self._split(points, np.arange(len(points)), leaf_rows)

    def _split(self, points, rows, leaf_rows) -> int:
        own = points[rows]
        low, high = own.min(0), own.max(0)
        me = len(self.nodes)
        self.nodes.append(None)
        self.cuts.append(None)
        side = int((high - low).argmax())
        if len(rows) <= leaf_rows or high[side] <= low[side]:
            self.nodes[me] = (low, high, -1, -1, len(self.leaves))
            self.leaves.append(rows)
            return me
        at = np.median(own[:, side])
        left = own[:, side] < at
        if not left.any():
            left = own[:, side] <= at
        a = self._split(points, rows[left], leaf_rows)
        b = self._split(points, rows[~left], leaf_rows)
        self.nodes[me] = (low, high, a, b, -1)
        self.cuts[me] = (side, own[~left, side].min())
        return me

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the points of each leaf."""
        leaves = sorted((n for n in self.nodes if n[4] >= 0), key=lambda n: n[4])
        return np.array([n[0] for n in leaves]), np.array([n[1] for n in leaves])

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into, by the splits; every point falls into one."""
        out = np.empty(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            i, rows = todo.pop()
            _, _, a, b, leaf = self.nodes[i]
            if leaf >= 0:
                out[rows] = leaf
                continue
            side, at = self.cuts[i]
            left = points[rows, side] < at
            todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def regions(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the space that each leaf owns by the splits, open-ended at the outside."""
        m = len(self.nodes[0][0])
        low, high = np.empty((len(self.leaves), m)), np.empty((len(self.leaves), m))
        todo = [(0, np.full(m, -np.inf), np.full(m, np.inf))]
        while todo:
            i, lo, hi = todo.pop()
            _, _, a, b, leaf = self.nodes[i]
            if leaf >= 0:
                low[leaf], high[leaf] = lo, hi
                continue
            side, at = self.cuts[i]
            lo2, hi2 = lo.copy(), hi.copy()
            hi2[side], lo2[side] = at, at
            todo += [(a, lo, hi2), (b, lo2, hi)]
        return low, high


def _units(blobs, kind: str) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1).astype(np.float64) if len(blobs) else np.empty((0, 1))
    return v, np.sqrt((v * v).sum(1))


FOUND = "query_id long, vec_id long, score double, verified long"


def search_cell(base: pd.DataFrame, queries: pd.DataFrame, kind: str, directions: np.ndarray, k: int, stop: float, leaf_rows: int) -> pd.DataFrame:
    """The k nearest found in one part of a cell for each query, and one row without a neighbour that says how many vectors
    were verified; `bound` is a query's k-th squared distance so far (or infinite)."""
    v, norm = _units(list(base["vec"]), kind)
    q, q_norm = _units(list(queries["vec"]), kind)
    points = (v / norm[:, None]) @ directions
    tree = KdTree(points, leaf_rows)
    low, high = tree.boxes()
    ids = [np.asarray(x) for x in base["ids"]]
    out = []
    for own, bound, x, x_norm in zip(queries["query_id"], queries["bound"], q, q_norm):
        best: list[tuple[float, int]] = []
        limit, verified = float(bound), 0
        at = (x / x_norm) @ directions
        gap = np.maximum(0, np.maximum(low - at, at - high))
        gap = (gap * gap).sum(1)
        order = np.argsort(gap, kind="stable")
        for a in range(0, len(order), LEAVES):
            leaves = order[a : a + LEAVES]
            leaves = leaves[gap[leaves] <= stop * limit]
            if not len(leaves):
                break
            rows = np.concatenate([tree.leaves[i] for i in leaves])
            far = points[rows] - at
            far = (far * far).sum(1)
            to = np.flatnonzero(far <= stop * limit)
            to = to[np.argsort(far[to], kind="stable")]
            while len(to):
                now, to = to[:VERIFY], to[VERIFY:]
                cosine = (v[rows[now]] * x).sum(1) / (norm[rows[now]] * x_norm)
                verified += len(now)
                close = np.flatnonzero(2 - 2 * cosine <= limit + 1e-9)
                if len(close):
                    best = sorted([*best, *((-cosine[c], int(i)) for c in close.tolist() for i in ids[rows[now[c]]] if i != own)])[:k]
                    if len(best) == k and (d := max(0.0, 2 + 2 * best[-1][0])) < limit:
                        limit = d
                        to = to[: np.searchsorted(far[to], stop * limit, "right")]
        out += [(own, i, -s, 0) for s, i in best]
        out.append((own, None, None, verified))
    got = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"])
    return got.astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "int64"})


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, directions: int = DIRECTIONS, confidence: float = CONFIDENCE, approximation: float = APPROXIMATION, cell_rows: int = CELL_ROWS, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score and verified (vectors whose cosine was computed for the query) for each valid row of
    `queries` (same columns), against all rows of `vectors`."""
    spark = vectors.sparkSession
    double = isinstance(vectors.schema[vec_col].dataType.elementType, T.DoubleType)
    element, kind = ("double", "<f8") if double else ("float", "<f4")

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast(f"array<{element}>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))

    base = valid(vectors)
    first = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    if first is None:
        return empty
    dim, n = first["d"], first["count"]
    base = base.filter(F.size("v") == dim)
    # Equal vectors as one: Spark keeps the k + 1 smallest ids before it shuffles.
    base = base.dropDuplicates(["id", "v"]).withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    base = base.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    matrix = np.random.default_rng(seed).standard_normal((dim, directions))
    if directions <= dim:
        matrix = np.linalg.qr(matrix)[0] * math.sqrt(dim)

    def pack(frame: DataFrame, keep: str, extra: str) -> DataFrame:
        """Arrays as bytes; a projection is computed where it is needed."""

        def run(batches):
            for b in batches:
                flat = b.column(1)
                size = np.dtype(kind).itemsize * dim
                values = flat.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
                vec = pa.array([values[i * size : (i + 1) * size] for i in range(b.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), vec], names=[keep, "vec"])

        return frame.select(keep, "v").mapInArrow(run, f"{extra}, vec binary")

    base = written(pack(base, "ids", "ids array<long>"), "nearest-base")
    asked = valid(queries).filter(F.size("v") == dim).dropDuplicates(["id", "v"]).withColumnRenamed("id", "query_id")
    asked = written(pack(asked, "query_id", "query_id long"), "nearest-queries")

    sample = [r["vec"] for r in base.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()]
    v, norm = _units(sample, kind)
    n_cells = max(1, round(n / cell_rows))
    top = KdTree((v / norm[:, None]) @ matrix, max(1, -(-len(sample) // n_cells)))
    low, high = top.regions()
    stop = chi2_quantile(confidence, directions) / approximation**2

    def place(batches):
        for b in batches:
            v, norm = _units(b.column("vec").to_pylist(), kind)
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top.cells((v / norm[:, None]) @ matrix))], names=[*b.schema.names, "cell"])

    base = written(base.mapInArrow(place, "ids array<long>, vec binary, cell long"), "nearest-cells")
    parts = written(base.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell_rows)).cast("int").alias("parts")), "nearest-parts")
    home = asked.mapInArrow(place, "query_id long, vec binary, cell long").withColumn("bound", F.lit(float("inf")))

    def searched(asks: DataFrame) -> DataFrame:
        """A cell's rows are dealt to parts, its queries to shares; a task searches one part for one share."""
        asks = written(asks, "nearest-asks")
        shares = asks.groupBy("cell").agg(F.ceil(F.count("*") / TASK_QUERIES).cast("int").alias("shares")).join(parts, "cell")
        both = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asks = asks.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int")).withColumn("part", both("parts")).drop("shares", "parts")
        rows = base.join(shares, "cell").withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int")).withColumn("share", both("shares")).drop("shares", "parts")

        def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "verified": []}).astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "int64"})
            return search_cell(left, right, kind, matrix, k, stop, leaf_rows)

        return rows.groupBy("cell", "part", "share").cogroup(asks.groupBy("cell", "part", "share")).applyInPandas(fn, FOUND)

    def best(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.filter("vec_id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.drop("verified")

    found = written(searched(home), "nearest-home")
    far = best(found).groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("s"))
    bound = F.when(F.col("n") == k, F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))).otherwise(F.lit(float("inf")))
    asks = home.drop("bound").join(far.select("query_id", bound.alias("bound")), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def route(batches):
        for b in batches:
            v, norm = _units(b.column("vec").to_pylist(), kind)
            if not b.num_rows:
                continue
            q = (v / norm[:, None]) @ matrix
            own, limit = b.column("cell").to_numpy(), b.column("bound").to_numpy()
            at, cell = [], []
            for i in range(len(q)):
                gap = np.maximum(0, np.maximum(low - q[i], q[i] - high))
                to = np.flatnonzero((gap * gap).sum(1) <= stop * limit[i])
                to = to[to != own[i]]
                at.append(np.full(len(to), i))
                cell.append(to)
            at = np.concatenate(at)
            out = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([out.column("query_id"), out.column("vec"), pa.array(np.concatenate(cell)), out.column("bound")], names=["query_id", "vec", "cell", "bound"])

    asks = asks.select("query_id", "vec", "cell", "bound").mapInArrow(route, "query_id long, vec binary, cell long, bound double")
    found = written(found.unionByName(searched(asks)), "nearest-found")
    verified = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return best(found).join(verified, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
