"""Toxicity by nearest labelled examples.

A bounded sample of labelled texts gives the examples, the weights of all their words and word beginnings, and the
calibration. A term weighs its TF-IDF times the root of its chi-square with the labels; norms are over the whole text. A
text's neighbours are the examples of largest cosine of these weights, found exactly with a block-max inverted index:
examples lie in blocks, each term keeps its largest weight per block, and blocks whose summed bound does not beat the k-th
neighbour so far are never opened. Votes are weighted by closeness; a logistic curve fitted on labelled texts that are no
examples turns votes into a probability.

Defined results: a null or empty text, and one without any term of the sample, has no neighbour and gets the
smoothed rate of such texts among the labelled. Neighbours of equal cosine come in order of their place in the index.
Without labelled texts of both kinds every score is the smoothed base rate. Repeated rows are scored one by one; labels
given twice for an id count twice. Other columns are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Codes, filter_texts, fold, map_texts, release, table

#: Bound of the labelled sample: the classifier is fitted on at most so many texts, those of the smallest hash, and on at
#: most SAMPLE_CHARS of their characters: a text that would pass the rest of it is left out, shorter ones still count.
SAMPLE = 6_000
SAMPLE_CHARS = 40_000_000
NEIGHBOURS = 16
BLOCK = 32
#: Terms that are held by block.
FREQUENT = 1_024
#: Texts that are looked up at a time, and those whose entries of rare terms are held at a time.
AT_ONCE, ADDED_AT_ONCE = 128, 8
#: A document is toxic at this score.
THRESHOLD = 0.3
#: Added to each term's chi-square (1 degree of freedom), so that terms without a lean still count; unseen terms have 0.
CHI_FLOOR = 0.01
#: Word beginnings of this many letters are terms, too.
STEM = 5

_LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Counts of words and word beginnings."""
    counts = Counter(_LETTERS.findall((text or "").lower()))
    for w, c in list(counts.items()):
        if len(w) > STEM:
            counts[w[:STEM] + "*"] += c
    return counts


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of the spans of n from first, end to end."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class BlockMaxIndex:
    """Unit vectors in an inverted index whose examples lie in blocks of BLOCK. Many queries are looked up at once.

    Entries of the rare terms are added up first. The FREQUENT most frequent terms are held by block, with their largest
    weight in each: what a block's examples have from rare terms, plus the query's weights times those, bounds their cosines,
    and a block is opened only while that can reach the k-th cosine found."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, frequent: int = FREQUENT):
        self.n, self.block = len(vectors), block
        self.n_blocks = -(-max(self.n, 1) // block)
        rows = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors]) if self.n else np.empty(0, np.int64)
        t = np.concatenate([t for t, _ in vectors]) if self.n else np.empty(0, np.int64)
        w = np.concatenate([w for _, w in vectors]) if self.n else np.empty(0)
        order = np.lexsort((rows, t))
        self.rows, self.weights = rows[order].astype(np.int32), w[order]
        n = np.bincount(t, minlength=n_terms)
        self.of_term = np.concatenate(([0], np.cumsum(n)))
        self.frequent = np.sort(np.argsort(-n, kind="stable")[:frequent])
        self.slot = np.full(n_terms, -1)
        self.slot[self.frequent] = np.arange(len(self.frequent))
        self.held = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None}  # each task makes its own

    def _by_block(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the frequent terms as (block, term, example), and the largest as (term, block)."""
        if self.held is None:
            n = self.of_term[self.frequent + 1] - self.of_term[self.frequent]
            at = _spans(self.of_term[self.frequent], n)
            dense = np.zeros((self.n_blocks, len(self.frequent), self.block))
            dense[self.rows[at] // self.block, np.repeat(np.arange(len(n)), n), self.rows[at] % self.block] = self.weights[at]
            self.held = dense, np.ascontiguousarray(dense.max(2).T)
        return self.held

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each query the numbers and cosines (to 12 digits) of its k examples of largest positive cosine, exactly, with
        ties going to the smaller number; and the share of blocks that each query opened."""
        dense, most = self._by_block()
        n_queries, width = len(queries), self.n_blocks * self.block
        owner = np.repeat(np.arange(n_queries), [len(t) for t, _ in queries])
        t = np.concatenate([t for t, _ in queries]) if queries else np.empty(0, np.int64)
        w = np.concatenate([w for _, w in queries]) if queries else np.empty(0)
        slot = self.slot[t]
        often = slot >= 0
        q = np.zeros((n_queries, len(self.frequent)))
        q[owner[often], slot[often]] = w[often]
        t, w, owner = t[~often], w[~often], owner[~often]
        scores = np.empty((n_queries, self.n_blocks, self.block))
        for first in range(0, n_queries, ADDED_AT_ONCE):
            few = scores[first : first + ADDED_AT_ONCE]
            own = slice(*np.searchsorted(owner, (first, first + len(few))))
            n = self.of_term[t[own] + 1] - self.of_term[t[own]]
            at = _spans(self.of_term[t[own]], n)
            few[:] = np.bincount(np.repeat((owner[own] - first) * width, n) + self.rows[at], self.weights[at] * np.repeat(w[own], n), few.size).reshape(few.shape)
        bound = scores.max(2) + q @ most
        done = bound <= 0
        opened = np.zeros(n_queries)
        limit = np.zeros(n_queries)
        # A few blocks of the largest bounds first; then, against the k-th cosine found, all that may still matter.
        for step in (2 * k // self.block + 1, 8 * k // self.block + 4, None):
            todo = ~done & (bound >= limit[:, None] - 1e-9)
            if step is not None and step < self.n_blocks:
                ranked = np.where(todo, bound, -1.0)
                todo &= ranked >= np.partition(ranked, self.n_blocks - step, axis=1)[:, self.n_blocks - step, None]
            for b in np.flatnonzero(todo.any(0)):
                who = np.flatnonzero(todo[:, b])
                scores[who, b] += q[who] @ dense[b]
            done |= todo
            opened += todo.sum(1)
            if self.n > k:
                limit = np.partition(scores.reshape(n_queries, width), width - k, axis=1)[:, -k]
        scores = scores.reshape(n_queries, width).round(12)
        kth = np.partition(scores, width - k, axis=1)[:, -k] if width > k else np.zeros(n_queries)
        out = []
        for own, least in zip(scores, kth):
            near = np.flatnonzero((own >= least) & (own > 0))
            near = near[np.lexsort((near, -own[near]))][:k]
            out.append((near, own[near]))
        return out, opened / self.n_blocks


class Coded:
    """Texts as numbers of their terms and how often each occurs; the texts themselves aren't kept."""

    def __init__(self, texts=()):
        self.codes, self.rows = Codes(), []
        for t in texts:
            self.add(t)

    def add(self, text: str | None) -> None:
        c = terms(text)
        self.rows.append((np.fromiter((self.codes[x] for x in c), np.int32, len(c)), np.fromiter(c.values(), np.int32, len(c))))


class Model:
    """Fitted on the driver from the bounded sample; small, and sent to the tasks with the function."""

    def __init__(self, texts: list[str] | Coded, toxic: np.ndarray, calibrate: np.ndarray, k: int = NEIGHBOURS):
        coded = texts if isinstance(texts, Coded) else Coded(texts)
        self.k, self.rate = k, (toxic.sum() + 0.1) / (len(toxic) + 1)
        n, p = len(coded.rows), int(toxic.sum())
        if not 0 < p < n:
            coded = Coded([None] * n)
        n_terms, none = len(coded.codes), np.empty(0, np.int32)
        self.vocabulary = dict(coded.codes)
        c = np.bincount(np.concatenate([t for t, _ in coded.rows] or [none]), minlength=n_terms).astype(float)
        a = np.bincount(np.concatenate([t for (t, _), y in zip(coded.rows, toxic) if y] or [none]), minlength=n_terms).astype(float)
        chi = n * (a * (n - p - c + a) - (c - a) * (p - a)) ** 2 / np.maximum(c * (n - c) * p * (n - p), 1)
        self.weights = np.log((n + 1) / np.maximum(c, 1)) * np.sqrt(chi + CHI_FLOOR)
        self.unseen = np.log(n + 1) * np.sqrt(CHI_FLOOR)
        vectors = [self._weighed(t.astype(np.int64), m) for t, m in coded.rows]
        example = [i for i in range(n) if not calibrate[i] and len(vectors[i][0])]
        # Sorted by their heaviest term among the common ones, so that a block's examples have terms in common.
        common = c * 50 >= n
        example.sort(key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1] * common[vectors[i][0]])]), i))
        self.index = BlockMaxIndex([vectors[i] for i in example], n_terms)
        self.labels = toxic[example].astype(float) if example else np.empty(0)
        self.curve = (0.0, 1.0)
        held = [i for i in range(n) if calibrate[i] and len(vectors[i][0])]
        self.none = (sum(bool(toxic[i]) for i in range(n) if not len(vectors[i][0])) + self.rate) / (sum(not len(v[0]) for v in vectors) + 1)
        if held and len(self.labels):
            self.curve = _logistic(np.array([v for v, _, _ in self.votes([vectors[i] for i in held])]), toxic[held].astype(float))
            self.index.held = None

    def _weighed(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, in order, and weights of the terms; a number below 0 is a term that the sample lacks and counts for the norm
        only."""
        tf = 1 + np.log(np.maximum(counts, 1))
        known = np.flatnonzero(t >= 0)
        known = known[np.argsort(t[known])]
        w = tf[known] * self.weights[t[known]]
        unseen = self.unseen * tf[t < 0]
        return t[known], w / np.sqrt(w @ w + unseen @ unseen) if len(known) else w

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        v = self.vocabulary
        return self._weighed(np.fromiter((v.get(x, -1) for x in counts), np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts)))

    def votes(self, vectors: list) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each vector the vote of its neighbours, weighted by 1 / (1 + distance) with the cosine distance and smoothed by
        one vote of the base rate of small weight; the neighbours and their cosines are the evidence."""
        out = []
        for a in range(0, len(vectors), AT_ONCE):
            for near, cosine in self.index.nearest(vectors[a : a + AT_ONCE], self.k)[0]:
                w = cosine / (1.0 + (1.0 - cosine))
                out.append(((w @ self.labels[near] + 0.25 * self.rate) / (w.sum() + 0.25), near, cosine))
        return out

    def scores(self, texts: list) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, neighbours and cosines of each text."""
        nothing = np.empty(0, np.int64), np.empty(0)
        if not len(self.labels):
            return [(self.rate, *nothing)] * len(texts)
        vectors = [self.vector(terms(t)) for t in texts]
        voted = iter(self.votes([v for v in vectors if len(v[0])]))
        out = []
        for v in vectors:
            if not len(v[0]):
                out.append((self.none, *nothing))
                continue
            vote, near, cosine = next(voted)
            out.append((1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * _logit(vote)))), near, cosine))
        return out


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _logistic(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a ridge that keeps separable data finite."""
    x = np.stack([np.ones_like(votes), _logit(votes)], 1)
    b, prior = np.array([0.0, 1.0]), np.diag([0.1, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + prior, x.T @ (y - p) - prior @ (b - [0.0, 1.0]))
        b = b + step
        if abs(step).max() < 1e-9:
            break
    return float(b[0]), max(float(b[1]), 0.05)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """From rows whose crc32(id as text) mod 4 is not 2: a sample of at most `sample` labelled texts, by hash of the id.

    The ids of the sample are chosen from the labels alone, so texts of other documents are never moved.
    """
    lab = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter((fold("__id", 4) != 2) & F.col("__y").isin(0, 1))
    chosen = F.broadcast(lab.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(chosen, "__id").select("__id", "__y", F.coalesce("__text", F.lit("")).alias("__text")).filter(F.length("__text") <= chars)
    coded, y, size = Coded(), [], 0
    for r in rows.orderBy(F.xxhash64("__id"), "__id", "__text").toLocalIterator():
        if size + len(r["__text"]) > chars:
            continue
        size += len(r["__text"])
        coded.add(r["__text"])
        y.append(r["__y"])
    model = Model(coded, np.array(y, dtype=int), np.arange(len(y)) % 4 == 3)
    release()
    return model


def _send(spark: SparkSession, model: Model):
    return spark.sparkContext.broadcast(model)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: bool = True) -> DataFrame:
    """id, score and (evidence) `neighbours`: number, cosine and label of each example that voted. No shuffle."""
    sent = _send(docs.sparkSession, model)
    fields = [T.StructField("score", T.DoubleType())]
    near_t = T.ArrayType(T.StructType([T.StructField("example", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    fields += [T.StructField("neighbours", near_t)] * evidence

    def make():
        m = sent.value

        def fn(texts):
            scored = m.scores(texts)
            out = {"score": np.array([s for s, _, _ in scored])}
            if evidence:
                out["neighbours"] = [[{"example": int(i), "cosine": float(c), "label": int(m.labels[i])} for i, c in zip(near, cos)] for _, near, cos in scored]
            return out

        return fn

    return map_texts(docs, [id_col], text_col, make, fields)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    sent = _send(docs.sparkSession, model)

    def make():
        m = sent.value
        return lambda texts: np.array([s < threshold for s, _, _ in m.scores(texts)], dtype=bool)

    return filter_texts(docs, text_col, make)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, model, evidence=False)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
