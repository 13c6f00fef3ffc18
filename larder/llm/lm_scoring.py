"""Language-model scoring with an interpolated modified Kneser-Ney bigram model.

Spark counts the words and word pairs of all training texts: tasks count their own rows into sorted arrays, the arrays
are dealt over ranges of hashes, and each range is merged and written to the shared folder as a sorted hash array. Workers
memory-map those files and look texts up by binary search; only a few totals pass through the driver. A word is known by
64 bits of hash for its own count, and by 32 bits inside a pair, so a pair is one 64-bit key. Counts have 64 bits.

Defined results: a null text counts as empty and has one token, the end. Rows with a null id are scored and counted as
training text. Without training text all words are unknown and have the same probability. Repeated rows count and are
scored as often as they occur. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hash_arrays as H
from .common import Codes, fold, low_words, map_texts, mix64, release, rounds, scratch, table, written

#: Tokens that a counting task gathers before it deals them out.
FLUSH = 1_000_000
#: Rows of word statistics that a merging task gathers before it deals them out.
STATS = 400_000
TOTAL, WORD, PAIR, STAT = 0, 1, 2, 3
WIDTHS = {TOTAL: 6, WORD: 1, PAIR: 1, STAT: 5}
END, START = b"\n</s>", b"\n<s>"


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _tokens(texts: list, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each text's start, words and end, text after text, and how many each text has."""
    start, end, flat, n = codes[START], codes[END], [], []
    for t in texts:
        words = low_words(t)
        flat.append(start)
        flat.extend([codes[w] for w in words])
        flat.append(end)
        n.append(len(words) + 2)
    return np.array(flat, dtype=np.int64), np.array(n, dtype=np.int64)


def _pairs(tokens: np.ndarray, n: np.ndarray, h32: np.ndarray) -> np.ndarray:
    """Keys of neighbouring tokens inside texts; there is one for each token but the starts."""
    first = np.zeros(len(tokens), dtype=bool)
    first[np.cumsum(n) - n] = True
    at = np.flatnonzero(~first)
    return (h32[tokens[at - 1]] << np.uint64(32)) | h32[tokens[at]]


def _by_word(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of distinct pairs (in the upper half of a key) and their statistics: by first word the pairs' sum and its
    followers seen once, twice, more often; by second word the number of words before it."""
    pairs = H.unmix64(keys)
    left, right = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    order = np.argsort(left, kind="stable")
    left, c = left[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
    one = np.zeros((len(at), 5), np.int64)
    for j, x in enumerate((c, c == 1, c == 2, c > 2)):
        one[:, j] = np.add.reduceat(x.astype(np.int64), at)
    right, n = np.unique(right, return_counts=True)
    two = np.zeros((len(right), 5), np.int64)
    two[:, 4] = n
    return H.summed(np.concatenate([left[at], right]) << np.uint64(32), np.concatenate([one, two]))


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    """Sum, number, and how many are 1, 2, 3 and 4."""
    return np.array([c.sum(), len(c), *(np.count_nonzero(c == i) for i in (1, 2, 3, 4))], dtype=np.int64)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of keys that occur 1 to 4 times."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


class Model:
    """Where the arrays lie and the totals; a few numbers."""

    def __init__(self, folder: str, layout: H.Layout):
        self.folder, self.layout = folder, layout
        self.tokens = self.words = self.types = 0
        self.pair_discounts = self.word_discounts = (0.5, 1.0, 1.5)
        self.left = 1.0  # share of the unigram distribution that goes to the uniform one


class Scorer:
    """Scores texts in one task with a model's arrays."""

    def __init__(self, model: Model):
        self.model, self.arrays = model, H.Reader(model.folder, model.layout)

    def score(self, texts: list) -> dict:
        m, codes = self.model, Codes()
        tokens, n = _tokens(texts, codes)
        h64 = _hashes(codes.words)
        h32 = h64 >> np.uint64(32)
        known = self.arrays.find("word", h64)[:, 0]
        total, n1, n2, n3, cont = self.arrays.find("stat", h32 << np.uint64(32), 5).T
        d1, d2, d3 = m.word_discounts
        unigram = m.left / (m.words + 1)
        p_word = np.maximum(cont - np.select([cont == 1, cont == 2, cont > 2], [d1, d2, d3], 0.0), 0) / max(m.types, 1) + unigram
        d1, d2, d3 = m.pair_discounts
        back = np.where(total > 0, (d1 * n1 + d2 * n2 + d3 * n3) / np.maximum(total, 1), 1.0)
        first = np.zeros(len(tokens), dtype=bool)
        first[np.cumsum(n) - n] = True
        at = np.flatnonzero(~first)
        keys, place = np.unique(mix64(_pairs(tokens, n, h32)), return_inverse=True)
        c = self.arrays.find("pair", keys)[:, 0][place]
        left, word = tokens[at - 1], tokens[at]
        p = np.maximum(c - np.select([c == 1, c == 2, c > 2], [d1, d2, d3], 0.0), 0) / np.maximum(total[left], 1) + back[left] * p_word[word]
        owner = np.repeat(np.arange(len(texts)), n - 1)
        base = np.log10((known[word] + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
        score = np.bincount(owner, np.log10(p), len(texts))
        return {
            "n_tokens": n - 1, "n_known": np.bincount(owner, known[word] > 0, len(texts)).astype(np.int64), "train_tokens": np.full(len(texts), m.tokens),
            "base_score": np.bincount(owner, base, len(texts)), "score": score, "perplexity": 10 ** (-score / (n - 1)),
        }


def train(docs: DataFrame, text_col: str = "text", buckets: int | None = None) -> Model:
    """Counts all texts of docs. What is shuffled are each task's distinct words and pairs, then the files' sums by word."""
    spark = docs.sparkSession
    source = docs.select(F.col(text_col).cast("string").alias("text"))
    layout = H.Layout(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0, buckets)
    folder = scratch(spark, "lm")
    model = Model(folder, layout)

    def count(batches):
        codes, parts, held = Codes(), [], 0

        def flush():
            h64 = _hashes(codes.words)
            tokens, n = np.concatenate([t for t, _ in parts]), np.concatenate([k for _, k in parts])
            c = np.bincount(tokens, minlength=len(codes.words))
            c[codes[START]] = 0
            at = np.flatnonzero(c)
            at = at[np.argsort(h64[at])]
            rows = layout.deal(WORD, h64[at], c[at])
            keys, k = np.unique(mix64(_pairs(tokens, n, h64 >> np.uint64(32))), return_counts=True)
            return H.batch(rows + layout.deal(PAIR, keys, k))

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in rounds(texts):
                parts.append(_tokens(texts[a:b], codes))
                held += len(parts[-1][0])
                if held >= FLUSH:
                    yield flush()
                    codes, parts, held = Codes(), [], 0
        if held:
            yield flush()
        codes, parts = None, None
        release()

    def totals(sums: dict) -> list[tuple]:
        return [(0, TOTAL, kind, b"", n.tobytes()) for kind, n in sums.items()]

    def merge(batches):
        writer, sums, stats, held = H.Writer(folder), {}, [], 0
        for file, kind, _, keys, values in H.buckets(batches, WIDTHS):
            writer.add(f"{'word' if kind == WORD else 'pair'}-{file}", keys, values)
            sums[kind] = sums.get(kind, 0) + _counts_of_counts(values[:, 0])
            if kind == PAIR:
                stats.append(_by_word(keys, values[:, 0]))
                held += len(stats[-1][0])
                if held >= STATS:
                    yield H.batch(layout.deal(STAT, *H.summed(*map(np.concatenate, zip(*stats)))))
                    stats, held = [], 0
        writer.close()
        if held:
            yield H.batch(layout.deal(STAT, *H.summed(*map(np.concatenate, zip(*stats)))))
        yield H.batch(totals(sums))
        release()

    def merge_stats(batches):
        writer, sums = H.Writer(folder), {STAT: np.zeros(6, np.int64)}
        for file, _, _, keys, values in H.buckets(batches, WIDTHS):
            writer.add(f"stat-{file}", keys, values)
            c = values[:, 4]
            sums[STAT] += np.array([c.sum(), np.count_nonzero(c > 2), *(np.count_nonzero(c == i) for i in (1, 2, 3, 4))])
        writer.close()
        yield H.batch(totals(sums))
        release()

    merged = H.dealt(source.mapInArrow(count, H.ROWS), layout).mapInArrow(merge, H.ROWS)
    # Totals come to the driver, one short row for each task; arrays never do.
    merged = merged.withColumn("file", F.when(F.col("kind") == TOTAL, -1).otherwise(F.col("file")))
    merged = written(merged, "lm-merged")
    found = {WORD: np.zeros(6, np.int64), PAIR: np.zeros(6, np.int64), STAT: np.zeros(6, np.int64)}
    for part in (merged.filter(F.col("kind") == TOTAL), H.dealt(merged.filter(F.col("kind") == STAT), layout).mapInArrow(merge_stats, H.ROWS)):
        for r in part.select("bucket", "counts").collect():
            found[r["bucket"]] += np.frombuffer(r["counts"], np.int64)
    word, pair, stat = (found[k].tolist() for k in (WORD, PAIR, STAT))
    model.tokens, model.words, model.types = word[0], word[1], stat[0]
    model.pair_discounts, model.word_discounts = _discounts(pair[2:]), _discounts(stat[2:])
    d1, d2, d3 = model.word_discounts
    model.left = (d1 * stat[2] + d2 * stat[3] + d3 * stat[1]) / stat[0] if stat[0] else 1.0
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity per row; no shuffle."""
    fields = [T.StructField(k, T.LongType()) for k in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(k, T.DoubleType()) for k in ("base_score", "score", "perplexity")]
    return map_texts(docs, [id_col], text_col, lambda: Scorer(model).score, fields)


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    out = score(docs, train(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
