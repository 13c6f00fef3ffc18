"""Language identification, word by word, with a linear-chain conditional random field.

Each word has affix, character n-gram and lexicon features; transitions between the labels of neighbouring words are
learned, so that a language holds on through a word that fits several and switches where the text does. Exact
forward-backward gives each word's label distribution; a document's language is the label of most probable words.

The forward-backward runs over all blocks of BLOCK words of many texts at once: each block's product of transition and
emission matrices first, then the messages across blocks, then those inside, which is exact and takes few array steps.

Defined results: a text that is null or has no letter is `und` with score 0; a word is a run of letters and marks with a
letter. Documents without a language or a word (or an empty table) teach nothing; without any, all texts are `und`. Of equal languages the smaller name wins. Repeated rows
are judged one by one; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Codes, filter_texts, fold, map_texts, rounds, table

#: Bounds of the sample that the model is fitted on: documents in all, shared evenly by the languages, of which each has
#: LEAST however many there are; words of each document (a stretch at a hash-chosen place).
SAMPLE = 3_000
LEAST = 20
STRETCH = 30
#: A word counts for a language from this probability on; of a document's words that share must.
SURE, LEAST_SURE = 0.7, 0.5
#: Words of a language's lexicon feature: those seen so often in its part of the sample.
LEXICON = 3
BUCKETS = 1 << 15
EPOCHS = 6
BLOCK = 64
UND = "und"

_ASCII = re.compile(r"[a-z]+")
_LETTERS = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
#: Words whose features a task keeps.
CACHE = 400_000


def words_of(text: str | None) -> list[str]:
    """The lower-cased words, for fit and prediction alike."""
    if not text:
        return []
    low = text.lower()
    return _ASCII.findall(low) if low.isascii() else _LETTERS.findall(low)


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Feature numbers of a lower-cased word: lexicon, the word, its beginnings and ends, all its trigrams."""
    names = [f"l{lexicon[word]}"] if word in lexicon else []
    names += [f"w{word}", f"p1{word[:1]}", f"p2{word[:2]}", f"p3{word[:3]}", f"s1{word[-1:]}", f"s2{word[-2:]}", f"s3{word[-3:]}"]
    names += [f"g{word[i : i + 3]}" for i in range(len(word) - 2)] or [f"g{word}"]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


class Crf:
    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon, n = labels, lexicon, len(labels)
        self.w = np.zeros((BUCKETS, n))
        self.trans, self.start = np.zeros((n, n)), np.zeros(n)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' features end to end, and how many each has (one at least)."""
        rows = [features(w, self.lexicon) for w in words]
        return np.array([f for r in rows for f in r], dtype=np.int64), np.array([len(r) for r in rows], dtype=np.int64)

    def emissions(self, f: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.w[f], np.cumsum(n) - n, axis=0) if len(n) else np.empty((0, len(self.labels)))

    # -- learning -------------------------------------------------------------------------------------------------

    def fit(self, sequences: list[tuple[list[str], list[int]]], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.2, seed: int = 7) -> None:
        """AdaGrad on the negative log-likelihood of sequences of equal length."""
        rng, n = np.random.default_rng(seed), len(self.labels)
        codes = Codes()
        x = np.array([[codes[w] for w in ws] for ws, _ in sequences])
        y = np.array([ys for _, ys in sequences])
        f, width = self.features(codes.words)
        begin = np.cumsum(width) - width
        gw, gt, gs = np.full_like(self.w, 1e-6), np.full_like(self.trans, 1e-6), np.full_like(self.start, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a : a + batch]
                used, place = np.unique(x[at].ravel(), return_inverse=True)
                k = width[used]
                fx = f[np.repeat(begin[used] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
                e = self.emissions(fx, k)[place].reshape(len(at), -1, n)
                post, pair = self._posteriors(e)
                truth = np.eye(n)[y[at]]
                d = (post - truth).reshape(-1, n) / len(at)
                g = np.stack([np.bincount(fx, np.repeat(np.bincount(place, d[:, j], len(used)), k), BUCKETS) for j in range(n)], 1)
                counts = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:])
                t, s = (pair - counts) / len(at) + 1e-4 * self.trans, (post[:, 0] - truth[:, 0]).sum(0) / len(at)
                for p, grad, acc in ((self.w, g, gw), (self.trans, t, gt), (self.start, s, gs)):
                    acc += grad * grad
                    p -= rate * grad / np.sqrt(acc)

    def _posteriors(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label distributions of each word and expected transition counts, of sequences of equal length."""
        b, steps, n = e.shape
        p, m = np.exp(e - e.max(2, keepdims=True)), np.exp(self.trans)
        alpha, beta = np.empty_like(p), np.ones_like(p)
        alpha[:, 0] = p[:, 0] * np.exp(self.start)
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, steps):
            alpha[:, t] = (alpha[:, t - 1] @ m) * p[:, t]
            alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
        pair = np.zeros((n, n))
        for t in range(steps - 1, 0, -1):
            back = p[:, t] * beta[:, t]
            joint = alpha[:, t - 1, :, None] * m[None] * back[:, None, :]
            pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            beta[:, t - 1] = back @ m.T
            beta[:, t - 1] /= beta[:, t - 1].sum(1, keepdims=True)
        post = alpha * beta
        return post / post.sum(2, keepdims=True), pair

    # -- inference ------------------------------------------------------------------------------------------------

    def posteriors(self, e: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Label distributions of the words of many texts laid end to end; e are their emissions, lengths are over 0."""
        n, m = len(self.labels), np.exp(self.trans - self.trans.max())
        blocks = -(-lengths // block)
        first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        n_blocks = int(blocks.sum())
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(e)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row, col = first[doc] + place // block, place % block
        p = np.ones((block, n_blocks, n))
        p[col, row] = np.exp(e - e.max(1, keepdims=True))
        real = np.zeros((block, n_blocks), dtype=bool)
        real[col, row] = True
        # Entering a word multiplies by m; a text's first word is entered from its start distribution instead.
        head = np.zeros(n_blocks, dtype=bool)
        head[first] = True
        eye = np.broadcast_to(np.eye(n), (n_blocks, n, n))
        prod = np.array(eye)
        for t in range(block):
            nxt = (prod.reshape(-1, n) @ m).reshape(n_blocks, n, n)
            if t == 0:
                nxt[head] = np.eye(n)
            nxt *= p[t][:, None, :]
            nxt /= nxt.sum((1, 2), keepdims=True)
            prod = np.where(real[t][:, None, None], nxt, prod)
        enter, leave = np.empty((n_blocks, n)), np.ones((n_blocks, n))
        state, live = np.tile(np.exp(self.start - self.start.max()), (len(lengths), 1)), np.arange(len(lengths))
        for k in range(int(blocks.max())):
            live = live[blocks[live] > k]
            at = first[live] + k
            enter[at] = state[live]
            s = np.einsum("bi,bij->bj", state[live], prod[at])
            state[live] = s / s.sum(1, keepdims=True)
        state = np.ones((len(lengths), n))
        for k in range(int(blocks.max()) - 1, -1, -1):
            live = np.flatnonzero(blocks > k)
            at = first[live] + k
            leave[at] = state[live]
            s = np.einsum("bij,bj->bi", prod[at], state[live])
            state[live] = s / s.sum(1, keepdims=True)
        alpha, beta = np.empty((block, n_blocks, n)), np.empty((block, n_blocks, n))
        s = enter
        for t in range(block):
            nxt = s @ m
            if t == 0:
                nxt[head] = s[head]
            nxt = nxt * p[t]
            nxt /= nxt.sum(1, keepdims=True)
            s = np.where(real[t][:, None], nxt, s)
            alpha[t] = s
        s = leave
        for t in range(block - 1, -1, -1):
            beta[t] = s
            nxt = (p[t] * s) @ m.T
            nxt /= nxt.sum(1, keepdims=True)
            s = np.where(real[t][:, None], nxt, s)
        post = alpha[col, row] * beta[col, row]
        return post / post.sum(1, keepdims=True)


class Tagger:
    """A model with a bounded memory of words' emissions, for one task."""

    def __init__(self, crf: Crf):
        self.crf, self.codes, self.e = crf, Codes(), np.empty((0, len(crf.labels)))

    def _emissions(self, words: list[str]) -> np.ndarray:
        if len(self.codes) > CACHE:
            self.codes, self.e = Codes(), self.e[:0]
        codes = self.codes
        at = [codes[w] for w in words]
        if len(codes.words) > len(self.e):
            new = codes.words[len(self.e) :]
            parts = [self.crf.emissions(*self.crf.features(new[i:j])) for i, j in rounds(new, 50_000)]
            self.e = np.concatenate([self.e, *parts])
        return self.e[at]

    def words(self, texts: list) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Each text's words, its number of words, and the words' label distributions end to end."""
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        flat = [w for ws in words for w in ws]
        if not flat or not self.crf.labels:
            return words, lengths, np.empty((0, len(self.crf.labels)))
        return words, lengths, self.crf.posteriors(self._emissions(flat), lengths[lengths > 0])

    def documents(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share of the words' probability, and each label's share."""
        _, lengths, post = self.words(texts)
        n = len(self.crf.labels)
        share = np.zeros((len(texts), n))
        if len(post):
            owner = np.repeat(np.arange(len(texts)), lengths)
            for j in range(n):
                share[:, j] = np.bincount(owner, post[:, j], len(texts)) / np.maximum(lengths, 1)
        if not n:
            return [UND] * len(texts), np.zeros(len(texts)), share
        best = share.argmax(1)
        score = np.where(lengths > 0, share[np.arange(len(texts)), best], 0.0)
        return [self.crf.labels[b] if k else UND for b, k in zip(best, lengths)], np.clip(score, 0, 1), share


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, stretch: int = STRETCH) -> Crf:
    """From documents with a language and a word whose crc32(id as text) mod 4 is not 2: stretches of `stretch` words of at
    most `sample` of them, by hash of the id, in equal shares of the languages, of which each has at least LEAST. Every
    second sequence joins two documents' stretches, so that transitions between languages are learned, too."""
    named = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text"))
    named = named.filter(F.col("__lang").isNotNull() & F.col("__text").rlike(r"\p{L}") & (fold("__id", 4) != 2))
    counts = sorted((r["__lang"], r["count"]) for r in named.groupBy("__lang").count().collect())
    labels = [k for k, _ in counts]
    number = {k: i for i, k in enumerate(labels)}
    share = max(LEAST, sample // max(len(labels), 1))
    # The smallest hashes are looked for among four times as many as wanted, so few rows of a large language meet in a task.
    bounds = docs.sparkSession.createDataFrame([(k, min(1.0, 4.0 * share / n)) for k, n in counts], "__lang string, __most double")
    u = F.shiftrightunsigned(F.xxhash64("__id"), 11) / float(1 << 53)
    near = named.select("__lang", "__id", u.alias("__u")).join(F.broadcast(bounds), "__lang").filter(F.col("__u") <= F.col("__most"))
    hashed = W.partitionBy("__lang").orderBy("__u", "__id")
    ids = F.broadcast(near.withColumn("__n", F.row_number().over(hashed)).filter(F.col("__n") <= share).select("__lang", "__id").distinct())

    def stretches_of(texts: list) -> dict:
        out = []
        for t in texts:
            ws = words_of(t)
            at = zlib.crc32(t.encode()) % max(1, len(ws) - stretch + 1)
            out.append(ws[at : at + stretch])
        return {"words": out}

    rows = map_texts(named.join(ids, ["__lang", "__id"]), ["__id", "__lang"], "__text", lambda: stretches_of, [T.StructField("words", T.ArrayType(T.StringType()))])
    rows = sorted((r["__id"], r["__lang"], tuple(r["words"])) for r in rows.collect() if r["words"])
    seen: dict[str, Counter] = {}
    for _, lang, ws in rows:
        for w in ws:
            seen.setdefault(w, Counter())[number[lang]] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items() if c.total() >= LEXICON and c.most_common(1)[0][1] >= 0.9 * c.total()}
    crf = Crf(labels, lexicon)
    if len(labels):
        rng = np.random.default_rng(11)
        stretches = [(ws, number[lang]) for _, lang, ws in rows]
        sequences, half = [], stretch // 2
        for i, (ws, y) in enumerate(stretches):
            if i % 2:
                other, z = stretches[int(rng.integers(len(stretches)))]
                ws, ys = ws[:half] + other[: stretch - half], [y] * min(half, len(ws)) + [z] * min(stretch - half, len(other))
            else:
                ys = [y] * len(ws)
            while len(ws) < stretch:  # a short text is repeated up to the common length
                ws, ys = ws + ws, ys + ys
            sequences.append((list(ws[:stretch]), ys[:stretch]))
        if sequences:
            crf.fit(sequences)
    return crf


def identify(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """id, lang_pred, score and (spans) `spans`: runs of words of one language, as label, first word, words. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    span_t = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType())]))
    fields += [T.StructField("spans", span_t)] * spans

    def make():
        tagger = Tagger(sent.value)

        def fn(texts):
            lang, score, _ = tagger.documents(texts)
            out = {"lang_pred": lang, "score": score}
            if spans:
                _, lengths, post = tagger.words(texts)
                best, at, rows = post.argmax(1) if len(post) else np.empty(0, int), 0, []
                for k in lengths:
                    own = best[at : at + k]
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)] if len(own) else [0]
                    rows.append([{"label": tagger.crf.labels[own[a]], "first_word": int(a), "words": int(b - a)} for a, b in zip(cuts, cuts[1:])])
                    at += k
                out["spans"] = rows
            return out

        return fn

    return map_texts(docs, [id_col], text_col, make, fields)


def keep_languages(docs: DataFrame, crf: Crf, languages: list[str] | None = None, sure: float = SURE, least: float = LEAST_SURE, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are written in the wanted languages (None: all learned ones), however many of
    them a text mixes: the share of words whose likeliest label is wanted, with a probability of `sure` at least, is `least`
    or more, or within three standard errors of it. A text of other languages or of none leaves the model unsure, word by
    word; a few words alone reject nothing. A text without a letter goes, and no other where no language was learned."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def make():
        tagger = Tagger(sent.value)
        wanted = np.array([languages is None or x in languages for x in tagger.crf.labels], dtype=bool)

        def fn(texts):
            _, lengths, post = tagger.words(texts)
            if not len(post):
                return np.asarray(lengths > 0)
            good = wanted[post.argmax(1)] & (post.max(1) >= sure)
            n = np.maximum(lengths, 1)
            share = np.bincount(np.repeat(np.arange(len(texts)), lengths), good, len(texts)) / n
            return (lengths > 0) & (share + 1.5 / np.sqrt(n) >= least)

        return fn

    return filter_texts(docs, text_col, make)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs), spans=False)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
