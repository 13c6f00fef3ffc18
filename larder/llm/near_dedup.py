"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles; weights are term frequency times a damped inverse document frequency.
Consistent weighted samples agree with the probability of the weighted Jaccard similarity; bands of samples make buckets.
Texts with the same words are one member each. In every bucket all members are compared with its smallest one; exact
weighted Jaccard similarities of those texts give the links, and links give classes. A bucket whose members then still
belong to several classes gets a second look: blocks of its members are compared with each other by their samples, and
pairs of different classes that agree well enough are verified like the others. What agrees well enough follows from the
similarity: a pair that has it agrees less with a chance of FILTER_MISS for each of the two filters.

Document frequencies are exact: all shingles are counted in Spark, and those of two documents or more are kept in sorted
hash arrays (48 bits of hash) that tasks map; any other shingle has one.

Defined results: a text with fewer than five words is one shingle of all its words. A text without a word (null, empty)
is a class of its own. Rows with a null id take no part. A repeated id is one document, with one of its texts, chosen by
their hashes. Classes are named by their smallest id. Other columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hash_arrays as H
from .common import Codes, checked, low_words, mix64, release, rounds, scratch, table, written

#: Fixed parameters of the query.
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: How much of a weight the inverse document frequency makes: 1 + DAMP * log(N / df) / log(N).
DAMP = 0.25
#: Shingles that a task counts before it deals them out.
FLUSH = 1_500_000
#: Rows of the tables of random numbers.
SLOTS = 1 << 16
SEED = 29
#: Members of a bucket that are compared with each other at a time.
BLOCK = 512
#: Chance that a filter of the second look loses a pair that has just the similarity sought.
FILTER_MISS = 1e-4
#: Buckets of more members are compared by WIDE turns of samples as well, so that few pairs come to be verified.
BIG = 24
WIDE = 16
#: Keys of one text or class that meet in a task are dealt over so many tasks.
SALTS = 32
#: Elements whose samples are computed at a time.
AT_ONCE = 2_048


class Shingles:
    """Distinct shingles of texts with their counts."""

    def __init__(self, size: int):
        self.size = size
        rng = np.random.default_rng(SEED)
        self.odd = rng.integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Owner, hash (52 bits) and count of each distinct shingle, by owner and hash; the texts' word hashes as bytes."""
        codes, flat, n = Codes(), [], []
        for t in texts:
            words = low_words(t)
            flat.extend([codes[w] for w in words])
            n.append(len(words))
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes.words), np.uint64, len(codes.words))[np.array(flat, dtype=np.int64)] if flat else np.empty(0, np.uint64)
        n = np.array(n, dtype=np.int64)
        ends = np.cumsum(n)
        keys = [xxhash.xxh3_128_digest(h[e - k : e].tobytes()) if k else None for e, k in zip(ends, n)]
        owner = np.repeat(np.arange(len(texts)), n)
        k, s = self.size, np.zeros(len(h), dtype=np.uint64)
        left = np.repeat(ends, n) - np.arange(len(h))  # words from here to the text's end
        for j in range(k):
            part = np.zeros(len(h), dtype=np.uint64)
            part[: max(0, len(h) - j)] = h[j:] * self.odd[j]
            s += np.where(left > j, part, np.uint64(0))
        first = np.arange(len(h)) == np.repeat(ends - n, n)
        use = (left >= k) | (first & (np.repeat(n, n) < k))
        key = (owner[use].astype(np.uint64) << np.uint64(52)) | (mix64(s[use]) >> np.uint64(12))
        key, count = np.unique(key, return_counts=True)
        return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), count, keys


def _parts(texts: list) -> Iterator[tuple[int, int]]:
    """Rounds of few enough texts for 12 bits of owner."""
    for a, b in rounds(texts):
        for i in range(a, b, 4096):
            yield i, min(b, i + 4096)


def least_agreement(similarity: float, samples: int, other: float = 0.0, miss: float = FILTER_MISS) -> int:
    """The largest number of agreeing samples that a pair of the similarity falls short of with a chance of `miss` at most;
    samples that differ agree with the chance `other`."""
    p, total = similarity + (1 - similarity) * other, 0.0
    for k in range(samples + 1):
        total += math.exp(math.lgamma(samples + 1) - math.lgamma(k + 1) - math.lgamma(samples - k + 1) + k * math.log(p) + (samples - k) * math.log1p(-p)) if 0 < p < 1 else float(k == samples * (p > 0))
        if total > miss:
            return k
    return samples


class Weights:
    """How to find a shingle's weight: where document frequencies lie, and how many documents there are."""

    def __init__(self, folder: str, layout: H.Layout, n: int, damp: float):
        self.folder, self.layout, self.n, self.damp = folder, layout, max(n, 2), damp

    def reader(self):
        """A function of shingles' hashes, for one task."""
        arrays = H.Reader(self.folder, self.layout)
        log_n = math.log(self.n)

        def weights(h: np.ndarray) -> np.ndarray:
            df = np.clip(arrays.find("df", _df_key(h))[:, 0], 1, self.n)
            return 1 + self.damp * (log_n - np.log(df)) / log_n

        return weights


def _df_key(h: np.ndarray) -> np.ndarray:
    """48 of the 52 bits of a shingle's hash, as the upper bits of a key."""
    return (h >> np.uint64(4)) << np.uint64(16)


def document_frequencies(docs: DataFrame, text_col: str, shingle: int = SHINGLE, damp: float = DAMP) -> Weights:
    """Counts the documents of every shingle. Tasks deal their own rows' sums over ranges of hashes; each range is summed
    and written to the shared folder, and only the number of documents comes to the driver."""
    spark = docs.sparkSession
    source = docs.select(F.col(text_col).cast("string").alias("text"))
    layout = H.Layout(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    folder = scratch(spark, "near-df")

    def count(batches):
        shingles, held, size, n = Shingles(shingle), [], 0, 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in _parts(texts):
                _, h, _, keys = shingles(texts[i:j])
                held.append(_df_key(h))
                size += len(h)
                n += sum(k is not None for k in keys)
                if size >= FLUSH:
                    yield H.batch(layout.deal(0, *np.unique(np.concatenate(held), return_counts=True)))
                    held, size = [], 0
        if size:
            yield H.batch(layout.deal(0, *np.unique(np.concatenate(held), return_counts=True)))
        yield H.batch([(0, 1, 0, H.packed_keys(np.zeros(1, np.uint64)), H.packed(np.array([n])))])
        release()

    def merge(batches):
        writer, n = H.Writer(folder), 0
        for file, kind, _, keys, values in H.buckets(batches, {0: 1, 1: 1}):
            if kind:
                n += int(values.sum())
                continue
            often = values[:, 0] > 1
            if often.any():
                writer.add(f"df-{file}", keys[often], values[often])
        writer.close()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    n = H.dealt(source.mapInArrow(count, H.ROWS), layout).mapInArrow(merge, "n long").agg(F.sum("n")).first()[0]
    return Weights(folder, layout, n or 0, damp)


class Sampler:
    """Consistent weighted samples. A shingle's random numbers (r and c from Gamma(2, 1), beta uniform, for each sample)
    lie in tables at its slot, so that equal shingles get equal ones everywhere."""

    def __init__(self, samples: int, slots: int = SLOTS):
        rng = np.random.default_rng(SEED)
        self.samples, self.slots = samples, slots
        self.r = rng.gamma(2, 1, (slots, samples)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (slots, samples))).astype(np.float32)
        self.beta = rng.random((slots, samples), dtype=np.float32)

    def __call__(self, owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, turn: int = 0) -> np.ndarray:
        """(n, samples) 64-bit values that are equal where samples agree; owners are sorted, each with an element. Every
        turn deals shingles to other slots and so gives samples of its own."""
        out = np.zeros((n, self.samples), dtype=np.uint64)
        best = np.full((n, self.samples), np.inf, dtype=np.float32)
        log_w = np.log(weight).astype(np.float32)
        slot = ((mix64(h + np.uint64(turn << 52)) if turn else h) % np.uint64(self.slots)).astype(np.int64)
        for a in range(0, len(h), AT_ONCE):
            at, own, key = slot[a : a + AT_ONCE], owner[a : a + AT_ONCE], h[a : a + AT_ONCE]
            r, beta = self.r.take(at, 0), self.beta.take(at, 0)
            t = log_w[a : a + AT_ONCE, None] / r
            t += beta
            np.floor(t, out=t)
            v = t - beta
            v += 1
            v *= r
            np.subtract(self.log_c.take(at, 0), v, out=v)
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            least = np.minimum.reduceat(v, first, axis=0)
            v = v == np.repeat(least, np.diff(np.append(first, len(own))), axis=0)
            row, k = np.divmod(np.flatnonzero(v)[::-1], self.samples)  # of equal elements the first is written last
            who = own[row]
            held = best[own[first]]
            better = (least < held)[np.searchsorted(first, row, "right") - 1, k]
            row, k, who = row[better], k[better], who[better]
            best[own[first]] = np.minimum(held, least)
            out[who, k] = key[row] * np.uint64(0x9E3779B97F4A7C15) + t[row, k].astype(np.int64).astype(np.uint64)
        return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and a hash of the text, which tells a repeated id's texts apart."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return df.filter(F.col("id").isNotNull()).withColumn("th", F.xxhash64("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, weights: Weights, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, th, words (16 bytes that are equal where all words are), bands (keys) and samples (4 bytes each) of texts with a
    word."""

    def run(batches):
        shingles, sampler, weight = Shingles(shingle), Sampler(bands * rows), weights.reader()
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _parts(texts):
                owner, h, count, keys = shingles(texts[i:j])
                have = np.array([k is not None for k in keys], dtype=bool)
                if not have.any():
                    continue
                place = np.cumsum(have) - 1
                s = mix64(sampler(place[owner], h, count * weight(h), int(have.sum())))
                band = np.zeros((len(s), bands), dtype=np.uint64)
                for r in range(rows):
                    band = mix64(band * np.uint64(31) + s[:, r::rows])
                band = mix64(band + np.arange(bands, dtype=np.uint64)).view(np.int64)
                ids, th = (b.column(c).slice(i, j - i).filter(pa.array(have)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [ids, th, pa.array([k for k in keys if k is not None], pa.binary()), pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * bands, band.ravel()), pa.array([x.tobytes() for x in (s >> np.uint64(32)).astype(np.uint32)], pa.binary())],
                    names=["id", "th", "words", "bands", "samples"],
                )
        release()

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, th long, words binary, bands array<long>, samples binary")


def wide_samples(docs: DataFrame, need: DataFrame, id_col: str, text_col: str, weights: Weights, shingle: int = SHINGLE, samples: int = BANDS * ROWS, turns: int = WIDE) -> DataFrame:
    """id and `samples * turns` samples, a byte each, of the texts of need (id, th)."""

    def run(batches):
        shingles, sampler, weight = Shingles(shingle), Sampler(samples), weights.reader()
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _parts(texts):
                owner, h, count, _ = shingles(texts[i:j])
                w = count * weight(h)
                s = np.concatenate([(mix64(sampler(owner, h, w, j - i, t + 1)) >> np.uint64(56)).astype(np.uint8) for t in range(turns)], 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x.tobytes() for x in s], pa.binary())], names=["id", "wide"])

    texts = _texts(docs, id_col, text_col).join(checked(written(need, "near-need")), ["id", "th"], "left_semi")
    return texts.select("id", "text").mapInArrow(run, "id long, wide binary").dropDuplicates(["id"])


def similarities(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, weights: Weights, shingle: int = SHINGLE) -> DataFrame:
    """a, b and the exact weighted Jaccard similarity of their texts, which reps (id, th) name."""
    need = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    need = written(reps.select("id", "th").join(need, "id", "left_semi"), "near-need")
    texts = written(_texts(docs, id_col, text_col).join(checked(need), ["id", "th"], "left_semi").dropDuplicates(["id"]).select("id", "text"), "near-texts")
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")

    def run(batches):
        shingles, weight = Shingles(shingle), weights.reader()
        for batch in batches:
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            both, out = [x for p in zip(ta, tb) for x in p], []
            for i in range(0, len(both), 64):
                owner, h, count, _ = shingles(both[i : i + 64])
                w = count * weight(h)
                ends = np.searchsorted(owner, np.arange(min(64, len(both) - i) + 1))
                for p in range(0, len(ends) - 1, 2):
                    x, y, z = ends[p : p + 3]
                    _, one, two = np.intersect1d(h[x:y], h[y:z], assume_unique=True, return_indices=True)
                    inter = np.minimum(w[x:y][one], w[y:z][two]).sum()
                    union = w[x:z].sum() - inter
                    out.append(inter / union if union else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """id, class (the smallest id that links reach) of each linked id, by alternating large- and small-star steps until
    nothing changes; they take about log(longest chain) rounds."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "near-edges")
    last = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours move to the smallest one.
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = written(small, "near-edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == last:
            break
        last = now
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("class")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())


def second_look(buckets: DataFrame, samples: DataFrame, shared: int, wide_shared: int, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of one bucket (bucket, id, class) but different classes that share samples enough (id, samples, wide).

    A bucket's members are dealt to blocks; each pair of blocks is one group, so no task holds a whole bucket.
    """
    rows = buckets.join(samples.select("id", "samples", "bands", "wide"), "id")
    n = buckets.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(n, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("bucket", "id", "class", "samples", "bands", "wide", "own", other).select("bucket", "id", "class", "samples", "bands", "wide", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, bucket = pdf["i"].iloc[0], pdf["j"].iloc[0], pdf["bucket"].iloc[0]
        bands = np.stack(list(pdf["bands"]))
        s = np.frombuffer(b"".join(pdf["samples"]), np.uint32).reshape(len(pdf), -1)
        wide = np.frombuffer(b"".join(pdf["wide"]), np.uint8).reshape(len(pdf), -1) if pdf["wide"].notna().all() else None
        ids, cls, own = pdf["id"].to_numpy(), pdf["class"].to_numpy(), pdf["own"].to_numpy()
        out = []
        for x in range(len(pdf)):
            to = np.flatnonzero((own == (j if own[x] == i else i)) & (ids > ids[x]) & (cls != cls[x]))
            if len(to):
                to = to[(s[to] == s[x]).sum(1) >= shared]
                same = bands[to] == bands[x]
                to = to[bands[x][same.argmax(1)] == bucket]  # in the first bucket that both are in
                if wide is not None:
                    to = to[(wide[to] == wide[x]).sum(1) >= wide_shared]
                out.append(np.stack([np.full(len(to), ids[x]), ids[to]], 1))
        release()
        pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, damp: float = DAMP) -> DataFrame:
    """id, class_id, class_size, n_links (verified links of the document's text to different texts) per distinct id."""
    docs = docs.select(id_col, text_col)
    weights = document_frequencies(docs, text_col, shingle, damp)
    sig = written(signatures(docs, id_col, text_col, weights, shingle, bands, rows), "near-signatures")
    # One text per id, then one member per text: first for each share of a text's ids, so that no task gets them all.
    one = sig.groupBy("id").agg(F.min(F.struct("words", "th")).alias("t")).select("id", "t.words", "t.th", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    one = written(one, "near-ids")
    shares = written(one.groupBy("words", "salt").agg(F.min(F.struct("id", "th")).alias("t"), F.count("*").alias("n")), "near-shares")
    members = written(shares.groupBy("words").agg(F.min("t").alias("t"), F.sum("n").alias("n")).select("words", F.col("t.id").alias("rep"), "t.th", "n"), "near-members")
    reps = sig.join(members.select(F.col("rep").alias("id"), "th"), ["id", "th"], "left_semi").dropDuplicates(["id"])
    keys = reps.select("id", F.explode("bands").alias("bucket"))
    first = keys.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    keys = written(keys.join(first, "bucket").select("bucket", "a", "id"), "near-buckets")
    pairs = written(keys.filter("a < id").select("a", F.col("id").alias("b")).distinct(), "near-pairs")
    named = members.select(F.col("rep").alias("id"), "th")
    links = written(similarities(pairs, named, docs, id_col, text_col, weights, shingle).filter(F.col("similarity") >= similarity), "near-links")
    found = written(components(links), "near-classes")
    classed = keys.join(found, "id", "left").select("bucket", "id", F.coalesce("class", "id").alias("class"))
    mixed = classed.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n")).filter("lo < hi and n > 2")
    mixed = written(classed.join(mixed.select("bucket", "n"), "bucket"), "near-mixed")
    big, small = mixed.filter(F.col("n") > BIG).drop("n"), mixed.filter(F.col("n") <= BIG).drop("n")
    samples = reps.select("id", "samples", "bands")
    least = least_agreement(similarity, bands * rows), least_agreement(similarity, bands * rows * WIDE, 1 / 256)
    rest = second_look(small, samples.withColumn("wide", F.lit(None).cast("binary")), *least)
    if not big.isEmpty():
        need = named.join(big.select("id").distinct(), "id", "left_semi")
        wide = written(wide_samples(docs, need, id_col, text_col, weights, shingle, bands * rows), "near-wide")
        rest = rest.union(second_look(big, samples.join(wide, "id"), *least)).distinct()
    rest = written(rest.join(pairs, ["a", "b"], "left_anti"), "near-rest")
    more = written(similarities(rest, named, docs, id_col, text_col, weights, shingle).filter(F.col("similarity") >= similarity), "near-links")
    links = links.union(more)
    found = written(components(links), "near-classes")
    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    # Classes of members, then of ids: a hot class is dealt by its members, a hot text by the shares of its ids.
    classed = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    classed = classed.select("words", "n", F.coalesce("class", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    classed = classed.withColumn("share", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
    parts = classed.groupBy("class_id", "share").agg(F.sum("n").alias("n"))
    size = parts.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    classed = classed.drop("n").join(parts.select("class_id", "share").join(size, "class_id"), ["class_id", "share"])
    shares = shares.select("words", "salt").join(classed.select("words", "class_id", "class_size", "n_links"), "words")
    out = one.select("id", "words", "salt").join(shares, ["words", "salt"]).select(F.col("id").alias(id_col), "class_id", "class_size", "n_links")
    empty = docs.select(F.col(id_col).cast("long").alias(id_col)).filter(F.col(id_col).isNotNull()).distinct().join(one.select(F.col("id").alias(id_col)), id_col, "left_anti")
    return out.union(empty.select(id_col, F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links")))


def _first_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """Of the rows that repeat an id the one of the smallest hash over all columns that can be hashed, so that reruns agree."""
    can = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return docs.withColumn("__near_hash", F.xxhash64(*can)).groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "__near_hash").alias("__near_row")).select("__near_row.*")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """The rows, with all their columns, but for documents that are not the smallest id of their class. Rows with a null
    id stay; of rows that repeat an id the one of the smallest hash stays."""
    gone = written(near_classes(docs, id_col, **params).filter(F.col(id_col) != F.col("class_id")).select(id_col), "near-gone")
    kept = docs.join(checked(gone), id_col, "left_anti").select(*docs.columns)
    twice = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col)
    if twice.isEmpty():
        return kept
    return kept.join(twice, id_col, "left_anti").select(*docs.columns).unionByName(_first_rows(kept.join(twice, id_col, "left_semi").select(*docs.columns), id_col))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
