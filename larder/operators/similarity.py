"""Communities of names on a similarity graph, their medoids, learned modifiers, weighted PCA and traffic splits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import matching, money, text, titles
from .windows import top_per_group

c = F.col


def clustering_coefficients(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, degree, triangles, coefficient (linked pairs of its neighbours of all such pairs; 0 below two neighbours).

    Each edge points to its end of higher degree, and two edges meet at the lower one: no node starts more than the
    square root of twice the number of edges, so a hub does not make all pairs of its neighbours.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct()
    degree = e.select(c("u").alias("node")).union(e.select("v")).groupBy("node").agg(F.count("*").alias("degree"))
    x = e.join(degree.select(c("node").alias("u"), c("degree").alias("du")), "u").join(degree.select(c("node").alias("v"), c("degree").alias("dv")), "v")
    up = (c("du") < c("dv")) | ((c("du") == c("dv")) & (c("u") < c("v")))
    arcs = x.select(F.when(up, c("u")).otherwise(c("v")).alias("low"), F.when(up, c("v")).otherwise(c("u")).alias("high"))
    wedges = arcs.join(arcs.withColumnRenamed("high", "other"), "low").filter("high < other")
    closed = wedges.join(e.select(c("u").alias("high"), c("v").alias("other")), ["high", "other"], "left_semi")
    count = closed.select(F.explode(F.array("low", "high", "other")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    out = degree.join(count, "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))
    return out.withColumn("coefficient", F.when(c("degree") < 2, 0.0).otherwise(F.try_divide(2.0 * c("triangles"), c("degree") * (c("degree") - 1))))


def communities(members: DataFrame, component: str, name: str, smallest: int = 3, coverage: float = 0.55) -> DataFrame:
    """Members of components with `smallest` or more names, a word that all of them have, and, on average, that share of
    a member's words common to all. Adds cluster_size, common (number of common words), purity (the member's share).
    Words are counted per component; no component's members come together in one row."""
    m = members.select(component, name).distinct().withColumn("cluster_size", F.count("*").over(W.partitionBy(component))).filter(c("cluster_size") >= smallest)
    words = m.select(component, name, "cluster_size", F.explode(F.array_distinct(text.tokens(c(name)))).alias("word"))
    # words of a component, one row each, before the members' words are marked
    common = words.groupBy(component, "word").agg(F.count("*").alias("n"), F.first("cluster_size").alias("s")).filter("n = s").select(component, "word", F.lit(1).alias("hit"))
    share = words.join(common, [component, "word"], "left").groupBy(component, name).agg(F.count("hit").alias("common"), F.first("cluster_size").alias("cluster_size"), (F.count("hit") / F.count("*")).alias("purity"))
    kept = share.groupBy(component).agg(F.avg("purity").alias("p"), F.max("common").alias("k")).filter((c("k") > 0) & (c("p") >= coverage)).select(component)
    return share.join(kept, component, "left_semi").select(component, name, "cluster_size", "common", "purity")


def merge_targets(found: DataFrame, component: str, name: str, products: DataFrame, larger: bool = False) -> DataFrame:
    """component, name, target: the purest member, then the one with most products, the shorter, the smaller (or larger)
    name, stands for the others. `products` has the name and n."""
    n = found.join(products.select(name, "n"), name, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = top_per_group(n, [component], [c("purity").desc(), c("n").desc(), F.length(name), c(name).desc() if larger else c(name)]).select(component, c(name).alias("target"))
    return found.select(component, name).join(best, component).filter(c(name) != c("target"))


def medoids(found: DataFrame, component: str, name: str, pairs: DataFrame, products: DataFrame, previous: DataFrame | None = None, delta: float = 0.01) -> DataFrame:
    """component, medoid, score, reason. A member scores by its mean similarity to the others (unknown pairs count 0), its
    purity and its products. With `previous` (name, medoid) a component keeps its most frequent former medoid unless
    another scores `delta` more.

    pairs: a, b, similarity; each pair counts once, with its largest similarity."""
    ends = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("s")).filter("a <> b")
    of = found.select(component, c(name))
    inner = ends.join(of.select(c(component).alias("ca"), c(name).alias("a")), "a").join(of.select(c(component).alias("cb"), c(name).alias("b")), "b").filter("ca = cb")
    mean = inner.select(c("ca").alias(component), F.explode(F.array("a", "b")).alias(name), "s").groupBy(component, name).agg(F.sum("s").alias("total"))
    x = found.join(mean, [component, name], "left").join(products.select(name, "n"), name, "left")
    x = x.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("mean", F.coalesce(F.try_divide(c("total"), (c("cluster_size") - 1).cast("double")), F.lit(0.0)))
    x = x.withColumn("score", F.round(money.medoid_score(c("mean"), c("purity"), c("n").cast("double")), 9))
    order = [c("score").desc(), c("mean").desc(), c("purity").desc(), c("n").desc(), F.length(name), c(name)]
    best = top_per_group(x, [component], order).select(component, c(name).alias("best"), c("score").alias("best_score"))
    if previous is None:
        return best.select(component, c("best").alias("medoid"), c("best_score").alias("score"), F.lit("initiation_best_score").alias("reason"))
    votes = of.join(previous.select(name, "medoid"), name).groupBy(component, "medoid").agg(F.count("*").alias("votes"))
    old = top_per_group(votes, [component], [c("votes").desc(), c("medoid")]).select(component, c("medoid").alias("old"))
    old = old.join(x.select(component, c(name).alias("old"), c("score").alias("old_score")), [component, "old"], "left")
    y = best.join(old, component, "left")
    better = (c("best") != c("old")) & (c("best_score") >= c("old_score") + delta)
    reason = F.when(c("old").isNull(), "perturbation_fallback_to_initiation").when(c("old_score").isNull(), "perturbation_missing_previous_medoid")
    reason = reason.when(better, "perturbation_promoted_better_candidate").otherwise("perturbation_retained_previous_medoid")
    y = y.withColumn("reason", reason)
    stays = c("reason") == "perturbation_retained_previous_medoid"
    return y.select(component, F.when(stays, c("old")).otherwise(c("best")).alias("medoid"), F.when(stays, c("old_score")).otherwise(c("best_score")).alias("score"), "reason")


def learned_modifiers(pairs: DataFrame, source: str, target: str, events: str) -> DataFrame:
    """head, word, weight, n_pairs: words that merges drop often, by the last word of the target. A word counts if its
    pairs weigh 8 or more, or if two pairs of weight 3 or more make 0.08 of the head's."""
    u, v = F.array_distinct(text.tokens(c(source))), text.tokens(c(target))
    dropped = F.filter(F.array_except(u, v), lambda w: F.length(w) >= 3)
    x = pairs.select(F.try_element_at(v, F.lit(-1)).alias("head"), dropped.alias("dropped"), F.greatest(F.lit(1).cast("long"), F.coalesce(c(events), F.lit(0))).alias("w"))
    x = x.filter(c("head").isNotNull() & (F.size("dropped") > 0))
    total = x.groupBy("head").agg(F.sum("w").alias("total"))
    words = x.select("head", "w", F.explode("dropped").alias("word")).groupBy("head", "word").agg(F.sum("w").alias("weight"), F.count("*").alias("n_pairs"))
    often = (c("weight") >= 3) & (c("n_pairs") >= 2) & (c("weight") / c("total") >= 0.08)
    return words.join(total, "head").filter(often | (c("weight") >= 8)).select("head", "word", "weight", "n_pairs")


def remap_decisions(candidates: DataFrame, name: str, least_confidence: float = 0.85, least_similarity: float = 0.96) -> DataFrame:
    """The best candidate of each name and what becomes of it: name, candidate, direction, score, decision, reason.

    candidates: name, category, confidence, candidate, candidate_category, similarity. A more generic candidate and one of
    another category lose score; ties go to the smaller candidate."""
    crosses = F.coalesce((c("category") != c("candidate_category")) & (c("category") != "") & (c("candidate_category") != ""), F.lit(False))
    x = candidates.withColumn("direction", matching.remap_direction(c(name), c("candidate"))).withColumn("crosses", crosses)
    score = c("similarity") - F.when(c("direction") == matching.SPECIFIC_TO_GENERIC, matching.SPECIFIC_PENALTY).otherwise(0.0) - F.when(c("crosses"), matching.CATEGORY_PENALTY).otherwise(0.0)
    x = top_per_group(x.withColumn("score", score), [name], [c("score").desc(), c("candidate")])
    cross_least = min(0.999, max(least_similarity + matching.CROSS_BUFFER, matching.CROSS_SIMILARITY))
    reason = (
        F.when(c("score") < least_similarity - 1e-9, "below_similarity_threshold").when(c("candidate") == c(name), "same_name")
        .when(c("crosses") & ((c("confidence") < matching.CROSS_CONFIDENCE - 1e-9) | (c("score") < cross_least - 1e-9)), "cross_category_mismatch")
        .when(~matching.remap_allowed(c("direction"), c("confidence"), c("score"), least_confidence, least_similarity), F.concat(F.lit("asymmetric_"), c("direction")))
        .otherwise("applied")
    )
    return x.withColumn("reason", reason).select(name, "candidate", "direction", "score", F.when(c("reason") == "applied", "remapped").otherwise("skipped").alias("decision"), "reason")


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        for vectors, weights in zip(np.array_split(batch.v.to_numpy(), len(batch) // 10_000 + 1), np.array_split(batch.w.to_numpy(), len(batch) // 10_000 + 1)):
            if not len(vectors):
                continue
            m, w = np.stack(vectors).astype(float), weights.astype(float)
            x = np.hstack([np.ones((len(m), 1)), m])
            part = (x * w[:, None]).T @ x
            total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})


def weighted_pca(df: DataFrame, vector: str, weight: str, axes: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, axes (rows) and explained shares of rows weighted by `weight`; each axis' largest component is positive.

    A task returns one weighted (d + 1) x (d + 1) matrix of moments, Spark adds them up, and the driver sees that sum
    alone, whose size follows from the width of the vectors. Rows with a null vector or no positive weight take no part,
    and all vectors must have one width. No rows at all give empty arrays."""
    x = df.select(c(vector).cast("array<double>").alias("v"), c(weight).cast("double").alias("w")).filter("v is not null and w > 0")
    rows = x.mapInPandas(_moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    if not rows:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    d = int(round(len(rows) ** 0.5))
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r.i] = r.x
    m = flat.reshape(d, d)
    mean = m[0, 1:] / m[0, 0]
    values, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    order = np.argsort(values)[::-1]
    vectors = vectors[:, order[:axes]].T
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    share = np.maximum(values[order], 0)
    return mean, vectors, share[:axes] / max(share.sum(), 1e-300)


def projected(df: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray, digits: int = 6) -> DataFrame:
    """df with the coordinates pc1, pc2, ... of its vectors; null where there is no vector."""
    out = df
    for k, axis in enumerate(axes, 1):
        terms = F.zip_with(F.transform(c(vector), lambda v: v.cast("double")), F.array(*[F.lit(float(a)) for a in axis]), lambda p, q: p * q)
        out = out.withColumn(f"pc{k}", F.round(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) - float(axis @ mean), digits))
    return out


def traffic_split(variants: DataFrame, experiment: str, seed: int, least_exposures: int = 50, floor: int = 5) -> DataFrame:
    """experiment, variant, percent: Thompson sampling, whole percents that sum to 100, each at least near `floor`.

    variants: experiment, variant, exposures, conversions. An experiment with a variant of fewer exposures is left out.
    A draw depends on the seed, the experiment and the variants' order by name, so reruns agree."""
    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("variant")
        if not len(rows) or (rows.exposures < least_exposures).any():
            return rows.iloc[:0].assign(percent=0)[[experiment, "variant", "percent"]]
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())])
        theta = rng.beta(rows.conversions + 1.0, np.maximum(rows.exposures - rows.conversions, 0) + 1.0)
        share = np.maximum(theta / theta.sum() * 100, floor)
        share = share / share.sum() * 100
        percent = np.floor(share).astype(int)
        percent[percent.argmax()] += 100 - percent.sum()
        return rows.assign(percent=percent)[[experiment, "variant", "percent"]]

    kind = dict(variants.dtypes)
    return variants.select(experiment, "variant", "exposures", "conversions").groupBy(experiment).applyInPandas(split, f"`{experiment}` {kind[experiment]}, variant {kind['variant']}, percent int")


def rerank(candidates: DataFrame, forms: list[str], best: int = 1, floor: float = matching.COSINE_FLOOR, tails: bool = True) -> DataFrame:
    """The best candidates of each query above the cosine floor, by the second ranking, with columns score and place.
    Without `tails` neither common words nor categories nor long tails count, as for names that are linked anew.

    candidates: query, query_category, candidate, candidate_category, cosine. Ties go to the larger cosine, then the name."""
    x = candidates.filter(c("cosine") >= floor)
    x = x.withColumn("score", F.round(matching.rerank_score(c("query"), c("candidate"), c("cosine"), c("query_category"), c("candidate_category"), forms, tails), 9))
    return top_per_group(x, ["query"], [c("score").desc(), c("cosine").desc(), c("candidate")], best, "place")


def weighted_word_similarity(pairs: DataFrame, a: str, b: str, words: DataFrame, total: int) -> DataFrame:
    """pairs with `similarity`: inverse document frequency of common words, of that of all their words.

    words: word, df (documents that have it), joined by word; an unknown word counts as one that a single document of
    `total` has. Pairs without words get 0."""
    u, v = F.array_distinct(text.tokens(c(a))), F.array_distinct(text.tokens(c(b)))
    x = pairs.select(a, b).distinct().withColumn("shared", F.array_intersect(u, v)).select(a, b, "shared", F.explode(F.array_union(u, v)).alias("word"))
    idf = F.log(F.lit(total + 1.0) / (F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)) + 1))
    x = x.join(words.select("word", "df"), "word", "left").select(a, b, F.array_contains("shared", c("word")).alias("both"), idf.alias("idf"))
    s = x.groupBy(a, b).agg(F.try_divide(F.sum(F.when(c("both"), c("idf")).otherwise(0.0)), F.sum("idf")).alias("similarity"))
    return pairs.join(s, [a, b], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def collocations(texts: DataFrame, column: str, least_df: int = 5, least_joint: int = 3) -> DataFrame:
    """a, b, joint, ppmi: neighbouring words that occur together more often than by chance. Words are split at blanks."""
    w = F.filter(F.split(F.lower(column), " "), lambda x: x != "")
    x = texts.filter(c(column).isNotNull()).select(w.alias("w"))
    n = x.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    joint = x.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("joint"))
    sums = n.agg(F.sum("n").alias("all_words")).join(joint.agg(F.sum("joint").alias("all_pairs")), F.lit(True))
    often = n.filter(c("n") >= least_df)
    y = joint.filter(c("joint") >= least_joint).join(often.select(c("word").alias("a"), c("n").alias("na")), "a").join(often.select(c("word").alias("b"), c("n").alias("nb")), "b")
    y = y.join(F.broadcast(sums), F.lit(True))
    ratio = (c("joint") / c("all_pairs")) / ((c("na") / c("all_words")) * (c("nb") / c("all_words")))
    return y.select("a", "b", "joint", F.round(F.greatest(F.lit(0.0), F.log(ratio)), 6).alias("ppmi"))


def search(queries: DataFrame, query: str, query_words: str, names: DataFrame, name: str, words: str) -> DataFrame:
    """query, name, score of names that share a word with a query: matched words, common words, and more if one contains the
    other. Candidates come from an equi-join on words; rank or cut them by score."""
    asked = queries.select(query, query_words, F.explode(F.array_distinct(query_words)).alias("__x"))
    known = names.select(name, words, F.explode(F.array_distinct(words)).alias("__x"))
    pairs = asked.join(known, "__x").dropDuplicates([query, name])
    both = F.size(F.array_intersect(query_words, words)).cast("double")
    score = both / F.size(words) + 1.6 * both / F.size(F.array_union(query_words, words))
    score = score + F.when(F.contains(c(query), c(name)), 0.75).otherwise(0.0) + F.when(F.contains(c(name), c(query)), 0.15).otherwise(0.0)
    return pairs.select(query, name, F.round(score, 6).alias("score"))


def sound(vector: Column) -> Column:
    """Whether a vector has a direction: not null, not zero, no component null or not finite."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def scaled(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, each times a power of two, so that no square is too large or small, and as unit vectors."""
    m = np.stack(list(vectors)).astype(float)
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])
    return m, m / np.linalg.norm(m, axis=1)[:, None]


def rounded_cosines(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, s: np.ndarray, digits: int = 9) -> np.ndarray:
    """s, the cosines of the rows i of x and j of y as a matrix product gave them, in so many digits. A product adds up in an
    order of its own; where its last bits decide a digit, the components are added one by one, so that equal rows have one
    cosine wherever they stand, and that of plain SQL."""
    large = np.abs(s) * 10.0**digits
    at = np.flatnonzero(np.abs(large - np.floor(large) - 0.5) < 1e-4)
    if len(at):
        s, p, q = s.copy(), x[i[at]], y[j[at]]
        dot, u, v = (np.zeros(len(at)) for _ in range(3))
        for i in range(p.shape[1]):
            dot, u, v = dot + p[:, i] * q[:, i], u + p[:, i] * p[:, i], v + q[:, i] * q[:, i]
        s[at] = np.clip(dot / np.sqrt(u * v), -1, 1)
    return s.round(digits)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, rows: int = 32_768, asked: int = 32_768) -> DataFrame:
    """a, b, cosine, place: each query's k nearest of all vectors but itself, by the cosine in nine digits, ties to the
    smaller key.

    Vectors are dealt to parts of at most about `rows`, queries to parts of at most about `asked`, and either to a few where
    there are enough; each pair of parts is one group, which multiplies a few queries at a time, and the groups' best k of
    each query are merged by a window. Rows without a vector, of zeros, or with a component that is no number take no part."""
    def fine(df: DataFrame) -> DataFrame:
        return df.select(key, vector).filter(c(key).isNotNull() & sound(c(vector)))

    v, q = fine(vectors), fine(queries)
    parts, shares = (max(-(-n // most), min(6, n // 2_000), 1) for n, most in ((v.count(), rows), (q.count(), asked)))
    # both sides' numbers have one type: groups of another type are dealt elsewhere and never meet
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    v = v.select(key, vector, dealt(parts).alias("part"), every(shares).alias("share"))
    q = q.select(key, vector, dealt(shares).alias("share"), every(parts).alias("part"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": "int64", "b": "int64", "cosine": "float64"})
        (m, unit), (n, asking) = scaled(left[vector]), scaled(right[vector])
        ids, own = left[key].to_numpy(), right[key].to_numpy()
        order = np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids[order], own, side) for side in ("left", "right"))
        out = []
        for start in range(0, len(n), 128):
            s = asking[start : start + 128] @ unit.T
            for i in np.flatnonzero(last[start : start + 128] > first[start : start + 128]):
                s[i, order[first[start + i] : last[start + i]]] = -9.0  # itself
            least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(s), -2.0)
            i, j = np.nonzero(s >= np.maximum(least - 2e-9, -2.0)[:, None])
            x = rounded_cosines(n, start + i, m, j, s[i, j])
            by = np.lexsort((ids[j], -x, i))
            i, j, x = i[by], j[by], x[by]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pd.DataFrame({"a": own[start + i[kept]], "b": ids[j[kept]], "cosine": x[kept]}))
        return pd.concat(out)

    found = v.groupBy("part", "share").cogroup(q.groupBy("part", "share")).applyInPandas(best, "a long, b long, cosine double")
    return top_per_group(found, ["a"], [c("cosine").desc(), c("b")], k, "place")


def logged_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (source, target, similarity) as they are logged: with their direction, and of lateral ones the shorter name
    first; each pair of names once, with its largest similarity."""
    x = pairs.withColumn("direction", matching.remap_direction(c("source"), c("target")))
    swap = (c("direction") == matching.LATERAL) & (F.length("target") < F.length("source"))
    x = x.select(F.when(swap, c("target")).otherwise(c("source")).alias("source"), F.when(swap, c("source")).otherwise(c("target")).alias("target"), "direction", "similarity")
    return x.groupBy("source", "target", "direction").agg(F.max("similarity").alias("similarity"))


def lexical_edges(names: DataFrame, name: str, family: int = 4, overlap: float = 0.6, letters: int = 4) -> DataFrame:
    """a, b: names with a common word of at least `letters` letters that at most `family` names have, whose common words
    make that share of the shorter name's. A word of more names makes no pairs, so none makes many."""
    n = names.select(name).distinct().withColumn("w", F.array_distinct(text.tokens(c(name), 2)))
    words = n.select(c(name), "w", F.explode("w").alias("word")).filter(F.length("word") >= letters)
    rare = words.groupBy("word").agg(F.count("*").alias("k")).filter(c("k").between(2, family)).select("word")
    x = words.join(rare, "word")
    pairs = x.select("word", c(name).alias("a"), c("w").alias("u")).join(x.select("word", c(name).alias("b"), c("w").alias("v")), "word").filter("a < b")
    return pairs.filter(text.containment(c("u"), c("v")) >= overlap - 1e-9).select("a", "b").distinct()


def consolidation_plan(rows: DataFrame, proposals: DataFrame) -> DataFrame:
    """rows (source, target, direction) with `loser`, `survivor` and `plan`: a pair that a proposal (name, target) names, in
    either order, follows it; other lateral pairs of names that proposals touch are superseded; the rest stays as it is."""
    pair = lambda p, q: [F.least(p, q).alias("__p"), F.greatest(p, q).alias("__q")]
    named = proposals.select(*pair("name", "target"), c("name").alias("loser"), c("target").alias("survivor")).dropDuplicates(["__p", "__q"])
    members = proposals.select(F.explode(F.array("name", "target")).alias("__member")).distinct().withColumn("__in", F.lit(True))
    x = rows.select("source", "target", "direction", *pair("source", "target")).join(named, ["__p", "__q"], "left")
    for end in ("source", "target"):
        x = x.join(members.select(c("__member").alias(end), c("__in").alias(f"__{end}")), end, "left")
    lost = (c("direction") == matching.LATERAL) & F.coalesce(c("__source"), c("__target"), F.lit(False))
    plan = F.when(c("loser").isNotNull(), "forced").when(lost, "superseded").otherwise("kept")
    return x.select("source", "target", "direction", "loser", "survivor", plan.alias("plan"))


def resolved_names(queue: DataFrame, key: str, title: str, names: DataFrame, name: str, least: float = 1.0) -> DataFrame:
    """What becomes of titles in the queue: key, name, score, outcome. No food is skipped; a title that is a known name is
    matched; else the best known name with a common word is taken if its score reaches `least`; the rest are new names."""
    q = queue.select(key, text.plain_name(c(title)).alias("__title"))
    food = q.filter(~titles.has_no_food_part(c("__title")))
    known = names.select(c(name).alias("__name")).distinct()
    exact = food.join(known.select(c("__name").alias("__title")), "__title", "left_semi").select("__title").distinct()
    open_ = food.select("__title").distinct().join(exact, "__title", "left_anti")
    words = lambda df, x: df.select(x, F.split(x, " ").alias(f"{x}_words"))
    found = search(words(open_, "__title"), "__title", "__title_words", words(known, "__name"), "__name", "__name_words")
    best = top_per_group(found.filter(c("score") >= least), ["__title"], [c("score").desc(), c("__name")])
    x = q.join(best, "__title", "left").join(exact.withColumn("__exact", F.lit(True)), "__title", "left")
    outcome = F.when(titles.has_no_food_part(c("__title")), "no_food").when(c("__exact"), "matched").when(c("__name").isNotNull(), "remapped").otherwise("new")
    taken = F.when(c("__exact"), c("__title")).otherwise(c("__name"))
    return x.select(key, F.when(outcome != "no_food", F.when(outcome == "new", c("__title")).otherwise(taken)).alias("name"), F.when(outcome == "remapped", c("score")).alias("score"), outcome.alias("outcome"))


def _powers(p: float, mean: np.ndarray, axis: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(mean) + 1)
        for batch in batches:
            for vectors, weights in zip(np.array_split(batch.v.to_numpy(), len(batch) // 10_000 + 1), np.array_split(batch.w.to_numpy(), len(batch) // 10_000 + 1)):
                if len(vectors):
                    m = np.stack(vectors).astype(float) - mean
                    along = m @ axis
                    pull = weights.astype(float) * np.abs(along) ** (p - 1)
                    total[:-1] += m.T @ (pull * np.sign(along))
                    total[-1] += (pull * np.abs(along)).sum()
        yield pd.DataFrame({"i": np.arange(len(total)), "x": total})

    return run


def lp_axes(df: DataFrame, vector: str, weight: str, p: float, axes: int = 2, rounds: int = 30, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, axes (rows) and objectives: unit axes on which the weighted sum of |x v|^p of centred rows is at a maximum,
    each orthogonal to those before; p is at least 1.

    An axis starts at the weighted PCA's and moves to the direction of its gradient in the space left, which never lowers
    the sum, as it is convex. A round is one pass, of which each task returns one vector; the driver sees their sum. The
    maximum is a local one. Stops where an axis moves less than `tol`, or after `rounds` passes."""
    if p < 1:
        raise ValueError("p is at least 1")
    mean, start, _ = weighted_pca(df, vector, weight, axes)
    x = df.select(c(vector).cast("array<double>").alias("v"), c(weight).cast("double").alias("w")).filter("v is not null and w > 0")
    found, sums = [], []
    for v in start:
        for _ in range(rounds):
            rows = x.mapInPandas(_powers(p, mean, v), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
            out = np.array([r.x for r in sorted(rows, key=lambda r: r.i)])
            step, power = out[:-1], out[-1]
            for known in found:
                step = step - (step @ known) * known
            length = np.linalg.norm(step)
            if length < 1e-300:
                break
            step = step / length
            moved, v = np.linalg.norm(step - v), step
            if moved < tol:
                break
        v = v * np.sign(v[np.abs(v).argmax()])
        found.append(v)
        sums.append(power)
    return mean, np.array(found).reshape(len(found), len(mean)), np.array(sums)


def jaccard_pairs(sets: DataFrame, key: str, elements: str, least: float) -> DataFrame:
    """a, b, similarity: keys (distinct) whose sets of strings have at least that Jaccard similarity, above 0.

    Elements are ordered from rare to frequent, and sets meet only at the first few of their elements: as many as any set
    so similar must share one of. Frequent elements thus make hardly any pairs, and sizes too far apart none."""
    s = sets.select(key, F.array_distinct(elements).alias("s")).filter(F.size("s") > 0)
    of = s.select(key, F.explode("s").alias("e"))
    ranked = of.join(of.groupBy("e").agg(F.count("*").alias("n")), "e").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("r"))
    n = F.size("r")
    first = F.slice("r", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
    heads = ranked.select(key, F.transform("r", lambda x: x["e"]).alias("s"), F.explode(first).alias("x")).select(key, "s", "x.e")
    pairs = heads.select("e", c(key).alias("a"), c("s").alias("u")).join(heads.select("e", c(key).alias("b"), c("s").alias("v")), "e").filter("a < b")
    near = F.least(F.size("u"), F.size("v")) >= F.greatest(F.size("u"), F.size("v")) * least - 1e-9
    similarity = text.jaccard(c("u"), c("v"))
    return pairs.filter(near & (similarity >= least - 1e-9)).select("a", "b", similarity.alias("similarity")).distinct()


def jaccard_join(left: DataFrame, a: str, right: DataFrame, b: str, elements: str, least: float, rows: int = 20_000) -> DataFrame:
    """a, b, similarity: keys of two frames (each distinct) whose sets of strings have at least that Jaccard similarity,
    above 0.

    Either side is dealt to parts of about `rows`; each pair of parts is one group, which lists the left sets of each element
    and counts, for some right sets at a time, how often a left set is listed. Frequent elements cost an addition for each
    pair and make no rows."""
    sides = [df.select(c(k).alias("key"), F.array_distinct(elements).alias("s")).filter(c("key").isNotNull() & (F.size("s") > 0)) for df, k in ((left, a), (right, b))]
    n, m = (max(1, -(-x.count() // rows)) for x in sides)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("key"), F.lit(k)).cast("int")
    x, y = sides[0].select("key", "s", dealt(n).alias("i"), every(m).alias("j")), sides[1].select("key", "s", every(n).alias("i"), dealt(m).alias("j"))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"x": left["key"].iloc[:0], "y": right["key"].iloc[:0], "s": np.zeros(0)})]
        if len(left) and len(right):
            sizes = [df["s"].map(len).to_numpy() for df in (left, right)]
            codes, known = pd.factorize(np.concatenate(left["s"].to_list()))
            holders = np.repeat(np.arange(len(left)), sizes[0])[np.argsort(codes, kind="stable")]
            starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(known)))])
            theirs = pd.Index(known).get_indexer(np.concatenate(right["s"].to_list()))
            own = np.repeat(np.arange(len(right)), sizes[1])[theirs >= 0]
            theirs = theirs[theirs >= 0]
            step = max(1, 2_000_000 // len(left))
            for start in range(0, len(right), step):
                at = slice(*np.searchsorted(own, [start, start + step]))
                first, many = starts[theirs[at]], np.diff(starts)[theirs[at]]
                listed = holders[np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(many) else holders[:0]
                common = np.bincount(np.repeat(own[at] - start, many) * len(left) + listed)
                pair = np.flatnonzero(common)
                q, p = start + pair // len(left), pair % len(left)
                similarity = common[pair] / (sizes[0][p] + sizes[1][q] - common[pair])
                near = similarity >= least - 1e-9
                out.append(pd.DataFrame({"x": left["key"].to_numpy()[p[near]], "y": right["key"].to_numpy()[q[near]], "s": similarity[near]}))
        return pd.concat(out)

    kinds = [side.schema["key"].dataType.simpleString() for side in sides]
    found = x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInPandas(count, f"x {kinds[0]}, y {kinds[1]}, s double")
    return found.select(c("x").alias(a), c("y").alias(b), c("s").alias("similarity"))
