"""Names that are one: reranked and relinked candidates, logged pairs, splits, verdicts and plans (names are made of parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching, text, titles
from ..operators import graph, similarity
from .catalog import query
from .offers import _NEAR, _NEAR_ALL, _near
from .tables import t

c = F.col
_FORMS = ["bolt", "ring"]

# -- candidates by vectors ------------------------------------------------------------------------------------------------


def _candidates(spark, d):
    """The 25 nearest vectors of each query (ids divisible by 50), under the names of the parts of their number."""
    names = t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", c("p_partkey").cast("string")).alias("name"), "p_type")
    of = lambda end, name, kind: names.select(c("p_partkey").alias(end), c("name").alias(name), c("p_type").alias(kind))
    return _near(spark, d).join(of("a", "query", "query_category"), "a").join(of("b", "candidate", "candidate_category"), "b")


@query("ml1_rerank")
def ml1(spark, d):
    """The best candidate of each name by the second ranking."""
    return similarity.rerank(_candidates(spark, d), _FORMS, floor=0.2).select("query", "candidate", "score")


@query("sr9_rerank_places")
def sr9(spark, d):
    """All candidates in the order of the second ranking: score, cosine, name."""
    return similarity.rerank(_candidates(spark, d), _FORMS, 25, floor=0.2).select("query", "candidate", "score", "place")


_PAIRS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_FORM_OF = "list_filter({}, lambda w: list_contains(['bolt', 'ring'], w))"


@query("ml2_relink", f"""{_NEAR}, n AS (SELECT p_partkey, p_name || ' ' || p_partkey AS name FROM part), p AS (SELECT a, b, cosine, x.name AS u, y.name AS v, {_PAIRS.format('x.name')} AS gu, {_PAIRS.format('y.name')} AS gv,
    {_FORM_OF.format("string_split(x.name, ' ')")} AS fu, {_FORM_OF.format("string_split(y.name, ' ')")} AS fv FROM r JOIN n x ON x.p_partkey = a JOIN n y ON y.p_partkey = b WHERE place <= 25 AND cosine >= 0.2),
    scored AS (SELECT a, b, cosine, v, round(cosine + CASE WHEN split_part(u, ' ', 1) = split_part(v, ' ', 1) THEN 0.03 ELSE 0 END
        + CASE WHEN len(list_intersect(gu, gv)) / (len(gu) + len(gv) - len(list_intersect(gu, gv))) >= 0.6 THEN 0.02 ELSE 0 END + CASE WHEN list_sort(fu) <> list_sort(fv) THEN -0.04 ELSE 0 END, 9) AS score FROM p)
    SELECT a, b, score, CASE WHEN b = a + 1 THEN 'already_correct' WHEN score < CASE WHEN a % 100 = 0 THEN 0.3 ELSE 0.35 END THEN 'below_threshold' ELSE 'updated' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, cosine DESC, v) AS n FROM scored) WHERE n = 1""")
def ml2(spark, d):
    """Products linked anew by head, letters and form; a link that is right stays, others need a score, one that is missing
    a lower one. Every second query has no link, the others are linked to the vector of the next number."""
    best = similarity.rerank(_candidates(spark, d), _FORMS, floor=0.2, tails=False)
    linked = F.when(c("a") % 100 != 0, c("a") + 1)
    low = c("score") < F.when(linked.isNull(), 0.3).otherwise(0.35)
    return best.select("a", "b", "score", F.when(c("b") == linked, "already_correct").when(low, "below_threshold").otherwise("updated").alias("outcome"))


@query("ml4_logged_pairs", f"""{_NEAR_ALL}, n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS name FROM part),
    p AS (SELECT x.name AS u, y.name AS v, cosine, string_split(x.name, ' ') AS wu, string_split(y.name, ' ') AS wv FROM r JOIN n x ON x.p_partkey = a JOIN n y ON y.p_partkey = b WHERE place <= 25),
    directed AS (SELECT *, CASE WHEN len(wu) < len(wv) AND list_has_all(wv, wu) THEN 'generic_to_specific' WHEN len(wv) < len(wu) AND list_has_all(wu, wv) THEN 'specific_to_generic' ELSE 'lateral' END AS direction FROM p)
    SELECT CASE WHEN direction = 'lateral' AND length(v) < length(u) THEN v ELSE u END AS source, CASE WHEN direction = 'lateral' AND length(v) < length(u) THEN u ELSE v END AS target, direction, max(cosine) AS similarity FROM directed GROUP BY 1, 2, 3""")
def ml4(spark, d):
    """Names whose vectors are near, with the direction between them; of lateral pairs the shorter name leads."""
    noun = F.element_at(F.split("p_name", " "), 2)
    names = t(spark, d, "part").select("p_partkey", F.when(c("p_partkey") % 3 == 0, noun).otherwise(c("p_name")).alias("name"))
    x = _near(spark, d, F.lit(True)).join(names.select(c("p_partkey").alias("a"), c("name").alias("source")), "a").join(names.select(c("p_partkey").alias("b"), c("name").alias("target")), "b")
    return similarity.logged_pairs(x.select("source", "target", c("cosine").alias("similarity")))


@query("ml5_like_missing", f"{_NEAR_ALL} SELECT a, b, cosine FROM r WHERE place <= 10 AND cosine >= 0.25")
def ml5(spark, d):
    """What could stand for a missing ingredient: of its ten nearest those that are near enough."""
    return _near(spark, d, F.lit(True), 10).filter("cosine >= 0.25").select("a", "b", "cosine")


@query("ml6_retained_form", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' paste' WHEN 1 THEN split_part(p_name, ' ', 2) || ' paste' WHEN 2 THEN 'chicken ' || p_name END AS name FROM part")
def ml6(spark, d):
    """Forms that a proposed name loses: kept whole, appended, a protein, without a common word, not lost."""
    noun, n = F.element_at(F.split("p_name", " "), 2), c("p_partkey") % 5
    source = F.when(n == 0, F.concat("p_name", F.lit(" paste"))).when(n == 1, F.concat(F.lit("huge brand "), "p_name", F.lit(" 17oz hot paste"))).when(n == 2, F.concat(F.lit("Chicken "), "p_name")).when(n == 3, F.concat("p_name", F.lit(" paste"))).otherwise(F.concat("p_name", F.lit(" paste!")))
    proposed = F.when(n == 0, c("p_name")).when(n == 1, noun).when(n == 2, c("p_name")).when(n == 3, F.lit("sauce")).otherwise(F.concat(F.lit("paste "), "p_name"))
    return t(spark, d, "part").select("p_partkey", matching.retained_form(source, proposed, ["paste", "chicken"]).alias("name"))


@query("ml6_retained_variety", "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') AND p_size % 2 = 0 THEN p_name END AS name FROM part")
def ml6_variety(spark, d):
    """Colours that a proposed name drops, where they are known to matter for its head."""
    noun = F.element_at(F.split("p_name", " "), 2)
    proposed = F.when(c("p_size") % 2 == 0, noun).otherwise(c("p_name"))
    return t(spark, d, "part").select("p_partkey", matching.retained_variety(c("p_name"), proposed, F.array(F.lit("red"), F.lit("blue"))).alias("name"))


# -- splits, verdicts, plans ------------------------------------------------------------------------------------------------


@query("gr2_split")
def gr2(spark, d):
    """Names of each brand, cut until the parts have a common word or no word cuts them."""
    x = t(spark, d, "part").select("p_brand", "p_name").distinct()
    return graph.split_components(x, "p_brand", "p_name")


@query("gr5_lexical_edges", """WITH n AS (SELECT DISTINCT p_name || ' lot' || p_partkey // 3 AS name, string_split(p_name || ' lot' || p_partkey // 3, ' ') AS w FROM part), x AS (SELECT name, w, unnest(w) AS word FROM n),
    rare AS (SELECT word FROM x WHERE length(word) >= 4 GROUP BY word HAVING count(*) BETWEEN 2 AND 4)
    SELECT DISTINCT a.name AS a, b.name AS b FROM x a JOIN x b ON a.word = b.word AND a.name < b.name JOIN rare ON rare.word = a.word WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.6 - 1e-9""")
def gr5_edges(spark, d):
    """Names that share a rare word and most of their words."""
    name = F.concat("p_name", F.lit(" lot"), F.floor(c("p_partkey") / 3).cast("string"))
    return similarity.lexical_edges(t(spark, d, "part").select(name.alias("name")), "name")


@query("gr5_larger_target", """WITH n AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2), best AS (SELECT DISTINCT ON (p_brand) p_brand, p_name AS target FROM n ORDER BY p_brand, n DESC, length(p_name), p_name DESC)
    SELECT p_brand, p_name, target FROM n JOIN best USING (p_brand) WHERE p_name <> target""")
def gr5_target(spark, d):
    """Merge targets where equal names go to the larger one."""
    n = t(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    key = F.concat_ws("|", "p_brand", "p_name")
    found = n.select("p_brand", key.alias("name"), F.lit(1.0).alias("purity"))
    got = similarity.merge_targets(found, "p_brand", "name", n.select(key.alias("name"), "n"), larger=True)
    part = lambda x: F.element_at(F.split(x, r"\|"), 2)
    return got.select("p_brand", part("name").alias("p_name"), part("target").alias("target"))


_VERDICTS = ["same_name", "plural_s", "singular", "near_and_common", "variant_review", "cross_category_review", "generic_to_specific_review", "empty_name_review"]


@query("gr8_verdicts", f"SELECT p_partkey, list_extract({_VERDICTS}, 1 + CAST(p_partkey % 8 AS INTEGER)) AS verdict FROM part")
def gr8(spark, d):
    """Pairs of names that may become one at once, and those that somebody must look at."""
    n, name = c("p_partkey") % 8, lambda tail: F.concat("p_name", F.lit(tail))
    source = F.when(n == 2, name(" berries")).when(n.isin(3, 4), name(" alpha")).when(n == 7, "").otherwise(c("p_name"))
    target = F.when(n == 0, F.upper("p_name")).when(n == 1, name("s")).when(n == 2, name(" berry")).when(n.isin(3, 4), name(" beta")).when(n == 6, name(" deluxe")).otherwise(c("p_name"))
    verdict = matching.merge_verdict(source, target, c("p_type"), F.when(n == 5, "OTHER").otherwise(c("p_type")), F.when(n == 3, 0.98).otherwise(0.9), F.lit(4), F.lit(9))
    return t(spark, d, "part").select("p_partkey", verdict.alias("verdict"))


@query("gr8_plan", """WITH n AS (SELECT p_name, split_part(p_name, ' ', 2) AS head, count(*) AS k FROM part GROUP BY 1), best AS (SELECT DISTINCT ON (head) head, p_name AS survivor FROM n WHERE head IN ('bolt', 'gear') ORDER BY head, k DESC, length(p_name), p_name),
    rows AS (SELECT a.p_name AS source, b.p_name AS target, a.head FROM n a JOIN n b ON a.head = b.head AND a.p_name < b.p_name)
    SELECT source, target, 'lateral' AS direction, CASE WHEN source = survivor THEN target WHEN target = survivor THEN source END AS loser, CASE WHEN survivor IN (source, target) THEN survivor END AS survivor,
    CASE WHEN survivor IS NULL THEN 'kept' WHEN survivor IN (source, target) THEN 'forced' ELSE 'superseded' END AS plan FROM rows LEFT JOIN best USING (head)""")
def gr8_plan(spark, d):
    """Pairs of names of one head against the merges that two heads' clusters propose."""
    n = t(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).withColumn("head", F.element_at(F.split("p_name", " "), 2))
    own = n.filter(c("head").isin("bolt", "gear")).select("head", c("p_name").alias("name"), "n", F.lit(1.0).alias("purity"))
    proposals = similarity.merge_targets(own.drop("n"), "head", "name", own.select("name", "n")).select("name", "target")
    rows = n.select("head", c("p_name").alias("source")).join(n.select("head", c("p_name").alias("target")), "head").filter("source < target")
    return similarity.consolidation_plan(rows.select("source", "target", F.lit(matching.LATERAL).alias("direction")), proposals)


_NO_FOOD = " OR ".join(f"contains(title, '{p}')" for p in titles.NO_FOOD_PARTS)


@query("q19_match_queue", f"""WITH q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN lower(p_type) || ' ' || p_name WHEN 2 THEN 'dog food ' || p_name ELSE 'zz' || p_size END AS title FROM part), food AS (SELECT *, {_NO_FOOD} AS bad FROM q),
    n AS (SELECT DISTINCT p_name FROM part), x AS (SELECT DISTINCT title, string_split(title, ' ') AS w FROM food WHERE NOT bad AND title NOT IN (SELECT p_name FROM n)), y AS (SELECT p_name, string_split(p_name, ' ') AS v FROM n),
    s AS (SELECT title, p_name, round(len(list_intersect(w, v)) / len(v) + 1.6 * len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) + CASE WHEN contains(title, p_name) THEN 0.75 ELSE 0 END + CASE WHEN contains(p_name, title) THEN 0.15 ELSE 0 END, 6) AS score
        FROM x JOIN y ON list_has_any(w, v)), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, p_name) AS r FROM s WHERE score >= 1) WHERE r = 1)
    SELECT p_partkey, CASE WHEN bad THEN NULL WHEN title IN (SELECT p_name FROM n) THEN title ELSE coalesce(p_name, title) END AS name, CASE WHEN NOT bad THEN score END AS score,
    CASE WHEN bad THEN 'no_food' WHEN title IN (SELECT p_name FROM n) THEN 'matched' WHEN p_name IS NOT NULL THEN 'remapped' ELSE 'new' END AS outcome FROM food LEFT JOIN best USING (title)""")
def q19(spark, d):
    """A queue of titles resolved: no food, known names, near names, new names."""
    n = c("p_partkey") % 4
    title = F.when(n == 0, c("p_name")).when(n == 1, F.concat_ws(" ", F.lower("p_type"), "p_name")).when(n == 2, F.concat(F.lit("dog food "), "p_name")).otherwise(F.concat(F.lit("zz"), c("p_size").cast("string")))
    queue = t(spark, d, "part").select("p_partkey", title.alias("title"))
    return similarity.resolved_names(queue, "p_partkey", "title", t(spark, d, "part").select("p_name"), "p_name")


# -- names alike, axes -------------------------------------------------------------------------------------------------------

_GRAMS = """WITH n AS (SELECT DISTINCT p_brand || ' ' || p_name AS name FROM part), g AS (SELECT name, list_distinct(flatten(list_transform(string_split(lower(replace(name, '#', ' ')), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS s FROM n)"""


@query("s12_similar_names", f"{_GRAMS} SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity FROM g a JOIN g b ON a.name < b.name WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.8 - 1e-9")
def s12_similar(spark, d):
    """Names of products with their brand whose padded trigrams are alike; rare trigrams find them."""
    n = t(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).distinct()
    grams = F.flatten(F.transform(text.tokens(c("name")), lambda w: text.grams(F.concat(F.lit("  "), w, F.lit(" ")), 3)))
    return similarity.jaccard_pairs(n.withColumn("s", grams), "name", "s", 0.8).withColumn("similarity", F.round("similarity", 6))


@query("s5_near_names", """WITH n AS (SELECT DISTINCT p_brand || ' ' || p_name AS name, string_split(lower(replace(p_brand || ' ' || p_name, '#', ' ')), ' ') AS s FROM part)
    SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM n a JOIN n b ON a.name < b.name WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.6 - 1e-9""")
def s5_near(spark, d):
    """Names that have most of their words in common."""
    n = t(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).distinct()
    return similarity.jaccard_pairs(n.withColumn("s", text.tokens(c("name"))), "name", "s", 0.6).withColumn("similarity", F.round("similarity", 6))


@query("pc2_lp_projection")
def pc2(spark, d):
    """Vectors on two axes of largest cubed distances, weighted by label."""
    e = t(spark, d, "embeddings").withColumn("w", c("label") + 1.0)
    mean, axes, _ = similarity.lp_axes(e, "embedding", "w", 3.0, 2)
    return similarity.projected(e.select("vec_id", "label", "embedding"), "embedding", mean, axes).drop("embedding")


@query("pc3_plain_projection")
def pc3(spark, d):
    """Vectors on the first two axes of a plain PCA."""
    e = t(spark, d, "embeddings").withColumn("w", F.lit(1.0))
    mean, axes, _ = similarity.weighted_pca(e, "embedding", "w", 2)
    return similarity.projected(e.select("vec_id", "label", "embedding"), "embedding", mean, axes).drop("embedding")
