"""Name matching, communities, decisions and experiments over the driver's tables (roles as in relational)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching
from ..operators import similarity
from .catalog import query
from .tables import t

c = F.col
_NOUN = "split_part(p_name, ' ', 2)"


def _named(spark, d):
    """Distinct product names with their head noun and number of products."""
    n = t(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return n.withColumn("head", F.element_at(F.split("p_name", " "), -1))


@query("s9_name_score")
def s9(spark, d):
    """Product names with a common word, by the combined similarity score; pairs come from an equi-join on words."""
    w = _named(spark, d).select("p_name", F.explode(F.array_distinct(F.split("p_name", " "))).alias("x"))
    pairs = w.select(c("p_name").alias("a"), "x").join(w.select(c("p_name").alias("b"), "x"), "x").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("score", F.round(matching.name_similarity(c("a"), c("b")), 6))


@query("s10_direction", "SELECT p_partkey, CASE WHEN p_size > 25 AND list_contains(string_split(p_name, ' '), lower(p_type)) THEN 'lateral' WHEN p_size > 25 THEN 'generic_to_specific' WHEN p_size < 10 THEN 'specific_to_generic' ELSE 'lateral' END AS direction FROM part")
def s10(spark, d):
    name = c("p_name")
    other = F.when(c("p_size") > 25, F.concat_ws(" ", F.lower("p_type"), name)).when(c("p_size") < 10, F.element_at(F.split(name, " "), 2)).otherwise(F.upper(name))
    return t(spark, d, "part").select("p_partkey", matching.remap_direction(name, other).alias("direction"))


@query("s20_non_food", "SELECT p_partkey, p_size % 5 IN (0, 1, 3) AS non_food FROM part")
def s20(spark, d):
    """Titles made from names and words that are, or are not, of the lists; word groups need not stand together."""
    tail = F.element_at(F.array(*map(F.lit, [" dog food", " Lip-OIL!", " paste", " tooth and paste", " sauce"])), (c("p_size") % 5 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", matching.is_non_food(F.concat("p_name", tail)).alias("non_food"))


@query("s28_lines", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size || ' 1/2' WHEN 1 THEN p_size || '-' || (p_size + 1) WHEN 2 THEN p_size::VARCHAR ELSE '' END AS quantity,
    CASE p_size % 4 WHEN 0 THEN 'cups' WHEN 1 THEN 'oz' ELSE '' END AS unit, p_name AS name FROM part""")
def s28(spark, d):
    """Recipe lines written from known parts and read again."""
    s, name, kind = c("p_size").cast("string"), c("p_name"), c("p_size") % 4
    line = F.when(kind == 0, F.concat(s, F.lit(" 1/2  cups "), name)).when(kind == 1, F.concat(F.lit(" "), s, F.lit(" - "), (c("p_size") + 1).cast("string"), F.lit(" oz. "), name))
    line = line.when(kind == 2, F.concat_ws(" ", s, name)).otherwise(name)
    return t(spark, d, "part").select("p_partkey", matching.ingredient_line(line).alias("x")).select("p_partkey", "x.quantity", "x.unit", "x.name")


@query("m16_new_name_risk", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'dynamic_token_confidence_floor' WHEN p_size % 5 = 1 THEN 'retail_title_like' WHEN p_size % 5 = 2 THEN 'high_noise_density' WHEN p_size % 5 = 3 THEN 'repeated_token_sequence' END AS reason FROM part""")
def m16(spark, d):
    """One name for each rule, built around a product's own; the last takes none."""
    make = [("minute {} box", "other", 0.5), ("{} with 12 more words", "dairy", 0.9), ("fresh {} pack", "dairy", 0.9), ("{} mix mix", "dairy", 0.9), ("{}", "other", 0.1)]
    rows = F.array(*[F.struct(F.replace(F.lit(n), F.lit("{}"), c("p_name")).alias("n"), F.lit(k).alias("k"), F.lit(p).alias("p")) for n, k, p in make])
    x = t(spark, d, "part").select("p_partkey", F.element_at(rows, (c("p_size") % 5 + 1).cast("int")).alias("x"))
    return x.select("p_partkey", matching.new_name_risk(c("x.n"), c("x.k"), c("x.p")).alias("reason"))


@query("m17_remap_policy", """SELECT l_returnflag, count(*) FILTER (WHERE CASE l_returnflag WHEN 'A' THEN l_quantity / 50 >= 0.95 AND 100 - l_tax * 100 >= 98 - 1e-7 WHEN 'R' THEN l_quantity / 50 >= 0.9 AND 100 - l_tax * 100 >= 99 - 1e-7 ELSE l_quantity / 50 >= 0.85 AND 100 - l_tax * 100 >= 96 - 1e-7 END) AS allowed, count(*) AS n FROM lineitem GROUP BY 1""")
def m17(spark, d):
    way = F.when(c("l_returnflag") == "A", matching.GENERIC_TO_SPECIFIC).when(c("l_returnflag") == "R", matching.SPECIFIC_TO_GENERIC).otherwise(matching.LATERAL)
    ok = matching.remap_allowed(way, c("l_quantity") / 50, 1 - c("l_tax"))
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(ok).alias("allowed"), F.count("*").alias("n"))


@query("m19_recipe_quality", """SELECT o_orderkey, CAST(1000 * round(CAST(0.15::DOUBLE * 1 + 0.35::DOUBLE * (CASE WHEN n < 3 THEN 0.4::DOUBLE ELSE least(1, n / 8) END) + 0.25::DOUBLE * (CASE WHEN n < 2 THEN 0.5::DOUBLE ELSE least(1, n / 5) END) + 0.15::DOUBLE * (CASE WHEN len < 3 THEN 0 ELSE least(1, len / 10) END) + 0.1::DOUBLE * (CASE WHEN k < 0.5 THEN 0 ELSE k END) AS DECIMAL(18, 9)), 3) AS INTEGER) AS points
    FROM (SELECT o_orderkey, count(*)::DOUBLE AS n, avg(length(p_name)) AS len, count(DISTINCT p_name)::DOUBLE / count(*) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1)""")
def m19(spark, d):
    """Orders as recipes, their products as ingredients and their lines as steps; points of 1000."""
    p = t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_name")
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(p, "l_partkey").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_list("p_name").alias("names"), F.collect_list(c("l_linenumber").cast("string")).alias("steps"))
    x = t(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(li, "o_orderkey")
    return x.select("o_orderkey", F.round(matching.recipe_quality(c("o_orderpriority"), c("names"), c("steps"))["score"] * 1000).cast("int").alias("points"))


@query("m20_verification", "SELECT CASE WHEN value >= 42.5 THEN 'auto_accepted' ELSE 'needs_confirmation' END AS status, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1 UNION ALL SELECT 'pending', count(*) FROM events WHERE value IS NULL HAVING count(*) > 0")
def m20(spark, d):
    return t(spark, d, "events").groupBy(matching.verification(c("value") / 50).alias("status")).agg(F.count("*").alias("n"))


@query("m22_journey", """SELECT user_id, least(12, p + v) AS progress, CAST(floor(100.0 * least(12, p + v) / 12 + 0.5) AS INTEGER) AS percent, p + v >= 12 AS completed FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'signup') AS v FROM events GROUP BY 1)""")
def m22(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg(F.count_if(c("event_type") == "purchase").alias("p"), F.count_if(c("event_type") == "signup").alias("v"))
    return g.select("user_id", matching.journey(c("p"), F.lit(12), c("v")).alias("j")).select("user_id", "j.progress", "j.percent", "j.completed")


@query("ml3_remap", """WITH x AS (SELECT p_partkey, list_contains(string_split(p_name, ' '), lower(p_type)) AS same, round(800 + p_size * 2 - CASE WHEN p_type = 'ECONOMY' THEN 500 ELSE 0 END) AS s1, 940 + 10 * (p_size % 7) AS s2, 800 + 4 * p_size AS conf FROM part),
    y AS (SELECT p_partkey, CASE WHEN s1 > s2 THEN 'specific_to_generic' WHEN same THEN 'lateral' ELSE 'generic_to_specific' END AS direction, greatest(s1, s2) AS s, conf FROM x)
    SELECT p_partkey, direction, CASE WHEN ok THEN 'remapped' ELSE 'skipped' END AS decision, CASE WHEN s < 960 THEN 'below_similarity_threshold' WHEN ok THEN 'applied' ELSE 'asymmetric_' || direction END AS reason FROM
    (SELECT *, CASE direction WHEN 'lateral' THEN conf >= 850 AND s >= 960 WHEN 'generic_to_specific' THEN conf >= 950 AND s >= 980 ELSE conf >= 900 AND s >= 990 END AS ok FROM y)""")
def ml3(spark, d):
    """For each product a more generic and a more specific name as candidates; the first loses score, so the second is best."""
    p = t(spark, d, "part").withColumn("name", F.concat_ws(" ", "p_name", c("p_partkey").cast("string")))
    some = p.select("p_partkey", "name", c("p_type").alias("category"), (F.lit(0.8) + c("p_size") / 250.0).alias("confidence"), F.explode(F.array(
        F.struct(c("p_name").alias("candidate"), F.when(c("p_type") == "ECONOMY", "x").otherwise(c("p_type")).alias("candidate_category"), (F.lit(0.9) + c("p_size") / 500.0).alias("similarity")),
        F.struct(F.concat_ws(" ", F.lower("p_type"), "name").alias("candidate"), c("p_type").alias("candidate_category"), (F.lit(0.94) + (c("p_size") % 7) / 100.0).alias("similarity")),
    )).alias("x")).select("p_partkey", "name", "category", "confidence", "x.*")
    out = similarity.remap_decisions(some, "name")
    return out.select(F.element_at(F.split("name", " "), -1).cast("long").alias("p_partkey"), "direction", "decision", "reason")


@query("ml7_modifiers", f"""WITH p AS (SELECT p_type, p_name, count(*) AS w FROM part GROUP BY 1, 2), x AS (SELECT {_NOUN} AS head, unnest(list_distinct([lower(p_type), split_part(p_name, ' ', 1)])) AS word, w FROM p),
    h AS (SELECT {_NOUN} AS head, sum(w) AS total FROM p GROUP BY 1) SELECT head, word, CAST(sum(w) AS BIGINT) AS weight, count(*) AS n_pairs FROM (SELECT * FROM x WHERE length(word) >= 3) JOIN h USING (head)
    GROUP BY head, word, total HAVING sum(w) >= 8 OR (sum(w) >= 3 AND count(*) >= 2 AND sum(w) / total >= 0.08)""")
def ml7(spark, d):
    """Modifiers that are lost when a typed product name is merged into its head noun."""
    p = t(spark, d, "part").groupBy("p_type", "p_name").agg(F.count("*").alias("w"))
    x = p.select(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("a"), F.element_at(F.split("p_name", " "), 2).alias("b"), "w")
    return similarity.learned_modifiers(x, "a", "b", "w")


@query("gr3_communities", f"""WITH n AS (SELECT p_name, {_NOUN} AS head, count(*) OVER (PARTITION BY {_NOUN}) AS cluster_size FROM (SELECT DISTINCT p_name FROM part)) SELECT head, p_name, cluster_size, 1::BIGINT AS common, 0.5::DOUBLE AS purity FROM n WHERE cluster_size >= 3""")
def gr3(spark, d):
    return similarity.communities(_named(spark, d), "head", "p_name", coverage=0.5)


@query("gr4_targets", f"""WITH n AS (SELECT p_name, {_NOUN} AS head, count(*) AS n, count(*) OVER (PARTITION BY {_NOUN}) AS size FROM part GROUP BY 1, 2), b AS (SELECT DISTINCT ON (head) head, p_name AS target FROM n WHERE size >= 3 ORDER BY head, n DESC, length(p_name), p_name)
    SELECT head, p_name, target FROM n JOIN b USING (head) WHERE p_name <> target""")
def gr4(spark, d):
    n = _named(spark, d)
    return similarity.merge_targets(similarity.communities(n, "head", "p_name", coverage=0.5), "head", "p_name", n)


@query("gr6_clustering", """WITH e AS (SELECT DISTINCT least(o_custkey, l_suppkey) AS u, greatest(o_custkey, l_suppkey) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey), g AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY 1),
    w AS (SELECT a.u AS x, a.v AS y, b.v AS z FROM e a JOIN e b ON b.u = a.v JOIN e k ON k.u = a.u AND k.v = b.v), m AS (SELECT node, count(*) AS triangles FROM (SELECT unnest([x, y, z]) AS node FROM w) GROUP BY 1)
    SELECT node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree < 2 THEN 0 ELSE 2.0::DOUBLE * coalesce(triangles, 0) / (degree * (degree - 1)) END, 9) AS coefficient FROM g LEFT JOIN m USING (node)""")
def gr6(spark, d):
    """Users and stores as nodes of one graph by number, linked by purchases."""
    o = t(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("a"))
    e = t(spark, d, "lineitem").select("l_orderkey", c("l_suppkey").alias("b")).join(o, "l_orderkey").select("a", "b")
    return similarity.clustering_coefficients(e).withColumn("coefficient", F.round("coefficient", 9))


_MEDOID = f"""n AS (SELECT p_name, {_NOUN} AS head, count(*) AS n, count(*) OVER (PARTITION BY {_NOUN}) AS size FROM part GROUP BY 1, 2), b AS (SELECT DISTINCT p_name, {_NOUN} AS head, p_brand FROM part), s AS (SELECT x.head, x.p_name, count(*) / 25.0::DOUBLE AS s FROM b x JOIN b y ON x.head = y.head AND x.p_brand = y.p_brand AND x.p_name <> y.p_name GROUP BY 1, 2),
    k AS (SELECT n.head, n.p_name, n.n, coalesce(s.s, 0) / (size - 1) AS mean, round(0.7 * coalesce(s.s, 0) / (size - 1) + 0.1::DOUBLE + 0.1 * least(1.0, ln(1 + n) / ln(101.0)), 9) AS score FROM n LEFT JOIN s ON s.head = n.head AND s.p_name = n.p_name WHERE size >= 3), best AS (SELECT DISTINCT ON (head) head, p_name AS best, score FROM k ORDER BY head, score DESC, mean DESC, n DESC, length(p_name), p_name)"""


def _brand_pairs(spark, d):
    """Names of one noun that brands share; similarity is the share of 25 brands."""
    b = t(spark, d, "part").select("p_name", "p_brand").distinct().withColumn("head", F.element_at(F.split("p_name", " "), 2))
    x = b.select(c("p_name").alias("a"), "p_brand", "head").join(b.select(c("p_name").alias("b"), "p_brand", "head"), ["p_brand", "head"]).filter("a < b")
    return x.groupBy("a", "b").agg((F.count("*") / 25.0).cast("double").alias("similarity"))


@query("gr10_medoids", f"WITH {_MEDOID} SELECT head, best AS medoid, 'initiation_best_score' AS reason FROM best")
def gr10(spark, d):
    n = _named(spark, d)
    return similarity.medoids(similarity.communities(n, "head", "p_name", coverage=0.5), "head", "p_name", _brand_pairs(spark, d), n).select("head", "medoid", "reason")


@query("gr10_medoids_kept", f"""WITH {_MEDOID}, old AS (SELECT head, min(p_name) AS old FROM n GROUP BY head) SELECT head, CASE WHEN best <> old AND best.score >= k.score + 0.05 THEN best ELSE old END AS medoid,
    CASE WHEN best <> old AND best.score >= k.score + 0.05 THEN 'perturbation_promoted_better_candidate' ELSE 'perturbation_retained_previous_medoid' END AS reason FROM best JOIN old USING (head) JOIN k ON k.head = best.head AND k.p_name = old""")
def gr10_kept(spark, d):
    """A medoid stays unless another name scores clearly more."""
    n = _named(spark, d)
    old = n.join(n.groupBy("head").agg(F.min("p_name").alias("medoid")), "head").select("p_name", "medoid")
    return similarity.medoids(similarity.communities(n, "head", "p_name", coverage=0.5), "head", "p_name", _brand_pairs(spark, d), n, old, 0.05).select("head", "medoid", "reason")


@query("pc1_weighted_projection")
def pc1_weighted(spark, d):
    """Vectors on the first two axes of a PCA weighted by label."""
    e = t(spark, d, "embeddings").withColumn("w", c("label") + 1.0)
    mean, axes, _ = similarity.weighted_pca(e, "embedding", "w", 2)
    return similarity.projected(e.select("vec_id", "label", "embedding"), "embedding", mean, axes).drop("embedding")


@query("ex1_traffic_split")
def ex1(spark, d):
    """One experiment per order status with priorities as variants; large orders are conversions."""
    v = t(spark, d, "orders").groupBy(c("o_orderstatus").alias("experiment"), c("o_orderpriority").alias("variant")).agg(F.count("*").alias("exposures"), F.count_if(c("o_totalprice") > 250000).alias("conversions"))
    return similarity.traffic_split(v, "experiment", 7)


@query("s31_retail_suffix", "SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN p_name END AS name FROM part")
def s31(spark, d):
    """Shop titles made from names, and the names found again; the last kind has nothing to strip."""
    s = c("p_size").cast("string")
    title = F.element_at(F.array(F.concat("p_name", F.lit(", "), s, F.lit(" oz Bag")), F.concat("p_name", F.lit(" "), s, F.lit("oz")), F.concat_ws(" ", "p_name", s, F.lit("ct"), F.lit("2 pack")), F.concat("p_name", F.lit(" soup"))), (c("p_size") % 4 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", matching.without_retail_suffix(title).alias("name"))


@query("s22_store_parent", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'kroger' WHEN 1 THEN 'aholddelhaize' WHEN 2 THEN 'traderjoes' WHEN 3 THEN 'independent' WHEN 4 THEN NULL ELSE 'heb' END AS parent FROM supplier")
def s22(spark, d):
    names = F.array(*map(F.lit, ["Fry's No. ", "STOP & SHOP #", "Trader Joe’s ", "Corner Deli ", "Old School ", "H-E-B "]))
    return t(spark, d, "supplier").select("s_suppkey", matching.store_parent(F.concat(F.element_at(names, (c("s_suppkey") % 6 + 1).cast("int")), F.lit("x"))).alias("parent"))


@query("m14_collocations", """WITH t AS (SELECT string_split(trim(regexp_replace(lower(text), ' +', ' ', 'g'), ' '), ' ') AS w FROM conversations WHERE trim(text, ' ') <> ''), n AS (SELECT word, count(*)::DOUBLE AS n FROM (SELECT unnest(w) AS word FROM t) GROUP BY 1),
    j AS (SELECT a, b, count(*) AS joint FROM (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t)) GROUP BY 1, 2), s AS (SELECT (SELECT sum(n) FROM n)::DOUBLE AS aw, (SELECT sum(joint) FROM j)::DOUBLE AS ap)
    SELECT a, b, joint, round(greatest(0::DOUBLE, ln((joint / ap) / ((x.n / aw) * (y.n / aw)))), 6) AS ppmi FROM j JOIN n x ON x.word = a AND x.n >= 5 JOIN n y ON y.word = b AND y.n >= 5, s WHERE joint >= 3""")
def m14_collocations(spark, d):
    return similarity.collocations(t(spark, d, "conversations"), "text")


@query("s14_weighted_similarity", f"""WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS word FROM n) GROUP BY 1), i AS (SELECT word, ln(((SELECT count(*) FROM n) + 1.0::DOUBLE) / (df + 1)) AS idf FROM w), p AS (SELECT p_name, split_part(p_name, ' ', 1) AS x, {_NOUN} AS y FROM n)
    SELECT a.p_name AS a, b.p_name AS b, round((CASE WHEN a.x = b.x THEN ax.idf ELSE ay.idf END) / (ax.idf + ay.idf + CASE WHEN a.x = b.x THEN bz.idf ELSE bx.idf END), 6) AS similarity FROM p a JOIN p b ON a.p_name < b.p_name AND (a.x = b.x OR a.y = b.y) JOIN i ax ON ax.word = a.x JOIN i ay ON ay.word = a.y JOIN i bx ON bx.word = b.x JOIN i bz ON bz.word = b.y""")
def s14(spark, d):
    """Names with a common word, by the weight of what they share."""
    n = _named(spark, d).select("p_name")
    w = n.select("p_name", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    pairs = w.select(c("p_name").alias("a"), "word").join(w.select(c("p_name").alias("b"), "word"), "word").filter("a < b").select("a", "b").distinct()
    out = similarity.weighted_word_similarity(pairs, "a", "b", w.groupBy("word").agg(F.count("*").alias("df")), n.count())
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"))
