"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's bad rate has a beta prior whose
mean is the posterior mean of the level above and whose strength is estimated from the data (method of moments for a
beta-binomial). A page is blocked when the lower posterior bound of its host's bad rate, a quantile of its beta
distribution, exceeds a limit.

A host's domain and suffix follow from its name: ports and user names are left out, a numeric address is its own domain
and suffix, and below a country's two letters a registry label such as `co` or `ac` belongs to the suffix.

Defined results: a null url or one without `://` has an empty host and path and is judged like any host of its own.
Outcomes that are null count nowhere. Without outcomes the prior mean is 0.5 of one pseudo-page and nothing is blocked.
Repeated rows are judged one by one, and repeated outcomes count as often as they occur. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, table, written

#: Rules of the query, host and path prefix.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Labels under which country registries register domains.
REGISTRY = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "govt", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Limits of the query: a host whose bad rate lies over this but for this tail of its posterior is blocked.
MAX_BAD_RATE = 0.35
TAIL = 0.05
#: Tasks over which a host's pages are dealt where reputations are too many to broadcast.
SALTS = 16
#: Bounds of a prior's strength, in pages.
STRENGTH = (1.0, 1000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(length, rule, verdict), or null; of equally long ones the greater text."""
    table = F.array(*[F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p, v in rules])
    fits = F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


#: The name in a host: without user, port and final dot; addresses in brackets stay whole.
_NAME = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*?)\.?(?::[0-9]*)?$"
_ADDRESS = r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"
_REGISTRY = rf"(^|\.)({'|'.join(REGISTRY)})\.[a-z]{{2}}$"


def registered_domain(host: Column) -> Column:
    """The public suffix and the label before it; the whole name if there is none."""
    name = F.regexp_extract(host, _NAME, 1)
    return F.when(name.rlike(_ADDRESS), name).otherwise(F.when(name.rlike(_REGISTRY), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2)))


def public_suffix(host: Column) -> Column:
    name = F.regexp_extract(host, _NAME, 1)
    return F.when(name.rlike(_ADDRESS), name).otherwise(F.when(name.rlike(_REGISTRY), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1)))


def beta_cdf(x, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distribution function of beta distributions at x, by its power series about the end that is nearer to x."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    flip = x > a / (a + b)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    log = np.frompyfunc(math.lgamma, 1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        lead = (log(p + q) - log(p + 1) - log(q)).astype(float) + p * np.log(y) + q * np.log1p(-y)
    term, total, n = np.ones(x.shape), np.ones(x.shape), 0
    while (term > 1e-17 * total).any():
        term = term * y * (p + q + n) / (p + 1 + n)
        total, n = total + term, n + 1
    part = np.where(y <= 0, 0.0, np.exp(lead) * total)
    return np.clip(np.where(flip, 1 - part, part), 0, 1)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros(np.shape(a)), np.ones(np.shape(a))
    for _ in range(45):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _bounds(mean: pd.Series, weight: pd.Series, tail: pd.Series) -> pd.DataFrame:
    a, b = (mean * weight).to_numpy(), ((1 - mean) * weight).to_numpy()
    p = float(tail.iloc[0]) if len(tail) else TAIL
    return pd.DataFrame({"lower": beta_quantile(p, a, b), "upper": beta_quantile(1 - p, a, b)})


def _strength(groups: DataFrame, parent: Column, n: str, k: str) -> float:
    """The strength of the beta priors that groups have from their parents, by the method of moments: how far groups of one
    parent differ beyond chance. Sums by parent first; one row comes to the driver."""
    n, k = F.col(n), F.col(k)
    g = groups.filter(n > 0).groupBy(parent.alias("parent")).agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kkn"))
    g = g.agg(
        F.count("*").alias("d"), F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("k") - F.col("kkn")).alias("inside"),
        F.sum(F.col("kkn") - F.col("k") * F.col("k") / F.col("n")).alias("between"), F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("size"),
    ).first()
    free = g["g"] - g["d"]
    if free < 1 or g["n"] <= g["g"]:
        return STRENGTH[1] if g["g"] else STRENGTH[0]
    between, within, size = g["between"] / free, g["inside"] / (g["n"] - g["g"]), g["size"] / free
    rho = (between - within) / (between + (size - 1) * within) if between + (size - 1) * within > 0 else 0.0
    return min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1]) if rho > 0 else STRENGTH[1]


def host_reputation(outcomes: DataFrame, url_col: str = "url", bad_col: str = "bad", tail: float = TAIL, pages: DataFrame | None = None) -> DataFrame:
    """host, domain, suffix, n, k (labelled pages, bad ones), mean and lower and upper bound of the bad rate of each host of outcomes and pages.

    A host without labelled pages has n = k = 0, so its mean is that of its domain, else of its suffix, else of all.
    Counts are summed per host once and written, so strengths, domains and suffixes read hosts, not pages.
    """
    host, _ = split_url(F.col(url_col))
    seen = outcomes.select(host.alias("host"), F.col(bad_col).cast("boolean").alias("bad"))
    if pages is not None:
        seen = seen.union(pages.select(host.alias("host"), F.lit(None).cast("boolean").alias("bad")))
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    hosts = written(hosts.select("host", registered_domain(F.col("host")).alias("domain"), public_suffix(F.col("host")).alias("suffix"), "n", "k"), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    total = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("sk"), F.lit(0)).alias("k")).first()
    mean = (total["k"] + 0.5) / (total["n"] + 1)
    s_suffix, s_domain, s_host = _strength(suffixes, F.lit(0), "sn", "sk"), _strength(domains, F.col("suffix"), "dn", "dk"), _strength(hosts, F.col("domain"), "n", "k")
    suffixes = suffixes.select("suffix", ((F.col("sk") + s_suffix * mean) / (F.col("sn") + s_suffix)).alias("sm"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("dk") + s_domain * F.col("sm")) / (F.col("dn") + s_domain)).alias("dm"))
    m = (F.col("k") + s_host * F.col("dm")) / (F.col("n") + s_host)
    out = hosts.join(domains, "domain").select("host", "domain", "suffix", "n", "k", m.alias("mean"))
    bounds = F.pandas_udf(_bounds, "lower double, upper double")
    return out.withColumn("b", bounds("mean", F.col("n") + F.lit(s_host), F.lit(tail))).select(*out.columns, "b.lower", "b.upper")


def filter_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad", rules=RULES, max_bad_rate: float = MAX_BAD_RATE, tail: float = TAIL) -> DataFrame:
    """id, host, path, rule, verdict, host_n, host_bad per row of pages. The bound of a host without outcomes is that of its prior."""
    host, path = split_url(F.col(url_col))
    df = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    df = df.withColumn("__r", rule_for(F.col("host"), F.col("path"), rules))
    rep = written(host_reputation(outcomes, url_col, bad_col, tail, pages).select("host", "n", "k", "lower"), "url-reputation")
    verdict = F.coalesce(F.col("__r.verdict"), F.when(F.col("lower") > max_bad_rate, "block").otherwise("allow"))
    if rep.count() <= BROADCAST_IDS:
        df = df.join(F.broadcast(rep), "host")
    else:  # a host may have a third of all pages: its rows are dealt over SALTS tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        df = df.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(rep.select("*", salts), ["host", "salt"])
    return df.select(id_col, "host", "path", F.col("__r.rule").alias("rule"), verdict.alias("verdict"), F.col("n").alias("host_n"), F.col("k").alias("host_bad"))


def page_outcomes(spark, sf_dir: str) -> DataFrame:
    """The labelled pages: a label belongs to the page of its id; low quality or toxic is bad."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return table(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), page_outcomes(spark, sf_dir))


_STRENGTH_SQL = """(SELECT CASE WHEN coalesce(g, 0) = 0 THEN 1.0 WHEN g - d < 1 OR n <= g OR rho <= 0 THEN 1000.0 ELSE least(greatest(1 / rho - 1, 1.0), 1000.0) END FROM (
  SELECT *, CASE WHEN between_ + (size_ - 1) * within_ > 0 THEN (between_ - within_) / (between_ + (size_ - 1) * within_) ELSE 0 END AS rho FROM (
    SELECT g, d, n, b / nullif(g - d, 0) AS between_, i / nullif(n - g, 0) AS within_, s / nullif(g - d, 0) AS size_ FROM (
      SELECT count(*)::DOUBLE AS d, sum(g) AS g, sum(n) AS n, sum(k - kkn) AS i, sum(kkn - k * k / n) AS b, sum(n - nn / n) AS s FROM (
        SELECT {p} AS par, count(*)::DOUBLE AS g, sum({n})::DOUBLE AS n, sum({k})::DOUBLE AS k, sum({n} * {n})::DOUBLE AS nn, sum({k} * {k} / {n}::DOUBLE) AS kkn FROM {t} WHERE {n} > 0 GROUP BY par)))))"""

OP4_SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, verdict) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
best AS (SELECT p.page_id, p.host, p.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS rv
    FROM p LEFT JOIN r ON (p.host = r.h OR suffix(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY p.page_id, p.host, p.path),
o AS (SELECT p.host, (l.quality = 0 OR l.toxic = 1) AS bad FROM p JOIN labels l ON l.doc_id = p.page_id UNION ALL SELECT host, NULL FROM p),
h0 AS (SELECT host, regexp_extract(host, '{_NAME}', 1) AS name, count(bad) AS n, count(*) FILTER (WHERE bad) AS k FROM o GROUP BY host),
h1 AS (SELECT *, string_split(name, '.') AS a, CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN 99 WHEN regexp_matches(name, '{_REGISTRY}') THEN 2 ELSE 1 END AS labels FROM h0),
h AS (SELECT host, n, k, array_to_string(a[-labels - 1:], '.') AS domain, array_to_string(a[-labels:], '.') AS suf FROM h1),
d AS (SELECT domain, suf, sum(n) AS dn, sum(k) AS dk FROM h GROUP BY domain, suf),
s AS (SELECT suf, sum(dn) AS sn, sum(dk) AS sk FROM d GROUP BY suf),
c AS (SELECT (SELECT (coalesce(sum(sk), 0) + 0.5::DOUBLE) / (coalesce(sum(sn), 0) + 1) FROM s) AS m, {_STRENGTH_SQL.format(p='0', n='sn', k='sk', t='s')} AS ss, {_STRENGTH_SQL.format(p='suf', n='dn', k='dk', t='d')} AS ds, {_STRENGTH_SQL.format(p='domain', n='n', k='k', t='h')} AS hs),
s2 AS (SELECT suf, (sk + ss * m) / (sn + ss) AS sm FROM s, c),
d2 AS (SELECT domain, (dk + ds * sm) / (dn + ds) AS dm FROM d JOIN s2 USING (suf), c),
h2 AS (SELECT host, n, k, (k + hs * dm) / (n + hs) AS hm, n + hs AS w FROM h JOIN d2 USING (domain), c),
-- The beta distribution function at the limit, by its power series; where the mean is no larger, the bound is below.
h3 AS (SELECT host, n, k, hm > {MAX_BAD_RATE} AND exp(lgamma(w) - lgamma(hm * w + 1) - lgamma((1 - hm) * w) + hm * w * ln({MAX_BAD_RATE}) + (1 - hm) * w * ln(1 - {MAX_BAD_RATE}))
    * list_sum(list_transform(range(0, 20000), lambda i: exp(lgamma(w + i) - lgamma(w) - lgamma(hm * w + 1 + i) + lgamma(hm * w + 1) + i * ln({MAX_BAD_RATE})))) < {TAIL} AS bad FROM h2)
SELECT page_id, best.host, path, rule, coalesce(rv, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, coalesce(n, 0) AS host_n, coalesce(k, 0) AS host_bad
FROM best LEFT JOIN h3 ON best.host = h3.host
"""
