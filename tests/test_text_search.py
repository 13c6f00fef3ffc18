"""Stems, ranked text search, containment and name search against plain Python."""

import math
import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from larder.functions.stemming import STOP_WORDS, stem
from larder.operators import similarity, text_search

DIR = "/root/testdata/sf0.001"
#: Published examples of the algorithm.
KNOWN = """consign consigned consigning consignment consist consisted consistency consistent consistently consisting consists|consign consign consign consign consist consist consist consist consist consist consist
consolation consolations consolatory console consoled consoles consolidate consolidated consolidating consoling|consol consol consolatori consol consol consol consolid consolid consolid consol
consolingly consols consonant consort consorted consorting conspicuous conspicuously conspiracy conspirator|consol consol conson consort consort consort conspicu conspicu conspiraci conspir
knack knackeries knacks knag knave knaves knavish kneaded kneading knee kneel kneeled kneeling kneels knees knell|knack knackeri knack knag knave knave knavish knead knead knee kneel kneel kneel kneel knee knell
knelt knew knick knif knife knight knightly knights knit knits knitted knitting knives knob knobs knock knocked|knelt knew knick knif knife knight knight knight knit knit knit knit knive knob knob knock knock
generate generates general generally generic generously communication communism arsenic|generat generat general general generic generous communic communism arsenic
skies dying gently news hopping hoping hoped running relational happy cry by say ties tied cries gas this|sky die gentl news hop hope hope run relat happi cri by say tie tie cri gas this"""


def plain_stem(w):
    """The same algorithm by positions of regions."""
    vowels = "aeiouy"
    special = dict(zip("skis skies dying lying tying idly gently ugly early only singly sky news howe atlas cosmos bias andes".split(), "ski sky die lie tie idl gentl ugli earli onli singl sky news howe atlas cosmos bias andes".split()))
    if w in special:
        return special[w]
    if len(w) <= 2:
        return w
    w = list(w.removeprefix("'"))
    for i, x in enumerate(w):
        if x == "y" and (i == 0 or w[i - 1] in vowels):
            w[i] = "Y"
    w = "".join(w)

    def after(s, start):
        for i in range(start + 1, len(s)):
            if s[i] not in vowels and s[i - 1] in vowels:
                return i + 1
        return len(s)

    head = next((h for h in ("gener", "commun", "arsen") if w.startswith(h)), None)
    r1 = len(head) if head else after(w, 0)
    r2 = after(w, r1)
    ends = lambda s, *xs: max((x for x in xs if s.endswith(x)), key=len, default=None)
    short_end = lambda s: len(s) == 2 and s[0] in vowels and s[1] not in vowels or len(s) > 2 and s[-1] not in vowels + "wxY" and s[-2] in vowels and s[-3] not in vowels
    if x := ends(w, "'", "'s", "'s'"):
        w = w[: -len(x)]
    x = ends(w, "sses", "ied", "ies", "s", "us", "ss")
    if x == "sses":
        w = w[:-2]
    elif x in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif x == "s" and any(y in vowels for y in w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    x = ends(w, "eed", "eedly", "ed", "edly", "ing", "ingly")
    if x in ("eed", "eedly"):
        if len(w) - len(x) >= r1:
            w = w[: -len(x)] + "ee"
    elif x and any(y in vowels for y in w[: -len(x)]):
        w = w[: -len(x)]
        if ends(w, "at", "bl", "iz") or r1 >= len(w) and short_end(w):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    two = "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:"
    two = dict(x.split(":") for x in two.split())
    if (x := ends(w, *two)) and len(w) - len(x) >= r1:
        rest = w[: -len(x)]
        if x == "ogi" and rest[-1:] != "l" or x == "li" and rest[-1:] not in tuple("cdeghkmnrt"):
            pass
        else:
            w = rest + two[x]
    three = dict(x.split(":") for x in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
    if (x := ends(w, *three)) and len(w) - len(x) >= (r2 if x == "ative" else r1):
        w = w[: -len(x)] + three[x]
    if (x := ends(w, *"al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())) and len(w) - len(x) >= r2:
        if x != "ion" or w[-4:-3] in ("s", "t"):
            w = w[: -len(x)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def test_stems(spark):
    known = {}
    for line in KNOWN.split("\n"):
        known |= dict(zip(*(x.split() for x in line.split("|"))))
    rng = random.Random(4)
    ends = "s es ed ing ingly edly ly ness ful ational tional ization ize ative ate er ement ment ent ion tion y ies ied ll e eed eedly ogi logy ism ous ousness iviti ability ical".split()
    made = {"".join(rng.choice("bcdfglmnprstvwxaeiouy") for _ in range(rng.randint(1, 6))) + rng.choice([rng.choice(ends), rng.choice(ends) + rng.choice(ends), ""]) for _ in range(6000)}
    texts = pd.read_parquet(f"{DIR}/documents.parquet").text.head(60)
    made |= {w for x in texts for w in re.findall("[a-z]+", x.lower())} | set(known)
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in sorted(made)], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in known} == known
    assert got == {w: plain_stem(w) for w in made}
    assert spark.sql("select cast(null as string) w").select(stem(F.col("w"))).first()[0] is None


def plain_words(x):
    return [w for w in re.split(r"[^\w]+|_", (x or "").lower()) if w]


def plain_search(texts, queries, k):
    held = {i: Counter(plain_stem(w) for w in plain_words(x) if w not in STOP_WORDS) for i, x in texts.items()}
    out = {}
    for q, x in queries.items():
        stems = {plain_stem(w) for w in plain_words(x) if w not in STOP_WORDS}
        found = []
        for i, n in held.items():
            if stems and all(s in n for s in stems):
                w = sum(0.1 * sum(1 / j**2 for j in range(1, n[s] + 1)) / 1.64493406685 for s in stems)
                found.append((-round(w / (1 + math.log(len(plain_words(texts[i])))) / len(stems), 9), i))
        out |= {(q, i): -r for r, i in sorted(found)[:k]}
    return out


def test_search_texts(spark):
    rng = random.Random(7)
    words = "run running runs runner cook cooks cooked cooking recipe recipes onion onions salt salted the and of flour floury knives knife".split()
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for i in range(300)} | {900: None, 901: "", 902: "the of and"}
    queries = {0: "running recipes", 1: "the and of", 2: "onion", 3: "salted COOKED knives, flour!", 4: "unknown onion", 5: None, 6: "the runner"}
    t = spark.createDataFrame([*texts.items(), (None, "run")], "id long, body string")
    q = spark.createDataFrame(list(queries.items()), "n long, asked string")
    for k in (1, 5, 400):
        rows = text_search.search_texts(t, "id", "body", q, "n", "asked", k).collect()
        got = {(r.query, r.text): r["rank"] for r in rows}
        want = plain_search(texts, queries, k)
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in got)
        places = {}
        for r in rows:
            places.setdefault(r.query, []).append((r.place, -r["rank"], r.text))
        assert all([p for p, _, _ in sorted(x)] == list(range(1, len(x) + 1)) and sorted(x) == sorted(x, key=lambda y: y[1:]) for x in places.values())
    assert text_search.search_texts(t.limit(0), "id", "body", q, "n", "asked", 3).count() == 0


def test_contained(spark):
    rng = random.Random(1)
    inner = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(150)}
    outer = {"".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(400)} | set(list(inner)[:20])
    a, b = (spark.createDataFrame([(x,) for x in [*s, None]], "x string") for s in (inner | {""}, outer))
    df = text_search.contained(a, "x", b, "x")
    assert sorted(map(tuple, df.collect())) == sorted((p, w) for p in inner for w in outer if p in w)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_search_names(spark):
    names = ["red onions", "onion", "Red Onion Soup", "salt", "sea salt flakes", "chicken breast", "chickens", "on"]
    queries = ["red onion", "onion soup", "SALT", "chicken", "breasts of chicken", "zzz"]
    grams = lambda x: {g for w in plain_words(x) for g in (("  " + w + " ")[i : i + 3] for i in range(len(w) + 1))}
    want = {}
    ranks = plain_search(dict(enumerate(names)), dict(enumerate(queries)), 100)
    for j, q in enumerate(queries):
        for i, n in enumerate(names):
            ql, nl = q.lower(), n.lower()
            like = len(grams(ql) & grams(nl)) / len(grams(ql) | grams(nl)) >= 0.3 - 1e-9
            if (j, i) in ranks or like or ql in nl or nl in ql:
                u, v = set(plain_words(ql)), set(plain_words(nl))
                score = ranks.get((j, i), 0) + 1.6 * len(u & v) / len(u | v) + 0.75 * (nl in ql) + 0.15 * (ql in nl)
                if round(score, 6) > 0.1:
                    want[ql, n] = score
    q, n = (spark.createDataFrame([(x,) for x in [*s, None]], "x string") for s in (queries, names))
    got = {(r.query, r.name): r.score for r in text_search.search_names(q, "x", n, "x").collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in got)


def test_jaccard_join_by_counts(spark):
    """In any parts the pairs of a loop, and no rows for what frequent elements have in common."""
    rng = random.Random(3)
    sets = [{"the", *(f"e{int(rng.expovariate(0.1))}" for _ in range(rng.randint(0, 6)))} if i % 9 else set() for i in range(150)]
    df = spark.createDataFrame([(f"k{i}", sorted(s)) for i, s in enumerate(sets)] + [("none", None), (None, ["the"])], "k string, s array<string>")
    right = df.withColumnRenamed("k", "id")
    want = {(f"k{i}", f"k{j}"): len(x & y) / len(x | y) for i, x in enumerate(sets) for j, y in enumerate(sets) if x & y and len(x & y) / len(x | y) >= 0.3}
    for rows in (20_000, 40):
        found = similarity.jaccard_join(df, "k", right, "id", "s", 0.3, rows)
        got = found.collect()
        assert len(got) == len(want) and {(r.k, r.id): r.similarity for r in got} == want
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
