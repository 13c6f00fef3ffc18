"""Text functions on columns: names, tokens, similarities, prices, codes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain form, one to one, then one to two.
MARKED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōőøřśšşťùúûüūůűýÿźžżłđ"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnoooooooorssstuuuuuuuyyzzzld"
DOUBLE = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))


def plain_name(name: Column) -> Column:
    """Lower case without marks; what is no letter, digit or space becomes a space; single spaces, none at the ends."""
    x = F.translate(F.lower(name), MARKED, PLAIN)
    for a, b in DOUBLE:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9 ]", " "), " +", " "))


def singular(word: Column) -> Column:
    """A word's singular by its ending; words of three letters or fewer stay."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(n <= 3, word)
        .when(F.endswith(word, F.lit("ies")) & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(F.endswith(word, F.lit("oes")) & (n > 4), cut(2))
        .when(F.rlike(word, F.lit("(ss|sh|ch|x|z)es$")), cut(2))
        .when(F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), cut(1))
        .otherwise(word)
    )


def tokens(name: Column, shortest: int = 1) -> Column:
    """Words of a plain name of at least that many letters."""
    return F.filter(F.split(plain_name(name), " "), lambda w: F.length(w) >= shortest)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of all elements of two arrays, 0 where both are empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared elements of the smaller array's."""
    return ratio(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared elements of both arrays' distinct elements."""
    return ratio(2 * F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigrams, each word padded by two spaces before and one behind."""
    own = lambda x: F.array_distinct(F.flatten(F.transform(tokens(x), lambda w: grams(F.concat(F.lit("  "), w, F.lit(" ")), 3))))
    return jaccard(own(a), own(b))


def price(text: Column) -> Column:
    """The number at the start of what is left of digits, points and minus signs; else null."""
    kept = F.regexp_replace(text, "[^0-9.-]", "")
    return F.nullif(F.regexp_extract(kept, r"^(-?\d*\.?\d+)", 1), F.lit("")).cast("double")


def zip_code(text: Column) -> Column:
    """The five digits that it starts with, else empty."""
    return F.regexp_extract(text, r"^\s*(\d{5})", 1)


def iso_minutes(text: Column) -> Column:
    """Minutes of PT#H#M, else the first whole number."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(F.rlike(text, F.lit(r"^PT(\d+H)?(\d+M)?")), part("H") * 60 + part("M")).otherwise(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("int"))


def idempotency_key(*parts: Column) -> Column:
    """Parts that are not blank, trimmed, lower-cased, joined by colons."""
    return F.concat_ws(":", *[F.nullif(F.lower(F.trim(p.cast("string"))), F.lit("")) for p in parts])
