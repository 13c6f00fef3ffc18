"""English stems of words, by the published suffix rules of the Porter2 algorithm, as column expressions.

A region test needs no counting: a suffix lies behind the first consonant that follows a vowel (region 1) exactly where
what stands before it holds such a pair, and in region 2 where it holds two of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm: its vowels, exceptions and suffixes. A y that acts as a consonant is written Y meanwhile.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
#: Words that a search leaves out.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

_HEAD = "gener|commun|arsen"
_REGION_1 = f"^({_HEAD})|^(?!{_HEAD}).*[aeiouy][^aeiouy]"
_REGION_2 = f"^({_HEAD}).*[aeiouy][^aeiouy]|^(?!{_HEAD}).*[aeiouy][^aeiouy].*[aeiouy][^aeiouy]"
_SHORT_END = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
_SHORT_WORD = "^([^aeiouy]+[aeiouy][^aeiouywxY]|[aeiouy][^aeiouy])$"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _is(word: Column, pattern: str) -> Column:
    return F.rlike(word, F.lit(pattern))


def _cut(word: Column, n: Column | int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def _replaced(word: Column, table: dict[str, str], allowed: Callable[[Column, Column], Column]) -> Column:
    """The longest suffix of the table gives way to its value, where `allowed` of the rest and the suffix."""
    values = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    suffix = F.regexp_extract(word, f"({'|'.join(sorted(table, key=len, reverse=True))})$", 1)
    return _let(suffix, lambda s: F.when(s == "", word).otherwise(_let(_cut(word, F.length(s)), lambda rest: F.when(allowed(rest, s), F.concat(rest, F.element_at(values, s))).otherwise(word))))


def _plural(w: Column) -> Column:
    two = F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    return F.when(_is(w, "sses$"), _cut(w, 2)).when(_is(w, "ie[ds]$"), two).when(_is(w, "[us]s$"), w).when(_is(w, "[aeiouy].+s$"), _cut(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    def mended(x: Column) -> Column:
        return F.when(_is(x, "(at|bl|iz)$") | _is(x, _SHORT_WORD), F.concat(x, F.lit("e"))).when(_is(x, "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(x, 1)).otherwise(x)

    long = F.regexp_replace(w, "eed(ly)?$", "")
    bare = F.regexp_replace(w, "(ingly|edly|ing|ed)$", "")
    return (
        F.when(_is(w, "eed(ly)?$"), F.when(_is(long, _REGION_1), F.concat(long, F.lit("ee"))).otherwise(w))
        .when(_is(w, "[aeiouy].*(ingly|edly|ing|ed)$"), _let(bare, mended)).otherwise(w)
    )


def _last(w: Column) -> Column:
    rest = _cut(w, 1)
    no_e = _is(w, "e$") & (_is(rest, _REGION_2) | _is(rest, _REGION_1) & ~_is(rest, _SHORT_END))
    return F.when(no_e | _is(w, "ll$") & _is(rest, _REGION_2), rest).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of an English word in lower case; null of null."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), "([aeiouy])y", "$1Y")
    r1, r2 = lambda x: _is(x, _REGION_1), lambda x: _is(x, _REGION_2)
    two = lambda x, s: r1(x) & F.when(s == "li", _is(x, "[cdeghkmnrt]$")).when(s == "ogi", _is(x, "l$")).otherwise(True)
    three = lambda x, s: F.when(s == "ative", r2(x)).otherwise(r1(x))
    four = lambda x, s: r2(x) & F.when(s == "ion", _is(x, "[st]$")).otherwise(True)
    steps = [
        _past,
        lambda w: F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"),
        lambda w: _replaced(w, STEP_2, two),
        lambda w: _replaced(w, STEP_3, three),
        lambda w: _replaced(w, dict.fromkeys(STEP_4, ""), four),
        _last,
        lambda w: F.replace(w, F.lit("Y"), F.lit("y")),
    ]

    def rest(w: Column, at: int = 0) -> Column:
        return w if at == len(steps) else _let(steps[at](w), lambda x: rest(x, at + 1))

    whole = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
    plural = _let(F.regexp_replace(marked, "('s'|'s|')$", ""), lambda w: _let(_plural(w), lambda x: F.when(x.isin(*KEPT_PLURALS), x).otherwise(rest(x))))
    return F.when((F.length(word) <= 2) | word.isin(*UNCHANGED), word).when(word.isin(*WHOLE), F.element_at(whole, word)).otherwise(plural)
