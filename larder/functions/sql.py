"""The functions that queries in plain SQL use: scalar ones as SQL functions, and lines of a recipe as a table function.

`register(spark)` makes them known to a session under the names below; optional arguments are nullable ones with a default.
Each agrees with the column function of the same rule, which the tests hold it against.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import matching, text, units


def _sizes(kind: dict[str, float], of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{u}' THEN {x!r}D" for u, x in kind.items()) + " END"


def _base(of: str) -> str:
    return f"coalesce({', '.join(_sizes(kind, of) for kind in (units.MASS, units.VOLUME, units.COUNT))})"


_SAME = " ".join(f"WHEN {_sizes(kind, 'unit')} IS NOT NULL AND {_sizes(kind, 'wanted')} IS NOT NULL THEN quantity * {_sizes(kind, 'unit')} / {_sizes(kind, 'wanted')}" for kind in (units.MASS, units.VOLUME, units.COUNT))
_PLAIN = f"translate(lower(name), '{text.MARKED}', '{text.PLAIN}')"
for _one, _two in text.DOUBLE:
    _PLAIN = f"replace({_PLAIN}, '{_one}', '{_two}')"

#: Parameters, type and body of each function.
FUNCTIONS = {
    "whole_packages": ("need DOUBLE, size DOUBLE", "BIGINT", "CASE WHEN size IS NULL OR size <= 0 THEN 1 ELSE greatest(1, ceil(need / size)) END"),
    "budget_surplus": ("budget DOUBLE, spent DOUBLE", "DOUBLE", "greatest(0, budget - spent)"),
    "goal_percent": ("balance DOUBLE, target DOUBLE", "INT", "CASE WHEN target <= 0 THEN 0 ELSE least(100, greatest(0, floor(try_divide(balance * 100, target) + 0.5))) END"),
    "convert_units": (
        "quantity DOUBLE, unit STRING, wanted STRING, grams_per_ml DOUBLE DEFAULT NULL", "DOUBLE",
        f"""CASE WHEN unit = wanted THEN quantity {_SAME}
        WHEN grams_per_ml > 0 AND {_sizes(units.MASS, 'unit')} IS NOT NULL THEN quantity * {_sizes(units.MASS, 'unit')} / (grams_per_ml * {_sizes(units.VOLUME, 'wanted')})
        WHEN grams_per_ml > 0 THEN quantity * {_sizes(units.VOLUME, 'unit')} * grams_per_ml / {_sizes(units.MASS, 'wanted')} END""",
    ),
    "base_unit_price": ("price DOUBLE, quantity DOUBLE, unit STRING", "DOUBLE", f"CASE WHEN quantity > 0 THEN try_divide(price, quantity * {_base('unit')}) END"),
    "plain_name": ("name STRING", "STRING", f"trim(regexp_replace(regexp_replace({_PLAIN}, '[^a-z0-9 ]', ' '), ' +', ' '))"),
    "singular_word": (
        "word STRING", "STRING",
        "CASE WHEN length(word) <= 3 THEN word WHEN word LIKE '%ies' AND length(word) > 4 THEN left(word, length(word) - 3) || 'y' WHEN word LIKE '%oes' AND length(word) > 4 THEN left(word, length(word) - 2) "
        "WHEN word RLIKE '(ss|sh|ch|x|z)es$' THEN left(word, length(word) - 2) WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, length(word) - 1) ELSE word END",
    ),
    "word_overlap": ("a STRING, b STRING", "DOUBLE", "coalesce(try_divide(size(array_intersect(split(plain_name(a), ' '), split(plain_name(b), ' '))), size(array_union(split(plain_name(a), ' '), split(plain_name(b), ' ')))), 0)"),
    "has_any_key": (
        "doc STRING, wanted ARRAY<STRING>", "BOOLEAN",
        r"""arrays_overlap(transform(filter(regexp_extract_all(doc, '"(?:[^"\\\\]|\\\\.)*"(?:\\s*:)?', 0), s -> endswith(s, ':')), s -> regexp_extract(s, '^"(.*)"\\s*:$', 1)), wanted)""",
    ),
    "payload_is_safe": ("doc STRING, blocked ARRAY<STRING>", "BOOLEAN", "startswith(trim(doc), '{') AND NOT has_any_key(doc, blocked)"),
}


@udtf(returnType="line INT, quantity STRING, unit STRING, name STRING")
class RecipeLines:
    """The lines of a recipe's ingredients, numbered from 1, each with quantity, unit and name; blank lines have none."""

    def eval(self, recipe: str) -> Iterator[tuple]:
        number = 0
        for line in (recipe or "").splitlines():
            clean = re.sub(r"\s+", " ", line.strip())
            if not clean:
                continue
            number += 1
            found = re.search(matching.QUANTITY, clean)
            if not found or not found[1]:
                yield number, "", "", clean
                continue
            rest = found[3] or ""
            split = re.search(matching.UNIT, rest)
            unit, name = ((split[i] or "").strip() for i in (1, 2)) if split else ("", "")
            yield number, found[1] + (f"-{found[2]}" if found[2] else ""), unit, name or rest


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("recipe_lines", RecipeLines)
