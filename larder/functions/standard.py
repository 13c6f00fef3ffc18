"""A raw ingredient's standard name, category and confidence by fixed rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import matching, text, titles

# Words of each category; the first category of which a word occurs is taken.
CATEGORIES = {
    "pantry_staples": "soup stew chowder salad bowl ravioli pasta noodle noodles macaron macarons roll rolls sandwich wrap taco burrito pizza".split(),
    "condiments": "sauce dressing ketchup mustard mayo mayonnaise vinegar soy".split(),
    "beverages": "juice soda water tea coffee drink beverage wine beer".split(),
    "produce": (
        "tomato onion pepper lettuce cucumber carrot potato spinach broccoli basil cilantro parsley mint kale celery mushroom garlic ginger lemon "
        "lime apple banana orange berry berries cherry grape seed seeds"
    ).split(),
    "dairy": "milk cheese yogurt butter cream egg eggs".split(),
    "meat_seafood": matching.PROTEINS,
    "snacks": "chip chips cracker crackers cookie cookies candy nuts nut pretzel pretzels".split(),
    "baking": "flour powder soda yeast vanilla chocolate chips".split(),
    "spices": "salt spice spices seasoning seasonings paprika cumin turmeric curry pepper peppercorn herb herbs".split(),
}


def category(words: Column) -> Column:
    """Of the words of a name; null where there are none."""
    rules = [(F.arrays_overlap(words, F.array(*map(F.lit, of))), kind) for kind, of in CATEGORIES.items()]
    return reduce(lambda done, rule: done.when(*rule), rules, F.when(F.size(words) == 0, F.lit(None).cast("string"))).otherwise("other")


def _with(value: Column, build: Callable[[Column], Column]) -> Column:
    """build(value), with the value computed once."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def standardised(raw: Column, forms: list[str]) -> Column:
    """struct(name, is_food, category, confidence): the cleaned name in the singular, unless that changes a word of `forms`.
    What is no food keeps its cleaned name. Confidence falls with the words that the name keeps."""
    source = _with(titles.recipe_name(raw), lambda x: F.when(x == "", text.plain_name(raw)).otherwise(x))

    def build(x: Column) -> Column:
        u, v, food = x["u"], x["v"], x["food"]
        whole = ~food | F.exists(u, lambda w: w.isin(forms) & ~F.array_contains(v, w))
        words = F.when(whole, u).otherwise(v)
        kept = F.size(F.filter(u, lambda w: F.array_contains(v, w)))
        confidence = F.when(~food, 0.05).when(words == u, 0.92).when(kept >= 2, 0.84).when(kept >= 1, 0.78).otherwise(0.7)
        return F.struct(F.array_join(words, " ").alias("name"), food.alias("is_food"), F.when(food, category(words)).alias("category"), confidence.alias("confidence"))

    both = _with(text.tokens(source), lambda u: F.struct(u.alias("u"), F.transform(u, text.singular).alias("v"), (~matching.is_non_food(raw)).alias("food")))
    return _with(both, build)
