"""Conversion between units of measure, hints of a unit in scraped fields, and checks of proposed labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .titles import has_unit

# Grams, millilitres and pieces of a unit.
MASS = {"mg": 0.001, "g": 1.0, "kg": 1000.0, "oz": 28.349523125, "lb": 453.59237}
VOLUME = {"ml": 1.0, "l": 1000.0, "tsp": 4.92892159375, "tbsp": 14.78676478125, "fl oz": 29.5735295625, "cup": 236.5882365, "pt": 473.176473, "qt": 946.352946, "gal": 3785.411784}
COUNT = {"each": 1.0, "dozen": 12.0}
# Fixed value: least confidence of a unit that a recipe does not write.
INFERRED_LEAST = 0.75


def _size(unit: Column, kind: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in kind.items() for x in pair]), unit)


def converted(quantity: Column, unit: Column, wanted: Column, grams_per_ml: Column | None = None) -> Column:
    """The quantity in another unit: of the same kind, or between mass and volume where the density is known; else null."""
    same = [F.try_divide(quantity * _size(unit, kind), _size(wanted, kind)) for kind in (MASS, VOLUME, COUNT)]
    if grams_per_ml is not None:
        density = F.when(grams_per_ml > 0, grams_per_ml)
        same.append(F.try_divide(quantity * _size(unit, MASS), density * _size(wanted, VOLUME)))
        same.append(F.try_divide(quantity * _size(unit, VOLUME) * density, _size(wanted, MASS)))
    return F.when(unit == wanted, quantity).otherwise(F.coalesce(*same))


def price_per_base_unit(price: Column, quantity: Column, unit: Column) -> Column:
    """Price of a gram, millilitre or piece; null for an unknown unit and quantities that are not positive."""
    size = F.coalesce(_size(unit, MASS), _size(unit, VOLUME), _size(unit, COUNT))
    return F.when(quantity > 0, F.try_divide(price, quantity * size))


def _given(field: Column) -> Column:
    x = F.trim(F.regexp_replace(field, r"\s+", " "))
    return F.when(~F.lower(x).isin("", "n/a", "na", "none", "null", "undefined"), x)


def unit_hint(explicit: Column, fields: list[Column], per_unit: Column) -> Column:
    """The unit that a scraped row names: its own, else the first field that holds something, else what a price per unit
    ends with behind its slash; null if none does."""
    suffix = F.regexp_extract(F.lower(F.trim(F.regexp_replace(per_unit, r"\s+", " "))), r"/\s*([a-z][a-z. ]{0,20})$", 1)
    return F.coalesce(_given(explicit), *[_given(f) for f in fields], F.nullif(F.trim(suffix), F.lit("")))


def checked_label(source: Column, raw: Column, unit: Column, quantity: Column, confidence: Column, aliases: dict[str, list[str]]) -> Column:
    """Why a proposed unit is refused, null where it stands: `raw` must show it by one of its aliases. Where `raw` shows no
    unit at all, a recipe's may stand if the confidence suffices. `unit` is null where no known label was proposed."""
    shown = [F.when(_any_alias(raw, names), F.lit(name)) for name, names in aliases.items()]
    signals = F.array_compact(F.array(*shown))
    inferred = (source == "recipe") & (confidence >= INFERRED_LEAST)
    return (
        F.when(unit.isNull(), "no_unit").when(quantity.isNull() | (quantity <= 0), "no_quantity")
        .when(F.size(signals) == 0, F.when(F.coalesce(inferred, F.lit(False)), F.lit(None)).otherwise("unit_not_shown"))
        .when(~F.array_contains(signals, unit), "other_unit_shown")
    )


def _any_alias(raw: Column, names: list[str]) -> Column:
    hit = F.lit(False)
    for n in names:
        hit = hit | has_unit(raw, n)
    return hit
