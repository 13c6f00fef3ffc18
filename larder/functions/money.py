"""Package, budget and confidence arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packages(need: Column, size: Column) -> Column:
    """Whole packages that cover a need; one where the size is unknown or not positive."""
    return F.when(size.isNull() | (size <= 0), F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.ceil(need / size).cast("long")))


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def surplus(budget: Column, spent: Column) -> Column:
    return F.greatest(F.lit(0), budget - spent)


def bankable(budget: Column, spent: Column, basis_points: int = 3000) -> Column:
    """Of a surplus at most that share of the budget, in whole cents."""
    bps = min(max(basis_points, 0), 10_000)
    return F.least(surplus(budget, spent), F.floor(budget * bps / 10_000))


def goal_percent(balance: Column, target: Column) -> Column:
    """0 to 100, halves rounded up; 0 where there is no target."""
    return F.when(target <= 0, F.lit(0)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.try_divide(balance * 100.0, target) + 0.5)))).cast("int")


def nudge_days(average_gap: Column) -> Column:
    """21 where no gap is known, else two and a half gaps between 10 and 35 days."""
    return F.when(average_gap.isNull(), F.lit(21)).otherwise(F.least(F.lit(35), F.greatest(F.lit(10), F.floor(average_gap * 2.5 + 0.5)))).cast("int")


def sane_price(price: Column, reference: Column, most: float = 100.0, low: float = 0.1, high: float = 3.0) -> Column:
    """Positive, at most `most`, and within the given ratios of a known reference."""
    near = reference.isNull() | (reference <= 0) | F.try_divide(price, reference).between(low, high)
    return F.coalesce((price > 0) & (price <= most) & near, F.lit(False))


def calibrated(raw: Column, accepted: Column, seen: Column, overall: Column, total: Column) -> Column:
    """A confidence drawn to its bin's acceptance rate, by how often the bin was seen; raw while few were seen at all."""
    weight = F.least(F.lit(1.0), seen / 60.0)
    empirical = weight * F.coalesce(F.try_divide(accepted.cast("double"), seen.cast("double")), overall) + (1 - weight) * overall
    return F.when(total < 50, raw).otherwise(F.round(0.6 * raw + 0.4 * empirical, 3))


def medoid_score(similarity: Column, purity: Column, products: Column) -> Column:
    return 0.7 * similarity + 0.2 * purity + 0.1 * F.least(F.lit(1.0), F.log1p(products) / F.log(F.lit(101.0)))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 3958.7613 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def week_start(day: Column, first: int = 1) -> Column:
    """The week's first day; first: 0 Sunday to 6 Saturday."""
    return F.date_sub(day, F.pmod(F.dayofweek(day) - 1 - first, F.lit(7)))


def iso_week(day: Column) -> Column:
    """ISO year and week, as 202401."""
    return (F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)).cast("int")


def plan_week(day: Column) -> Column:
    """The day's year and its week from Monday, as 202401; the first week holds January 1, so a late December day may
    carry week 1 of its own year."""
    first = lambda year: week_start(F.make_date(year, F.lit(1), F.lit(1)))
    week = F.floor(F.datediff(week_start(day), first(F.year(day))) / 7) + 1
    return (F.year(day) * 100 + F.when(first(F.year(day) + 1) == week_start(day), 1).otherwise(week)).cast("int")
