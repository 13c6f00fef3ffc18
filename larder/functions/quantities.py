"""Package counts, line totals, quantity checks, and answers of rules on scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest quantity, and how often the quantity of the search a later one may be.
QUANTITY_MOST, QUANTITY_SPIKE = 10_000, 5.0


def covering(need: Column, size: Column) -> Column:
    """Whole packages that cover a need, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.try_divide(need, size))).cast("long")


def estimated(need: Column, base_need: Column, base_packages: Column) -> Column:
    """Packages in proportion to a known need and its packages; null where those are not positive."""
    return F.when((base_need > 0) & (base_packages > 0), F.greatest(F.lit(1), F.ceil(F.try_divide(base_packages, base_need) * need)).cast("long"))


def line_total(need: Column, price: Column, size: Column, failed: Column, base_need: Column, base_packages: Column) -> Column:
    """Price of the packages: by size; where conversion failed, by estimate, else of one package; null without a price or
    size."""
    n = F.when(failed, F.coalesce(estimated(need, base_need, base_packages), F.lit(1))).otherwise(F.when(size > 0, covering(need, size)))
    return F.when(price > 0, price * n)


def one_package_more(quantity: Column, size: Column) -> Column:
    return F.round((covering(quantity, size) + 1) * size, 4)


def one_package_less(quantity: Column, size: Column) -> Column:
    return F.greatest(size, F.round(F.greatest(F.lit(1), covering(quantity, size) - 1) * size, 4))


def quantity_fault(quantity: Column, base: Column, most: float = QUANTITY_MOST, spike: float = QUANTITY_SPIKE) -> Column:
    """Why a quantity should not be used; null where it may be. Without a positive base only its range is looked at."""
    finite = quantity.isNotNull() & ~F.isnan(quantity) & (F.abs(quantity) != float("inf"))
    return (
        F.when(~finite | (quantity <= 0), "not_positive").when(quantity > most, "over_cap")
        .when((base > 0) & (F.try_divide(quantity, base) > spike), "inflated")
    )


def streak_reason(focus: Column, plan: Column, home: Column, nutrition: Column, budget: Column, confidence: Column) -> Column:
    """Why a day counts for a streak or does not; scores that are missing count as 0, a missing focus as balanced."""
    p, h, n, b, f = (F.coalesce(x, F.lit(0.0)) for x in (plan, home, nutrition, budget, confidence))
    focus = F.coalesce(focus, F.lit("balanced"))
    return (
        F.when(f < 0.4, "low_confidence_needs_confirmation").when(p >= 0.7, "on_plan")
        .when((focus == "budget") & (h >= 0.75) & (b >= 0.5), "budget_home_cooked").when((focus == "health") & (n >= 0.7), "nutrition_aligned")
        .when((focus == "balanced") & ((p >= 0.55) | (h >= 0.6) | (n >= 0.6)), "balanced_forgiving").otherwise("requires_user_confirmation")
    )
