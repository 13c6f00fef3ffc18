"""Values of JSON that need not be what they should: coercions, envelopes, keys at any depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields that wrap an answer, and keys that must not reach other users.
ENVELOPES = ["pricing_summary", "result", "data"]
PRIVATE_KEYS = [
    "budget", "budgetAmount", "budget_amount", "rawBudget", "raw_budget", "deficit", "jarBalance", "jar_balance", "savingsGoal", "savings_goal", "spend",
    "spendLog", "spendLogs", "spend_log", "spend_logs", "aiConfidence", "ai_confidence", "confidence", "privateVerificationMetadata",
    "private_verification_metadata", "stagnation", "nudgeState", "nudge_state", "receipt", "receipts", "receiptItems", "receipt_items",
    "pantryInventory", "pantry_inventory", "pantryItems", "pantry_items", "receiptTotal", "receipt_total",
]


def number(value: Column) -> Column:
    """A finite number, else null; blank is none."""
    x = F.when(F.rlike(F.trim(value), F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), F.trim(value).try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def positive(value: Column) -> Column:
    x = number(value)
    return F.when(x > 0, x)


def boolean(value: Column) -> Column:
    x = F.lower(F.trim(value))
    return F.when(x == "true", True).when(x == "false", False)


def unwrapped(value: Column, layers: int = 3) -> Column:
    """JSON text inside at most so many envelopes or strings of JSON."""
    for _ in range(layers):
        text = F.when(F.startswith(F.trim(value), F.lit('"')), F.get_json_object(value, "$")).otherwise(value)
        value = F.coalesce(*[F.get_json_object(text, f"$.{e}") for e in ENVELOPES], text)
    return value


def keys(value: Column) -> Column:
    """All keys of JSON text at any depth: strings before a colon, read string by string."""
    strings = F.regexp_extract_all(value, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    return F.array_distinct(F.transform(F.filter(strings, lambda s: F.endswith(s, F.lit(":"))), lambda s: F.regexp_extract(s, r'^"(.*)"\s*:$', 1)))


def is_shareable(value: Column, blocked: list[str] | None = None) -> Column:
    """An object without a blocked key anywhere in it."""
    return F.startswith(F.trim(value), F.lit("{")) & ~F.arrays_overlap(keys(value), F.array(*map(F.lit, blocked or PRIVATE_KEYS)))
