"""First, latest and best rows per key, each under a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key. Spark limits each partition to n rows per key before the shuffle. `order` should
    end in a unique column; pass `rank` to keep the row number under that name."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_lookup(left: DataFrame, history: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """left, with the columns of each key's first history row under `order`; keys are compared null-safe."""
    newest = top_per_group(history, keys, order).select(*[F.col(k).alias(f"__{k}") for k in keys], *columns)
    on = [left[k].eqNullSafe(newest[f"__{k}"]) for k in keys]
    return left.join(newest, on, "left").drop(*[f"__{k}" for k in keys])


def pair_in_order(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """First with first, second with second, within each key; what has no partner goes."""
    number = lambda df, order: df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "__n"]).drop("__n")


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset to offset + size of the order."""
    return df.orderBy(*order).offset(offset).limit(size)


def share_of_total(df: DataFrame, value: str, name: str, digits: int = 2) -> DataFrame:
    """value in percent of its sum over all rows; for small, aggregated frames."""
    return df.withColumn(name, F.round(100.0 * F.col(value) / F.sum(value).over(W.partitionBy()), digits))


def store_range(stores: DataFrame, zip_min: str | None = None, zip_max: str | None = None, state=None, cities: list | None = None, city=None) -> DataFrame:
    """Stores (zip, state, city) between two zip codes, compared as text, of a state, and of some cities or else of one.
    What is not given does not filter."""
    wanted = [(zip_min, lambda v: F.col("zip") >= v), (zip_max, lambda v: F.col("zip") <= v), (state, lambda v: F.col("state") == v), (cities or None, lambda v: F.col("city").isin(v)), (None if cities else city, lambda v: F.col("city") == v)]
    for value, condition in wanted:
        if value is not None:
            stores = stores.filter(condition(value))
    return stores
