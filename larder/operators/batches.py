"""Rows in batches of bounded size, in order: the greedy cut of a queue of any length, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored
from .ranking import numbered, sums_before

c = F.col


def in_order(rows: DataFrame, queue: str, key: str, size: str, items: int = 64, most: int = 12_000) -> DataFrame:
    """rows with `batch` (the key that its batch starts with): a queue's rows by key, each batch as many as fit in `items`
    and in `most` of their sizes; a larger row is alone. Keys are unique in their queue, sizes whole and not negative; null
    is a queue, too.

    Where a batch would end depends only on where it starts, so every row points to the row that would start the next
    batch: running sums tell which. Which rows really start one follows from the first by doubling: pointers of 1, 2, 4, ...
    batches reach them all in as many rounds as the logarithm of the number of batches."""
    x = rows.select(queue, key, c(size).cast("long").alias("size"))
    x = stored(numbered(sums_before(x, [queue], [c(key)], c("size"), "before"), [queue], [c(key)]))

    # Of the queue's rows those end within a row's reach whose sums do not pass the row's start by more than `most`.
    ends = x.select(queue, (c("before") + c("size")).alias("at"), F.lit(0).alias("asks"), "place")
    asks = x.select(queue, (c("before") + most).alias("at"), F.lit(1).alias("asks"), "place")
    fit = sums_before(ends.union(asks), [queue], [c("at"), c("asks"), c("place")], 1 - c("asks"), "fit").filter("asks = 1")
    behind = F.greatest(c("place") + 1, F.least(c("place") + items, c("fit") + 1))
    last = x.groupBy(queue).agg(F.max("place").alias("last"))
    pointers = fit.join(last, fit[queue].eqNullSafe(last[queue])).filter(behind <= c("last")).select(fit[queue].alias("__queue"), "place", behind.alias("next"))

    jump = stored(pointers)
    starts = stored(x.filter("place = 1").select(c(queue).alias("__queue"), "place"))
    while True:
        new = starts.alias("s").join(jump.alias("j"), c("s.__queue").eqNullSafe(c("j.__queue")) & (c("s.place") == c("j.place"))).select("s.__queue", c("j.next").alias("place"))
        new = stored(new)
        if not new.limit(1).count():
            break
        starts = stored(starts.union(new))
        jump = stored(jump.alias("a").join(jump.alias("b"), c("a.__queue").eqNullSafe(c("b.__queue")) & (c("a.next") == c("b.place"))).select("a.__queue", "a.place", "b.next"))

    flagged = x.join(starts.withColumn("starts", F.lit(1)), x[queue].eqNullSafe(c("__queue")) & (x["place"] == starts["place"]), "left").select(x[queue], x[key], x["size"], F.coalesce("starts", F.lit(0)).alias("starts"))
    counted = stored(sums_before(flagged, [queue], [c(key)], c("starts"), "number").withColumn("number", c("number") + c("starts")))
    first = counted.filter("starts = 1").select(c(queue).alias("__queue"), c("number").alias("n"), c(key).alias("batch"))
    return counted.join(first, counted[queue].eqNullSafe(c("__queue")) & (c("number") == c("n"))).select(counted[queue], counted[key], c("size").cast(rows.schema[size].dataType).alias(size), "batch")
