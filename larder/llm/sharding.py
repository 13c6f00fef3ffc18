"""Sharding by histogram sort: shards of nearly equal bytes, cut from one order of all rows.

Rows are ordered by a hash of the text, then by a hash of the id, then by their place in the input. Splitters between
shards are found by probing: each round lays probes evenly over the keys that may still hold a splitter, counts the
exact bytes between them in one aggregation, and keeps the part that holds the splitter's target. A splitter is done when
a probe lies within the tolerance of its target. Equal texts have one first key and so stay together, unless their bytes
alone leave the tolerance; then the same search goes on inside the group, by the next key. Rows cross the network once,
in ranges of about `range_bytes` of a shard; prefix sums of exact counts of rows give each range its first slot.

Defined results: a null text counts as empty. A row is never cut, so where a single row is larger than the tolerance the
nearer of its ends is taken. Rows that agree in id and text are told apart by their place in the input, so `docs` must
read the same way twice (a written table does); shards of all other rows, and slots outside of large groups of one text,
do not depend on the place. Null ids are one id. Columns are kept whatever
their names, but for `size`, `shard` and `slot`, which the result replaces. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked, table, written

#: Fixed parameters of the query.
SHARDS = 8
#: A splitter may miss its target by this share of a shard.
TOLERANCE = 0.01
#: Probes that a round lays over the keys of one splitter.
PROBES = 64
#: Bytes of text in a range that one task writes.
RANGE_BYTES = 16 << 20

KEYS = ("__text_key", "__id_key", "__row_key")
SPAN = 1 << 63


@dataclass(frozen=True)
class Cell:
    """Keys that agree with `prefix` in the first keys and lie in [low, high) in the next one; bytes below all of them."""

    prefix: tuple[int, ...]
    low: int
    high: int
    below: int

    @property
    def step(self) -> int:
        return -(-(self.high - self.low) // PROBES)

    def holds(self) -> Column:
        key = F.col(KEYS[len(self.prefix)])
        inside = (key >= F.lit(self.low)) & (key <= F.lit(self.high - 1))
        for name, value in zip(KEYS, self.prefix):
            inside = inside & (F.col(name) == F.lit(value))
        return inside

    def bucket(self) -> Column:
        return F.expr(f"({KEYS[len(self.prefix)]} - {self.low}L) div {self.step}L")


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with size and the three keys, from 0 to 2^63 - 1."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "shard", "slot")]
    keys = (F.shiftrightunsigned(F.xxhash64(text), 1), F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`")), 1), F.monotonically_increasing_id())
    return docs.select(*kept, (F.octet_length(text) + 1).cast("long").alias("size"), *[k.alias(n) for k, n in zip(keys, KEYS)])


def splitters(sizes: DataFrame, targets: list[float], tolerance: float) -> list[tuple[int, ...]]:
    """For each target, in order, the key up to which rows lie below it: their bytes are within the tolerance of the target,
    or as near as whole rows allow. Each round is one aggregation, of which PROBES rows for each target reach the driver."""
    done: dict[int, tuple[int, ...]] = {}
    open_ = {i: Cell((), 0, SPAN, 0) for i in range(len(targets))}
    while open_:
        cells = sorted(set(open_.values()), key=lambda c: (c.prefix, c.low))
        number = F.coalesce(*[F.when(c.holds(), F.lit(i)) for i, c in enumerate(cells)])
        bucket = F.coalesce(*[F.when(c.holds(), c.bucket()) for c in cells])
        key = F.coalesce(*[F.when(c.holds(), F.col(KEYS[len(c.prefix)])) for c in cells])
        held = sizes.select(number.alias("cell"), bucket.alias("bucket"), key.alias("key"), "size").filter("cell is not null")
        counted = held.groupBy("cell", "bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        found: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r.cell, r.bucket)):
            found.setdefault(r.cell, []).append(r)
        for i, cell in list(open_.items()):
            below = cell.below
            for r in found.get(cells.index(cell), []):
                if below + r.bytes >= targets[i]:
                    break
                below += r.bytes
            else:  # no row is left above the target
                done[i] = (*cell.prefix, cell.high)
                del open_[i]
                continue
            under, over = targets[i] - below, below + r.bytes - targets[i]
            if min(under, over) <= tolerance or r.rows == 1 or r.low == r.high and len(cell.prefix) == len(KEYS) - 1:
                done[i] = (*cell.prefix, r.low if under <= over else r.high + 1)
                del open_[i]
            elif r.low == r.high:
                open_[i] = Cell((*cell.prefix, r.low), 0, SPAN, below)
            else:
                open_[i] = Cell(cell.prefix, r.low, r.high + 1, below)
    return [done[i] for i in range(len(targets))]


def _from(splitter: tuple[int, ...]) -> Column:
    """Whether a row's keys are the splitter's or above."""
    name, value = KEYS[len(splitter) - 1], splitter[-1]
    above = F.lit(False) if value >= SPAN else F.col(name) >= F.lit(value)
    for name, value in reversed(list(zip(KEYS, splitter[:-1]))):
        above = (F.col(name) > F.lit(value)) | (F.col(name) == F.lit(value)) & above
    return above


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with size (bytes of the text and one), shard and slot, gapless from 0 in each shard."""
    sizes = written(with_keys(docs, id_col, text_col).select("size", *KEYS), "shard-keys")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(sizes, [total * s / shards for s in range(1, shards)], tolerance * total / shards) if total else []
    shard = sum((_from(c).cast("int") for c in cuts), F.lit(0))
    bits = max(0, (total // range_bytes).bit_length())
    bucket = F.shiftrightunsigned(F.col(KEYS[0]), 63 - bits) if bits else F.lit(0).cast("long")
    place = {"__shard": shard, "__bucket": bucket}

    # A bucket of many more bytes than a range should have holds a hot text: its rows are dealt over parts.
    placed = sizes.withColumns(place)
    large = placed.groupBy("__shard", "__bucket").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > 2 * range_bytes)
    large = checked(written(large.select("__shard", "__bucket", F.ceil(F.col("bytes") / range_bytes).alias("__parts")), "shard-large"))
    part = F.coalesce(F.pmod(F.xxhash64(*KEYS), F.col("__parts")), F.lit(0)).alias("__part")
    ranges = placed.join(large, ["__shard", "__bucket"], "left").select("__shard", "__bucket", part).groupBy("__shard", "__bucket", "__part").agg(F.count("*").alias("__rows"))
    order = W.partitionBy("__shard").orderBy("__bucket", "__part")
    ranges = checked(written(ranges.select("__shard", "__bucket", "__part", (F.sum("__rows").over(order) - F.col("__rows")).alias("__start")), "shard-ranges"))

    rows = with_keys(docs, id_col, text_col)
    names = [c for c in rows.columns if c not in KEYS]
    rows = rows.withColumns(place).join(large, ["__shard", "__bucket"], "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in (*names, *KEYS, "__shard", "__bucket")], part).join(ranges, ["__shard", "__bucket", "__part"])
    local = F.row_number().over(W.partitionBy("__shard", "__bucket", "__part").orderBy(*KEYS)) - 1
    return rows.select(*[F.col(f"`{c}`") for c in names], F.col("__shard").alias("shard"), (F.col("__start") + local).alias("slot"))


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
