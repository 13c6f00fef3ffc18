"""Periodic runs of words: stretches that repeat a block of words twice or more, found exactly and collapsed.

A run with period q and length L repeats its first L - q words at distance q. Since L is at least max(least, 2q), that
overlap has k = ceil(least / 2) words or more, so every word of a run lies in a k-gram that its text holds twice. All
other words are masked: no run holds one. The stretches of unmasked words are the segments that survive, and a run that
ends at a mask ends in the whole text as well. Only segments are searched, by the divide and conquer of Main and Lorentz:
at each centre and for each period, the words that agree forwards and backwards at that distance give the run that
crosses the centre. Agreement is read from numbers of all blocks of 1, 2, 4, ... words, so no hash can err.

Defined results: a null or empty text has no word and no run. A text shorter than `least` words has none. Repeated rows
and ids are searched row by row, null ids too; other columns are not looked at, whatever their names. Memory of a task
follows the texts of one round, of a very long text its surviving words, 4 bytes for each level of block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

#: Fixed parameter of the query: words of the shortest run.
LEAST = 12
#: Pairs of words that one step looks at.
STEP = 1 << 20
#: Words of a run whose places are remembered, so that it is not found at every centre inside it.
LONG = 64

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
NO_PAIR = np.empty(0, dtype=np.int64)


def _numbers(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair, equal where pairs are, and how often each number occurs."""
    if not len(left):
        return NO_PAIR, NO_PAIR
    _, ids, many = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True, return_counts=True)
    return ids.astype(np.int64), many


def unmasked(codes: np.ndarray, k: int) -> np.ndarray:
    """For each word whether it lies in a k-gram that occurs twice or more. Only places whose shorter blocks repeat are
    looked at again."""
    n = len(codes)
    out = np.zeros(n, dtype=bool)
    if n <= k:
        return out
    many = np.bincount(codes)
    ids = np.where(many[codes] > 1, codes, -1)  # of the block that starts here; -1: occurs once
    width = 1
    while width < k:
        step = min(width, k - width)  # the last block of the two overlaps the first where k is no power of two
        at = np.flatnonzero((ids[: n - step] >= 0) & (ids[step:] >= 0))
        number, many = _numbers(ids[at], ids[at + step])
        ids = np.full(n, -1, dtype=np.int64)
        again = many[number] > 1 if len(number) else np.empty(0, bool)
        ids[at[again]] = number[again]
        width += step
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(ids[: n - k + 1] >= 0)
    edge[starts] += 1
    edge[starts + k] -= 1
    return np.cumsum(edge[:-1]) > 0


class Extensions:
    """How far two places of a sequence agree, forwards and backwards. Its last word must occur nowhere else."""

    def __init__(self, words: np.ndarray, longest: int):
        self.levels = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        n = len(words)
        while 2 << (len(self.levels) - 1) <= longest:
            half, width = self.levels[-1].astype(np.int64), 1 << (len(self.levels) - 1)
            ids = np.empty(n, dtype=np.int32)
            number, _ = _numbers(half[: n - width], half[width:])
            ids[: n - width] = number
            ids[n - width :] = n + np.arange(width)  # beyond the end: equal to nothing
            self.levels.append(ids)

    def share(self, x: np.ndarray, y: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Pairs of which `words` words agree from x and y on, or end before them; cheap, and true for some that agree in
        fewer (half as many at least)."""
        level = np.minimum(np.frexp(words)[1] - 1, len(self.levels) - 1)
        out = np.zeros(len(x), dtype=bool)
        for j in np.unique(level):
            at = np.flatnonzero(level == j)
            ids, a, b, w = self.levels[j], x[at], y[at], 1 << int(j)
            back = a >= w
            out[at] = (ids[a] == ids[b]) | (back & (ids[np.where(back, a - w, 0)] == ids[np.where(back, b - w, 0)]))
        return out

    def forwards(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = np.zeros(len(x), dtype=np.int64)
        for j in [len(self.levels) - 1, *range(len(self.levels) - 1, -1, -1)]:  # the widest block fits twice at most
            f += (self.levels[j][x + f] == self.levels[j][y + f]) * np.int64(1 << j)
        return f

    def backwards(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that agree before x and y."""
        b = np.zeros(len(x), dtype=np.int64)
        for j in [len(self.levels) - 1, *range(len(self.levels) - 1, -1, -1)]:
            w = np.int64(1 << j)
            fits = x - b >= w
            at = np.where(fits, x - b - w, 0)
            b += (fits & (self.levels[j][at] == self.levels[j][at + (y - x)])) * w
        return b


def _pairs(n: int, level: int, top: bool):
    """(x, y): the places around centres c at distances p up to 2^level, (c-p, c) and (c, c+p). Centres are the odd
    multiples of 2^level, at the top all multiples."""
    half = 1 << level
    centres = np.arange(half, n, half if top else 2 * half)
    p = np.arange(1, half + 1)
    for a in range(0, len(centres), max(1, STEP // half)):
        for b in range(0, half, STEP):
            c = np.repeat(centres[a : a + max(1, STEP // half)], len(p[b : b + STEP]))
            d = np.tile(p[b : b + STEP], len(c) // len(p[b : b + STEP]))
            yield c - d, c
            inside = c + d < n
            yield c[inside], (c + d)[inside]


def main_lorentz(words: np.ndarray, longest: int, least: int) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs of a sequence whose last word occurs nowhere else and in which no
    run is longer than `longest`."""
    reach = Extensions(words, longest)
    found = [np.empty((0, 3), dtype=np.int64)]
    top = (longest // 2).bit_length()  # no period is longer than 2^top, and shorter runs that cross no centre of it lie between two
    start, end, period = np.zeros((3, len(words)), dtype=np.int32)  # of a known run at each place: its pairs give nothing new
    for level in range(top, -1, -1):
        new = []
        for x, y in _pairs(len(words), level, level == top):
            known = (x >= start[y]) & (y < end[y])
            known[known] = (y[known] - x[known]) % period[y[known]] == 0
            x, y = x[~known], y[~known]
            overlap = np.maximum(y - x, least - (y - x))
            near = reach.share(x, y, (overlap + 1) // 2)
            x, y = x[near], y[near]
            if not len(x):
                continue
            runs = np.stack([x - reach.backwards(x, y), y + reach.forwards(x, y), y - x], axis=1)
            long = runs[:, 1] - runs[:, 0] >= np.maximum(least, 2 * runs[:, 2])
            new.append(np.unique(runs[long], axis=0))
        found += new
        for a, b, p in np.concatenate(new).tolist() if new else ():
            if b - a >= LONG and not (start[a] <= a and b <= end[a]):
                start[a:b], end[a:b], period[a:b] = a, b, p
    runs = np.unique(np.concatenate(found), axis=0)  # by start, end, period: the first of a stretch has its smallest period
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def runs_of(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rows (start, end, period) of the runs by start and period, and which words are unmasked. Texts that do not share a
    word number may stand one after another."""
    none = np.empty((0, 3), dtype=np.int64)
    open_ = unmasked(codes, (least + 1) // 2)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return none, open_
    # The segments side by side, a word of its own behind each; `shift` leads back to places of the texts.
    sizes = ends - starts + 1
    at = np.cumsum(sizes) - sizes
    shift = np.repeat(starts - at, sizes)
    place = np.arange(int(sizes.sum())) + shift
    last = at + sizes - 1
    words = np.empty(len(place), dtype=np.int64)
    words[:] = codes[np.minimum(place, len(codes) - 1)]
    words[last] = int(codes.max()) + 1 + np.arange(len(last))
    runs = main_lorentz(words, int(sizes.max()), least)
    back = shift[runs[:, 0]]
    runs = runs + np.stack([back, back, np.zeros_like(back)], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))], open_


def _search(least: int):
    def search(texts: list) -> dict:
        words = [t.encode().split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        codes, base = np.empty(int(sizes.sum()), dtype=np.int64), 0
        for w, a in zip(words, starts):
            own: dict[bytes, int] = {}
            codes[a : a + len(w)] = [own.setdefault(x, len(own)) for x in w]
            codes[a : a + len(w)] += base  # texts share no number
            base += len(own)
        runs, open_ = runs_of(codes, least) if len(codes) else (np.empty((0, 3), np.int64), np.empty(0, bool))
        edge = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 1], -1)
        kept = np.cumsum(edge[:-1]) == 0
        owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        rows, left = [], []
        for i, w in enumerate(words):
            a, own = starts[i], runs[first[i] : first[i + 1]]
            rows.append(list(zip((own[:, 0] - a).tolist(), (own[:, 1] - own[:, 0]).tolist(), own[:, 2].tolist())))
            left.append(b" ".join([x for x, k in zip(w, kept[a : a + len(w)].tolist()) if k] if len(own) else w).decode())
        opened = np.concatenate([[0], np.cumsum(open_)])
        return {"n_words": sizes, "n_unmasked": opened[starts + sizes] - opened[starts], "runs": rows, "collapsed": left}

    return search


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_words, n_unmasked, runs (start, length and period of each, by start and period) and the collapsed text: words
    of any run after its first period go, the others are joined by one space. No shuffle.

    A run is a maximal stretch of words with smallest period q and at least max(least, 2q) words.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_unmasked", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    return map_texts(docs, [id_col], text_col, lambda: _search(least), fields)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's documents: in one of ten, told by the crc32 of the id, a tail of the text repeats its first words."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    df = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h"))
    df = df.withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words)).withColumn("n", F.size("w"))
    df = df.withColumn("a", F.when(F.col("n") > 0, F.expr("(h div 10) % n")))
    df = df.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), F.lit(1), F.col("n")), " ")
    return df.select(F.col(id_col), F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    df = found.withColumn("top", top)
    return df.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
