"""Harmonic packing of token sequences.

Lengths fall into classes by reciprocal capacity: class k holds lengths in (capacity/(k+1), capacity/k], and each of its
bins takes exactly k pieces, whatever they are. Tasks fill their bins on their own; no state is shared. A text longer
than the capacity is cut into whole sequences and a rest; a rest that would leave a wide gap in its class's slot is cut
further, first into a piece that fills a slot of the next class. Bins that a task leaves unfinished are emptied and
their pieces dealt, longest first, to the first sequence with room.

Defined results: a null text counts as empty; an empty text has one token, the separator. Rows are packed one by one,
repeated or not; the sequences depend on how Spark deals the rows over tasks, so pack a table that is written, not one
that is recomputed. Other columns are not looked at; an empty table gives no piece.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import release, table, text_rounds

#: Fixed parameters of the query.
CAPACITY = 1024
SEPARATOR = 0
#: Tokens of padding that one cut more is worth, and the shortest piece that a cut makes.
CUT_COST, SHORTEST = 10, 16


@lru_cache(maxsize=8)
def cuts(capacity: int, cut_cost: float = CUT_COST, shortest: int = SHORTEST) -> tuple[tuple[int, ...], ...]:
    """For each length below the capacity the pieces to cut it into: the least padding in its slots plus cost of cuts."""
    cost, plan = [0.0] * capacity, [()] * capacity
    units = sorted({capacity // j for j in range(2, max(3, capacity // shortest + 1))})
    for r in range(1, capacity):
        cost[r], plan[r] = capacity / (capacity // r) - r, (r,)
        for q in units:
            if q + shortest > r:
                break
            c = capacity / (capacity // q) - q + cost[r - q] + cut_cost
            if c < cost[r]:
                cost[r], plan[r] = c, (q, *plan[r - q])
    return tuple(plan)


class Ids:
    """Token ids of a byte-level BPE tokenizer file (the JSON of the tokenizers library), special tokens' strings being
    ordinary text. Its vocabulary is given to tiktoken as ranks, which merges several times faster; that needs ids in the
    order of merges, and a file of another kind is refused. A text on which tiktoken's pattern runs out of stack (about a
    million blanks in a row) is encoded by the tokenizers library itself."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ordinary = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(ordinary)]
        byte = {chr(b): b for b in ordinary} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary, merges = model["vocab"], [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [vocabulary[m.replace(" ", "")] for m in merges]
        if ids != sorted(ids):
            raise ValueError("the tokenizer's ids are not in the order of its merges")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if len(t) == 1 or i >= ids[0] and i <= ids[-1]}
        self.fast = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.path, self.slow = path, None

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast(text, disallowed_special=()), dtype=np.uint32)
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def __call__(self, texts: list) -> list[np.ndarray]:
        return [self.encode(t) if t else np.empty(0, np.uint32) for t in texts]


class Packer:
    """The bins of one task. A piece is (row, start, length, crc, doc_tokens); `done` collects pieces with their places."""

    def __init__(self, capacity: int, part: int):
        self.capacity, self.next, self.open, self.done = capacity, part << 40, {}, []

    def _close(self, pieces: list) -> None:
        at = 0
        for p in pieces:
            self.done.append((*p, self.next, at))
            at += p[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        if k == 1:
            return self._close([piece])
        own = self.open.setdefault(k, [])
        own.append(piece)
        if len(own) == k:
            self._close(self.open.pop(k))

    def finish(self) -> None:
        """First fit, longest first, for the pieces of unfinished bins (fewer than k of each class k)."""
        bins: list[list] = []
        for p in sorted((p for own in self.open.values() for p in own), key=lambda p: -p[2]):
            own = next((b for b in bins if b[0] >= p[2]), None)
            if own is None:
                bins.append(own := [self.capacity])
            own[0] -= p[2]
            own.append(p)
        self.open = {}
        for own in bins:
            self._close(own[1:])


def pack(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (ids) the ids. No shuffle.

    `tokenizer` is the file of a byte-level BPE tokenizer that every worker can read, `pattern` its pre-token pattern.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])] + [T.StructField("ids", T.ArrayType(T.LongType()))] * ids)
    id_type = to_arrow_type(schema[0].dataType)

    def run(batches):
        encode, packer, plans = Ids(tokenizer, pattern), Packer(capacity, TaskContext.get().partitionId()), cuts(capacity)
        end = np.array([separator], dtype=np.uint32)

        def rows(whole: bool):
            out, packer.done = packer.done, []
            if not out and not whole:
                return None
            cols = [pa.array([p[0][0] for p in out], id_type)] + [pa.array([p[i] for p in out], pa.int64()) for i in range(1, 7)]
            if ids:
                cols.append(pa.array([p[0][1][p[1] : p[1] + p[2]].astype(np.int64) for p in out], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(cols, names=[*names, *["ids"] * ids])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts in text_rounds(batch.column(1)):
                for key, tokens in zip(keys[a:b], encode(texts)):
                    tokens = np.concatenate([tokens, end])
                    at, n = 0, len(tokens)
                    row = (key, tokens if ids else None)
                    for size in (*[capacity] * (n // capacity), *plans[n % capacity]):
                        packer.add((row, at, size, zlib.crc32(tokens[at : at + size].tobytes()), n))
                        at += size
                if packer.done:
                    yield rows(False)
        packer.finish()
        yield rows(True)
        encode = packer = batch = texts = tokens = row = None  # noqa: F841  freed before memory goes back
        release()

    return source.mapInArrow(run, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
