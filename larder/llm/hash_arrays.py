"""Sorted hash arrays: values of 64-bit keys, summed by Spark, stored in the shared folder, memory-mapped by tasks.

Keys are hashes spread evenly over 64 bits. The key space is cut into buckets, ranges of equal width that are merged one
at a time, and a file holds the buckets of a longer range in order, so it is one sorted array. Tasks deal the sorted
arrays of their own rows over the buckets; what is merged at once is one bucket, however large a file is.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_file, mix64, open_folder

#: Bytes of input that a bucket stands for, buckets of a file at most, files that a task keeps mapped at most.
BUCKET_BYTES = 2 << 20
FILE_BUCKETS = 128
MAPPED = 4_096
#: Zero bits at the end of keys of 48 bits.
SPARE = 16
#: Files that small inputs are spread over, so that many tasks merge.
FILES = 48
ROWS = "file int, kind int, bucket int, keys binary, counts binary"
_BIG = 255


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


class Layout:
    """How many buckets and files there are, and where a key belongs."""

    def __init__(self, n_bytes: int, buckets: int | None = None):
        self.buckets = buckets or max(4, -(-n_bytes // BUCKET_BYTES))
        self.per_file = min(FILE_BUCKETS, -(-self.buckets // FILES))
        self.files = -(-self.buckets // self.per_file)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (((keys >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)

    def deal(self, kind: int, keys: np.ndarray, values: np.ndarray) -> list[tuple]:
        """Rows of ROWS: sorted keys and their values (one or several columns) by bucket."""
        cuts = np.searchsorted(self.bucket(keys), np.arange(self.buckets + 1))
        return [(int(i) // self.per_file, kind, int(i), packed_keys(keys[cuts[i] : cuts[i + 1]]), packed(values[cuts[i] : cuts[i + 1]])) for i in np.flatnonzero(np.diff(cuts))]


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as 32-bit differences where they fit; keys that end in SPARE zero bits are told without them."""
    gaps = np.diff(keys)
    if len(gaps):
        low = SPARE if not (keys & np.uint64((1 << SPARE) - 1)).any() else 0
        gaps >>= np.uint64(low)
        if gaps.max() < 1 << 32:
            return bytes([low]) + keys[:1].tobytes() + gaps.astype(np.uint32).tobytes()
    return b"\xff" + keys.tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    if data[0] == 0xFF:
        return np.frombuffer(data, np.uint64, -1, 1)
    first = np.frombuffer(data, np.uint64, 1, 1)
    gaps = np.frombuffer(data, np.uint32, -1, 9).astype(np.uint64) << np.uint64(data[0])
    return np.concatenate([first, first + np.cumsum(gaps, dtype=np.uint64)])


def packed(values: np.ndarray) -> bytes:
    """Counts as one byte each, those of _BIG or more as 64 bits behind them; nothing at all if all are 1."""
    flat = np.ravel(values)
    if flat.size and flat.min() == flat.max() == 1:
        return b""
    return np.minimum(flat, _BIG).astype(np.uint8).tobytes() + flat[flat >= _BIG].astype(np.int64).tobytes()


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    if not data:
        return np.ones((n, width), np.int64)
    flat = np.frombuffer(data, np.uint8, n * width).astype(np.int64)
    flat[flat == _BIG] = np.frombuffer(data, np.int64, -1, n * width)
    return flat.reshape(n, width)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their rows of values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.stack([np.add.reduceat(values[order, j], first) for j in range(values.shape[1])], 1)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    file, kind, bucket, keys, counts = zip(*rows) if rows else ((),) * 5
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((file, kind, bucket, keys, counts), types)], names=["file", "kind", "bucket", "keys", "counts"])


def dealt(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows of a file in one task, bucket by bucket."""
    return rows.repartition(layout.files, "file").sortWithinPartitions("file", "kind", "bucket")


def buckets(batches: Iterator[pa.RecordBatch], widths: dict[int, int]) -> Iterator[tuple]:
    """(file, kind, bucket, keys, values) of dealt rows: one sorted array for each bucket."""
    now, keys, values = None, [], []
    for b in batches:
        for at in range(0, b.num_rows, 64):
            for file, kind, bucket, k, c in zip(*(x.to_pylist() for x in b.slice(at, 64).columns)):
                if (file, kind, bucket) != now:
                    if now is not None:
                        yield *now, *summed(np.concatenate(keys), np.concatenate(values))
                    now, keys, values = (file, kind, bucket), [], []
                keys.append(unpacked_keys(k))
                values.append(unpacked(c, len(keys[-1]), widths[kind]))
    if now is not None:
        yield *now, *summed(np.concatenate(keys), np.concatenate(values))


class Writer:
    """One file at a time: keys, one byte for each value, and the place and size of the values that need more. A file
    appears whole or not at all; a lost or repeated task leaves the same one."""

    def __init__(self, folder: str):
        self.store, self.path = open_folder(folder)
        self.store.create_dir(self.path, recursive=True)
        self.name = None

    def add(self, name: str, keys: np.ndarray, values: np.ndarray) -> None:
        if name != self.name:
            self.close()
            self.name, self.at = name, 0
            self.temp = {part: f"{self.path}/.{name}.{part}-{uuid.uuid4().hex}" for part in ("keys", "small", "big")}
            self.out = {part: self.store.open_output_stream(p) for part, p in self.temp.items()}
        flat = np.ravel(values)
        big = np.flatnonzero(flat >= _BIG)
        self.out["keys"].write(np.ascontiguousarray(keys).tobytes())
        self.out["small"].write(np.minimum(flat, _BIG).astype(np.uint8).tobytes())
        self.out["big"].write(np.stack([big + self.at, flat[big]], 1).astype(np.int64).tobytes())
        self.at += flat.size

    def close(self) -> None:
        if self.name is not None:
            for part, out in self.out.items():
                out.close()
                self.store.move(self.temp[part], f"{self.path}/{self.name}.{part}")
            self.name = None


class Reader:
    """The arrays of a folder, memory-mapped as they are needed; the files looked at longest ago are let go."""

    def __init__(self, folder: str, layout: Layout):
        self.folder, self.layout = folder, layout
        self.store, self.path = open_folder(folder)
        self.maps: OrderedDict = OrderedDict()

    def _file(self, name: str) -> tuple | None:
        if name not in self.maps:
            import pyarrow.fs as fs

            here = self.store.get_file_info(f"{self.path}/{name}.keys").type == fs.FileType.File
            self.maps[name] = (map_file(self.folder, f"{name}.keys", np.uint64), map_file(self.folder, f"{name}.small", np.uint8), map_file(self.folder, f"{name}.big", np.int64).reshape(-1, 2)) if here else None
            if len(self.maps) > MAPPED:
                self.maps.popitem(last=False)
        self.maps.move_to_end(name)
        return self.maps[name]

    def find(self, kind: str, keys: np.ndarray, width: int = 1) -> np.ndarray:
        """(keys, width) values, 0 where a key is unknown."""
        out = np.zeros((len(keys), width), dtype=np.int64)
        order = np.argsort(keys)
        own = keys[order]
        cuts = np.searchsorted(self.layout.bucket(own) // self.layout.per_file, np.arange(self.layout.files + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            file = self._file(f"{kind}-{i}")
            if file is None:
                continue
            all_keys, small, big = file
            want = own[cuts[i] : cuts[i + 1]]
            pos = np.minimum(np.searchsorted(all_keys, want), len(all_keys) - 1)
            hit = np.flatnonzero(all_keys[pos] == want)
            at = pos[hit, None] * width + np.arange(width)
            values = small[at].astype(np.int64)
            full = values == _BIG
            values[full] = big[np.searchsorted(big[:, 0], at[full]), 1]
            out[order[cuts[i] + hit]] = values
        return out


__all__ = ["Layout", "Reader", "Writer", "batch", "buckets", "dealt", "mix64", "summed", "unmix64", "ROWS"]
