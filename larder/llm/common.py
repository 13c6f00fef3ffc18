"""What several operators share: tables, the shared folder, Arrow maps over texts, and folds by crc32."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of text that one round of a Python operator holds as words at most (a longer text makes a round of its own).
CHUNK_CHARS = 600_000
MASK64 = (1 << 64) - 1


#: Ids that may be broadcast to pick rows; beyond it rows are shuffled to them.
BROADCAST_IDS = 1_000_000


def release() -> None:
    """Gives memory that a task has freed back to the system, since Spark keeps its Python workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def checked(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids, a written table, marked for broadcast if it has few enough rows."""
    return F.broadcast(ids) if ids.count() <= most else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset (tests), a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larder/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: what follows does not compute it again and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def low_words(text: str | None) -> list[bytes]:
    """The words of WORD with A-Z lower-cased, as UTF-8: bytes know no other letters and no other white space."""
    return text.encode().lower().split() if text else []


def rounds(texts: list, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of texts that hold about `most` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_rounds(column: pa.Array) -> Iterator[tuple[int, int, list]]:
    """Slices of a column of texts that hold about CHUNK_CHARS bytes each, and their texts: only these are Python's."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= CHUNK_CHARS or i + 1 == len(sizes):
            yield start, i + 1, column.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0


def map_texts(docs: DataFrame, keep: list[str], text_col: str, make: Callable[[], Callable[[list], dict]], fields: list[T.StructField]) -> DataFrame:
    """For each row the columns `keep` and the ones that a function computes from the texts of many rows at once.

    `make()` runs once in each task and returns the function: a list of texts (None where null) to arrays by field name.
    """
    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "__text"] + fields)
    types = {f.name: _arrow(f.dataType) for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for a, b, texts in text_rounds(batch.column(batch.num_columns - 1)):
                out = fn(texts)
                cols = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                arrays = cols + [pa.array(out[n], type=t) for n, t in types.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *types])
        fn = batch = texts = out = cols = arrays = None  # noqa: F841  freed before memory goes back
        release()

    return source.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows, all columns as they are, whose text the function marks true; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for a, b, texts in text_rounds(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(np.asarray(fn(texts), dtype=bool)))
        fn = batch = texts = None  # noqa: F841
        release()

    return docs.mapInArrow(run, docs.schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


class Codes(dict):
    """Numbers words in order of first sight; `words` lists them."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, w):
        self[w] = n = len(self.words)
        self.words.append(w)
        return n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (splitmix64's finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def open_folder(uri: str):
    """(file system, path) of a folder in the shared store, for use in tasks."""
    import pyarrow.fs as fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all: a lost or repeated task leaves the same file."""
    store, path = open_folder(uri)
    store.create_dir(path, recursive=True)
    temp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        f.write(data)
    store.move(temp, f"{path}/{name}")


def map_file(uri: str, name: str, dtype) -> np.ndarray:
    """A file of the shared store as a memory-mapped array; from a remote store through an unlinked local copy."""
    store, path = open_folder(uri)
    if type(store).__name__ == "LocalFileSystem":
        return np.memmap(f"{path}/{name}", dtype=dtype, mode="r") if os.path.getsize(f"{path}/{name}") else np.empty(0, dtype)
    with tempfile.TemporaryFile() as f, store.open_input_stream(f"{path}/{name}") as src:
        while block := src.read(1 << 24):
            f.write(block)
        f.flush()
        return np.memmap(f, dtype=dtype, mode="r") if f.tell() else np.empty(0, dtype)
