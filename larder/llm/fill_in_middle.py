"""Fill-in-middle transformation over an index of distinct texts.

Rows are dealt once by their text and sorted by it, so equal texts lie together and are told apart by their content
itself. Each distinct text gets its token boundaries as an Elias-Fano list once; its rows join the list as they pass, a
batch at a time, and each selects its two cuts from it. A text that very many rows share is dealt over parts, each of
which holds about `hot_rows` rows and its own copy of the list.

An Elias-Fano list holds m growing numbers below u as their low bits, l = log2(u / m) each, and a bit vector in which the
i-th one stands at the number's high part plus i: about 2 + l bits a boundary.

Defined results: a null text counts as empty, and an empty one stays plain. A text that holds a marker stays plain. A null
id draws its cuts as an id without digits would. Rows that repeat an id and text get the same result each. Other columns
are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked, table, written

#: Fixed parameters of the query.
SEED = "1"
FIM_PERCENT, SPM_PERCENT = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows of one text beyond which it is dealt over parts.
HOT_ROWS = 1_000


def boundaries(text: str) -> np.ndarray:
    """Code points before each token and after the last. A token is a run of ASCII letters or one other code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = (points | 32) - np.uint32(97) < 26
    inside = np.zeros(len(points), dtype=bool)
    inside[1:] = letter[1:] & letter[:-1]
    return np.append(np.flatnonzero(~inside), len(points))


def low_bits(m: int, top: int) -> int:
    """Low bits of each of m numbers from 0 to top."""
    return max(0, ((top + 1) // m).bit_length() - 1)


def elias_fano(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Low bits and high bits of growing numbers, the largest last."""
    m = len(numbers)
    width = low_bits(m, int(numbers[-1]))
    low = (numbers[:, None] >> np.arange(width - 1, -1, -1)) & 1
    at = (numbers >> width) + np.arange(m)
    high = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
    high[at] = 1
    return np.packbits(low.astype(np.uint8).ravel()).tobytes(), np.packbits(high).tobytes()


def select(low: bytes, high: bytes, m: int, top: int, ranks: np.ndarray) -> np.ndarray:
    """The numbers of the given ranks, from 0, of a list of m numbers up to top."""
    width, bits = low_bits(m, top), np.frombuffer(high, dtype=np.uint8)
    ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
    byte = np.searchsorted(ones, ranks + 1)
    before = np.where(byte > 0, ones[byte - 1], 0)
    inner = np.cumsum(np.unpackbits(bits[byte][:, None], axis=1), axis=1)  # the eight bits of each byte
    at = 8 * byte + (inner < (ranks + 1 - before)[:, None]).sum(axis=1)
    value = at - ranks
    lows = np.frombuffer(low, dtype=np.uint8)
    for k in range(width):
        bit = ranks * width + k
        value = 2 * value + (lows[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
    return value


class BoundaryList:
    """The token boundaries of one text as an Elias-Fano list."""

    def __init__(self, text: str):
        numbers = boundaries(text)
        self.n, self.chars = len(numbers) - 1, int(numbers[-1])
        self.low, self.high = elias_fano(numbers)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        return select(self.low, self.high, self.n + 1, self.chars, ranks)


def _join_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of text: where the content changes, the next text's list is made; every row of the text joins it."""
    text = index = None
    for batch in batches:
        ids, texts, one, two = (batch.column(i) for i in range(4))
        many = texts.value_counts()  # distinct texts of the batch in order of sight, which is sorted
        counts = many.field("counts").to_numpy()
        cuts, sizes = [], []
        at = 0
        for own, count in zip(many.field("values").to_pylist(), counts.tolist()):
            if own != text:
                text, index = own, BoundaryList(own)
            ranks = np.stack([one[at : at + count].to_numpy(), two[at : at + count].to_numpy()]) % (index.n + 1)
            cuts.append(index.select(np.sort(ranks, axis=0).ravel()).reshape(2, count))
            sizes.append(index.n)
            at += count
        first, second = np.concatenate(cuts, axis=1) if cuts else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([ids, texts, pa.array(np.repeat(np.array(sizes, np.int64), counts)), pa.array(first), pa.array(second)], names=["id", "text", "n", "first", "second"])


def dealt(docs: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, text and part, dealt by text and part: rows of a text that very many share go to several parts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    hot = rows.groupBy("hash").agg(F.count("*").alias("many")).filter(F.col("many") > hot_rows)
    hot = checked(written(hot.select("hash", F.ceil(F.col("many") / hot_rows).alias("parts")), "fim-hot"))
    # The input's partition deals rows that agree in id and text.
    part = F.coalesce(F.pmod(F.xxhash64("id", "at"), "parts"), F.lit(0))
    rows = rows.withColumn("at", F.spark_partition_id()).join(hot, "hash", "left")
    return rows.select("id", "text", part.alias("part")).repartition("text", "part")


def number(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, from 1, as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    body = F.substr(output, F.lit(4))
    other = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    one = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substr(body, F.length(one) + F.length(other) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(two) + 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars and the output text."""
    rows = dealt(docs, id_col, text_col, hot_rows)
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = rows.sortWithinPartitions("text").select("id", "text", number(digest, 1).alias("one"), number(digest, 2).alias("two"))
    schema = T.StructType([rows.schema["id"], rows.schema["text"], *(T.StructField(c, T.LongType()) for c in ("n", "first", "second"))])
    df = rows.mapInArrow(_join_index, schema)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (number(digest, 3) % 100 >= fim_percent)
    df = df.withColumn("form", F.when(plain, "plain").when(number(digest, 4) % 100 < spm_percent, "spm").otherwise("psm"))
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), first), F.substr("text", first + 1, second - first), F.substr("text", second + 1)
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    is_plain = F.col("form") == "plain"
    return df.select(
        F.col("id").alias(id_col), "n", "form", F.when(~is_plain, F.col("first")).alias("prefix_chars"), F.when(~is_plain, F.col("second") - F.col("first")).alias("middle_chars"),
        F.when(is_plain, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1:b], ''), '') AS middle, coalesce(array_to_string(w[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
