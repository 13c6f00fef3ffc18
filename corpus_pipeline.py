"""From raw documents to packed training sequences: toxicity, language, near-duplicates, source mix, packing.

Every stage works on all that its predecessor kept and takes part in the result. All but the last return the columns of
documents; the last returns the pieces of sequences.

Defined results: rows with a null id go through all stages, and near-duplicates are not sought among them. A null or
empty text has no letter and goes with the language stage, and so does one in a language that no document is labelled with. Rows that repeat an id leave one row at the near-duplicates.
A document that the mix takes twice has two rows from there on. Columns are kept whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import larder
from larder.llm import language_id, near_dedup, packing, source_mix, toxicity
from larder.llm.common import table, written

#: Bytes of an Arrow batch and rows that are read from Parquet at a time. Both are held twice or more, in the JVM and, for
#: Arrow, in Python, by every task; Spark's own limits let a batch grow to a whole split of texts. Results do not depend on them.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def _prepare(spark: SparkSession) -> None:
    """Ships the package, and sets BATCHES for the session: a stage runs when what it returns is written."""
    larder.ship(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    _prepare(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words the model places in the learned languages, in several of them too."""
    _prepare(spark)
    return language_id.keep_languages(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    _prepare(spark)
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its budget, whole epochs repeated."""
    _prepare(spark)
    return source_mix.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    import public_tokenizers

    _prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("language_id", keep_languages), ("minhash_near_dedup", drop_near_copies), ("source_mix", mix_sources), ("packing", pack_sequences)]
#: SQL can express none of the learned, sketched or tokenizing stages; test_pipeline_by_brute_force holds each against a
#: plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
