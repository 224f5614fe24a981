"""A corpus made ready for training: documents that are good, new and mixed to weights, packed into sequences.

Each stage takes (spark, docs, sf_dir) and what its predecessor kept. Between stages the table is
written and read back. All but the last return the columns of documents; the last returns pieces of
sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.boosting import keep_good
from wavelake.llm.common import small_batches, table, written
from wavelake.llm.copies import keep_one
from wavelake.llm.mixing import keep_mix
from wavelake.llm.packing import pack
from wavelake.llm.passages import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, each judged by its text; see boosting.keep_good()."""
    small_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles alike to 0.8 or more; see copies."""
    small_batches(spark)
    return keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; ones that lose all words go; see passages.without_repeats()."""
    small_batches(spark)
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, row by row; see mixing.keep_mix()."""
    small_batches(spark)
    return keep_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece, their end token; rows that repeat are packed as often.
    """
    small_batches(spark)
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixing", mixing), ("packing", packing)]
#: The stages are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
