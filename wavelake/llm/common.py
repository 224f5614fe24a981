"""Session helpers shared by the text operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; only a longer single text exceeds it.
SLICE_BYTES = 1 << 20

#: Bytes of input for each file of a table derived from it.
FILE_BYTES = 64 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and all run on one machine (tests) a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="wavelake-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = "file://" + _LOCAL[0]
    return f"{base.rstrip('/')}/wavelake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that clash with none of a table's (Spark tells no case apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def volume(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as Spark knows them without a job; rows whose size it doesn't know count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)


def partitions(source: DataFrame, bytes_each: int = FILE_BYTES) -> int:
    """Tasks for work that grows with source: as many as the session shuffles into, or more where its files are worth more."""
    spark = source.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(volume(source) // bytes_each, 1 << 20))


def compact(df: DataFrame, source: DataFrame) -> DataFrame:
    """df in as few partitions as keep all cores busy twice, or more where source's files are worth more.

    Tables derived from source then have no files of a few rows, whatever the shuffle partitions.
    """
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, min(volume(source) // FILE_BYTES, 1 << 20)))


def written(df: DataFrame, source: DataFrame | None = None, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there.

    The files outlive executors, so that a lost one costs only its running tasks. source: what df's
    size is held against, see compact().
    """
    path = shared_folder(df.sparkSession)
    (compact(df, source) if source is not None else df).write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have at most BATCH_ROWS rows, where the session doesn't say otherwise: texts are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, n: int):
    """crc32 of the id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
