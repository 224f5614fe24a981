"""A register of payloads: which ones several transmitters send, kept up as files of texts arrive.

Each text stands for the bytes that one source has sent. A run takes the files that are new since its
last run, by a file stream with a checkpoint that ends when all are taken. Two outputs:

* `payloads`: a row for each text, with its bytes' check, digest and length, by bucket of the digest
  and by batch. A batch that is repeated after a failure replaces its own rows.
* `register`: a row for each digest, with how often and by how many sources it was sent, and by which
  first. Only the buckets that a batch touches are made again, of their payloads.

So a run again over nothing new changes nothing, and the register doesn't depend on how files fell into
runs. Null texts are empty ones, null sources count as the empty name.

    python -m jobs.payload_register --config jobs/payload_register.json --set texts=/data/documents --set out=/data/register
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, overwrite
from wavelake.functions.register import crc24

TEXTS = "doc_id long, text string, source string"
PAYLOADS = "doc_id long, source string, n_bytes long, crc long, digest string, bucket int, batch long"
REGISTER = "digest string, crc long, n_bytes long, transmissions long, transmitters long, first_doc_id long, first_source string, shared boolean, bucket int"


def payloads(texts: DataFrame, buckets: int) -> DataFrame:
    """A row for each text, but for the batch."""
    d = texts.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    d = d.select("doc_id", "source", F.octet_length("data").cast("long").alias("n_bytes"), crc24("data").alias("crc"), F.sha2("data", 256).alias("digest"))
    return d.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def register(sent: DataFrame) -> DataFrame:
    """A row for each digest. Counts by digest and source come first, so that a payload sent very often is no task's own."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source"))
    each = sent.groupBy("bucket", "digest", "source").agg(F.count("*").alias("n"), F.min("crc").alias("crc"), F.min("n_bytes").alias("n_bytes"), first.alias("f"))
    d = each.groupBy("bucket", "digest").agg(F.min("crc").alias("crc"), F.min("n_bytes").alias("n_bytes"), F.sum("n").alias("transmissions"), F.count("*").alias("transmitters"), F.min("f").alias("f"))
    return d.select("digest", "crc", "n_bytes", "transmissions", "transmitters", F.col("f.doc_id").alias("first_doc_id"), F.col("f.source").alias("first_source"), (F.col("transmitters") > 1).alias("shared"), "bucket")


def run(spark: SparkSession, config: dict) -> DataFrame:
    """config: texts, out; optionally checkpoint, buckets, files_per_batch. The register as it stands, read back.

    buckets must stay as they are for an output.
    """
    out = config["out"].rstrip("/")
    buckets = int(config.get("buckets", 64))
    sent, kept = f"{out}/payloads", f"{out}/register"
    for path, schema in ((sent, PAYLOADS), (kept, REGISTER)):  # no rows: the folder is there, whatever arrives
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*(["bucket", "batch"] if path == sent else ["bucket"])).parquet(path)
    texts = spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", int(config.get("files_per_batch", 1000))).parquet(config["texts"])

    def taken(batch: DataFrame, number: int) -> None:
        rows = payloads(batch, buckets).withColumn("batch", F.lit(number).cast("long"))
        # Files of even size, a bucket in several where it is large; the key is not dealt to one task.
        overwrite(rows.hint("rebalance", "bucket"), sent, "bucket", "batch")
        session = batch.sparkSession
        every = session.read.schema(PAYLOADS).parquet(sent)
        # At most `buckets` numbers, of the folders' names alone.
        own = every.where(F.col("batch") == number)
        touched = F.col("bucket").isin([r.bucket for r in own.select("bucket").distinct().collect()])
        overwrite(register(every.where(touched)).hint("rebalance", "bucket"), kept, "bucket")
        log.info("batch %d: read %d texts, wrote %d register rows", number, own.count(), session.read.schema(REGISTER).parquet(kept).where(touched).count())

    stream = texts.writeStream.foreachBatch(taken).option("checkpointLocation", config.get("checkpoint") or f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("took %d texts of %s into %s", sum(p.numInputRows for p in stream.recentProgress), config["texts"], out)
    return spark.read.schema(REGISTER).parquet(kept)


if __name__ == "__main__":
    raise SystemExit(main(__doc__, run))
