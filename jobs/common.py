"""What the jobs share: command line, config, writes by partition."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def overwrite(df: DataFrame, path: str, *by: str) -> None:
    """Write df by partitions; those that it has rows for are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def main(doc: str, run: Callable[[SparkSession, dict], DataFrame], argv: list[str] | None = None) -> int:
    """Run a job from the command line: a config file (JSON, at any path Spark reads), and values that go before it."""
    p = argparse.ArgumentParser(description=doc)
    p.add_argument("--config", required=True)
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a value (JSON, or else text) instead of the config's")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = json.loads(spark.read.text(args.config, wholetext=True).first()[0])
        for item in args.set:
            key, _, value = item.partition("=")
            try:
                config[key] = json.loads(value)
            except ValueError:
                config[key] = value
        run(spark, config)
    finally:
        spark.stop()
    return 0
