"""What the jobs share: their log, their command line and their config file."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object, from any store that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes df in folders of by; of what was there, only the folders that df has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def main(name: str, run: Callable, wanted: Sequence[str], doc: str | None) -> None:
    """The command line of a job: a config file, and any of its values given once more as --value."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    parser.add_argument("--config", help="JSON file with the job's settings")
    for key in wanted:
        parser.add_argument(f"--{key.replace('_', '-')}", dest=key, help="instead of the config file's")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        settings = read_config(spark, given["config"]) if given["config"] else {}
        settings |= {k: given[k] for k in wanted if given[k] is not None}
        run(spark, **settings)
    finally:
        spark.stop()
