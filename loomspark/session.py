"""Session set-up shared by the command line, the benchmark and the tests."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomspark.scratch import PLAIN_READS

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitting tool's own configuration is used instead."""
    cores = cores or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", "8g")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(cores), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows and bytes of a batch to Python. A text may take a hundred kilobytes, so Spark's own ten thousand rows are too many.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 2 << 20) -> None:
    """Hold the session's batches to ``rows`` and ``size`` bytes from now on, unless it asks for fewer already. Results do not depend on it."""
    for key, most in ((BATCH, rows), (BATCH_BYTES, size)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def open_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Python workers that start from now on find this package as the driver did."""
    root, seen = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in seen.get("PYTHONPATH", "").split(os.pathsep):
        seen["PYTHONPATH"] = os.pathsep.join(filter(None, [root, seen.get("PYTHONPATH", "")]))
    small_batches(spark)
    return spark.read.options(**PLAIN_READS).parquet(f"{folder}/{name}.parquet")
