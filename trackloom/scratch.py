"""Scratch tables: what a job in several rounds keeps between them, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where they go if the session names no shared folder: tests on one machine.
OWN_DIR = "/tmp/checkpoints/trackloom-routes"

#: Rows of a table that Spark may broadcast by itself.
MANY_ROWS = 200_000

_own: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The part of the shared folder (spark.checkpoint.dir) that belongs to this application. Only where none is named
    and all is one process, as in tests, a folder of our own is used, which goes when it ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"{OWN_DIR}/{os.getpid()}"
        if own not in _own:
            _own.add(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
    return os.path.join(named, f"routes-{spark.sparkContext.applicationId}")


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write df there as Parquet, in folders by the columns `by`, and read it back: cuts lineage and survives lost executors.

    Rows in order pack so well that Spark takes millions of them for few and broadcasts them. So the rows are counted (from
    the files' footers), and of over MANY_ROWS joins are merged, unless the other side is broadcast by name."""
    spark = df.sparkSession
    path = os.path.join(folder(spark), f"{label}-{uuid.uuid4().hex}")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back = back.select(*df.columns) if by else back
    return back.hint("merge") if back.count() > MANY_ROWS else back


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application. Results that have not been written yet can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
