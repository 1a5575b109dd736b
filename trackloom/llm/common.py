"""Helpers that the text operators share: scratch tables, batch bounds and the word rule."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word after lower-casing A-Z: any run of ASCII letters, digits or non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in one Arrow batch. Texts are of any length, so a batch is kept to few rows.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where scratch tables go if the session names no shared folder: tests on one machine.
OWN_DIR = "/tmp/checkpoints/trackloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The cluster names it in spark.checkpoint.dir; only where that is
    unset and all is one process (local mode, as in tests) a folder of our own is used, which goes when it ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"{OWN_DIR}/{os.getpid()}"
    if own not in _own:
        _own.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


_own: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return os.path.join(shared_dir(spark), f"scratch-{spark.sparkContext.applicationId}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts lineage, and survives lost executors
    because every executor can read the files. They stay, as results may read them, until release()."""
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application. Results that have not been written yet can't be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow batches of `rows` rows at most: views of those that come, so that what is made of very long texts does
    not gather. (Spark itself ends a batch at 64 MB.)"""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def gathered(batches: Iterator, rows: int, most_bytes: int = 1 << 25) -> Iterator:
    """Batches put together until they have `rows` rows or most_bytes bytes."""
    import pyarrow as pa

    held: list = []
    n = size = 0
    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= most_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def crc_of(col: Column) -> Column:
    """Unsigned CRC-32 of a value's decimal text."""
    return F.crc32(col.cast("string").cast("binary"))


def give_back() -> None:
    """Return freed memory of a Python worker to the system. Workers live on between stages, so what one stage has
    needed at its most would otherwise be held through all later ones."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Memo:
    """Remembered results in two generations: when the newer holds `size` entries it becomes the older one, whose
    entries are dropped unless they are asked for again. Bounded, and it changes no result."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict = {}
        self.old: dict = {}

    def put(self, key, value):
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value

    def shrink(self) -> None:
        self.old = {}

    def old_value(self, key):
        """A value of the older generation, made new again; None if there is none."""
        value = self.old.pop(key, None)
        return None if value is None else self.put(key, value)
