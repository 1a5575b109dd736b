"""Exact duplicates by a tree-merge of sorted digest runs. DataFrame functions only.

Every input partition is a run: its rows reduced to one entry per digest. Runs then meet in binomial rounds.
In a round, `fan_in` neighbouring runs (those whose number agrees after dropping log2(fan_in) bits) exchange
entries by digest and are merged into one: entries whose digest, length and second hash all agree become one
entry with the row that stays and the sum of the rows. A run is spread over many tasks by digest, so no task
holds a whole run, and a text that fills a third of the corpus costs at most one entry a run in each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The white space that does not count: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

#: What must agree besides the SHA-256 digest before two entries are merged.
KEY = ["text_sha256", "n_norm", "check"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row per document: id, digest key, code points of the original text, its run and a row number."""
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        norm.alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
    ).select(
        "doc_id",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("norm").alias("n_norm"),
        F.xxhash64("norm").alias("check"),
        "n_points",
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def merge_runs(entries: DataFrame, n_runs: int, fan_in: int = 8) -> DataFrame:
    """Merge runs round by round until one is left: a row per digest key with `best` and `group_size`."""
    bits = fan_in.bit_length() - 1
    if fan_in != 1 << bits or bits < 1:
        raise ValueError("fan_in must be a power of two, 2 at least")
    while True:
        entries = entries.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        if n_runs <= 1:
            return entries.drop("run")
        entries = entries.withColumn("run", F.shiftright("run", bits))
        n_runs = -(-n_runs // fan_in)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deleting space and U+0009 to U+000D; null counts as empty.
    The row with the most code points, then the smallest id (null last), stays. Of rows that repeat both
    id and text exactly one is kept. An empty table gives no rows. Other columns are not looked at.
    """
    slim = stored(digest_rows(docs, id_col, text_col), "digests")
    n_runs = (slim.agg(F.max("run").alias("n")).first()["n"] or 0) + 1
    best = F.struct(
        (-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("row").alias("row")
    )
    entries = slim.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("group_size"))
    merged = merge_runs(entries, n_runs, fan_in)
    return slim.join(merged, KEY).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of docs.

    Rows are found again by id and digest. Where several rows share both, the one with the most code points stays (of
    equally long texts that of the greater 64-bit hash; of rows that repeat id and text one).
    """
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__kept"), F.col("text_sha256").alias("__kept_sha"))
    tagged = docs.withColumn("__sha", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    same = tagged[id_col].eqNullSafe(kept["__kept"]) & (tagged["__sha"] == kept["__kept_sha"])
    best = F.max_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(F.char_length(F.coalesce(F.col(text_col), F.lit(""))), F.xxhash64(text_col)))
    one = tagged.join(kept, same, "left_semi").groupBy(F.col(id_col).alias("__id"), "__sha").agg(best.alias("__row"))
    return one.select("__row.*")


def op6_exact_dedup(spark, sf_dir):
    from .common import table

    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id)
"""
