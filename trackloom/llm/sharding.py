"""Shards that each match the mixture of sources: proportional stratified interleaving. DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank (rank + 1/2) / rows of
the source spreads every source evenly over 0 to 1. Sources of fewer rows than there are shards have, in place of
the half, a number that a seeded hash gives them, or all sources of one row would come to lie in the middle. In the
order of fractional ranks the rows are cut into shards whose counts differ by one at most, so each shard holds every
source in proportion.

Both rankings are made without a window over a whole source or over the whole table, but in buckets that rise with
the order. A row's rank is the number of rows in the buckets before its own, from a table of one row a bucket, and
its rank within the bucket. Within a source the buckets are equal steps of the seeded hash; over the table they are
Spark's ranges of the whole sort key, as fractions of sources of one size coincide. A source that holds a third of
all rows is thereby spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Rows that a bucket should hold, and the fewest and most buckets.
BUCKET_ROWS, LEAST, MOST = 20_000, 256, 1 << 20


def _ranked(rows: DataFrame, parts: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Add the rank (from 0) within `parts`, for rows whose bucket numbers rise with the order."""
    rows = rows.withColumn("__bucket", bucket)
    sizes = rows.groupBy(*parts, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*parts).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).drop("__n")
    inside = Window.partitionBy(*parts, "__bucket").orderBy(*order)
    rows = rows.withColumn("__inside", F.row_number().over(inside) - 1)
    at = [rows[c].eqNullSafe(sizes[c]) for c in [*parts, "__bucket"]]
    joined = rows.join(sizes, at, "left")
    return joined.select(*[rows[c] for c in rows.columns if not c.startswith("__")], (F.col("__before") + F.col("__inside")).alias(name))


def interleaved_shards(
    docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """A row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null text: no bytes), text_crc32 that of those bytes. law is "rows":
    the counts of the shards differ by one at most. slot counts from 0 without gaps in each shard. grown_shard is
    null, as the law is not that of keys. A null source is a source of its own. The order within a source is that
    of the MD5 of seed, id (nothing if null) and text_crc32; rows that repeat wholly get places of their own. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), F.crc32(text))).alias("key"),
        ),
        "shard-rows",
    )
    slim = _spread(slim)
    per_source = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n_source"))
    total = slim.count()
    buckets = max(LEAST, min(MOST, total // BUCKET_ROWS))
    # The upper 32 bits of the hash as a number from 0 to 2^32 - 1, in equal steps.
    step = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    order = [F.col("key"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = _ranked(slim, ["source"], step, order, "rank")
    # Where a small source begins between 0 and its first step: 32 bits of a hash.
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), ranked["source"])), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    share = ranked.join(F.broadcast(per_source) if per_source_is_small(per_source) else per_source, ranked["source"].eqNullSafe(per_source["source"])).select(
        ranked["doc_id"], ranked["source"], "size", "text_crc32", "key", ((F.col("rank") + F.when(F.col("n_source") < shards, start).otherwise(0.5)) / F.col("n_source")).alias("fraction")
    )
    placed = _ranked(
        ranges(share, total).withColumn("all", F.lit(0)),
        ["all"],
        F.col("range"),
        [F.col("fraction"), F.col("source"), F.col("key"), F.col("doc_id"), F.col("text_crc32"), F.col("size")],
        "place",
    )
    # Shard s holds the places p with floor(p * shards / total) = s; it starts at ceil(s * total / shards).
    n = max(total, 1)
    return placed.withColumn("shard", F.expr(f"CAST(place * {shards}L DIV {n}L AS INT)")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"place - (shard * {n}L + {shards - 1}L) DIV {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def ranges(share: DataFrame, total: int) -> DataFrame:
    """share with range: the number of the part of the order (fraction, source, key, doc_id) that a row lies in. Parts
    are Spark's own ranges, even by a sample of the keys, and are written, so that all that follows sees the same."""
    parts = max(int(share.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST, total // BUCKET_ROWS))
    dealt = share.repartitionByRange(parts, "fraction", "source", "key", "doc_id")
    return stored(dealt.withColumn("range", F.spark_partition_id().cast("long")), "shard-ranges")


def _spread(rows: DataFrame, most: int = BUCKET_ROWS) -> DataFrame:
    """Rows with keys of their own where more than `most` share one: such rows are copies of each other in all that is
    looked at, so any order among them gives the same result, and no bucket need hold them all."""
    crowded = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", F.lit(True).alias("__crowded")), "crowded-keys")
    if crowded.isEmpty():
        return rows
    marked = rows.join(crowded, "key", "left")
    own = F.when(F.col("__crowded"), F.md5(F.concat_ws(":", "key", F.monotonically_increasing_id()))).otherwise(F.col("key"))
    return stored(marked.withColumn("key", own).select(*rows.columns), "shard-rows")


def per_source_is_small(per_source: DataFrame, most: int = 100_000) -> bool:
    """Whether the sources are few enough to send to every executor; counted, not assumed."""
    return per_source.limit(most + 1).count() <= most


#: The same in SQL. CRC-32 is worked out bit by bit: a table of 256 entries, then a fold over the bytes.
OP3_SQL = """
WITH poly AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
sized AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
crc AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS crc FROM sized, poly),
keyed AS (SELECT *, md5('42:' || doc_id || ':' || crc) AS key FROM crc),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id, crc, size) - 1 + CASE WHEN count(*) OVER (PARTITION BY source) < 16 THEN CAST(CAST('0x' || substr(md5(concat_ws(':', '42', source)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 ELSE CAST(0.5 AS DOUBLE) END) / count(*) OVER (PARTITION BY source) AS fraction FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, source, key, doc_id, crc, size) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 16 // n AS INTEGER) AS shard, CAST(place - ((place * 16 // n) * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""


def op3_interleaved_shards(spark, sf_dir):
    return interleaved_shards(table(spark, sf_dir, "documents"))

