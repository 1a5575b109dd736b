"""WARC fixity audit with Merkle trees.

Records are serialised as WARC resource records and laid out in files of 2 ** FILE_BITS slots by their page number,
in order, so a record's place does not depend on what its replica has lost. A leaf stands for a slot: count, length and
a sum of the digests of its records, so that any number of records may share a page number (or lack one) and are still
added up in parts. A node digests the ordered digests of 2 ** FAN_BITS neighbouring children: ranges of slots, files,
groups of files, up to one root. Two replicas whose roots agree are equal. Otherwise only the children of nodes that
differ are compared, level by level, down to the slots at fault.

Only page number, length and digest of a record are shuffled, never its bytes. Offsets come from the lengths of parts
of files (a slot, or for many records in one slot a part of its digests), so no window holds more than a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

FILE_BITS, FAN_BITS = 10, 4

#: Parts into which the records of one slot and one beginning of digests are dealt.
SALTS = 16


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC/1.0 resource record. Null url and html count as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        page_id.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, slot, length, digest, part of every record, stored. A null number counts as -1."""
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long"))
    text = record_text(number, F.col(url_col), F.col(html_col))
    return stored(
        pages.select(
            F.col(id_col).cast("long").alias("page_id"),
            number.alias("slot"),
            F.octet_length(text).cast("long").alias("length"),
            F.sha2(text.cast("binary"), 256).alias("digest"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt"),
        ).withColumn("part", F.concat_ws("/", F.substring("digest", 1, 3), "salt")),
        "warc-records",
    )


def laid_out(found: DataFrame) -> DataFrame:
    """The records with their file and byte offset in it: files hold their records in the order of slots, and records
    of one slot by the parts and digests they have."""
    found = found.withColumn("warc_file", F.shiftright("slot", FILE_BITS))
    keys = ["warc_file", "slot", "part"]
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy(*keys).agg(F.sum("length").alias("bytes"))
    sizes = sizes.withColumn("start", F.coalesce(F.sum("bytes").over(before("warc_file").orderBy("slot", "part")), F.lit(0).cast("long"))).drop("bytes")
    inside = F.coalesce(F.sum("length").over(before("warc_file", "slot", "part").orderBy("digest", "page_id")), F.lit(0).cast("long"))
    return found.withColumn("inside", inside).join(sizes, keys).withColumn("offset", F.col("start") + F.col("inside"))


def parents(nodes: DataFrame) -> DataFrame:
    """node, digest of the nodes above: the ordered digests of children, with their places."""
    ordered = F.array_sort(F.collect_list(F.struct("node", "digest")))
    up = nodes.groupBy(F.shiftright("node", FAN_BITS).alias("above")).agg(ordered.alias("children"))
    line = F.transform("children", lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"]))
    return up.select(F.col("above").alias("node"), F.sha2(F.array_join(line, "\n").cast("binary"), 256).alias("digest"))


def leaves(found: DataFrame) -> DataFrame:
    """node, digest of every slot: how many records it has, their lengths, and the sums of the five parts of their
    digests, none of which depends on their order."""
    piece = lambda k: F.sum(F.conv(F.substring("digest", 1 + 13 * k, 13), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = F.concat_ws("/", F.count(F.lit(1)).cast("string"), F.sum("length").cast("string"), *[piece(k) for k in range(5)])
    return found.groupBy(F.col("slot").alias("node")).agg(sums.alias("digest"))


def tree(found: DataFrame, top: int) -> list[DataFrame]:
    """Levels from the leaves up to the root; `top` of them above the leaves, so that two replicas' trees are alike."""
    levels = [stored(leaves(found), "warc-leaves")]
    nodes = levels[0]
    for _ in range(top):
        nodes = stored(parents(nodes), "warc-level")
        levels.append(nodes)
    return levels


def height(*replicas: DataFrame) -> int:
    """Levels until all slots of all replicas have one ancestor."""
    ends = [r.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).first() for r in replicas]
    lo, hi = min([e["lo"] for e in ends if e["lo"] is not None], default=0), max([e["hi"] for e in ends if e["hi"] is not None], default=0)
    n = 1
    while lo >> FAN_BITS * n != hi >> FAN_BITS * n and n < 20:
        n += 1
    return n


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that are not alike in both levels."""
    right = b.select(F.col("node").alias("other"), F.col("digest").alias("other_digest"))
    met = a.join(right, a["node"] == right["other"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("other_digest")))
    return met.select(F.coalesce("node", "other").alias("node")).distinct()


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """slot, kind of every slot at fault in replica b against a, both made by records(): kind is altered (its records
    are not the same), missing or extra (the other has none). No row: equal."""
    top = height(a, b)
    up, other = tree(a, top), tree(b, top)
    bad = stored(differing(up[-1], other[-1]), "warc-bad")
    for level in range(top - 1, 0, -1):
        if bad.isEmpty():
            break
        bad = stored(differing(*[_under(t[level], bad) for t in (up, other)]), "warc-bad")
    left, right = _under(up[0], bad), _under(other[0], bad).select(F.col("node").alias("other"), F.col("digest").alias("e"))
    met = left.join(right, left["node"] == right["other"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("e")))
    kind = F.when(F.col("e").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("altered")
    return met.select(F.coalesce("node", "other").alias("slot"), kind.alias("kind"))


def _under(level: DataFrame, bad: DataFrame) -> DataFrame:
    """The nodes of a level whose parents are bad."""
    return level.withColumn("above", F.shiftright("node", FAN_BITS)).join(bad.withColumnRenamed("node", "above"), "above", "left_semi").drop("above")


#: What the registered query's replica adds to the numbers of pages that it makes up.
EXTRA = 1 << 30


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults for the registered query: of 97 pages, one has its last character replaced,
    one lacks its last ten, one is lost, and one is there once more under a number EXTRA higher."""
    rest = F.pmod("page_id", F.lit(97))
    html = F.when(rest == 5, F.concat(F.expr("left(html, length(html) - 1)"), F.lit("\x7f"))).when(rest == 11, F.expr("left(html, length(html) - 10)")).otherwise(F.col("html"))
    more = pages.where(rest == 23).withColumn("page_id", F.col("page_id") + EXTRA)
    return pages.where(F.coalesce(rest != 17, F.lit(True))).withColumn("html", html).unionByName(more)


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """A row per record of pages: page_id, warc_file, offset, length, record_sha256, fault (null if sound); and one for
    each slot that only the replica fills: its number as page_id, fault extra, the rest null. Records that share a number
    share its fault. Null url and html count as empty, pages without number share one slot, texts are read whole, other
    columns are not read. Two empty tables give no rows."""
    own = records(pages)
    found = stored(audit(own, records(replica)), "warc-faults")
    whole = laid_out(own).join(found.where("kind <> 'extra'"), "slot", "left")
    rows = whole.select("page_id", "warc_file", "offset", "length", F.col("digest").alias("record_sha256"), F.col("kind").alias("fault"))
    more = found.where("kind = 'extra'").select(F.col("slot").alias("page_id"), F.col("kind").alias("fault"))
    return rows.unionByName(more, allowMissingColumns=True)


def op5_warc_fixity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return fixity(pages, damaged(pages))


OP5_SQL = r"""
WITH r AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
         || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
         || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages)
SELECT page_id, page_id // 1024 AS warc_file,
       CAST(coalesce(sum(octet_length(encode(rec))) OVER (PARTITION BY page_id // 1024 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(octet_length(encode(rec)) AS BIGINT) AS length, sha256(rec) AS record_sha256,
       CASE page_id % 97 WHEN 5 THEN 'altered' WHEN 11 THEN 'altered' WHEN 17 THEN 'missing' END AS fault
FROM r
UNION ALL SELECT page_id + 1073741824, NULL, NULL, NULL, NULL, 'extra' FROM r WHERE page_id % 97 = 23
"""
