"""GPX files in and out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives

_POINT = "ARRAY<STRUCT<_lat: DOUBLE, _lon: DOUBLE, ele: DOUBLE, name: STRING>>"
SCHEMA = f"trk ARRAY<STRUCT<name: STRING, trkseg: ARRAY<STRUCT<trkpt: {_POINT}>>>>, rte ARRAY<STRUCT<name: STRING, rtept: {_POINT}>>, wpt {_POINT}"

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trackloom" xmlns="http://www.topografix.com/GPX/1/1">\n'


def within(path: str):
    """The path of a file inside the folder that is read: its name if it lies in it, with its folders if deeper, so that
    files of one name stay apart."""
    from urllib.parse import quote

    stem = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    root = quote(re.sub(r"^[a-z0-9]+:/+", "/", stem if stem == path else stem.rpartition("/")[0]), safe="/").rstrip("/") + "/"
    whole, at = F.col("_metadata.file_path"), F.locate(root, F.col("_metadata.file_path"))
    return F.when(at > 0, F.substr(whole, at + len(root))).otherwise(F.col("_metadata.file_name"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """track_id (the file, by its path in the folder), name, idx, lat, lon, ele of all track points of GPX files, in document order over
    tracks and segments. A missing elevation is 0. Files without track points give no rows; malformed ones neither
    (`uploads` and `opened` tell which)."""
    files = spark.read.format("xml").option("rowTag", "gpx").option("mode", "DROPMALFORMED").schema(SCHEMA).load(path)
    return track_points(files.select(within(path).alias("track_id"), "trk"), "track_id")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """track_id, name, gpx, error: the GPX files of a folder and those inside its ZIP archives, whatever the case of
    their endings; other files are passed over. track_id is the path in the folder (of a member: that of its archive, ! and its
    own), so files of one name stay apart. An archive that can't be read is one row with an error."""
    archives.register(spark)
    plain = spark.read.option("pathGlobFilter", "*.[gG][pP][xX]").option("recursiveFileLookup", True).text(path, wholetext=True)
    plain = plain.select(within(path).alias("track_id"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("gpx"), F.lit(None).cast("string").alias("error"))
    inner = spark.read.format("zip_members").option("suffixes", ".gpx").load(path)
    inner = inner.select(F.concat_ws("!", "archive", "path").alias("track_id"), "name", F.col("content").cast("string").alias("gpx"), "error")
    return plain.unionByName(inner)


def is_queue(files: DataFrame) -> bool:
    """Two files and more are worked on as a queue, one by hand."""
    return files.where("error is null").limit(2).count() > 1


def opened(files: DataFrame) -> DataFrame:
    """files (track_id, gpx, error, more) with trk; `error` says why a text gives no track: it is no XML, or it has no
    track points."""
    broken = "__corrupt"
    x = F.from_xml(F.col("gpx"), f"{SCHEMA}, {broken} STRING", {"rowTag": "gpx", "columnNameOfCorruptRecord": broken})
    points = F.aggregate(F.coalesce("__x.trk", F.array()), F.lit(0), lambda n, t: n + F.aggregate(F.coalesce(t["trkseg"], F.array()), F.lit(0), lambda m, s: m + F.coalesce(F.size(F.coalesce(s["trkpt"], F.array())), F.lit(0))))
    why = F.when(F.col("gpx").isNull(), "no text").when(F.col(f"__x.{broken}").isNotNull() | F.col("__x").isNull(), "not well-formed").when(points == 0, "no track points")
    return files.withColumn("__x", x).select(*[c for c in files.columns if c != "error"], F.col("__x.trk").alias("trk"), F.coalesce("error", why).alias("error"))


def track_points(files: DataFrame, key: str) -> DataFrame:
    """The same from parsed files: key and trk."""
    t = files.select(key, F.posexplode("trk").alias("__t", "trk"))
    s = t.select(key, "__t", F.col("trk.name").alias("name"), F.posexplode("trk.trkseg").alias("__s", "seg"))
    p = s.select(key, "name", "__t", "__s", F.posexplode("seg.trkpt").alias("__p", "p"))
    return numbered(p.select(key, "name", F.struct("__t", "__s", "__p").alias("at"), *_fields()), key)


def _fields():
    return [F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.coalesce("p.ele", F.lit(0.0)).alias("ele")]


def numbered(p: DataFrame, key: str) -> DataFrame:
    from pyspark.sql.window import Window

    return p.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).cast("long")).select(key, "name", "idx", "lat", "lon", "ele")


def all_points(files: DataFrame, key: str) -> DataFrame:
    """Track points, then route points, then waypoints: key, name, idx, lat, lon, ele (null where missing)."""
    ele = [F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele")]
    t = files.select(key, F.posexplode("trk").alias("__a", "x")).select(key, "__a", F.col("x.name").alias("name"), F.posexplode("x.trkseg").alias("__b", "y"))
    t = t.select(key, "name", "__a", "__b", F.posexplode("y.trkpt").alias("__c", "p"))
    r = files.select(key, F.posexplode("rte").alias("__a", "x")).select(key, "__a", F.col("x.name").alias("name"), F.posexplode("x.rtept").alias("__c", "p"))
    w = files.select(key, F.posexplode("wpt").alias("__c", "p"))
    at = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.col("__c").alias("c")).alias("at")
    parts = [
        t.select(key, "name", at(0, F.col("__a"), F.col("__b")), *ele),
        r.select(key, "name", at(1, F.col("__a"), F.lit(0)), *ele),
        w.select(key, F.col("p.name").alias("name"), at(2, F.lit(0), F.lit(0)), *ele),
    ]
    return numbered(parts[0].unionByName(parts[1]).unionByName(parts[2]), key)


def parsed(texts: DataFrame, text_col: str = "gpx") -> DataFrame:
    """texts with trk, rte and wpt from GPX text in a column."""
    x = F.from_xml(F.col(text_col), SCHEMA, {"rowTag": "gpx"})
    return texts.withColumn("__x", x).select(*texts.columns, "__x.trk", "__x.rte", "__x.wpt")


def to_gpx(points: DataFrame, key: str = "track_id", name_col: str | None = None) -> DataFrame:
    """key, gpx: one document for each track, coordinates to 8 and elevations to 3 decimals, null elevation as 0."""
    line = F.format_string('<trkpt lat="%.8f" lon="%.8f"><ele>%.3f</ele></trkpt>', "lat", "lon", F.coalesce("ele", F.lit(0.0)))
    named = F.first(F.col(name_col), True) if name_col else F.first(F.col(key).cast("string"))
    grouped = points.select("*", line.alias("__line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "__line"))).alias("p"), named.alias("name"))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("name", F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    body = F.concat(F.lit(HEAD + "<trk><name>"), safe, F.lit("</name><trkseg>\n"), F.array_join(F.transform("p", lambda x: x["__line"]), "\n"), F.lit("\n</trkseg></trk>\n</gpx>\n"))
    return grouped.select(key, body.alias("gpx"))


def write_gpx(points: DataFrame, path: str, key: str = "track_id") -> None:
    """A folder per track with its document as text."""
    to_gpx(points, key).select(F.col("gpx").alias("value"), F.col(key)).write.partitionBy(key).text(path)
