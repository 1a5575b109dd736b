"""Choices among tiles, records, sources and map ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo

from .elevation import country, sane

#: Metres between the heights that each country's source has; other countries and places DEFAULT.
RESOLUTION = {
    "FR": 1, "CH": 2, "SI": 1, "ES": 5, "NL": 1, "HR": 20, "NO": 1, "FI": 2, "US": 1, "EE": 1, "DK": 1, "DE": 1, "PL": 1,
    "GB": 1, "CA": 1, "NZ": 1, "AT": 10, "BE": 1, "AU": 5, "MX": 5, "HK": 1,
}
DEFAULT = 5

#: Kinds of railways whose bridges and tunnels carry no road.
RAILWAYS = ["rail", "light_rail", "subway", "tram", "narrow_gauge", "funicular", "monorail", "miniature", "preserved"]


def primary_country(points: DataFrame) -> DataFrame:
    """track_id, cc: the country of the middle point."""
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    return points.withColumn("__n", n).where(F.col("idx") == F.floor(F.col("__n") / 2)).select("track_id", country(F.col("lat"), F.col("lon")).alias("cc"))


def target_resolution(points: DataFrame) -> DataFrame:
    """track_id, metres: the finest resolution at five points of a track, DEFAULT at most."""
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    at = [F.lit(0), F.floor(F.col("__n") / 4), F.floor(F.col("__n") / 2), F.floor(3 * F.col("__n") / 4), F.col("__n") - 1]
    own = F.lit(DEFAULT)
    for cc, metres in RESOLUTION.items():
        own = F.when(F.col("__cc") == cc, metres).otherwise(own)
    seen = points.withColumn("__n", n).where(F.array_contains(F.array(*[a.cast("long") for a in at]), F.col("idx").cast("long")))
    return seen.withColumn("__cc", country(F.col("lat"), F.col("lon"))).groupBy("track_id").agg(F.least(F.min(own), F.lit(DEFAULT)).alias("metres"))


def raster_stats(cells: DataFrame) -> DataFrame:
    """tile_id, rows, cols, lowest, highest, missing of the cells (tile_id, row, col, z) of rasters."""
    return cells.groupBy("tile_id").agg(
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.min("z").alias("lowest"), F.max("z").alias("highest"), F.count_if(F.col("z").isNull()).alias("missing")
    )


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes (west, south, east, north) touch or overlap."""
    return (a["north"] >= b["south"]) & (a["south"] <= b["north"]) & (a["east"] >= b["west"]) & (a["west"] <= b["east"])


def coordinates_box(text: Column) -> Column:
    """struct(west, south, east, north) of all coordinate pairs in GeoJSON text, at any depth; null if there are none."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    pair = rf"\[\s*{number}\s*,\s*{number}"
    side = lambda i: F.transform(F.regexp_extract_all(text, F.lit(pair), F.lit(i)), lambda v: v.cast("double"))
    x, y = side(1), side(2)
    return F.when(F.size(x) > 0, F.struct(F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north")))


def degree_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The box with its sides in order, if all are degrees; else null."""
    fits = x0.between(-180, 180) & x1.between(-180, 180) & y0.between(-90, 90) & y1.between(-90, 90)
    return F.when(fits, F.struct(F.least(x0, x1).alias("west"), F.least(y0, y1).alias("south"), F.greatest(x0, x1).alias("east"), F.greatest(y0, y1).alias("north")))


def source_tag(explicit: Column, dataset: Column, kind: Column, cc: Column) -> Column:
    """The name under which a provider's answers are known: its own, that of its data, or country and kind."""
    suffix = F.when(kind == "gpxz", "_GPXZ").when(kind == "wcs", "_WCS").otherwise("_REST")
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(dataset, F.lit("")), F.concat(cc, suffix))


def date_ordinal(title: Column) -> Column:
    """Days since the first of January of the year 1 (which is 1) of the date dd.mm.yyyy in a title; 0 if there is none."""
    found = F.regexp_extract(title, r"(\d{2}\.\d{2}\.\d{4})", 1)
    day = F.try_to_date(F.nullif(found, F.lit("")), "dd.MM.yyyy")
    return F.coalesce(F.datediff(day, F.lit("1970-01-01").cast("date")) + 719163, F.lit(0)).cast("long")


def best_record(records: DataFrame, keys: list[str], bonus: Column) -> DataFrame:
    """Of the records (keys, pos, title) of each key the newest, dates and bonus counted together; of equals the one of
    the later date, then the first. Surface models are left out."""
    day = date_ordinal(F.col("title"))
    kept = records.where(~F.coalesce(F.col("title").rlike("(?i)als dsm"), F.lit(False)))
    return kept.groupBy(*keys).agg(F.max_by(F.struct("pos", "title"), F.struct((day + bonus).alias("score"), day.alias("day"), (-F.col("pos")).alias("early"))).alias("best")).select(*keys, "best.pos", "best.title")


#: What the address or description of a raster holds at least one of.
RASTER_WORDS = (".tif", ".tiff", ".zip", "geotiff", "geo tiff", "dtm", "dgm", "terrain")


def best_resource(resources: DataFrame, keys: list[str], hosts: list[str], expected: Column | None = None, keywords: list[str] | None = None) -> DataFrame:
    """Of the resources (keys, pos, url, format, name, description) of each record the most promising: keys, pos, url.

    Only addresses on `hosts` and their subdomains count, that are rasters by their words and hold one of `keywords` (if
    any are given). Points are given for the expected code, for endings and formats, for names of terrain models, and
    taken off for services; of equals the first in order."""
    text = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    url = F.trim(F.coalesce("url", F.lit("")))
    hay = F.concat_ws(" ", F.lower(url), text("format"), text("name"), text("description"))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    any_of = lambda c, parts: F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda w: F.contains(c, w))
    allowed = F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h))) if hosts else F.lit(False)
    good = allowed & any_of(hay, RASTER_WORDS)
    if keywords:
        good = good & any_of(hay, keywords)
    low, kind = F.lower(url), text("format")
    when = lambda test, points: F.when(test, points).otherwise(0)
    score = when(low.contains(".tif"), 8) + when(low.contains(".zip"), 6) + when(kind.contains("geotiff") | (kind == "tiff"), 5) + when(kind == "zip", 4)
    score = score + when(any_of(hay, ["dtm", "dgm"]), 3) - when(any_of(hay, ["wms", "wfs", "service"]), 6)
    if expected is not None:
        code = F.lower(F.coalesce(expected, F.lit("")))
        score = score + when((code != "") & F.contains(hay, code), 20)
    best = F.max_by(F.struct("pos", url.alias("url")), F.struct(score.alias("score"), (-F.col("pos")).alias("early")))
    return resources.where(good).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.pos", "b.url")


def discovery_points(points: DataFrame, cell: float, step: int = 5, most: int = 200) -> DataFrame:
    """Points to ask a catalogue about, of those it has no tile for (track_id, idx, lat, lon): every step-th and both ends
    of each track, one in a cell of `cell` degrees, `most` of a track (a limit of the service that is asked)."""
    w = Window.partitionBy("track_id").orderBy("idx")
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    k = F.row_number().over(w) - 1
    some = points.withColumn("__k", k).withColumn("__n", n).where((F.col("__k") % step == 0) | (F.col("__k") == F.col("__n") - 1))
    place = [F.floor(F.col("lat") / cell), F.floor(F.col("lon") / cell)]
    first = some.withColumn("__c", F.row_number().over(Window.partitionBy("track_id", *place).orderBy("idx"))).where("__c = 1")
    return first.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).select("track_id", "idx", "lat", "lon")


def road_kinds(ways: DataFrame) -> DataFrame:
    """The ways (tags, closed, more) that are bridges or tunnels of roads, with kind (a way may be both): not closed, not
    waterways, not rail unless a cycleway, no passages through buildings; viaducts are bridges."""
    has = lambda k: F.col("tags")[k].isNotNull()
    rail = F.coalesce(F.col("tags")["railway"].isin(RAILWAYS), F.lit(False)) & ~F.coalesce(F.col("tags")["highway"] == "cycleway", F.lit(False))
    dry = ~has("waterway") | F.coalesce(F.col("tags")["highway"] == "cycleway", F.lit(False))
    over = (has("bridge") & ~rail & dry) | (F.coalesce(F.col("tags")["man_made"] == "viaduct", F.lit(False)) & ~has("waterway"))
    under = has("tunnel") & (F.col("tags")["tunnel"] != "building_passage") & ~rail & dry
    kinds = F.array_compact(F.array(F.when(over, "bridge"), F.when(under, "tunnel")))
    return ways.where(~F.col("closed")).withColumn("kind", F.explode(kinds))


def road_ways(ways: DataFrame) -> DataFrame:
    """id, kind of the ways (id, tags, closed) that are bridges or tunnels of roads."""
    return road_kinds(ways).select("id", "kind").distinct()


def unsupported(countries: DataFrame, supported: DataFrame, neighbours: DataFrame) -> DataFrame:
    """cc, others: countries (cc) without a source, and their neighbours (cc, priority, other) that have one, best first;
    an empty list where no neighbour helps."""
    missing = countries.join(supported, "cc", "left_anti").distinct()
    helps = neighbours.join(supported.select(F.col("cc").alias("other")), "other")
    listed = missing.join(helps, "cc", "left").groupBy("cc").agg(F.array_sort(F.collect_list(F.when(F.col("other").isNotNull(), F.struct("priority", "other")))).alias("l"))
    return listed.select("cc", F.transform("l", lambda x: x["other"]).alias("others"))


def seam_sampled(points: DataFrame, tiles: DataFrame, cells: DataFrame, size: float, grid: float) -> DataFrame:
    """points (track_id, idx, lat, lon) with ele of the first tile (by ord) that holds them; where it has no value, of
    the smallest other that has one. Tiles (tile_id, ord, west, south, east, north) and points meet in cells of `grid`
    degrees; cells: tile_id, row, col, z, rows from the north edge."""
    side = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / grid), F.floor(F.col(b) / grid)))
    rows = tiles.withColumn("cy", side("south", "north")).withColumn("cx", side("west", "east"))
    placed = points.withColumn("cy", F.floor(F.col("lat") / grid)).withColumn("cx", F.floor(F.col("lon") / grid))
    met = placed.join(rows, ["cy", "cx"]).where(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
    first = F.min("ord").over(Window.partitionBy("track_id", "idx"))
    met = met.withColumn("__second", F.col("ord") != first).withColumn("__area", (F.col("east") - F.col("west")) * (F.col("north") - F.col("south")))
    met = met.withColumn("row", F.floor((F.col("north") - F.col("lat")) / size)).withColumn("col", F.floor((F.col("lon") - F.col("west")) / size))
    asked = met.join(cells, ["tile_id", "row", "col"]).withColumn("z", sane(F.col("z"))).where(F.col("z").isNotNull())
    best = asked.groupBy("track_id", "idx").agg(F.min_by(F.struct("z", "tile_id"), F.struct("__second", "__area", "ord")).alias("b"))
    return points.join(best, ["track_id", "idx"], "left").select(*points.columns, F.col("b.z").alias("ele"), F.col("b.tile_id").alias("tile_id"))


def on_line(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column], most: float = 1.0) -> Column:
    """Whether a place lies on the leg from a to b: at an end of it, or with its foot inside and `most` metres off."""
    ax, ay = geo.local_vector(*p, *a)
    bx, by = geo.local_vector(*p, *b)
    dx, dy = bx - ax, by - ay
    n = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    f = -(ax * dx + ay * dy) / n
    off = F.abs(ax * dy - ay * dx) / F.sqrt(n)
    return at_place(p, a) | at_place(p, b) | F.coalesce((f >= 0) & (f <= 1) & (off <= most), F.lit(False))


def at_place(p: tuple[Column, Column], q: tuple[Column, Column], most: float = 0.05) -> Column:
    """Whether two places are less than `most` metres apart."""
    return geo.great_circle(*p, *q) < most


def on_corner(p, a, b, c, d) -> Column:
    """Whether a place lies on the corner between the legs a-b and c-d: at b or c, or the directions by way of it turn
    one way only."""
    along = lambda u, v: geo.direction(*u, *v)
    first = along(a, b)
    t1, t2, t3 = [geo.delta_angle(first, along(u, v)) for u, v in ((b, p), (p, c), (c, d))]
    turns = ((t1 >= 0) & (t2 >= t1) & (t3 >= t2)) | ((t1 <= 0) & (t2 <= t1) & (t3 <= t2))
    return at_place(p, b) | at_place(p, c) | (turns & ~at_place(a, b) & ~at_place(b, c) & ~at_place(c, d))


def on_road(p, a, b, c, d, most: float = 1.0) -> Column:
    """On the leg b-c, or on its corner with the legs before and after it."""
    return on_line(p, b, c, most) | on_corner(p, a, b, c, d)
