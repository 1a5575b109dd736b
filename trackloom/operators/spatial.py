"""Joins of places: nearest, within reach, crossing, and along the track."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo
from trackloom.scratch import stored

from .intervals import islands
from .tracks import in_order

METRES_PER_DEGREE = geo.RADIUS * math.pi / 180


def segments(points: DataFrame) -> DataFrame:
    """A row per segment: track_id, seg (of its first point), its ends alat, alon, blat, blon, adist, bdist."""
    nxt = lambda c: F.lead(c).over(in_order())
    out = points.select(
        "track_id", F.col("idx").alias("seg_idx"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.col("dist").alias("adist"),
        nxt("lat").alias("blat"), nxt("lon").alias("blon"), nxt("dist").alias("bdist"),
    )
    return out.where(F.col("blat").isNotNull())


def _row_scale(y: Column, step: float) -> Column:
    """How much shorter a degree of longitude is in a row of cells."""
    return F.cos(F.radians(F.least(F.abs(y * step), F.lit(89.9))))


def cell(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    """Grid cell of a place: rows of `size` metres from south to north, in each of which cells are about as wide."""
    step = size / METRES_PER_DEGREE
    y = F.floor(lat / step)
    return F.floor(lon * _row_scale(y, step) / step), y


def around(lat: Column, lon: Column, within: float, size: float) -> Column:
    """The cells of `size` of all places within `within` metres: mostly one to four, where cells are twice as large."""
    step, d = size / METRES_PER_DEGREE, within / METRES_PER_DEGREE
    side = d / F.cos(F.radians(F.least(F.abs(lat) + d, F.lit(89.9))))
    rows = F.sequence(F.floor((lat - d) / step), F.floor((lat + d) / step))
    # Each row of cells with its ends: (y, first x, last x), worked out once.
    scale = lambda y: _row_scale(y, step) / step
    ends = F.transform(rows, lambda y: F.struct(y.alias("y"), F.floor((lon - side) * scale(y)).alias("a"), F.floor((lon + side) * scale(y)).alias("b")))
    return F.flatten(F.transform(ends, lambda r: F.transform(F.sequence(r["a"], r["b"]), lambda x: F.struct(x.alias("x"), r["y"].alias("y")))))


def self_proximity(points: DataFrame, within: float = 8.0, gap: int = 100) -> DataFrame:
    """track_id, i, j, metres: pairs of points of a track `gap` points apart or more and within `within` metres."""
    x, y = cell(F.col("lat"), F.col("lon"), 2 * within)
    left = points.select("track_id", F.col("idx").alias("i"), F.col("lat").alias("la"), F.col("lon").alias("lo"), F.explode(around(F.col("lat"), F.col("lon"), within, 2 * within)).alias("c"))
    left = left.select("track_id", "i", "la", "lo", "c.x", "c.y")
    right = points.select("track_id", F.col("idx").alias("j"), F.col("lat").alias("lb"), F.col("lon").alias("lob"), x.alias("x"), y.alias("y"))
    met = left.join(right, ["track_id", "x", "y"]).where(F.col("j") - F.col("i") >= gap)
    m = geo.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lob"))
    return met.withColumn("metres", m).where(F.col("metres") <= within).select("track_id", "i", "j", "metres")


def with_cells_along(lines: DataFrame, reach: float) -> DataFrame:
    """lines (alat, alon, blat, blon, more) with x and y, a row for each cell of 4 * reach in which places within `reach`
    of the segment lie: those around places on it that are `reach` apart at most. Short segments have two such places."""
    step = reach / METRES_PER_DEGREE
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("blat") - F.col("alat")), F.abs(F.col("blon") - F.col("alon"))) * math.sqrt(2) / step)).cast("int")
    on = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t
    places = F.transform(F.sequence(F.lit(0), F.col("__n")), lambda k: F.struct(on("alat", "blat", k / F.col("__n")).alias("lat"), on("alon", "blon", k / F.col("__n")).alias("lon")))
    cells = F.transform("__on", lambda p: around(p["lat"], p["lon"], 1.5 * reach, 4 * reach))
    out = lines.withColumn("__n", n).withColumn("__on", places).withColumn("c", F.explode(F.array_distinct(F.flatten(cells))))
    return out.select(*lines.columns, "c.x", "c.y")


def near_segments(places: DataFrame, lines: DataFrame, reach: float) -> DataFrame:
    """Places (track_id, plat, plon, more) with the segments (track_id, alat, alon, blat, blon, more) of their track
    within `reach` metres, and m, how far. Both meet in cells of a grid."""
    x, y = cell(F.col("plat"), F.col("plon"), 4 * reach)
    met = places.withColumn("x", x).withColumn("y", y).join(with_cells_along(lines, reach), ["track_id", "x", "y"]).drop("x", "y")
    return met.withColumn("m", geo.to_segment(*map(F.col, _BOTH))).where(F.col("m") <= reach)


#: The columns of a place and a segment.
_BOTH = ("plat", "plon", "alat", "alon", "blat", "blon")

#: How far is looked for the nearest place, in metres, ring by ring; what has none within the last meets all its track.
RINGS = (50.0, 1000.0, 20_000.0, 400_000.0)


def _by_rings(places: DataFrame, near, far) -> DataFrame:
    """Answers by place_id from the first ring that has one: near(places, reach), and at last far(places). A ring is
    looked into only while places are left without an answer, and what it finds is written, so none is worked out twice."""
    left = stored(places, "places")
    out = None
    for reach in RINGS:
        found = stored(near(left, reach), "found")
        out = found if out is None else out.unionByName(found)
        rest = left.join(found.select("place_id"), "place_id", "left_anti")
        if rest.isEmpty():
            return out
        left = stored(rest, "places")
    return out.unionByName(far(left))


def nearest_points(places: DataFrame, points: DataFrame) -> DataFrame:
    """place_id, idx of the nearest point of the place's track, in the plane of degrees; the first of equals."""
    p = places.select("place_id", "track_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    to = points.select("track_id", "idx", "lat", "lon")
    d = (F.col("lat") - F.col("plat")) * (F.col("lat") - F.col("plat")) + (F.col("lon") - F.col("plon")) * (F.col("lon") - F.col("plon"))
    best = lambda met: met.groupBy("place_id").agg(F.min_by(F.struct("idx", d.alias("d")), F.struct(d.alias("d"), "idx")).alias("b"))

    def near(left: DataFrame, reach: float) -> DataFrame:
        # A ring is square in degrees here, as the distance is in degrees: what lies within it beats what doesn't.
        step = reach / METRES_PER_DEGREE
        at = lambda c: F.sequence(F.floor((F.col(c) - step) / (2 * step)), F.floor((F.col(c) + step) / (2 * step)))
        put = left.withColumn("x", F.explode(at("plon"))).withColumn("y", F.explode(at("plat")))
        grid = to.withColumn("x", F.floor(F.col("lon") / (2 * step))).withColumn("y", F.floor(F.col("lat") / (2 * step)))
        return best(put.join(grid, ["track_id", "x", "y"])).where(F.col("b.d") <= step * step).select("place_id", "b.idx")

    return _by_rings(p, near, lambda left: best(left.join(to, "track_id")).select("place_id", "b.idx"))


def to_track(places: DataFrame, points: DataFrame) -> DataFrame:
    """place_id, metres to the nearest place of the track's line, along (metres along the track there; the first of
    equals)."""
    p = places.select("place_id", "track_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    lines = segments(points)

    def best(met: DataFrame) -> DataFrame:
        _, _, t = geo.nearest_on_segment(*map(F.col, _BOTH))
        one = met.select("place_id", "seg_idx", "m", geo.lerp(F.col("adist"), F.col("bdist"), t).alias("along"))
        least = one.groupBy("place_id").agg(F.min_by(F.struct("m", "along"), F.struct("m", "seg_idx")).alias("b"))
        return least.select("place_id", F.col("b.m").alias("metres"), F.col("b.along").alias("along"))

    far = lambda left: best(left.join(lines, "track_id").withColumn("m", geo.to_segment(*map(F.col, _BOTH))))
    return _by_rings(p, lambda left, reach: best(near_segments(left, lines, reach)), far)


def structures_near(nodes: DataFrame, points: DataFrame, buffer: float) -> DataFrame:
    """struct_id, median: structures (struct_id, track_id, node, lat, lon) whose upper median distance from the track
    is `buffer` at most. Nodes further off than that count, but how far doesn't matter."""
    p = nodes.select("struct_id", "node", "track_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    close = near_segments(p, segments(points), buffer).groupBy("struct_id", "node").agg(F.min("m").alias("m"))
    listed = close.groupBy("struct_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    sizes = nodes.groupBy("struct_id").agg(F.countDistinct("node").alias("n"))
    median = F.get("m", F.floor(F.col("n") / 2).cast("int"))
    return listed.join(sizes, "struct_id").select("struct_id", median.alias("median")).where(F.col("median").isNotNull())


def structure_spans(nodes: DataFrame, points: DataFrame, reach: float = 30.0, gap: int = 20) -> DataFrame:
    """struct_id, pass, alo, ahi: runs of points within `reach` of a structure's line, `gap` points apart at most."""
    w = Window.partitionBy("struct_id").orderBy("node")
    lines = nodes.select("struct_id", "track_id", "node", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.lead("lat").over(w).alias("blat"), F.lead("lon").over(w).alias("blon")).where(
        F.col("blat").isNotNull()
    )
    p = points.select("track_id", "idx", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    near = near_segments(p, lines, reach).select("struct_id", "track_id", "idx").distinct()
    found = islands(near, F.col("idx") - F.lag("idx").over(Window.partitionBy("struct_id").orderBy("idx")) > gap, ["struct_id"], ["idx"], "pass")
    return found.groupBy("struct_id", "pass").agg(F.min("idx").alias("alo"), F.max("idx").alias("ahi"))


def aligned(lines: DataFrame, points: DataFrame, most: float = 20.0) -> DataFrame:
    """struct_id of lines (struct_id, track_id, alo, ahi, bearing) one of whose segments runs with the track between
    alo and ahi within `most` degrees, either way. A line names its points, and the join is on them."""
    named = lines.where("alo <= ahi").select("struct_id", "track_id", F.col("bearing").alias("__own"), F.explode(F.sequence(F.col("alo").cast("long"), F.col("ahi").cast("long"))).alias("idx"))
    met = named.join(points.where(F.col("bearing").isNotNull()).select("track_id", "idx", "bearing"), ["track_id", "idx"])
    return met.where(geo.bearing_difference(F.col("__own"), F.col("bearing")) <= most).select("struct_id").distinct()


def head_and_tail(points: DataFrame, within: float = 10.0, least: int = 20) -> DataFrame:
    """track_id, start: first point of the longest end of the track all of whose points lie near its head (the first
    fifth, 200 points at most); ends of under three points and tracks of under `least` points give none."""
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    sized = points.withColumn("n", n).where(F.col("n") >= least).withColumn("h", F.least(F.floor(F.col("n") * 0.2), F.lit(200)))
    head = sized.where(F.col("idx") < F.col("h")).select(F.col("track_id").alias("__t"), F.col("lat").alias("hlat"), F.col("lon").alias("hlon"), F.explode(around(F.col("lat"), F.col("lon"), within, 2 * within)).alias("c"))
    x, y = cell(F.col("lat"), F.col("lon"), 2 * within)
    tail = sized.where(F.col("idx") >= F.col("h")).withColumn("x", x).withColumn("y", y)
    same = (tail["track_id"] == head["__t"]) & (tail["x"] == head["c.x"]) & (tail["y"] == head["c.y"])
    near = same & (geo.haversine(tail["lat"], tail["lon"], head["hlat"], head["hlon"]) <= within)
    far = tail.join(head, near, "left_anti").groupBy("track_id").agg(F.max("idx").alias("far"))
    ends = sized.groupBy("track_id").agg(F.max("n").alias("n"), F.max("h").alias("h")).join(far, "track_id", "left")
    start = F.coalesce(F.col("far") + 1, F.col("h"))
    return ends.where(F.col("n") - start >= 3).select("track_id", start.cast("long").alias("start"))


def crossings(points: DataFrame, size: float = 50.0) -> DataFrame:
    """track_id, i, j: segments of a track, not next to each other, that cross. Only segments that share a grid cell
    are compared; a segment is put in all cells of its box."""
    s = segments(points)
    k = METRES_PER_DEGREE
    s = s.join(points.groupBy("track_id").agg(F.cos(F.radians(F.avg("lat"))).alias("c")), "track_id")
    x = lambda c: F.col(c) * k * F.col("c")
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    s = s.select("track_id", "seg_idx", x("alon").alias("ax"), (F.col("alat") * k).alias("ay"), x("blon").alias("bx"), (F.col("blat") * k).alias("by"))
    grid = s.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"))))
    left = grid.select("track_id", "cx", "cy", F.col("seg_idx").alias("i"), *[F.col(c).alias(f"l{c}") for c in ("ax", "ay", "bx", "by")])
    right = grid.select("track_id", "cx", "cy", F.col("seg_idx").alias("j"), *[F.col(c).alias(f"r{c}") for c in ("ax", "ay", "bx", "by")])
    met = left.join(right, ["track_id", "cx", "cy"]).where(F.col("j") > F.col("i") + 1)
    f, _ = geo.segments_meet(*[F.col(c) for c in ("lax", "lay", "lbx", "lby", "rax", "ray", "rbx", "rby")])
    return met.where(f.isNotNull()).select("track_id", "i", "j").distinct()
