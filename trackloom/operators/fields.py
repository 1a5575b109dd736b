"""Fields of a polished line. Points in one place must have been joined before (without_duplicates)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo

from .tracks import in_order, so_far


def _legs() -> tuple[Column, Column, Column, Column]:
    """(direction, length) to the point and (direction, length) from it; null at the ends."""
    back = [F.lag("lat").over(in_order()), F.lag("lon").over(in_order()), F.col("lat"), F.col("lon")]
    ahead = [F.col("lat"), F.col("lon"), F.lead("lat").over(in_order()), F.lead("lon").over(in_order())]
    return geo.direction(*back), geo.great_circle(*back), geo.direction(*ahead), geo.great_circle(*ahead)


def with_direction(points: DataFrame) -> DataFrame:
    """direction (radians, 0 = east, without jumps along the track), heading (0 = north, up to 360) and curvature
    (turn per metre, legs counted up to 10 m; 0 at the ends)."""
    a, da, b, db = _legs()
    own = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(geo.average_angles(a, b))
    turn = F.when(a.isNull() | b.isNull(), 0.0).otherwise(2 * geo.delta_angle(a, b) / F.nullif(F.least(da, F.lit(10.0)) + F.least(db, F.lit(10.0)), F.lit(0.0)))
    out = points.withColumn("__own", F.coalesce(own, F.lit(0.0))).withColumn("curve", F.coalesce(turn, F.lit(0.0)))
    step = F.coalesce(geo.reduce_angle(F.col("__own") - F.lag("__own").over(in_order())), F.col("__own"))
    out = out.withColumn("__step", step).withColumn("direction", F.sum("__step").over(so_far()))
    return out.withColumn("heading", F.pmod(90 - F.degrees("direction"), F.lit(360.0))).drop("__own", "__step")


def with_course(points: DataFrame) -> DataFrame:
    """course: metres along the track on the polishing radius."""
    _, d, _, _ = _legs()
    return points.withColumn("__d", F.coalesce(d, F.lit(0.0))).withColumn("course", F.sum("__d").over(so_far())).drop("__d")


def reversed_fields(points: DataFrame) -> DataFrame:
    """The track the other way round: fields that have a sign change it."""
    n, total = F.max("idx").over(Window.partitionBy("track_id")), F.max("course").over(Window.partitionBy("track_id"))
    return points.withColumn("__n", n).withColumn("__t", total).select(
        "track_id", (F.col("__n") - F.col("idx")).alias("idx"), "lat", "lon", "ele", (F.col("__t") - F.col("course")).alias("course"), (F.col("direction") + math.pi).alias("direction"), (-F.col("curve")).alias("curve")
    )


def quality(points: DataFrame) -> DataFrame:
    """track_id, score, score_direction, score_altitude: how much the line jitters, by changes of slope and of
    direction over its length."""
    a, _, b, db = _legs()
    p = points.select("track_id", "idx", db.alias("ds"), (F.lead("ele").over(in_order()) - F.col("ele")).alias("dz"), F.coalesce(geo.delta_angle(a, b), F.lit(0.0)).alias("turn"))
    p = p.where((F.col("ds") >= 0.01) & ~((F.col("ds") < 0.1) & (F.abs("dz") < 0.01)))
    p = p.withColumn("s", F.col("dz") / F.sqrt(F.col("dz") * F.col("dz") + F.col("ds") * F.col("ds")))
    p = p.withColumn("change", F.lead("s").over(in_order()) - F.col("s"))
    total = p.groupBy("track_id").agg(
        F.sum(F.coalesce(F.col("change") * F.col("change"), F.lit(0.0))).alias("z"), F.sum(F.col("ds") * (F.col("s") * F.col("s") + 1e-4)).alias("base"),
        F.sum(F.col("turn") * F.col("turn")).alias("d"), F.sum("ds").alias("length"),
    )
    z, d = 10 * F.col("z") / F.col("base"), 100 * F.col("d") / F.col("length")
    return total.select("track_id", (z + d).alias("score"), d.alias("score_direction"), z.alias("score_altitude"))


def is_loop(points: DataFrame) -> DataFrame:
    """track_id, is_loop: ends within 40 m, and no U-turn from the last leg of 10 m or more into the first."""
    first = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumn("__lat", F.first("lat").over(first)).withColumn("__lon", F.first("lon").over(first)).withColumn("__n", F.max("idx").over(Window.partitionBy("track_id")))
    p = p.withColumn("__d", geo.great_circle(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")))
    far = F.when(F.col("__d") >= 10, F.struct("lat", "lon"))
    ends = p.groupBy("track_id").agg(
        F.min_by(far, F.when(far.isNotNull(), F.col("idx"))).alias("out"), F.max_by(far, F.when(far.isNotNull(), F.col("idx"))).alias("home"),
        F.max_by("__d", "idx").alias("gap"), F.count(F.lit(1)).alias("n"), F.first("__lat").alias("lat"), F.first("__lon").alias("lon"),
    )
    ax, ay = geo.local_vector(F.col("home.lat"), F.col("home.lon"), F.col("lat"), F.col("lon"))
    bx, by = geo.local_vector(F.col("lat"), F.col("lon"), F.col("out.lat"), F.col("out.lon"))
    return ends.select("track_id", F.coalesce((F.col("n") > 2) & (F.col("gap") < 40) & (geo.dot(ax, ay, bx, by) > -0.1), F.lit(False)).alias("is_loop"))


def deviation(points: DataFrame, a: int, b: int) -> DataFrame:
    """track_id, mean, most, rms: how far the points between a and b lie off the straight line from a to b."""
    ends = points.groupBy("track_id").agg(*[F.max(F.when(F.col("idx") == i, F.col(c))).alias(f"{c}{n}") for n, i in (("a", a), ("b", b)) for c in ("lat", "lon")])
    met = points.join(ends, "track_id").where((F.col("idx") > a) & (F.col("idx") < b))
    ux, uy = geo.local_vector(F.col("lata"), F.col("lona"), F.col("latb"), F.col("lonb"))
    vx, vy = geo.local_vector(F.col("lata"), F.col("lona"), F.col("lat"), F.col("lon"))
    off = F.abs(ux * vy - uy * vx) / F.nullif(F.sqrt(ux * ux + uy * uy), F.lit(0.0))
    return met.select("track_id", off.alias("o")).groupBy("track_id").agg(F.avg("o").alias("mean"), F.max("o").alias("most"), F.sqrt(F.avg(F.col("o") * F.col("o"))).alias("rms"))


def corners(points: DataFrame, least: float = 90.0, vertex: float = 3.0, gap: float = 50.0, density: float = 2.0) -> DataFrame:
    """track_id, start_idx, end_idx, total_turn: runs of turning points, `gap` metres apart at most, that turn `least`
    degrees together and `density` degrees a metre. points has turn and dist."""
    from .intervals import islands

    v = points.where(F.col("turn") >= vertex)
    far = geo.haversine(F.lag("lat").over(in_order()), F.lag("lon").over(in_order()), F.col("lat"), F.col("lon")) > gap
    found = islands(v, far, ["track_id"], ["idx"]).groupBy("track_id", "island").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.sum("turn").alias("total_turn"), (F.max("dist") - F.min("dist")).alias("length")
    )
    dense = (F.col("length") == 0) | (F.col("total_turn") >= density * F.col("length"))
    return found.where((F.col("total_turn") >= least) & dense).select("track_id", "start_idx", "end_idx", "total_turn")


def overlap_directions(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """track_id, cluster, way: whether the second pass of each cluster of pairs (track_id, cluster, i, j) runs the same
    way as the first."""
    e = pairs.groupBy("track_id", "cluster").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    for c in ("i0", "i1", "j0", "j1"):
        e = e.join(points.select("track_id", F.col("idx").alias(c), F.col("lat").alias(f"{c}a"), F.col("lon").alias(f"{c}o")), ["track_id", c])
    col = lambda *n: [F.col(x) for x in n]
    d = F.abs(geo.bearing(*col("i0a", "i0o", "i1a", "i1o")) - geo.bearing(*col("j0a", "j0o", "j1a", "j1o")))
    return e.select("track_id", "cluster", F.when(F.when(d > 180, 360 - d).otherwise(d) < 90, "same").otherwise("opposite").alias("way"))


def snapped(pairs: DataFrame, points: DataFrame, most: float = 15.0) -> DataFrame:
    """The track with points of second passes put on the nearest point of the first, if within `most` metres. pairs:
    track_id, i, j, metres."""
    best = pairs.where(F.col("metres") <= most).groupBy("track_id", "j").agg(F.min_by("i", F.struct("metres", "i")).alias("i"))
    to = points.select("track_id", F.col("idx").alias("i"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    moves = best.join(to, ["track_id", "i"]).select("track_id", F.col("j").alias("idx"), "slat", "slon")
    return points.join(moves, ["track_id", "idx"], "left").withColumn("lat", F.coalesce("slat", "lat")).withColumn("lon", F.coalesce("slon", "lon")).drop("slat", "slon")


def kept_structures(candidates: DataFrame) -> DataFrame:
    """struct_id of located structures (track_id, struct_id, pass, kind, start, end, mean_off) that stay when, in order
    along the track, one of a kind that overlaps the last kept gives way to it or, if nearer, takes its place. The same
    structure on another pass, and one of another kind, always stay."""
    one = F.struct("start", "end", "kind", "struct_id", F.col("pass").alias("pass"), "mean_off")
    listed = candidates.groupBy("track_id").agg(F.array_sort(F.collect_list(one)).alias("c"))

    def sweep(kept: Column, b: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = last.isNull() | (b["start"] >= last["end"]) | (last["start"] >= b["end"])
        both = apart | (b["struct_id"] == last["struct_id"]) | (b["kind"] != last["kind"])
        nearer = b["mean_off"] < last["mean_off"]
        return F.when(both, F.concat(kept, F.array(b))).when(nearer, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(b))).otherwise(kept)

    kept = F.aggregate("c", F.filter("c", lambda x: F.lit(False)), sweep)
    return listed.select("track_id", F.explode(kept).alias("k")).select("track_id", "k.struct_id", "k.pass")


def joined_names(zones: DataFrame) -> Column:
    """Names of merged structures in their order, each once, joined by slashes; for an aggregate."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("s_start", "name"))), lambda x: x["name"])
    return F.array_join(F.array_distinct(F.filter(listed, lambda n: n.isNotNull() & (n != ""))), " / ")
