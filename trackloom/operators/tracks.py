"""Ordered operators over tracks: one row a point, keyed by (track_id, idx).

All windows share one partitioning and order, so a chain of them costs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo, physics


def in_order():
    return Window.partitionBy("track_id").orderBy("idx")


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole_track():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def rows(before: int, after: int):
    return in_order().rowsBetween(-before, after)


def near(expression: str, radius: float, order: str = "dist") -> Column:
    """An aggregate over the points within `radius` of a point's distance, ends included. Range frames over doubles
    are only open to SQL text."""
    return F.expr(f"{expression} OVER (PARTITION BY track_id ORDER BY {order} RANGE BETWEEN {radius:.6f}D PRECEDING AND {radius:.6f}D FOLLOWING)")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as the session names (spark.sql.shuffle.partitions). Left alone, Spark joins tasks
    by their bytes on disk, and points in order pack so well there that one task gets millions of them to sort."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def derived_tracks(events: DataFrame) -> DataFrame:
    """Tracks made from the events table: a point per event of a user, about 11 m apart, with error events as
    spikes of elevation."""
    idx = F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "event_id")) - 1
    # Named before it is dealt, so that all later windows see that rows are dealt by track.
    own = events.select(F.col("user_id").alias("track_id"), "ts", "event_id", "event_type", "value")
    return dealt(own, "track_id").withColumn("idx", idx.cast("long")).select(
        "track_id",
        "idx",
        (F.lit(46.0) + F.col("idx") * F.lit(0.0001)).alias("lat"),
        (F.lit(14.5) + (F.col("event_id") % 7) * F.lit(0.00002)).alias("lon"),
        (F.lit(300.0) + F.col("idx") * F.lit(0.5) + F.when(F.col("event_type") == "error", F.col("value") * F.lit(0.05)).otherwise(0.0)).alias("ele"),
    )


def with_distance(points: DataFrame) -> DataFrame:
    """Add seg (metres from the point before) and dist (along the track, 0 at its start)."""
    at = lambda c: F.lag(c).over(in_order())
    seg = F.coalesce(geo.haversine(at("lat"), at("lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    return points.withColumn("seg", seg).withColumn("dist", F.sum("seg").over(so_far()))


def with_gradient(points: DataFrame, name: str = "gr", ele: str = "ele") -> DataFrame:
    """Percent to the next point, 0 over 1 cm or less; the last point repeats the one before."""
    ds, dz = F.lead("dist").over(in_order()) - F.col("dist"), F.lead(ele).over(in_order()) - F.col(ele)
    own = F.when(ds > 0.01, 100 * dz / F.nullif(ds, F.lit(0.0))).when(ds.isNotNull(), 0.0)
    return points.withColumn("__own", own).withColumn(name, F.coalesce("__own", F.lag("__own").over(in_order()), F.lit(0.0))).drop("__own")


def with_bearing(points: DataFrame) -> DataFrame:
    """bearing to the next point (null at the end) and turn at the point (0 at both ends)."""
    c = {k: (F.lag(k).over(in_order()), F.col(k), F.lead(k).over(in_order())) for k in ("lat", "lon")}
    turn = geo.turn_angle(*[c[k][i] for i in range(3) for k in ("lat", "lon")])
    return points.withColumn("bearing", geo.bearing(c["lat"][1], c["lon"][1], c["lat"][2], c["lon"][2])).withColumn("turn", F.coalesce(turn, F.lit(0.0)))


def averaged_gradient(points: DataFrame, half: int = 4) -> DataFrame:
    """ele_smoothed: gradients of segments averaged over `half` segments on both sides, then added up again from
    the first elevation."""
    ds, dz = F.lead("dist").over(in_order()) - F.col("dist"), F.lead("ele").over(in_order()) - F.col("ele")
    slope = F.when(ds > 0, dz / F.nullif(ds, F.lit(0.0))).when(ds.isNotNull(), 0.0)
    mean = F.when(ds.isNotNull(), F.avg("__slope").over(rows(half, half)))
    rise = F.coalesce(F.lag(F.col("__mean") * F.col("__ds")).over(in_order()), F.lit(0.0))
    return (
        points.withColumn("__ds", ds).withColumn("__slope", slope).withColumn("__mean", mean).withColumn("__rise", rise)
        .withColumn("ele_smoothed", F.first("ele").over(whole_track()) + F.sum("__rise").over(so_far()))
        .drop("__ds", "__slope", "__mean", "__rise")
    )


def display_gradient(points: DataFrame, window: int = 9) -> DataFrame:
    return points.withColumn("gr_shown", F.avg("gr").over(rows(window // 2, window // 2)))


def integrated(points: DataFrame) -> DataFrame:
    """ele_integrated: gradients added up, then tilted so that the end keeps its elevation."""
    step = F.coalesce(F.lag(F.col("gr") / 100).over(in_order()) * (F.col("dist") - F.lag("dist").over(in_order())), F.lit(0.0))
    raw = points.withColumn("__step", step).withColumn("__raw", F.first("ele").over(whole_track()) + F.sum("__step").over(so_far()))
    miss = F.last("ele").over(whole_track()) - F.last("__raw").over(whole_track())
    share = F.coalesce(F.col("dist") / F.nullif(F.last("dist").over(whole_track()), F.lit(0.0)), F.lit(0.0))
    return raw.withColumn("ele_integrated", F.col("__raw") + miss * share).drop("__step", "__raw")


def with_radius(points: DataFrame) -> DataFrame:
    """radius3: of the circle through a point and its neighbours; infinite at ends and where they are in line."""
    c = {k: (F.lag(k).over(in_order()), F.col(k), F.lead(k).over(in_order())) for k in ("lat", "lon")}
    r = geo.menger_radius(*[c[k][i] for i in range(3) for k in ("lat", "lon")])
    return points.withColumn("radius3", F.coalesce(r, F.lit(float("inf"))))


def tangent_slope(points: DataFrame, half: int = 8) -> DataFrame:
    frame = rows(half, half)
    dz, ds = F.last("ele").over(frame) - F.first("ele").over(frame), F.last("dist").over(frame) - F.first("dist").over(frame)
    return points.withColumn("tangent", F.coalesce(dz / F.nullif(ds, F.lit(0.0)), F.lit(0.0)))


def eroded(points: DataFrame, radius: float = 75.0, value: str = "ele", name: str = "eroded") -> DataFrame:
    return points.withColumn(name, near(f"min({value})", radius))


def dilated(points: DataFrame, radius: float = 75.0, value: str = "ele", name: str = "dilated") -> DataFrame:
    return points.withColumn(name, near(f"max({value})", radius))


def opened(points: DataFrame, radius: float = 75.0) -> DataFrame:
    """Erosion, then dilation: the ground under what is narrower than twice the radius."""
    return dilated(eroded(points, radius, "ele", "__low"), radius, "__low", "opening").drop("__low")


def distance_gaussian(points: DataFrame, value: str, sigma: float) -> DataFrame:
    """value_gauss: weights fall with distance along the track up to 4 sigma (not included); each point stands for
    half the gap to its neighbours within the window. Below 0.5 m the values stay."""
    if sigma < 0.5:
        return points.withColumn(f"{value}_gauss", F.col(value))
    listed = points.withColumn("__near", near(f"collect_list(struct(dist, {value} AS v))", 4 * sigma))
    inside = F.array_sort(F.filter("__near", lambda p: F.abs(p["dist"] - F.col("dist")) < 4 * sigma))
    at = lambda i: F.get("__in", i)["dist"]

    def weigh(p: Column, i: Column) -> Column:
        width = (F.coalesce(at(i + 1), p["dist"]) - F.coalesce(F.when(i > 0, at(i - 1)), p["dist"])) / 2
        d = p["dist"] - F.col("dist")
        return F.struct((F.exp(-d * d / (2 * sigma * sigma)) * width).alias("w"), p["v"].alias("v"))

    done = listed.withColumn("__in", inside).withColumn("__w", F.transform("__in", weigh))
    total = lambda f: F.aggregate("__w", F.lit(0.0), lambda s, x: s + f(x))
    mean = total(lambda x: x["w"] * x["v"]) / F.nullif(total(lambda x: x["w"]), F.lit(0.0))
    return done.withColumn(f"{value}_gauss", F.coalesce(mean, F.col(value))).drop("__near", "__in", "__w")


def position_gaussian(points: DataFrame, sigma: float = 5.0) -> DataFrame:
    """lat_gauss, lon_gauss: kernel over distance up to 3 sigma (included); both ends stay."""
    out = points.withColumn("__near", near("collect_list(struct(dist, lat, lon))", 3 * sigma))
    weight = lambda p: F.exp(-(p["dist"] - F.col("dist")) * (p["dist"] - F.col("dist")) / (2 * sigma * sigma))
    total = F.aggregate("__near", F.lit(0.0), lambda s, p: s + weight(p))
    end = (F.col("idx") == F.min("idx").over(whole_track())) | (F.col("idx") == F.max("idx").over(whole_track()))
    for c in ("lat", "lon"):
        out = out.withColumn(f"{c}_gauss", _mean(c, weight, total, end))
    return out.drop("__near")


def _mean(c: str, weight, total: Column, end: Column) -> Column:
    def add(s: Column, p: Column) -> Column:
        return s + weight(p) * p[c]

    return F.when(end, F.col(c)).otherwise(F.aggregate("__near", F.lit(0.0), add) / total)


def curvature(points: DataFrame, window: float = 100.0) -> DataFrame:
    """curvature, 0 to 1: mean change of bearing at the vertices within `window` on both sides, over 45 degrees. The
    point itself does not count; ends are 0."""
    back = geo.bearing(F.lag("lat").over(in_order()), F.lag("lon").over(in_order()), F.col("lat"), F.col("lon"))
    ahead = geo.bearing(F.col("lat"), F.col("lon"), F.lead("lat").over(in_order()), F.lead("lon").over(in_order()))
    change = F.abs(ahead - back)
    out = points.withColumn("__turn", F.radians(F.when(change > 180, 360 - change).otherwise(change)))
    around, count = near("sum(__turn)", window), near("count(__turn)", window)
    total, n = F.coalesce(around, F.lit(0.0)) - F.coalesce("__turn", F.lit(0.0)), count - F.col("__turn").isNotNull().cast("long")
    mean = F.least(F.coalesce(total / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(0.0)) / (3.141592653589793 / 4), F.lit(1.0))
    end = F.col("__turn").isNull()
    return out.withColumn("curvature", F.when(end, 0.0).otherwise(mean)).drop("__turn")


def timing(points: DataFrame, watts: float = 200.0, mass: float = 80.0, group: bool = True, half: int = 5) -> DataFrame:
    """Running time, time alone, distance and climb of a rider at constant power."""
    d = F.lead("dist").over(in_order()) - F.col("dist")
    dz = F.lead("ele").over(in_order()) - F.col("ele")
    slope = F.when(d > 0.5, geo.clamp(dz / F.nullif(d, F.lit(0.0)), -0.25, 0.25)).when(d.isNotNull(), 0.0)
    out = points.withColumn("__d", d).withColumn("__up", F.greatest(dz, F.lit(0.0))).withColumn("__slope", slope)
    out = out.withColumn("gr_ride", F.when(F.col("__d").isNotNull(), F.avg("__slope").over(rows(half, half))))
    g = F.col("gr_ride")
    out = out.withColumn("__t", F.col("__d") / physics.speed(watts, mass, g, physics.drag_area(g, group))).withColumn("__alone", F.col("__d") / physics.speed(watts, mass, g, physics.drag_area(g, False)))
    for name, step in (("cum_time", "__t"), ("cum_time_alone", "__alone"), ("cum_dist", "__d"), ("cum_climb", "__up")):
        out = out.withColumn(f"{step}0", F.coalesce(F.lag(step).over(in_order()), F.lit(0.0))).withColumn(name, F.sum(f"{step}0").over(so_far()))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def track_stats(points: DataFrame) -> DataFrame:
    """A row per track: length, ascent, descent (half up to whole metres), points and steepest gradient."""
    dz = F.col("ele") - F.lag("ele").over(in_order())
    up = points.withColumn("__dz", F.coalesce(dz, F.lit(0.0)))
    whole = lambda x: F.floor(x + 0.5).cast("long")
    return up.groupBy("track_id").agg(
        F.max("dist").alias("length"),
        whole(F.sum(F.greatest("__dz", F.lit(0.0)))).alias("ascent"),
        whole(F.sum(F.greatest(-F.col("__dz"), F.lit(0.0)))).alias("descent"),
        F.count(F.lit(1)).alias("points"),
        F.max(F.abs("gr")).alias("max_gradient"),
    )


def bounds(points: DataFrame, buffer: float = 0.0) -> DataFrame:
    """south, west, north, east of each track, widened by `buffer` metres."""
    b = points.groupBy("track_id").agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    up = F.lit(buffer / 111_320.0)
    side = up / F.cos(F.radians((F.col("s") + F.col("n")) / 2))
    return b.select("track_id", (F.col("s") - up).alias("south"), (F.col("w") - side).alias("west"), (F.col("n") + up).alias("north"), (F.col("e") + side).alias("east"))


def trimmed(points: DataFrame, a: int, b: int, kind: str | None = None) -> DataFrame:
    """Cut between two points: what is before b goes (start), what is after a (end), or what lies between them (mid).
    Where no kind is given each track has its own: start where a is within the first ten, end where b is within the last
    ten, else mid. Points are numbered anew, and then the first and last elevation are those of their neighbours."""
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    i = F.col("idx")
    kinds = {"start": i >= b, "end": i <= a, "mid": (i <= a) | (i >= b)}
    keep = kinds[kind] if kind else F.when(F.lit(a <= 10), kinds["start"]).when(F.lit(b) >= F.col("__n") - 11, kinds["end"]).otherwise(kinds["mid"])
    kept = points.withColumn("__n", n).where(keep).drop("__n").withColumn("idx", (F.row_number().over(in_order()) - 1).cast("long"))
    size = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    first = F.when(i == 0, F.coalesce(F.lead("ele").over(in_order()), F.col("ele"))).otherwise(F.col("ele"))
    before = F.lag("__e").over(in_order())
    return kept.withColumn("__size", size).withColumn("__e", first).withColumn("ele", F.when((i == F.col("__size") - 1) & (F.col("__size") > 1), before).otherwise(F.col("__e"))).drop("__e", "__size")


def without_duplicates(points: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Consecutive points in one place become their mean, numbered anew."""
    moved = (F.abs(F.col("lat") - F.lag("lat").over(in_order())) > tolerance) | (F.abs(F.col("lon") - F.lag("lon").over(in_order())) > tolerance)
    runs = points.withColumn("__new", F.coalesce(moved, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(so_far()))
    return runs.groupBy("track_id", "__run").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("ele").alias("ele")).select(
        "track_id", (F.col("__run") - 1).cast("long").alias("idx"), "lat", "lon", "ele"
    )


def reversed_tracks(points: DataFrame) -> DataFrame:
    return points.withColumn("idx", F.max("idx").over(Window.partitionBy("track_id")) - F.col("idx"))
