"""Operators that look up places along a track by distance or time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo

from .tracks import in_order, whole_track


def resampled(points: DataFrame, spacing: float | Column = 10.0) -> DataFrame:
    """Points at equal distances of about `spacing` metres, both ends included: track_id, k, dist, lat, lon, ele.

    Each segment makes the points that lie in it, so nothing is joined."""
    total = F.max("dist").over(whole_track())
    n = F.greatest(F.lit(2.0), F.floor(total / spacing + 0.5) + 1)
    nxt = lambda c: F.lead(c).over(in_order())
    s = points.select("track_id", "idx", *[c for k in ("dist", "lat", "lon", "ele") for c in (F.col(k).alias(f"a{k}"), nxt(k).alias(f"b{k}"))], (total / (n - 1)).alias("step"), n.cast("long").alias("n"))
    # The last point of a track makes its own; a segment those from its begin up to before its end.
    first = F.when(F.col("step") > 0, F.ceil(F.col("adist") / F.col("step") - 1e-9)).otherwise(F.lit(0)).cast("long")
    last = F.least(F.when(F.col("step") > 0, F.ceil(F.col("bdist") / F.col("step") - 1e-9)).otherwise(F.lit(0)).cast("long") - 1, F.col("n") - 2)
    mids = s.where(F.col("bdist").isNotNull()).withColumn("f", first).withColumn("l", last).where("l >= f").withColumn("k", F.explode(F.sequence("f", "l")))
    t = (F.col("k") * F.col("step") - F.col("adist")) / F.nullif(F.col("bdist") - F.col("adist"), F.lit(0.0))
    t = F.coalesce(t, F.lit(0.0))
    mid = mids.select("track_id", "k", (F.col("k") * F.col("step")).alias("dist"), *[geo.lerp(F.col(f"a{c}"), F.col(f"b{c}"), t).alias(c) for c in ("lat", "lon", "ele")])
    end = s.where(F.col("bdist").isNull()).select("track_id", (F.col("n") - 1).alias("k"), F.col("adist").alias("dist"), *[F.col(f"a{c}").alias(c) for c in ("lat", "lon", "ele")])
    return mid.unionByName(end)


def to_resolution(points: DataFrame, metres: DataFrame, slack: float = 1.5) -> DataFrame:
    """track_id, idx, lat, lon, ele, dist: tracks whose points lie `slack` times further apart on the mean than the
    heights there are for them (metres: track_id, metres) are resampled to that spacing; the others stay."""
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    mean = F.max("dist").over(Window.partitionBy("track_id")) / F.nullif(n - 1, F.lit(0))
    sized = points.select("track_id", "idx", "lat", "lon", "ele", "dist", mean.alias("__mean")).join(metres, "track_id", "left")
    sized = sized.withColumn("__coarse", F.coalesce(F.col("__mean") > slack * F.col("metres"), F.lit(False)))
    made = resampled(sized.where("__coarse"), F.col("metres")).select("track_id", F.col("k").alias("idx"), "lat", "lon", "ele", "dist")
    return sized.where("not __coarse").select(*made.columns).unionByName(made)


def densified(points: DataFrame, spacing: float = 5.0) -> DataFrame:
    """Points put between those that are further apart than `spacing`, at equal parts: track_id, idx, part, lat, lon,
    ele. part 0 is the point itself."""
    nxt = lambda c: F.lead(c).over(in_order())
    steps = F.coalesce(F.floor((nxt("dist") - F.col("dist")) / spacing), F.lit(0)).cast("long")
    s = points.select("track_id", "idx", *[c for k in ("lat", "lon", "ele") for c in (F.col(k), nxt(k).alias(f"b{k}"))], steps.alias("steps"))
    out = s.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
    t = F.col("part") / (F.col("steps") + 1)
    return out.select("track_id", "idx", "part", *[F.when(F.col("part") == 0, F.col(c)).otherwise(geo.lerp(F.col(c), F.col(f"b{c}"), t)).alias(c) for c in ("lat", "lon", "ele")])


def at_distance(targets: DataFrame, points: DataFrame) -> DataFrame:
    """track_id, target_id, idx: first point at or beyond each target's distance (target_m), else the last point. Both
    are sorted together along the track, so none meets all others."""
    t = targets.select("track_id", "target_id", F.col("target_m").cast("double").alias("dist"))
    both = points.select("track_id", "idx", "dist").unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy("track_id").orderBy("dist", F.col("idx").isNotNull(), "idx")
    beyond = F.first("idx", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.max("idx").over(Window.partitionBy("track_id"))
    return both.withColumn("__i", F.coalesce(beyond, last)).where("idx IS NULL AND __i IS NOT NULL").select("track_id", "target_id", F.col("__i").alias("idx"))


def transferred(onto: DataFrame, points: DataFrame) -> DataFrame:
    """Elevations of points put onto another line of the track, in proportion to the distance along each: track_id,
    idx, ele. Both have dist. Rows of both are sorted together by distance, so no range join is needed."""
    ends = points.groupBy("track_id").agg(F.max("dist").alias("total")).join(onto.groupBy("track_id").agg(F.max("dist").alias("own")), "track_id")
    scaled = onto.join(ends, "track_id").select("track_id", F.col("idx").alias("to_idx"), (F.col("dist") / F.coalesce(F.nullif(F.col("own"), F.lit(0.0)), F.lit(1.0)) * F.col("total")).alias("at"))
    known = points.select("track_id", F.lit(None).cast("long").alias("to_idx"), F.col("dist").alias("at"), "ele", "dist")
    both = known.unionByName(scaled, allowMissingColumns=True)
    w = Window.partitionBy("track_id").orderBy("at", F.col("to_idx").isNotNull(), "to_idx")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pick = lambda f, c, frame: f(c, ignorenulls=True).over(frame)
    both = both.select("track_id", "to_idx", "at", *[pick(f, c, w_).alias(f"{n}_{c}") for c in ("ele", "dist") for f, w_, n in ((F.last, before, "a"), (F.first, after, "b"))])
    t = (F.col("at") - F.col("a_dist")) / F.nullif(F.col("b_dist") - F.col("a_dist"), F.lit(0.0))
    ele = F.coalesce(geo.lerp(F.col("a_ele"), F.col("b_ele"), t), "a_ele", "b_ele")
    return both.where(F.col("to_idx").isNotNull()).select("track_id", F.col("to_idx").alias("idx"), ele.alias("ele"))


def split_targets(timed: DataFrame, seconds: float = 600.0) -> DataFrame:
    """track_id, split, until: ends of equal parts of about `seconds` of each ride."""
    total = timed.groupBy("track_id").agg(F.max("cum_time").alias("total")).where("total > 0")
    n = F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / seconds + 0.5))
    return total.withColumn("n", n).withColumn("split", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        "track_id", "split", F.when(F.col("split") == F.col("n"), F.col("total")).otherwise(F.col("total") / F.col("n") * F.col("split")).alias("until")
    )
