"""Zones of tracks: finding them as islands, merging them, and what is asked of the points inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo

from .tracks import in_order, so_far, whole_track


def islands(rows: DataFrame, breaks: Column, keys: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Number the runs of rows that follow each other; a row for which `breaks` holds begins a run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def merged(zones: DataFrame, keys: list[str], start: str, end: str, gap: Column | float = 0.0, aggregates: list[Column] = ()) -> DataFrame:
    """Join zones whose start lies no further than `gap` after the furthest end before them."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = islands(zones.withColumn("__reach", reach), F.col(start) - F.col("__reach") > gap, keys, [start, end])
    return found.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), *aggregates)


def spike_runs(points: DataFrame, steep: float = 25.0, gap: int = 30) -> DataFrame:
    """track_id, lo, hi of runs of points with gradients beyond `steep` that are `gap` points apart at most."""
    return spike_anchors(points, steep=steep, gap=gap).select("track_id", "lo", "hi")


def spike_anchors(points: DataFrame, steep: float = 25.0, calm: float = 30.0, gap: int = 30) -> DataFrame:
    """track_id, lo, hi, alo, ahi, dlo, dhi: runs of points with gradients beyond `steep`, `gap` points apart at most,
    widened to the nearest points whose gradient is below `calm`: alo before the run, ahi one after such a point behind
    it; the ends of the track where there is none. dlo and dhi are the distances there. All windows and the grouping
    follow the track, so they share one exchange."""
    here = F.struct("idx", "dist")
    quiet = F.when(F.abs("gr") < calm, here)
    behind = F.when(F.abs(F.lag("gr").over(in_order())) < calm, here)
    ends = [F.first(here).over(whole_track()), F.last(here).over(whole_track())]
    before = F.last("__quiet", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__behind", ignorenulls=True).over(in_order().rowsBetween(2, Window.unboundedFollowing))
    seen = points.withColumn("__quiet", quiet).withColumn("__behind", behind)
    seen = seen.select("track_id", "idx", "gr", F.coalesce(before, ends[0]).alias("a"), F.coalesce(after, ends[1]).alias("b"))
    bad = seen.where(F.abs("gr") > steep)
    found = islands(bad, F.col("idx") - F.lag("idx").over(in_order()) > gap, ["track_id"], ["idx"])
    runs = found.groupBy("track_id", "island").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.min_by("a", "idx").alias("a"), F.max_by("b", "idx").alias("b"))
    return runs.select("track_id", "lo", "hi", F.col("a.idx").alias("alo"), F.col("b.idx").alias("ahi"), F.col("a.dist").alias("dlo"), F.col("b.dist").alias("dhi"))


def spike_zones(points: DataFrame, steep: float = 25.0, calm: float = 30.0, gap: int = 30, chain: float = 10.0) -> DataFrame:
    """track_id, alo, ahi of zones: widened runs, merged where they overlap and chained over `chain` metres."""
    far = [F.min("dlo").alias("dlo"), F.max("dhi").alias("dhi")]
    wide = merged(spike_anchors(points, steep, calm, gap), ["track_id"], "alo", "ahi", 0, far).drop("island")
    return merged(wide.withColumn("start", F.col("dlo")).withColumn("end", F.col("dhi")), ["track_id"], "start", "end", chain, [F.min("alo").alias("alo"), F.max("ahi").alias("ahi")]).select("track_id", "alo", "ahi")


def inside(points: DataFrame, zones: DataFrame, lo: str = "alo", hi: str = "ahi", margin: int = 0) -> DataFrame:
    """Points of each zone. A zone names its points, and the join is on them: no point meets zones it is not in."""
    z = zones.select("track_id", lo, hi, F.explode(F.sequence((F.col(lo) - margin).cast("long"), (F.col(hi) + margin).cast("long"))).alias("idx"))
    return z.join(points, ["track_id", "idx"])


def zone_stats(points: DataFrame, zones: DataFrame, edge: int = 8) -> DataFrame:
    """For each zone: span, grade, lowest and highest elevation, mean steepness, changes of sign in percent, and the
    sharpest change of gradient per metre around each edge."""
    steps = points.withColumn("__ds", F.col("dist") - F.lag("dist").over(in_order())).withColumn("__before", F.lag("gr").over(in_order()))
    steps = steps.withColumn("__sharp", F.when(F.col("__ds") > 0, F.abs(F.col("gr") - F.col("__before")) / F.nullif(F.col("__ds"), F.lit(0.0))))
    i, lo, hi = F.col("idx"), F.col("alo"), F.col("ahi")
    flip = (F.signum("gr") != F.signum("__before")) & (F.col("gr") != 0) & (F.col("__before") != 0)
    at = lambda c, k: F.max(F.when(i == k, F.col(c)))
    mid = (i >= lo) & (i < hi)
    first_edge = (i > lo - edge) & (i > 0) & (i <= F.least(lo + edge, hi))
    last_edge = (i > F.greatest(lo, hi - edge)) & (i <= hi + edge)
    span = at("dist", hi) - at("dist", lo)
    return (
        inside(steps, zones, margin=edge)
        .groupBy("track_id", "alo", "ahi")
        .agg(
            span.alias("span"),
            F.when(span > 0, 100 * (at("ele", hi) - at("ele", lo)) / F.nullif(span, F.lit(0.0))).otherwise(0.0).alias("grade"),
            F.min(F.when(i.between(lo, hi), F.col("ele"))).alias("lowest"),
            F.max(F.when(i.between(lo, hi), F.col("ele"))).alias("highest"),
            F.coalesce(F.avg(F.when(mid, F.abs("gr"))), F.lit(0.0)).alias("mean_gr"),
            F.floor(100 * F.sum(F.when(mid & (i > lo) & flip, 1).otherwise(0)) / F.greatest(F.lit(1), F.max(hi - lo) - 1) + 0.5).alias("rev_rate"),
            F.coalesce(F.max(F.when(first_edge, F.col("__sharp"))), F.lit(0.0)).alias("sharp_lo"),
            F.coalesce(F.max(F.when(last_edge, F.col("__sharp"))), F.lit(0.0)).alias("sharp_hi"),
        )
    )


def labelled(stats: DataFrame, gradual: float = 2.0, long: float = 200.0, few: float = 5.0, steep: float = 8.0, dip: float = 1.0, spike: float = 1.0) -> DataFrame:
    """kind of each zone: suspect (gradual edges, or long, steady and steep), else bridge, tunnel or artifact by how
    far it goes below or above the mean of its ends."""
    level = (F.col("e_lo") + F.col("e_hi")) / 2
    real = (F.col("sharp_lo") <= gradual) & (F.col("sharp_hi") <= gradual)
    steady = (F.col("span") >= long) & (F.col("rev_rate") <= few) & (F.col("mean_gr") >= steep)
    kind = F.when(real | steady, "suspect").when(level - F.col("lowest") >= dip, "bridge").when(F.col("highest") - level >= spike, "tunnel").otherwise("artifact")
    return stats.withColumn("kind", kind)


def interpolated(points: DataFrame, zones: DataFrame) -> DataFrame:
    """ele_fixed: inside zones (which don't touch) the straight line between their ends, or the cubic where the zone
    has slopes m0 and m1; elsewhere the elevation itself. Beginnings of zones are put between the points of their track
    and carried along it, so nothing is joined."""
    shape = [c for c in ("m0", "m1") if c in zones.columns]
    z = zones.select("track_id", F.col("alo").cast("long").alias("idx"), F.struct("alo", "ahi", *shape).alias("__z"))
    both = points.withColumn("__p", F.lit(1)).unionByName(z, allowMissingColumns=True)
    order = Window.partitionBy("track_id").orderBy("idx", F.col("__p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    p = both.withColumn("__z", F.last("__z", ignorenulls=True).over(order)).where(F.col("__p").isNotNull()).withColumn("__lo", F.col("__z.alo"))
    own = Window.partitionBy("track_id", "__lo")
    at = lambda c, k: F.max(F.when(F.col("idx") == F.col(f"__z.{k}"), F.col(c))).over(own)
    p = p.withColumn("__d0", at("dist", "alo")).withColumn("__e0", at("ele", "alo")).withColumn("__d1", at("dist", "ahi")).withColumn("__e1", at("ele", "ahi"))
    span = F.col("__d1") - F.col("__d0")
    t = (F.col("dist") - F.col("__d0")) / F.nullif(span, F.lit(0.0))
    value = geo.lerp(F.col("__e0"), F.col("__e1"), t)
    if shape:
        value = F.when(F.col("__z.m0").isNotNull(), geo.hermite(t, F.col("__e0"), F.col("__e1"), F.col("__z.m0"), F.col("__z.m1"), span)).otherwise(value)
    within = (F.col("idx") > F.col("__z.alo")) & (F.col("idx") < F.col("__z.ahi")) & (span > 0)
    return p.withColumn("ele_fixed", F.coalesce(F.when(within, value), "ele")).select(*points.columns, "ele_fixed")


#: Metres of the stretches of a track in which zones and structures are brought together.
STRETCH = 500.0


def first_overlap(zones: DataFrame, structures: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """Kind of the first structure (by ord) that overlaps each zone; null if none does. zones: track_id, zone, start,
    end; structures: track_id, ord, kind, s_start, s_end. Both lie in all stretches of the track that they reach into,
    and meet in these, so a zone meets what is near it and not all structures of its track."""
    along = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / stretch), F.floor(F.greatest(a, b) / stretch)))
    met = zones.withColumn("__s", along("start", "end")).join(structures.withColumn("__s", along("s_start", "s_end")), ["track_id", "__s"])
    met = met.where((F.col("start") < F.col("s_end")) & (F.col("end") > F.col("s_start")))
    best = met.groupBy("track_id", "zone").agg(F.min_by("kind", "ord").alias("kind"))
    return zones.select("track_id", "zone").join(best, ["track_id", "zone"], "left")


def without_overlap(zones: DataFrame, others: DataFrame) -> DataFrame:
    """Zones (track_id, alo, ahi) that overlap none of the others (track_id, alo, ahi). Others are put before the ends of
    zones by their beginnings: a zone is free if the furthest end of those that begin before it ends is not beyond its
    beginning. One pass along the track, nothing is joined."""
    mine = zones.select("track_id", F.col("ahi").cast("double").alias("__at"), F.lit(0).alias("__o"), F.struct(*zones.columns).alias("__z"), F.lit(None).cast("double").alias("__hi"))
    theirs = others.select("track_id", F.col("alo").cast("double").alias("__at"), F.lit(1).alias("__o"), F.lit(None).cast(mine.schema["__z"].dataType).alias("__z"), F.col("ahi").cast("double").alias("__hi"))
    w = Window.partitionBy("track_id").orderBy("__at", "__o").rowsBetween(Window.unboundedPreceding, -1)
    seen = mine.unionByName(theirs).withColumn("__far", F.max("__hi").over(w)).where(F.col("__z").isNotNull())
    return seen.where(~F.coalesce(F.col("__far") > F.col("__z.alo"), F.lit(False))).select("__z.*")


def span_mask(points: DataFrame, structures: DataFrame, margin: float = 10.0) -> DataFrame:
    """masked: 1 within `margin` metres of a structure (track_id, s_start, s_end), else 0. Beginnings and ends are
    counted along the track: a point is masked where more have begun than ended before it."""
    edge = lambda at, step, order: structures.select("track_id", at.alias("dist"), F.lit(step).alias("__step"), F.lit(order).alias("__o"))
    edges = edge(F.col("s_start") - margin, 1, 0).unionByName(edge(F.col("s_end") + margin, -1, 2))
    both = points.withColumn("__step", F.lit(0)).withColumn("__o", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    open_ = F.sum("__step").over(Window.partitionBy("track_id").orderBy("dist", "__o").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("masked", (open_ > 0).cast("int")).where("__o = 1").select(*points.columns, "masked")


def raised_regions(points: DataFrame, least: float = 1.5, buffer: float = 15.0, narrow: float = 5.0) -> DataFrame:
    """track_id, lo_m, hi_m, max_spike: runs of points more than `least` above the opening, widened by `buffer`
    metres to whole points, merged where they overlap, and not narrower than `narrow`. points has opening, and
    masked (optional)."""
    free = F.col("masked") == 0 if "masked" in points.columns else F.lit(True)
    rise = F.col("ele") - F.col("opening")
    reach = "OVER (PARTITION BY track_id ORDER BY dist RANGE BETWEEN"
    lo, hi = F.expr(f"min(dist) {reach} {buffer:.9f}D PRECEDING AND CURRENT ROW)"), F.expr(f"max(dist) {reach} CURRENT ROW AND {buffer + 1 - 1e-9:.9f}D FOLLOWING)")
    flagged = points.withColumn("__lo", lo).withColumn("__hi", hi).where((rise > least) & free).select("track_id", "idx", "__lo", "__hi", rise.alias("rise"))
    wide = islands(flagged, F.col("idx") - F.lag("idx").over(in_order()) > 1, ["track_id"], ["idx"]).groupBy("track_id", "island").agg(
        F.min("__lo").alias("lo_m"), F.max("__hi").alias("hi_m"), F.max("rise").alias("spike")
    ).drop("island")
    found = merged(wide, ["track_id"], "lo_m", "hi_m", 0.0, [F.max("spike").alias("max_spike")])
    return found.where(F.col("hi_m") - F.col("lo_m") >= narrow).drop("island")


def runs_of(points: DataFrame, column: str) -> DataFrame:
    """track_id, run, first, last, value: consecutive points with one value."""
    found = islands(points, ~F.col(column).eqNullSafe(F.lag(column).over(in_order())), ["track_id"], ["idx"], "run")
    return found.groupBy("track_id", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.first(column).alias("value"))


def running(points: DataFrame, column: str) -> Column:
    return F.sum(column).over(so_far())
