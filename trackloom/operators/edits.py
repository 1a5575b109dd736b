"""Changes to tracks and zones by hand: views, cuts, restored ranges, and zones that follow a cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo

from .tracks import in_order


def visible(points: DataFrame, lo: float, hi: float) -> DataFrame:
    """Points from lo to hi metres, and one more on both sides."""
    before, after = F.lag("dist").over(in_order()), F.lead("dist").over(in_order())
    seen = (F.col("dist") >= lo) | F.coalesce(F.col("__after") >= lo, F.lit(True))
    return points.withColumn("__before", before).withColumn("__after", after).where(seen & ((F.col("dist") <= hi) | F.coalesce(F.col("__before") < hi, F.lit(True)))).drop("__before", "__after")


def restored(points: DataFrame, lo: int, hi: int, fixed: str = "ele_fixed") -> DataFrame:
    """The measured elevation again between two points, both included."""
    return points.withColumn(fixed, F.when(F.col("idx").between(lo, hi), F.col("ele")).otherwise(F.col(fixed)))


def best_elevation() -> Column:
    """Smoothed, else fixed, else measured."""
    return F.coalesce("ele_smoothed", "ele_fixed", "ele")


def cropped(points: DataFrame, start: float, end: float, delete: bool = False) -> DataFrame:
    """The track between two distances (negative ones count from its end), with points put at both; with `delete`, or
    where start lies behind end, what is outside instead. Numbered anew."""
    total = F.max("dist").over(Window.partitionBy("track_id"))
    at = lambda v: F.lit(v) if v >= 0 else F.col("__total") + F.lit(v)
    p = points.withColumn("__total", total).withColumn("__a", at(start)).withColumn("__b", at(end))
    inside = F.col("dist").between(F.least("__a", "__b"), F.greatest("__a", "__b"))
    turned = F.lit(delete) != (F.col("__a") > F.col("__b"))
    nxt = lambda c: F.lead(c).over(in_order())
    seg = p.select("*", *[nxt(c).alias(f"__n{c}") for c in ("lat", "lon", "ele", "dist")])
    cuts = seg.withColumn("__at", F.explode(F.array("__a", "__b"))).where((F.col("__at") > F.col("dist")) & (F.col("__at") < F.col("__ndist")))
    t = (F.col("__at") - F.col("dist")) / (F.col("__ndist") - F.col("dist"))
    made = cuts.select("track_id", F.col("__at").alias("dist"), *[geo.lerp(F.col(c), F.col(f"__n{c}"), t).alias(c) for c in ("lat", "lon", "ele")])
    kept = p.where(F.when(turned, ~inside).otherwise(inside)).select("track_id", "dist", "lat", "lon", "ele")
    idx = F.row_number().over(Window.partitionBy("track_id").orderBy("dist")) - 1
    return kept.unionByName(made).withColumn("idx", idx.cast("long"))


def moved_zones(zones: DataFrame, kind: str, a: int, b: int, left: int) -> DataFrame:
    """Zones (alo, ahi) after a cut at the start (before b) or end (after a) that left `left` points: shifted, clipped,
    and gone where nothing is left of them."""
    shift = b if kind == "start" else 0
    kept = zones.where(F.col("ahi") > b) if kind == "start" else zones.where(F.col("alo") < a)
    out = kept.withColumn("alo", F.greatest(F.lit(0), F.col("alo") - shift)).withColumn("ahi", F.least(F.lit(left - 1), F.col("ahi") - shift))
    return out.where("ahi > alo")


def hit(zones: DataFrame, metres: float) -> DataFrame:
    """For each track the zone that holds a place, the first of them; else the one whose middle is nearest."""
    inside = F.col("start").cast("double") <= metres
    inside = inside & (F.col("end") >= metres)
    rank = F.struct((~inside).alias("out"), F.when(inside, 0.0).otherwise(F.abs((F.col("start") + F.col("end")) / 2 - metres)).alias("far"), F.col("zone"))
    return zones.groupBy("track_id").agg(F.min_by("zone", rank).alias("zone"))


def accepted(zones: DataFrame, ids: list) -> DataFrame:
    """Zones named are accepted, or no longer; a suspect one that had no shape is drawn straight then."""
    mine = F.col("zone").isin(ids)
    now = F.when(mine, ~F.col("accepted")).otherwise(F.col("accepted"))
    return zones.withColumn("accepted", now).withColumn("interp", F.when(mine & F.col("accepted") & (F.col("interp") == "none"), "uniform").otherwise(F.col("interp")))


def rejected(zones: DataFrame, ids: list) -> DataFrame:
    return zones.withColumn("rejected", F.when(F.col("zone").isin(ids), ~F.col("rejected")).otherwise(F.col("rejected")))


def drawn(zones: DataFrame, track_id: int, alo: int, ahi: int) -> DataFrame:
    """A zone more, by hand."""
    new = zones.sparkSession.createDataFrame([(track_id, min(alo, ahi), max(alo, ahi), "manual")], "track_id long, alo long, ahi long, source string")
    return zones.unionByName(new, allowMissingColumns=True)
