"""Elevation from several sources by region: which regions hold a point, whose service is asked first, and who is asked
where it has no answer. Regions overlap at their borders, and each has heights on a grid of its own projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import crs
from trackloom.scratch import stored

from .elevation import MISSING_RULES, is_missing
from .intervals import islands
from .kernels import box_groups

#: German states with heights of their own: name, EPSG code of the grid, lowest and highest latitude,
#: lowest and highest longitude. The first that holds a point is asked first.
GERMAN_STATES = [
    ("NRW", 25832, 50.25, 52.55, 5.75, 9.55), ("BB", 25833, 51.30, 53.65, 11.20, 14.85), ("MV", 25833, 53.05, 54.75, 10.55, 14.50), ("BW", 25832, 47.45, 49.85, 7.45, 10.55),
    ("HE", 25832, 49.35, 51.70, 7.75, 10.30), ("ST", 25832, 50.85, 53.05, 10.50, 13.25), ("SL", 25832, 49.05, 49.65, 6.30, 7.45), ("BE", 25833, 52.30, 52.70, 13.05, 13.80),
]

#: The side of one request in metres, and the margin around its points.
REQUEST_SIDE, MARGIN = 500.0, 50.0

REGION = "region string, ord int, epsg int, west double, south double, east double, north double"

Answers = Callable[[DataFrame], DataFrame]


def german_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, k, epsg, w, s, e, n) for k, (name, epsg, s, n, w, e) in enumerate(GERMAN_STATES)], REGION)


def regions_at(points: DataFrame, regions: DataFrame, cell: float = 1.0) -> DataFrame:
    """track_id, idx, lat, lon, region, epsg, k: all regions whose box holds a point, edges included, numbered from 0 in
    their order (ord). Boxes are put in all cells of `cell` degrees that they touch, so the join is on equal cells."""
    side = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    boxes = regions.withColumn("cy", side("south", "north")).withColumn("cx", side("west", "east"))
    placed = points.select("track_id", "idx", "lat", "lon", F.floor(F.col("lat") / cell).alias("cy"), F.floor(F.col("lon") / cell).alias("cx"))
    met = placed.join(boxes, ["cy", "cx"]).where(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
    k = F.row_number().over(Window.partitionBy("track_id", "idx").orderBy("ord", "region")) - 1
    return met.select("track_id", "idx", "lat", "lon", "region", "epsg", k.alias("k"))


def primary_runs(points: DataFrame, met: DataFrame) -> DataFrame:
    """points with region (the first that holds them, null if none does), epsg and run: consecutive points of one first
    region are one run."""
    first = met.where("k = 0").select("track_id", "idx", "region", "epsg")
    seen = points.join(first, ["track_id", "idx"], "left")
    changes = ~F.col("region").eqNullSafe(F.lag("region").over(Window.partitionBy("track_id").orderBy("idx")))
    here = F.row_number().over(Window.partitionBy("track_id").orderBy("idx"))
    return islands(seen.withColumn("__first", here == 1), changes | F.col("__first"), ["track_id"], ["idx"], "run").drop("__first")


def with_grid_place(df: DataFrame) -> DataFrame:
    """df with x and y, metres in the zone of its column epsg, of its lat and lon; null for zones that are not known."""
    return crs.in_zone(df, "lat", "lon", "epsg").withColumnsRenamed({"easting": "x", "northing": "y"})


def requests(runs: DataFrame, side: float = REQUEST_SIDE, margin: float = MARGIN) -> DataFrame:
    """track_id, run, chunk, region, n, west, south, east, north: what is asked of the first regions. The points of a
    run are gathered one after another while their box stays within `side` metres; the box gets a margin."""
    placed = runs.where(F.col("region").isNotNull())
    p = with_grid_place(placed).select(F.struct("track_id", "run", "region").alias("track_id"), "idx", F.col("y").alias("lat"), F.col("x").alias("lon"))
    grouped = box_groups(p, side).withColumnRenamed("box", "chunk").groupBy("track_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), (F.min("lon") - margin).alias("west"), (F.min("lat") - margin).alias("south"), (F.max("lon") + margin).alias("east"), (F.max("lat") + margin).alias("north")
    )
    return grouped.select("track_id.track_id", "track_id.run", "chunk", "track_id.region", "n", "west", "south", "east", "north")


def grid_answers(cells: DataFrame, size: float, rule: dict | None = None) -> Answers:
    """Answers from a table of heights (region, row, col, z): row and col count `size` metres north and east of the
    origin of the region's own grid. What counts as missing follows `rule` (is_missing's arguments)."""
    rule = MISSING_RULES["de"] if rule is None else rule

    def ask(asked: DataFrame) -> DataFrame:
        at = (asked if "x" in asked.columns else with_grid_place(asked)).withColumn("row", F.floor(F.col("y") / size)).withColumn("col", F.floor(F.col("x") / size))
        found = at.join(cells.select("region", "row", "col", "z"), ["region", "row", "col"])
        return found.where(~is_missing(F.col("z"), **rule)).select("track_id", "idx", "region", "k", F.col("z").alias("ele"))

    return ask


def routed(points: DataFrame, regions: DataFrame, cell: float = 1.0) -> DataFrame:
    """regions_at with the place on each region's grid, written once: what is asked of all regions reads it."""
    return stored(with_grid_place(regions_at(points, regions, cell)), "regions")


def asked_in_turn(points: DataFrame, met: DataFrame, ask: Answers) -> DataFrame:
    """points with ele, region and asked: of the regions that hold a point (`met`, as routed() gives it) the first is
    asked for all points, the others only for those it has no height for; of their answers the first in order holds.
    `asked` counts the regions up to the answer, or all that hold the point if none has one (0 outside all)."""
    first = stored(ask(met.where("k = 0")), "first-answers")
    left = met.where("k > 0").join(first.select("track_id", "idx"), ["track_id", "idx"], "left_anti")
    found = first.unionByName(ask(left)).select("track_id", "idx", F.struct("k", "ele", "region").alias("b"))
    best = found.unionByName(met.select("track_id", "idx", "k"), allowMissingColumns=True).groupBy("track_id", "idx").agg(F.min("b").alias("b"), (F.max("k") + 1).alias("held"))
    kept = points.drop("ele", "region", "asked")
    out = kept.join(best, ["track_id", "idx"], "left")
    return out.select(*kept.columns, F.col("b.ele").alias("ele"), F.col("b.region").alias("region"), F.coalesce(F.col("b.k") + 1, "held", F.lit(0)).alias("asked"))
