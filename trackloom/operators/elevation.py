"""Elevation lookup: which tile or provider answers for a point, and what to do where none does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.scratch import stored

from .tracks import dealt

#: Country, lowest and highest latitude, lowest and highest longitude; the first box that holds a point
#: names its country.
BOXES = [
    ("HK", 22.15, 22.56, 113.83, 114.41), ("SI", 45.42, 46.88, 13.38, 16.60), ("HR", 42.39, 46.55, 13.49, 19.43), ("LU", 49.45, 50.18, 5.73, 6.53),
    ("EE", 57.51, 59.68, 21.84, 28.21), ("DK", 54.56, 57.75, 8.08, 15.20), ("NL", 50.75, 53.47, 3.36, 7.21), ("BE", 49.50, 51.50, 2.55, 6.40),
    ("CH", 45.82, 47.81, 5.96, 10.49), ("AT", 46.37, 49.02, 9.53, 17.16), ("PL", 49.00, 54.84, 14.12, 24.15), ("DE", 47.27, 55.06, 5.87, 15.04),
    ("FR", 41.36, 51.09, -5.14, 9.56), ("ES", 36.00, 43.79, -9.30, 3.32), ("NO", 57.96, 71.19, 4.64, 31.08), ("FI", 59.81, 70.09, 20.65, 31.59),
    ("GB", 49.96, 60.85, -8.17, 1.77), ("IT", 36.65, 47.09, 6.63, 18.52), ("US", 24.40, 49.38, -124.85, -66.93), ("CA", 41.68, 83.11, -141.00, -52.62),
    ("AU", -43.64, -10.06, 113.16, 153.64), ("NZ", -47.29, -34.39, 166.43, 178.52), ("MX", 14.53, 32.72, -118.37, -86.71),
]


def country(lat: Column, lon: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, s, n, w, e in reversed(BOXES):
        out = F.when(lat.between(s, n) & lon.between(w, e), name).otherwise(out)
    return out


def sane(ele: Column) -> Column:
    """Elevation in metres, null where it is no number of a place on earth."""
    z = ele.try_cast("double")
    return F.when((z > -1000) & (z < 10000) & ~F.isnan(z), z)


def is_missing(value: Column, tag: Column | None = None, low: float | None = None, zero_counts: bool = True, huge: float = 1e37) -> Column:
    """Whether a raster's value stands for no data: its own tag, not a number, beyond `huge`, under `low`, or exactly
    zero where that does not count. Providers differ in these rules only."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) > huge)
    if tag is not None:
        bad = bad | F.coalesce(value == tag, F.lit(False))
    if low is not None:
        bad = bad | (value < low)
    return bad if zero_counts else bad | (value == 0)


#: The rules of is_missing by provider family.
MISSING_RULES = {
    "wcs": {"low": -9998.0, "zero_counts": False},
    "wcs-coast": {"low": -9998.0, "zero_counts": True},
    "de": {"low": -100.0, "zero_counts": False},
    "us": {"low": -500.0},
    "no": {"low": -100.0},
    "dk": {"low": -100.0},
    "pl": {},
}


#: Points that ask for one key in one task, and keys that are cut into pieces at most: the limit rises with the points.
PIECE, MOST_CUT = 20_000, 10_000

#: Rows of tiles or cells that are broadcast at most.
FEW_ROWS = 100_000


def dealt_join(points: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """points (track_id, idx, more) with the rows of a table that share their keys. Keys that many points ask for are cut
    into pieces, to each of which the table's rows go, so that no task gets all points of a place. Both sides are merged,
    whatever Spark thinks of their size: points in order pack so well that it would take millions of them for few."""
    count = F.count(F.lit(1))
    asked = points.groupBy(*keys).agg(count.alias("__n")).crossJoin(F.broadcast(points.agg(count.alias("__all"))))
    most = F.greatest(F.lit(PIECE), F.col("__all") / MOST_CUT)
    hot = F.broadcast(asked.select(*keys, F.ceil(F.col("__n") / most).alias("__n")).where("__n > 1"))
    n, at = F.coalesce("__n", F.lit(1)), F.xxhash64("track_id", "idx")
    # Points without a key meet nothing and may lie anywhere.
    lost = F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True)
    own = points.join(hot, keys, "left").withColumn("__piece", F.when(lost, at).otherwise(F.pmod(at, n))).drop("__n")
    theirs = table.join(hot, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("__n")
    return dealt(own, *keys, "__piece").hint("merge").join(theirs, [*keys, "__piece"], how).drop("__piece")


def looked_up(points: DataFrame, table: DataFrame, keys: list[str], n: int) -> DataFrame:
    """points with the row of a table that has their keys, nulls if none has. A table made of n rows, FEW_ROWS at most, is
    broadcast, so that points stay where they are; else points are kept as a table, as they are counted by keys and then
    dealt by them. Points are never broadcast."""
    if n <= FEW_ROWS:
        return points.join(F.broadcast(table), keys, "left")
    return dealt_join(stored(points, "asked"), table, keys, "left")


def assigned(points: DataFrame, tiles: DataFrame, cell: float, fields: tuple[str, ...] = ()) -> DataFrame:
    """tile_id (and `fields`) of the first tile (by ord, then tile_id) that holds each point, edges included; null if none
    does. points: track_id, idx, lat, lon; tiles: tile_id, ord, west, south, east, north. Tiles are put in all cells of
    `cell` degrees that they touch, so that the join is on equal cells; the tiles of a cell are one row, in order, so cells
    should not be much wider than tiles."""
    side = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    tile = F.struct(*dict.fromkeys(("ord", "tile_id", "south", "west", "north", "east", *fields)))
    rows = tiles.where(F.col("ord").isNotNull()).withColumn("__cy", side("south", "north")).withColumn("__cx", side("west", "east"))
    lists = rows.groupBy("__cy", "__cx").agg(F.sort_array(F.collect_list(tile)).alias("__tiles"))
    placed = points.withColumn("__cy", F.floor(F.col("lat") / cell)).withColumn("__cx", F.floor(F.col("lon") / cell))
    holds = lambda t: F.col("lat").between(t["south"], t["north"]) & F.col("lon").between(t["west"], t["east"])
    first = looked_up(placed, lists, ["__cy", "__cx"], rows.count()).select(*points.columns, F.get(F.filter("__tiles", holds), F.lit(0)).alias("__t"))
    return first.select(*points.columns, *[F.col(f"__t.{c}").alias(c) for c in ("tile_id", *fields)])


def sampled(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """ele of the raster cell that each point lies in. cells: tile_id, row, col, z with rows counted from the north
    edge; points carry tile_id, west and north of their tile."""
    at = points.withColumn("row", F.floor((F.col("north") - F.col("lat")) / size)).withColumn("col", F.floor((F.col("lon") - F.col("west")) / size))
    found = looked_up(at, cells.select("tile_id", "row", "col", "z"), ["tile_id", "row", "col"], cells.count())
    return found.withColumn("ele", sane(F.col("z"))).drop("z", "row", "col")


def chained(points: DataFrame, keys: list[str], providers: list[tuple[str, DataFrame]]) -> DataFrame:
    """ele and source of the first provider that answers. providers: (name, answers by keys with ele), best first.
    All answers are brought together by one shuffle."""
    answers = None
    for rank, (name, found) in enumerate(providers):
        own = found.where(F.col("ele").isNotNull()).select(*keys, F.col("ele"), F.lit(name).alias("source"), F.lit(rank).alias("rank"))
        answers = own if answers is None else answers.unionByName(own)
    best = answers.groupBy(*keys).agg(F.min_by(F.struct("ele", "source"), "rank").alias("a"))
    return points.join(best, keys, "left").select(*points.columns, F.col("a.ele").alias("ele"), F.col("a.source").alias("source"))


def with_neighbours(points: DataFrame, answers: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Fill points without elevation from neighbouring countries. points: track_id, idx, cc, ele; answers: track_id,
    idx, cc, ele that each country's provider gives; neighbours: cc, priority, other."""
    open_ = points.where(F.col("ele").isNull()).select("track_id", "idx", "cc")
    asked = open_.join(neighbours, "cc").select("track_id", "idx", "priority", F.col("other").alias("cc"))
    found = asked.join(answers.where(F.col("ele").isNotNull()), ["track_id", "idx", "cc"]).groupBy("track_id", "idx").agg(F.min_by("ele", "priority").alias("filled"))
    return points.join(found, ["track_id", "idx"], "left").withColumn("ele", F.coalesce("ele", "filled")).drop("filled")


def source_table(points: DataFrame) -> DataFrame:
    """source, n, missing, with a Total row."""
    counted = points.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ele").isNull()).alias("missing"))
    return counted.select(F.coalesce("source", F.lit("Total")).alias("source"), "n", "missing")


def single_source(points: DataFrame) -> DataFrame:
    """track_id, source: the one source of a track's points, or MIXED."""
    return points.groupBy("track_id").agg(F.when(F.count_distinct("source") == 1, F.first("source", True)).when(F.count_distinct("source") > 1, "MIXED").alias("source"))
