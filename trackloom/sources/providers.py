"""Elevation providers: what is known of each, and the protocol by which a table of answers stands in for a service.

No service is called here. A provider is any callable from points (track_id, idx, lat, lon) to answers (track_id, idx,
ele): a join with a raster table that an ingestion job has filled, or a replay of recorded answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import elevation

Lookup = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Provider:
    """Country, grid in metres, points or degrees of one request, rule of missing values (a key of MISSING_RULES)."""

    country: str
    name: str
    grid: float
    batch: int | None = None
    box: float | None = None
    missing: str = "wcs"


#: Providers by country, the best first.
PROVIDERS = [
    Provider("ES", "MDT01", 0.5), Provider("ES", "MDT02", 2), Provider("ES", "WCS", 5, box=0.1), Provider("AT", "ALS1", 1), Provider("AT", "DGM5", 5), Provider("DE", "DGM1", 1, missing="de"),
    Provider("US", "3DEP", 1, box=0.0045, missing="us"), Provider("PL", "NMT", 1, missing="pl"), Provider("NO", "DTM1", 1, missing="no"), Provider("DK", "DHM", 0.4, missing="dk"), Provider("FI", "KM2", 2, missing="wcs-coast"),
    Provider("NL", "AHN4", 0.5, missing="wcs-coast"), Provider("EE", "DTM1", 1, missing="wcs-coast"), Provider("FR", "RGE", 1, batch=120), Provider("CH", "PROFILE", 2, batch=100), Provider("SI", "LIDAR", 1, batch=200),
    Provider("HR", "DTM20", 20), Provider("*", "GPXZ", 10, batch=512),
]


def raster(cells: DataFrame, tiles: DataFrame, size: float, cell: float = 0.01) -> Lookup:
    """A provider from a table of raster cells (tile_id, row, col, z) and tiles (tile_id, ord, west, south, east, north).
    It answers for every point, with null where it has no height, so what it is asked need not be joined again."""

    def lookup(points: DataFrame) -> DataFrame:
        placed = elevation.assigned(points.select("track_id", "idx", "lat", "lon"), tiles, cell, ("west", "north"))
        return elevation.sampled(placed, cells, size).select("track_id", "idx", "ele")

    return lookup


def replay(answers: DataFrame, places: int = 5) -> Lookup:
    """A provider from recorded answers (lat, lon, ele), found by coordinates to five places."""
    key = lambda c: F.round(F.col(c), places)

    def lookup(points: DataFrame) -> DataFrame:
        known = answers.groupBy(key("lat").alias("klat"), key("lon").alias("klon")).agg(F.first("ele", True).alias("ele"))
        return points.withColumn("klat", key("lat")).withColumn("klon", key("lon")).join(known, ["klat", "klon"]).select("track_id", "idx", "ele")

    return lookup


def with_elevation(points: DataFrame, chain: list[tuple[str, Lookup]]) -> DataFrame:
    """ele and source from a chain of providers; each is asked only for points that none before has answered."""
    open_, parts = points.select("track_id", "idx", "lat", "lon"), None
    for name, lookup in chain:
        found = lookup(open_).where(elevation.sane(F.col("ele")).isNotNull()).select("track_id", "idx", "ele", F.lit(name).alias("source"))
        parts = found if parts is None else parts.unionByName(found)
        open_ = open_.join(found.select("track_id", "idx"), ["track_id", "idx"], "left_anti")
    kept = points.drop("ele", "source")
    return kept.join(parts, ["track_id", "idx"], "left") if parts is not None else kept.withColumn("ele", F.lit(None).cast("double")).withColumn("source", F.lit(None).cast("string"))


def gpxz_elevation(ele, resolution):
    """An answer counts only where its source is no coarser than 10 m."""
    return F.when(resolution <= 10, ele)


def swiss_elevation(fine, coarse):
    """The fine model, or the coarse one where the fine one has none or zero."""
    return F.coalesce(F.nullif(fine, F.lit(0.0)), coarse)
