"""The queue of routes to work on, as a stream of files, and the versions of what was worked on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators import intervals, tracks
from trackloom.sources import gpx

STEPS = ["pending", "structures", "elevation", "cleaning", "ready"]


def cleaned(points: DataFrame) -> DataFrame:
    """What the queue does to each route: distances, gradients, spike zones drawn straight."""
    g = tracks.with_gradient(tracks.with_distance(points))
    return intervals.interpolated(g, intervals.spike_zones(g)).select("track_id", "idx", "lat", "lon", "ele", "dist", "gr", "ele_fixed")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int = 100):
    """Read new GPX files of a folder as they come, clean their routes and append them to `out`, once each. Returns the
    stream, which ends when all files that are there have been worked on."""
    stream = (
        spark.readStream.format("xml").option("rowTag", "gpx").option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", per_batch)
        .schema(gpx.SCHEMA).load(folder).withColumn("track_id", gpx.within(folder))
    )

    def work(batch: DataFrame, number: int) -> None:
        # A batch that is run again writes to its own folder again.
        cleaned(gpx.track_points(batch, "track_id")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def smallest_first(entries: DataFrame) -> DataFrame:
    return entries.where("size > 0").orderBy("size", "id")


def upsert(state: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """state with rows of the same key replaced and new ones added."""
    return state.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def advanced(state: DataFrame, ids: DataFrame | list, status: str, key: str = "id") -> DataFrame:
    """The entries named (a list by hand, or a table with the key) move to a status; those that are done stay so."""
    if isinstance(ids, DataFrame):
        seen = state.join(ids.select(key).distinct().withColumn("__named", F.lit(True)), key, "left")
        return seen.withColumn("status", F.when(F.col("__named") & (F.col("status") != "done"), status).otherwise(F.col("status"))).select(*state.columns)
    return state.withColumn("status", F.when(F.col(key).isin(ids) & (F.col("status") != "done"), status).otherwise(F.col("status")))


def removed(state: DataFrame, ids: DataFrame | list, key: str = "id") -> DataFrame:
    if isinstance(ids, DataFrame):
        return state.join(ids.select(key), key, "left_anti")
    return state.where(~F.col(key).isin(ids))


def has_pending(state: DataFrame) -> bool:
    return not state.where(F.col("status") != "done").isEmpty()


def first_pending(state: DataFrame) -> DataFrame:
    return state.where("status = 'pending'").orderBy("seq").limit(1)


def parked_raw(state: DataFrame) -> DataFrame:
    """Parked entries whose elevation has not been looked up."""
    return state.where((F.col("status") == "parked") & F.col("source").isNull())


class History:
    """Versions of a table with undo and redo, in a folder that belongs to one run. A version is written once; undo and
    redo only choose what is read."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 30):
        self.spark, self.folder, self.most = spark, f"{folder}/{uuid.uuid4().hex}", most
        self.versions: list[int] = []
        self.at, self.next = -1, 0

    def push(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v={self.next}")
        self.versions = [*self.versions[: self.at + 1], self.next][-self.most :]
        self.next += 1
        self.at = len(self.versions) - 1

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={self.versions[self.at]}")

    def undo(self) -> bool:
        moved = self.at > 0
        self.at -= moved
        return moved

    def redo(self) -> bool:
        moved = self.at + 1 < len(self.versions)
        self.at += moved
        return moved


# A route that is being built: waypoints (route_id, ord, lat, lon) and legs between neighbours.


def with_waypoint(waypoints: DataFrame, ord_: int, lat: float, lon: float) -> DataFrame:
    """A waypoint put before the one numbered ord_ (or at the end); later ones move on."""
    moved = waypoints.withColumn("ord", F.when(F.col("ord") >= ord_, F.col("ord") + 1).otherwise(F.col("ord")))
    new = waypoints.select("route_id").distinct().select("route_id", F.lit(ord_).cast("long").alias("ord"), F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    return moved.unionByName(new)


def without_waypoint(waypoints: DataFrame, ord_: int) -> DataFrame:
    return waypoints.where(F.col("ord") != ord_).withColumn("ord", F.when(F.col("ord") > ord_, F.col("ord") - 1).otherwise(F.col("ord")))


def legs(waypoints: DataFrame) -> DataFrame:
    """route_id, leg and both ends of each leg."""
    w = Window.partitionBy("route_id").orderBy("ord")
    out = waypoints.select("route_id", F.col("ord").alias("leg"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.lead("lat").over(w).alias("blat"), F.lead("lon").over(w).alias("blon"))
    return out.where(F.col("blat").isNotNull())


def legs_to_route(before: DataFrame, after: DataFrame) -> DataFrame:
    """Legs of `after` whose ends `before` has no leg for: the only ones to be routed anew."""
    ends = ["route_id", "alat", "alon", "blat", "blon"]
    return after.join(before.select(*ends), ends, "left_anti")
