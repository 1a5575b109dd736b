"""Places matched to a track in their order along it, and the stretches between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trackloom.functions.geo import RADIUS


def forward(lat: np.ndarray, lon: np.ndarray, plat: np.ndarray, plon: np.ndarray) -> np.ndarray:
    """For each place in turn the nearest point (the first of those that are equally far, to a micrometre) from the one after the last match on, within
    three tenths of the track or 200 points; so switchbacks and ways back are not taken for the way out."""
    n, out, start = len(lat), np.zeros(len(plat), dtype=np.int64), 0
    reach = max(200, int(n * 0.3))
    la, lo = np.radians(lat), np.radians(lon)
    for k, (p, q) in enumerate(zip(np.radians(plat), np.radians(plon), strict=True)):
        s = slice(start, min(n, start + reach))
        h = np.sin((la[s] - p) / 2) ** 2 + np.cos(p) * np.cos(la[s]) * np.sin((lo[s] - q) / 2) ** 2
        out[k] = start + int(np.argmin(np.round(2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1))), 6)))
        start = min(int(out[k]) + 1, n - 1)
    return out


def matched(places: DataFrame, points: DataFrame) -> DataFrame:
    """track_id, ord, idx: the point that each place (track_id, ord, lat, lon) is matched to. A match depends on the one
    before, so a track's places are taken in order, by one task for each track; tracks go their own ways. Places of
    tracks without points are left out."""
    schema = T.StructType([points.schema["track_id"], *T.StructType.fromDDL("ord long, idx long")])

    def run(left, right):
        import pyarrow as pa

        left, right = left.sort_by("ord"), right.sort_by("idx")
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([left["track_id"].slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.int64())], names=schema.names)
        c = lambda t, name: t[name].to_numpy()
        at = forward(c(right, "lat"), c(right, "lon"), c(left, "lat"), c(left, "lon"))
        return pa.Table.from_arrays([left["track_id"], pa.array(c(left, "ord"), pa.int64()), pa.array(c(right, "idx")[at], pa.int64())], names=schema.names)

    mine = places.select("track_id", F.col("ord").cast("long").alias("ord"), "lat", "lon")
    return mine.groupBy("track_id").cogroup(points.select("track_id", "idx", "lat", "lon").groupBy("track_id")).applyInArrow(run, schema)


def between(matches: DataFrame) -> DataFrame:
    """track_id, split, start_idx, end_idx: the stretches between places that follow each other (records.split_points
    gives their points); stretches of under two points are left out."""
    nxt = F.lead("idx").over(Window.partitionBy("track_id").orderBy("ord"))
    out = matches.select("track_id", F.col("ord").alias("split"), F.col("idx").alias("start_idx"), nxt.alias("end_idx"))
    return out.where("end_idx > start_idx")
