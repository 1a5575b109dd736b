"""Joins of places against all pairs, far from the equator and the first meridian too."""

import math
import random

import numpy as np
import pytest

from trackloom.operators import spatial, tracks


def metres(a, b, c, d):
    p, q, r, s = map(np.radians, (a, b, c, d))
    h = np.sin((r - p) / 2) ** 2 + np.cos(p) * np.cos(r) * np.sin((s - q) / 2) ** 2
    return 2 * 6_371_000.0 * np.arcsin(np.sqrt(h))


def wander(lat, lon, n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        out.append((lat, lon))
        lat, lon = lat + r.uniform(-1, 1) * 2e-4, lon + r.uniform(-1, 1) * 4e-4
    return out


@pytest.fixture(scope="module", params=[(46.0, 14.5), (69.5, 179.0), (-33.0, -120.0)])
def ride(request, spark):
    line = wander(*request.param, 150, 7)
    df = spark.createDataFrame([("t", i, a, b, 0.0) for i, (a, b) in enumerate(line)], "track_id string, idx long, lat double, lon double, ele double")
    return line, tracks.with_distance(df)


def test_all_pairs_of_a_track(ride):
    line, p = ride
    want = {(i, j) for i, a in enumerate(line) for j, b in enumerate(line) if j - i >= 10 and metres(*a, *b) <= 25}
    assert {(r.i, r.j) for r in spatial.self_proximity(p, 25.0, 10).collect()} == want


def test_nearest_places_and_segments(spark, ride):
    line, p = ride
    r = random.Random(5)
    lat, lon = line[70]
    # Beside the track, some hundred metres off, and far beyond the last ring.
    places = [(i, "t", lat + r.uniform(-1, 1) * s, lon + r.uniform(-1, 1) * s) for i, s in enumerate([1e-4] * 8 + [5e-3] * 8 + [0.5] * 4)]
    df = spark.createDataFrame(places, "place_id long, track_id string, lat double, lon double")
    idx = {x.place_id: x.idx for x in spatial.nearest_points(df, p).collect()}
    off = {x.place_id: x.metres for x in spatial.to_track(df, p).collect()}
    a, b = np.array(line[:-1]), np.array(line[1:])
    for i, _, y, x in places:
        d = [(v - y) ** 2 + (w - x) ** 2 for v, w in line]
        assert idx[i] == int(np.argmin(d))
        t = np.clip((([y, x] - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)[:, None]
        foot = a + t * (b - a)
        assert off[i] == pytest.approx(metres(y, x, foot[:, 0], foot[:, 1]).min(), rel=1e-6)


def test_structures_with_long_legs(spark, ride):
    line, p = ride
    nodes = [(1, "t", 0, line[10][0], line[10][1]), (1, "t", 1, line[120][0], line[120][1]), (2, "t", 0, line[5][0] + 1, line[5][1]), (2, "t", 1, line[5][0] + 1.1, line[5][1])]
    df = spark.createDataFrame(nodes, "struct_id long, track_id string, node int, lat double, lon double")
    a, b, q = np.array(line[10]), np.array(line[120]), np.array(line)
    t = np.clip(((q - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(), 0, 1)[:, None]
    foot = a + t * (b - a)
    near = np.flatnonzero(metres(q[:, 0], q[:, 1], foot[:, 0], foot[:, 1]) <= 30)
    runs = np.split(near, np.flatnonzero(np.diff(near) > 3) + 1)
    got = sorted((r.struct_id, r.alo, r.ahi) for r in spatial.structure_spans(df, p, 30.0, 3).collect())
    assert got == [(1, int(x[0]), int(x[-1])) for x in runs]
    assert {r.struct_id for r in spatial.structures_near(df, p, 5.0).collect()} == {1}


def test_points_that_ask_for_one_key_are_cut_into_pieces(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trackloom.operators import elevation

    monkeypatch.setattr(elevation, "PIECE", 5)
    p = spark.range(60).select(F.lit("a").alias("track_id"), F.col("id").alias("idx"), F.when(F.col("id") < 40, 1).when(F.col("id") < 50, 2).alias("k"))
    z = spark.createDataFrame([(1, 10.0), (3, 30.0)], "k int, z double")
    got = sorted((r["idx"], r["z"]) for r in elevation.dealt_join(p, z, ["k"], "left").collect())
    assert got == [(i, 10.0 if i < 40 else None) for i in range(60)]


def overlapping_tiles(spark):
    """Tiles of 0.01 degrees, a north half that overlaps the south one, two of one rank, one without any, and their cells."""
    tiles = [("s", 1, 46.0, 14.0, 46.01, 14.01), ("n", 0, 46.005, 14.0, 46.015, 14.01), ("b", 2, 46.02, 14.0, 46.03, 14.01), ("a", 2, 46.02, 14.0, 46.03, 14.01), ("x", None, 46.04, 14.0, 46.05, 14.01)]
    cells = [(t, r, c, 100.0 * i + 10 * r + c) for i, t in enumerate("snbax") for r in range(11) for c in range(11) if (r + c) % 3]
    return spark.createDataFrame(tiles, "tile_id string, ord int, south double, west double, north double, east double"), spark.createDataFrame(cells, "tile_id string, row long, col long, z double"), tiles, cells


@pytest.mark.parametrize("few", [100_000, 0])
def test_raster_answers_for_every_point(spark, monkeypatch, few):
    from trackloom.operators import elevation
    from trackloom.sources import providers

    monkeypatch.setattr(elevation, "FEW_ROWS", few)
    monkeypatch.setattr(elevation, "PIECE", 5)
    grid, cells, tiles, known = overlapping_tiles(spark)
    points = [("t", i, 46.0 + i % 60 * 0.00093, 14.0 + i % 7 * 0.0013) for i in range(300)] + [("edge", 0, 46.005, 14.01), ("none", 0, None, 14.0), ("none", 1, 46.0, None), ("none", 2, float("nan"), 14.0), (None, 5, 46.002, 14.002)]
    z, ranked = {k[:3]: k[3] for k in known}, sorted((t for t in tiles if t[1] is not None), key=lambda t: (t[1], t[0]))

    def want(lat, lon):
        t = next((t for t in ranked if lat is not None and lon is not None and t[2] <= lat <= t[4] and t[3] <= lon <= t[5]), None)
        return t and z.get((t[0], math.floor((t[4] - lat) / 0.001), math.floor((lon - t[3]) / 0.001)))

    got = providers.raster(cells, grid, 0.001)(spark.createDataFrame(points, "track_id string, idx long, lat double, lon double")).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r["track_id"], r["idx"], r["ele"]) for r in got), key=key) == sorted(((t, i, want(a, o)) for t, i, a, o in points), key=key)


@pytest.mark.parametrize("few", [100_000, 0])
def test_packed_points_are_not_broadcast(spark, monkeypatch, tmp_path, few):
    """A file of points in order is so small that Spark would take them for few rows."""
    from pyspark.sql import functions as F

    from trackloom.operators import elevation
    from trackloom.sources import providers

    monkeypatch.setattr(elevation, "FEW_ROWS", few)
    grid, cells, _, _ = overlapping_tiles(spark)
    spark.range(20_000).select(F.lit("t").alias("track_id"), F.col("id").alias("idx"), (46.0 + F.col("id") * 1e-6).alias("lat"), F.lit(14.0).alias("lon")).write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    raster = providers.raster(cells, grid, 0.001)
    met = elevation.dealt_join(points.withColumn("col", F.floor(F.col("lon") - 14.0)), cells, ["col"])
    for found in (raster(points), raster(points).where("ele is not null"), met):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan


def test_kept_tables_of_many_rows_are_merged(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trackloom import scratch

    monkeypatch.setattr(scratch, "MANY_ROWS", 1000)
    kept = {n: scratch.stored(spark.range(n), f"kept-{n}") for n in (1000, 1001)}
    few, plan = spark.range(3000).withColumn("x", F.rand()), lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(few.join(kept[1000], "id"))
    for how in ("inner", "left", "left_anti"):
        found = few.join(kept[1001].where("id > 5").select("id"), "id", how)
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    assert "BuildRight" in plan(kept[1001].join(F.broadcast(few), "id"))
    assert few.join(kept[1001], "id").count() == 1001
