"""Regions that overlap, requests of them, and tables laid out by place."""

import os

from pyspark.sql import functions as F

from trackloom import scratch
from trackloom.functions import crs
from trackloom.operators import catalogues, regions
from trackloom.plans import state_queries  # noqa: F401  registers its queries
from trackloom.plans.queries import QUERIES
from trackloom.sources import layout


def line(spark, places):
    return spark.createDataFrame([("a/1", i, y, x) for i, (y, x) in enumerate(places)], "track_id string, idx long, lat double, lon double")


def test_zones_by_column_as_by_code(spark):
    p = line(spark, [(52.5, 13.2), (47.5, 7.6), (46.05, 14.5), (60.2, 25.0)])
    for code in crs.ZONES:
        x, y = crs.transverse_mercator(F.col("lat"), F.col("lon"), code)
        for r in crs.in_zone(p.withColumn("epsg", F.lit(code)), "lat", "lon", "epsg").select("easting", "northing", x.alias("x"), y.alias("y")).collect():
            assert abs(r.easting - r.x) < 1e-6 and abs(r.northing - r.y) < 1e-6
    unknown = crs.in_zone(p.withColumn("epsg", F.lit(1)), "lat", "lon", "epsg").first()
    assert unknown.easting is None and unknown.northing is None


def test_routing_runs_and_requests(spark):
    # In one state, in two, in three (13.05 to 13.25 east), in none, and back.
    p = line(spark, [(49.0, 9.0), (49.4, 9.0), (49.401, 9.0), (49.41, 9.0), (52.4, 13.1), (45.0, 13.1), (45.1, 13.1), (49.0, 9.0), (49.001, 9.0)])
    met = regions.regions_at(p, regions.german_states(spark))
    by = {}
    for r in met.orderBy("idx", "k").collect():
        by.setdefault(r["idx"], []).append(r["region"])
    assert by == {0: ["BW"], 1: ["BW", "HE"], 2: ["BW", "HE"], 3: ["BW", "HE"], 4: ["BB", "ST", "BE"], 7: ["BW"], 8: ["BW"]}
    runs = regions.primary_runs(p, met)
    assert [(r["region"], r["run"]) for r in runs.orderBy("idx").collect()] == [("BW", 1)] * 4 + [("BB", 2)] + [(None, 3)] * 2 + [("BW", 4)] * 2
    asked = regions.requests(runs).orderBy("run", "chunk").collect()
    # 0.4 degrees and 1 km part requests, 111 m don't; a run of its own is asked on its own.
    assert [(r["run"], r["region"], r["n"]) for r in asked] == [(1, "BW", 1), (1, "BW", 2), (1, "BW", 1), (2, "BB", 1), (4, "BW", 2)]
    assert all(r["east"] - r["west"] >= 100 and r["north"] - r["south"] <= 600 for r in asked)


def test_alternates_are_asked_for_gaps_only(spark):
    p = line(spark, [(52.4, 13.1), (52.41, 13.1), (52.42, 13.1), (52.43, 13.1), (45.0, 13.1)])
    told = {("BB", 0): 5.0, ("ST", 0): 6.0, ("BE", 1): 7.0, ("ST", 2): 8.0, ("BE", 2): 9.0}
    table = spark.createDataFrame([(r, i, z) for (r, i), z in told.items()], "region string, idx long, ele double")
    asked = []

    def ask(rows):
        asked.append(sorted((r["idx"], r["region"]) for r in rows.collect()))
        return rows.join(table, ["region", "idx"]).select("track_id", "idx", "region", "k", "ele")

    out = regions.asked_in_turn(p, regions.routed(p, regions.german_states(spark)), ask).orderBy("idx").collect()
    assert [(r["ele"], r["region"], r["asked"]) for r in out] == [(5.0, "BB", 1), (7.0, "BE", 3), (8.0, "ST", 2), (None, None, 3), (None, None, 0)]
    assert asked[0] == [(i, "BB") for i in range(4)] and asked[1] == sorted((i, r) for i in (1, 2, 3) for r in ("ST", "BE"))


def test_heights_of_two_grids(spark):
    p = line(spark, [(52.4, 13.1), (52.4101, 13.1), (52.42, 13.1)])
    met = regions.routed(p, regions.german_states(spark))
    cells = met.select("region", F.floor(F.col("y") / 10).alias("row"), F.floor(F.col("x") / 10).alias("col"), F.when((F.col("region") == "BB") & (F.col("idx") > 0), F.lit(0.0)).otherwise(F.col("epsg") + 0.0).alias("z"))
    out = regions.asked_in_turn(p, met, regions.grid_answers(cells, 10.0)).orderBy("idx").collect()
    assert [(r["ele"], r["region"]) for r in out] == [(25833.0, "BB"), (25832.0, "ST"), (25832.0, "ST")]


def folders(path):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_only_the_folders_of_a_batch_are_read(spark, tmp_path):
    """All files of folders that the batch does not need are spoiled: whoever opened one would fail."""
    size = 0.5
    tiles = spark.range(400).select(F.concat(F.lit("t"), "id").alias("tile_id"), F.col("id").alias("ord"), *[((F.col("id") % 20 if c in ("south", "north") else F.floor(F.col("id") / 20)) * 0.5 + (0.499 if c in ("north", "east") else 0.0)).alias(c) for c in layout.BOX])
    laid = layout.by_cell(tiles, size)
    path = str(tmp_path / "tiles")
    layout.write_by_cell(laid, path, "ord")
    kept = {f"{path}/cell={y * (1 << 22) + x}" for y, x in ((3, 4), (7, 2))}
    files = folders(path)
    assert len({os.path.dirname(f) for f in files}) == 400
    for f in files:
        if os.path.dirname(f) not in kept:
            with open(f, "r+b") as out:
                out.truncate(10)
    table = layout.read_by_cell(spark, path, laid.schema)
    batch = line(spark, [(1.6, 2.2), (3.9, 1.4), (1.6, 2.3)])
    found = layout.first_tile(batch, table, size)
    assert [r["tile_id"] for r in found.orderBy("idx").collect()] == ["t83", "t47", "t83"]
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_more_cells_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(layout, "MOST_CELLS", 1)
    tiles = spark.createDataFrame([("a", 0, 1.0, 1.0, 1.4, 1.4), ("b", 1, 1.2, 1.2, 3.0, 3.0)], "tile_id string, ord int, south double, west double, north double, east double")
    laid = scratch.stored(layout.by_cell(tiles, 0.5), "tiles", "cell")
    got = layout.first_tile(line(spark, [(1.3, 1.3), (1.45, 1.45), (2.9, 2.9), (9.0, 9.0)]), laid, 0.5)
    assert [r["tile_id"] for r in got.orderBy("idx").collect()] == ["a", "b", "b", None]


def test_a_way_in_several_cells_is_met_once(spark):
    node = "array<struct<lat:double,lon:double>>"
    ways = spark.createDataFrame([
        (1, {"bridge": "yes"}, [(0.1, 0.1), (2.1, 2.1)]), (2, {"tunnel": "building_passage"}, [(0.1, 0.1), (0.2, 0.2)]), (3, {"tunnel": "yes", "bridge": "yes"}, [(0.3, 0.3), (0.4, 0.4)]),
        (4, {"bridge": "yes"}, [(0.1, 0.1), (0.2, 0.2), (0.1, 0.1)]), (5, {"bridge": "yes"}, [(0.1, 0.1)]), (6, {"bridge": "yes", "railway": "tram"}, [(0.1, 0.1), (0.2, 0.2)]), (7, {"bridge": "yes"}, [(9.0, 9.0), (9.1, 9.1)]),
    ], f"id long, tags map<string,string>, nodes {node}")
    laid = scratch.stored(layout.ways_by_cell(ways, 0.5), "ways", "cell")
    boxes = spark.createDataFrame([("x", 0.0, 0.0, 1.6, 1.6), ("y", 5.0, 5.0, 6.0, 6.0)], "track_id string, south double, west double, north double, east double")
    got = layout.structures_around(boxes, laid, 0.5).orderBy("id", "kind").collect()
    assert [(r["track_id"], r["id"], r["kind"]) for r in got] == [("x", 1, "bridge"), ("x", 3, "bridge"), ("x", 3, "tunnel")]


def shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_tracks_and_ways_are_not_dealt_again(spark):
    """100 tracks that meet 400 ways each in several cells: 40,000 pairs of some 2,000 rows."""
    at = F.col("id") / 1000
    node = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    ways = spark.range(400).select("id", F.create_map(F.lit("bridge"), F.lit("yes")).alias("tags"), F.array(node(at, at), node(at + 0.7, at + 0.4)).alias("nodes"))
    boxes = spark.range(100).select(F.col("id").alias("track_id"), (at + 0.3).alias("south"), (at + 0.2).alias("west"), (at + 1).alias("north"), (at + 1).alias("east"))
    laid = scratch.stored(layout.ways_by_cell(ways, 0.5), "ways", "cell")
    before = shuffled_rows(spark)
    got = layout.structures_around(boxes, laid, 0.5).select("track_id", "id").collect()
    assert len(got) == len(set(got)) == 40_000
    assert shuffled_rows(spark) - before < 20_000


def test_a_way_that_comes_with_several_boxes_is_met_once(spark, monkeypatch):
    monkeypatch.setattr(layout, "PIECE", 2)
    node = "array<struct<lat:double,lon:double>>"
    ways = spark.createDataFrame([(i, {"bridge": "yes"}, [(0.1 + k, 0.1 + k), (0.3 + k, 0.3 + k)]) for i in range(9) for k in ((0, 0, 1) if i % 2 else (0, 0))], f"id long, tags map<string,string>, nodes {node}")
    laid = scratch.stored(layout.ways_by_cell(ways, 0.5), "ways", "cell")
    boxes = spark.createDataFrame([("x", 0.0, 0.0, 2.0, 2.0), ("y", 1.0, 1.0, 2.0, 2.0), ("z", 0.2, 0.2, 0.2, 0.2), ("z", 0.0, 0.0, 9.0, 9.0)], "track_id string, south double, west double, north double, east double")
    got = sorted((r["track_id"], r["id"]) for r in layout.structures_around(boxes, laid, 0.5).collect())
    assert got == [("x", i) for i in range(9)] + [("y", i) for i in (1, 3, 5, 7)] + [("z", i) for i in range(9)]


def test_catalogue_files(spark):
    texts = [(1, '{"tiles":[{"id":"a b","bbox":[1,2,3,4],"path":"../x"},{"id":"a b","bbox":[5,2,6,4]},{"bbox":[1,2,3,4]},{"bbox":"no"},{"id":"z"}]}'), (2, "[]"), (3, "broken"), (4, None), (5, '[{"name":"n","bbox":[0,0,1,1],"sec":" 7 ","codSerie":"mdt"}]')]
    rows = layout.catalogue_entries(spark.createDataFrame(texts, "k long, value string"), "k")
    got = [tuple(r) for r in layout.tile_index(rows, "k", "DS").orderBy("k", "ord").collect()]
    assert got == [(1, "a_b", 0, "a_b.tif", "", 5.0, 2.0, 6.0, 4.0, "", ""), (1, "DS_1", 2, "DS_1.tif", "", 1.0, 2.0, 3.0, 4.0, "", ""), (5, "n", 0, "MDT_7.tif", "", 0.0, 0.0, 1.0, 1.0, "7", "MDT")]


def test_catalogues_share_files(spark, tmp_path):
    """Before, each catalogue had a folder and a file of its own."""
    i = F.col("id")
    spark.range(900).select(i.alias("event_id"), F.when(i % 300 > 0, i % 300).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["catalogue_round_trip"](spark, str(tmp_path))
    want = {(n % 300 or None, f"tile_{n}", n / 8, n / 8 + 1, f"tile_{n}.tif") for n in range(900)}
    assert found.count() == 900 and {tuple(r) for r in found.collect()} == want
    assert len(found.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_catalogues_read_back_as_written(spark, tmp_path):
    rows = [("x\ny {}", [("ü\n1", [1.0, 2.0, 3.0, 4.0])]), (None, [("z", [0.0, 0.0, 1.0, 1.0])]), ("none", [])]
    layout.write_catalogues(spark.createDataFrame(rows, "k string, tiles array<struct<id: string, bbox: array<double>>>"), f"{tmp_path}/c")
    back = layout.read_catalogues(spark, f"{tmp_path}/c", "k", "string")
    assert {r["k"] for r in back.collect()} == {k for k, _ in rows}
    assert {(r["k"], r["id"], r["bbox"][2]) for r in layout.catalogue_entries(back, "k").collect()} == {("x\ny {}", "ü\n1", 3.0), (None, "z", 1.0)}


def test_surface_models_are_left_out_by_their_name_only(spark):
    rows = spark.createDataFrame([(1, 0, "ALS DSM 01.02.2020"), (1, 1, "DTM Domzale 01.02.2010"), (1, 2, None)], "k long, pos long, title string")
    assert catalogues.best_record(rows, ["k"], F.lit(0)).first()["pos"] == 1
