"""GPX, structures, lines, grids, catalogues and the queue."""

from pyspark.sql import functions as F

from trackloom.sources import gpx, records
from trackloom.streaming import queue

DOC = """<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"><name>w</name></wpt>
<rte><rtept lat="3" lon="4"><ele>5</ele></rtept></rte>
<trk><name>t</name><trkseg><trkpt lat="46" lon="14"><ele>300</ele></trkpt><trkpt lat="46.1" lon="14.1"/></trkseg><trkseg><trkpt lat="46.2" lon="14.2"><ele>302</ele></trkpt></trkseg></trk></gpx>"""


def test_gpx_text(spark):
    docs = gpx.parsed(spark.createDataFrame([("a", DOC), ("b", None), ("c", "no xml")], "k string, gpx string"))
    rows = [tuple(r) for r in gpx.track_points(docs, "k").orderBy("k", "idx").collect()]
    assert rows == [("a", "t", 0, 46.0, 14.0, 300.0), ("a", "t", 1, 46.1, 14.1, 0.0), ("a", "t", 2, 46.2, 14.2, 302.0)]
    every = [(r.lat, r.ele) for r in gpx.all_points(docs, "k").orderBy("idx").collect()]
    assert every == [(46.0, 300.0), (46.1, None), (46.2, 302.0), (3.0, 5.0), (1.0, None)]


def test_gpx_files_and_queue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gpx").write_text(DOC)
    (tmp_path / "in/bad.gpx").write_text("<gpx><trk>")
    got = gpx.read_gpx(spark, str(tmp_path / "in"))
    assert [(r.track_id, r.idx) for r in got.orderBy("idx").collect()] == [("a.gpx", 0), ("a.gpx", 1), ("a.gpx", 2)]
    for _ in range(2):
        queue.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    gpx.write_gpx(got, str(tmp_path / "gpx"))
    assert len(list((tmp_path / "gpx").glob("track_id=*/*.txt"))) == 1


def test_structures(spark):
    body = """{"elements":[{"type":"way","id":9,"geometry":[{"lat":1,"lon":2},{"lat":1,"lon":3}]},{"type":"count"},
     {"type":"way","id":1,"tags":{"name":"Old"},"geometry":[{"lat":1,"lon":2},{"lat":1,"lon":3}]},
     {"type":"way","id":2,"tags":{"highway":"primary"},"geometry":[{"lat":1,"lon":2},{"lat":99,"lon":3}]},{"type":"count"},
     {"type":"way","id":3,"tags":{"highway":"primary"},"geometry":[{"lat":1,"lon":2},{"lat":2,"lon":3}]}]}"""
    df = records.structures(spark.createDataFrame([(1, body), (2, None)], "k int, body string"), "k")
    assert [(r.kind, r.id, r.name) for r in df.orderBy("id").collect()] == [("bridge", 1, "Old"), ("tunnel", 3, "Primary")]


def test_polyline(spark):
    assert records.decode_line("_p~iF~ps|U_ulLnnqC_mqNvxq`@", 5) == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    df = records.decoded(spark.createDataFrame([("_p~iF~ps|U",), (None,)], "line string"), "line")
    assert [len(r.coordinates) for r in df.collect()] == [1, 0]


def test_grid_and_catalogue(spark):
    text = "ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4\n"
    g = records.ascii_grid(spark.createDataFrame([("t", text)], "k string, value string"), "k").orderBy("row", "col").collect()
    assert [(r.row, r.col, r.z) for r in g] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 4.0)] and g[0].west == 10.0
    rows = spark.createDataFrame(
        [("a b", None, None, "../x.tif", None, [1.0, 2.0, 3.0, 4.0], 0), (None, None, "n", "d/y.tif", None, [1.0, 2.0, 3.0, 4.0], 1), ("z", None, None, None, None, [1.0], 2)],
        "id string, tile_id string, name string, path string, url string, bbox array<double>, ord int",
    )
    assert [(r.tile_id, r.path) for r in records.catalogue(rows).orderBy("ord").collect()] == [("a_b", "a_b.tif"), ("n", "d/y.tif")]


def test_state_and_history(spark, tmp_path):
    s = spark.createDataFrame([(1, "pending", 1), (2, "done", 2)], "id int, status string, seq int")
    s = queue.upsert(s, spark.createDataFrame([(3, "parked", 3)], "id int, status string, seq int"))
    assert {r.id: r.status for r in queue.advanced(s, [1, 2], "ready").collect()} == {1: "ready", 2: "done", 3: "parked"}
    assert queue.has_pending(s) and queue.first_pending(s).first().id == 1 and queue.removed(s, [1]).count() == 2
    h = queue.History(spark, str(tmp_path), 2)
    for n in range(3):
        h.push(spark.range(n + 1))
    assert h.current().count() == 3 and h.undo() and h.current().count() == 2 and not h.undo() and h.redo() and not h.redo()


def test_builder(spark):
    w = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 0.0, 2.0)], "route_id long, ord long, lat double, lon double")
    more = queue.with_waypoint(w, 1, 5.0, 5.0)
    assert [r.lon for r in more.orderBy("ord").collect()] == [0.0, 5.0, 1.0, 2.0]
    assert queue.legs_to_route(queue.legs(w), queue.legs(more)).count() == 2
    assert queue.without_waypoint(more, 1).orderBy("ord").select("lon").collect() == w.orderBy("ord").select("lon").collect()
    assert queue.legs(w.where(F.lit(False))).count() == 0


def test_read_files_go_through_every_kernel(spark, tmp_path):
    """Files have text for track ids; kernels keep it, and the other columns of the points they keep."""
    from trackloom.operators import kernels, polish, shape, tracks

    points = "".join(f'<trkpt lat="{46 + i * 1e-4:.6f}" lon="{14.5 + (i % 7) * 2e-5:.6f}"><ele>{300 + (i % 9 == 4) * 6}</ele></trkpt>' for i in range(60))
    for name in ("a", "b"):
        (tmp_path / f"{name}.gpx").write_text(f"{gpx.HEAD}<trk><name>{name}</name><trkseg>{points}</trkseg></trk></gpx>")
    read = tracks.with_gradient(tracks.with_distance(gpx.read_gpx(spark, f"file://{tmp_path}/*.gpx")))
    for f in (kernels.simplified, kernels.dip_smoothed, kernels.vegetation_filtered, kernels.box_groups, kernels.reduced):
        rows = f(read).collect()
        assert {r.track_id for r in rows} == {"a.gpx", "b.gpx"} and all(r.name == r.track_id[0] for r in rows), f
        at = {(r.track_id, r.lat, r.lon): r.gr for r in read.collect()}
        assert all(at[r.track_id, r.lat, r.lon] == r.gr for r in rows), f
    for f in (kernels.filleted, polish.polished, lambda p: kernels.splits(tracks.timing(p), 20.0), lambda p: kernels.snap_waypoints(tracks.curvature(p)), lambda p: shape.on_tracks(p, shape.shaped)):
        assert {r.track_id for r in f(read).collect()} == {"a.gpx", "b.gpx"}
