"""Archives in and out, and tile indexes from the headers of rasters and shapefiles, on files that the tests write."""

import io
import math
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from trackloom.functions import crs
from trackloom.sources import archives, headers


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    archives.register(spark)
    headers.register(spark)


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def tiff(width, height, x, y, size, epsg, order="<", big=False, point=False, matrix=False, tail=0):
    """A TIFF of one directory without an image: size, place and coordinate system."""
    keys = [1, 1, 0, 2, 3072 if epsg != 4326 else 2048, 0, 1, epsg, 1025, 0, 1, 2 if point else 1]
    fields = [(256, 3, [width]), (257, 4, [height]), (305, 2, b"made by a test\0")]
    if matrix:
        fields.append((34264, 12, [size, 0.0, 0.0, x, 0.0, -size, 0.0, y, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    else:
        fields += [(33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x, y, 0.0])]
    fields.append((34735, 3, keys))
    codes = {2: "s", 3: "H", 4: "I", 12: "d"}
    start, each = (16, 20) if big else (8, 12)
    at, body, extra = start + (8 if big else 2) + each * len(fields) + (8 if big else 4), b"", b""
    for tag, kind, value in fields:
        data = value if kind == 2 else struct.pack(f"{order}{len(value)}{codes[kind]}", *value)
        room = 8 if big else 4
        held = data.ljust(room, b"\0") if len(data) <= room else struct.pack(order + ("Q" if big else "I"), at + len(extra))
        extra += b"" if len(data) <= room else data
        body += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(value)) + held
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    return head + struct.pack(order + ("Q" if big else "H"), len(fields)) + body + b"\0" * (8 if big else 4) + extra + b"\0" * tail


def shapefile(boxes, kind=5):
    body = b""
    for k, box in enumerate(boxes):
        shape = struct.pack("<i", 0) if box is None else struct.pack("<i2d", 1, *box[:2]) if kind == 1 else struct.pack("<i4d", kind, *box) + b"\0" * 60
        body += struct.pack(">2i", k + 1, len(shape) // 2) + shape
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i", 1000, kind) + b"\0" * 64 + body


def table(names, rows, width=20):
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 32 + 32 * len(names) + 1, 1 + width * len(names))
    head += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15 for n in names) + b"\r"
    return head + b"".join(b" " + b"".join(v.encode().ljust(width) for v in r) for r in rows)


def test_degrees_and_back(spark):
    p = spark.createDataFrame([(52.5, 13.2), (46.05, 14.5), (47.1, 9.6), (60.2, 25.0), (52.0, 10.0)], "y double, x double")
    for code in [*crs.ZONES, 3035]:
        e, n = crs.equal_area(F.col("y"), F.col("x")) if code == 3035 else crs.transverse_mercator(F.col("y"), F.col("x"), code)
        for r in crs.in_degrees(p.select("y", "x", e.alias("e"), n.alias("n"), F.lit(code).alias("epsg")), "e", "n", "epsg").collect():
            far = code != 3035 and abs(r.x - crs.ZONES[code][0]) > 6  # the series are those of a zone
            assert max(abs(r.lat - r.y), abs(r.lon - r.x)) < (1e-5 if far else 1e-8), code
    assert crs.in_degrees(p.withColumn("epsg", F.lit(7)), "x", "y", "epsg").first().lat is None
    assert crs.in_degrees(p.withColumn("epsg", F.lit(4326)), "x", "y", "epsg").first().lat == 52.5


def test_raster_index(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    files = {
        "a b.tif": tiff(100, 50, 500_000.0, 5_300_000.0, 10.0, 25832), "deep/a b.tif": tiff(10, 10, 10.0, 50.0, 0.1, 4326, order=">"), "a b.TIF": tiff(10, 10, 10.0, 50.0, 0.1, 4326, big=True),
        "c.tiff": tiff(20, 20, 4_500_000.0, 2_800_000.0, 50.0, 3035, matrix=True, tail=3_000_000), "p.tif": tiff(10, 10, 10.05, 49.95, 0.1, 4326, point=True),
        "bad.tif": b"II*\0", "text.tif": b"no raster at all", "empty.tif": b"", "other.png": b"x", "unknown.tif": tiff(1, 1, 0.0, 0.0, 1.0, 9999), "cut.tif": tiff(9, 9, 0.0, 0.0, 1.0, 4326)[:60],
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = spark.read.format("tiff_headers").load(str(tmp_path)).cache()
    assert found.count() == 10 and {r["name"] for r in found.where("error is not null").collect()} == {"bad.tif", "text.tif", "empty.tif", "cut.tif"}
    index = {r["tile_id"]: r for r in headers.raster_index(found, url="https://x/{id}?f={name}&s={stem}").collect()}
    assert set(index) == {"a_b", "a_b_1", "a_b_2", "c", "p"}
    # The three files of one name: .tif by path, then .TIF.
    assert index["a_b"]["path"].endswith("/a b.tif") and index["a_b_1"]["path"].endswith("/deep/a b.tif") and index["a_b_2"]["path"].endswith("/a b.TIF")
    assert index["a_b_1"]["url"] == "https://x/a_b_1?f=a b.tif&s=a b"
    for name in ("a_b_1", "a_b_2", "p"):
        r = index[name]
        assert [round(r[c], 9) for c in ("west", "south", "east", "north")] == [10.0, 49.0, 11.0, 50.0]
    r = index["a_b"]
    k = 0.9996 * 111_320
    assert abs(r["west"] - 9) < 1e-9 and abs((r["east"] - 9) * k * math.cos(math.radians(r["north"])) - 1000) < 3 and abs((r["north"] - r["south"]) * k - 500) < 3
    names = {r["tile_id"] for r in headers.raster_index(found, id_from="name").collect()}
    assert names == {"a_b.tif", "a_b.tif_1", "a_b.TIF", "c.tiff", "p.tif"}
    flat = spark.read.format("tiff_headers").option("recursive", "false").load(str(tmp_path))
    assert flat.count() == 9
    assert spark.read.format("tiff_headers").load(str(tmp_path / "deep" / "a b.tif")).count() == 1


def test_coverage_index(spark, tmp_path):
    boxes = [(10.0, 50.0, 11.0, 51.0), None, (11.0, 50.0, 12.0, 51.0), (12.0, 50.0, 13.0, 51.0), (13.0, 50.0, 14.0, 51.0)]
    rows = [("k 1", "http://one"), ("none", ""), ("k 1", ""), ("", "http://x"), ("Blatt-77", "")]
    prj = 'GEOGCS["WGS 84",DATUM["D",SPHEROID["S",6378137,298.25]],AUTHORITY["EPSG","4326"]]'
    (tmp_path / "cover.zip").write_bytes(zipped([("in/er.shp", shapefile(boxes)), ("in/er.dbf", table(["Kachel", "LINK"], rows)), ("in/er.prj", prj), ("in/points.shp", shapefile([(9.0, 48.0)], kind=1))]))
    (tmp_path / "plain.shp").write_bytes(shapefile([(4_321_000.0, 3_210_000.0, 4_322_000.0, 3_211_000.0)]))
    (tmp_path / "plain.DBF").write_bytes(table(["my_sheet_no"], [("P1",)]))
    (tmp_path / "plain.prj").write_text('PROJCS["ETRS_1989_LAEA",GEOGCS["x"]]')
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04nothing")
    read = spark.read.format("shape_records")
    found = read.load(str(tmp_path)).cache()
    assert {r["path"].rsplit("/", 1)[-1] for r in found.where("error is not null").collect()} == {"broken.zip"}
    assert found.where("shp = 'points.shp'").select("xmin", "ymax").first()[:] == (9.0, 48.0)
    files = spark.createDataFrame([("t/x_k-1.tif", "x_k-1.tif"), ("t/77.tif", "77.tif"), ("t/a77.tif", "a77.tif"), ("t/K1.tif", "K1.tif")], "path string, name string")
    index = {r["tile_id"]: r for r in headers.coverage_index(found, files, path="far/{id}.tif", url="u/{id}").collect()}
    assert set(index) == {"k_1", "k_1_1", "Blatt-77", "P1"}
    assert (index["k_1"]["path"], index["k_1"]["url"]) == ("t/K1.tif", "http://one")
    assert (index["k_1_1"]["path"], index["k_1_1"]["url"], index["k_1_1"]["west"]) == ("t/K1.tif", "u/k_1_1", 11.0)
    assert index["Blatt-77"]["path"] == "t/77.tif" and index["P1"]["path"] == "far/P1.tif"
    assert abs(index["P1"]["west"] - 10) < 1e-9 and abs(index["P1"]["south"] - 52) < 1e-6
    assert read.option("shp", "POINTS").load(str(tmp_path / "cover.zip")).count() == 1


def test_codes_of_well_known_text(spark):
    texts = [('PROJCS["ETRS89 / UTM zone 33N",GEOGCS["a",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","25833"]]', 25833), ('PROJCS["ETRS_1989_UTM_Zone_32N",GEOGCS["x"]]', 25832), ("", 4326), (None, 4326), ('GEOGCS["GCS_WGS_1984"]', 4326), ('PROJCS["mine"]', None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    assert [r["c"] for r in df.select("i", headers.wkt_code(F.col("t")).alias("c")).orderBy("i").collect()] == [c for _, c in texts]


def test_archives_in(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.zip").write_bytes(zipped([("a.gpx", "1"), ("d/A.GPX", "2"), ("d/", ""), ("b.txt", "3")]))
    (tmp_path / "sub" / "Two.ZIP").write_bytes(zipped([("a.gpx", b"\x00\xff")]))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 and no more")
    rows = spark.read.format("zip_members").option("suffixes", ".gpx").load(str(tmp_path)).collect()
    got = sorted((r["archive"].rsplit("/", 1)[-1], r["path"], r["name"], bytes(r["content"])) for r in rows if r["error"] is None)
    assert got == [("Two.ZIP", "a.gpx", "a.gpx", b"\x00\xff"), ("one.zip", "a.gpx", "a.gpx", b"1"), ("one.zip", "d/A.GPX", "A.GPX", b"2")]
    assert [r["archive"].rsplit("/", 1)[-1] for r in rows if r["error"]] == ["bad.zip"]
    assert spark.read.format("zip_members").load(str(tmp_path)).where("error is null").count() == 4
    assert spark.read.format("zip_members").option("recursive", "false").load(str(tmp_path)).where("error is null").count() == 3
    (tmp_path / "none").mkdir()
    assert spark.read.format("zip_members").load(str(tmp_path / "none")).count() == 0


def test_archives_out_and_in(spark, tmp_path):
    out = str(tmp_path / "bundles")
    rows = spark.range(1000).select(F.format_string("r%03d.gpx", F.col("id") % 700).alias("name"), F.concat(F.lit("text "), "id").alias("content"), F.col("id").alias("ord"))
    archives.bundled(rows, 90).write.format("zip_archives").mode("append").save(out)
    back = spark.read.format("zip_members").load(out).cache()
    got = {r["path"]: bytes(r["content"]).decode() for r in back.collect()}
    assert got == {f"r{i % 700:03d}.gpx": f"text {i}" for i in range(1000)}
    sizes = {r["archive"]: r["count"] for r in back.groupBy("archive").count().collect()}
    assert max(sizes.values()) <= 90 and sum(sizes.values()) == 700 and all("/_" not in a for a in sizes)
    rows.limit(0).write.format("noop").mode("append").save()
    archives.bundled(rows.where("ord < 5"), 90).write.format("zip_archives").mode("overwrite").save(out)
    assert spark.read.format("zip_members").load(out).count() == 5


def test_rows_of_one_archive_in_several_tasks_are_refused(spark, tmp_path):
    out = str(tmp_path / "torn")
    rows = spark.range(8).repartition(4).select(F.lit("one").alias("archive"), F.col("id").cast("string").alias("name"), F.lit("x").alias("content"))
    with pytest.raises(Exception, match="several tasks"):
        rows.write.format("zip_archives").mode("append").save(out)
    assert spark.read.format("zip_members").load(out).count() == 0


def test_unwrapped(spark):
    data = [(1, b"II*plain"), (2, zipped([("deep/tile.tif", b"long"), ("t.TIF", b"short"), ("x", b"no")])), (3, zipped([("readme", b"x")])), (4, b"PK\x03\x04broken"), (5, None), (6, b"")]
    df = spark.createDataFrame(data, "id long, content binary").withColumn("more", F.lit("kept"))
    got = {r["id"]: r["content"] and bytes(r["content"]) for r in archives.unwrapped(df).collect()}
    assert got == {1: b"II*plain", 2: b"short", 3: None, 4: None, 5: None, 6: b""}


def test_uploads(spark, tmp_path):
    from trackloom.sources import gpx

    doc = lambda n: f"{gpx.HEAD}<trk><name>t</name><trkseg>" + "".join(f'<trkpt lat="46.{i}" lon="14"><ele>{n}</ele></trkpt>' for i in range(n)) + "</trkseg></trk></gpx>"
    for k, folder in enumerate(("", "a", "b c")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "ride.gpx").write_text(doc(2 + k))
    (tmp_path / "UP.GPX").write_text(doc(7))
    (tmp_path / "broken.gpx").write_text("<gpx><trk>")
    (tmp_path / "empty.gpx").write_text(gpx.HEAD + "</gpx>")
    (tmp_path / "more.zip").write_bytes(zipped([("x/ride.gpx", doc(9)), ("ride.gpx", "no"), ("photo.jpg", "x")]))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04")
    (tmp_path / "notes.txt").write_text("x")
    files = gpx.opened(gpx.uploads(spark, str(tmp_path)))
    got = {r["track_id"].replace(str(tmp_path) + "/", ""): (r["name"], (r["error"] or "")[:12]) for r in files.drop("trk", "gpx").collect()}
    assert got == {
        "ride.gpx": ("ride.gpx", ""), "a/ride.gpx": ("ride.gpx", ""), "b%20c/ride.gpx": ("ride.gpx", ""), "UP.GPX": ("UP.GPX", ""), "broken.gpx": ("broken.gpx", "not well-for"),
        "empty.gpx": ("empty.gpx", "no track poi"), "more.zip!x/ride.gpx": ("ride.gpx", ""), "more.zip!ride.gpx": ("ride.gpx", "not well-for"), "bad.zip": (None, got["bad.zip"][1]),
    }
    assert got["bad.zip"][1] and gpx.is_queue(gpx.uploads(spark, str(tmp_path))) and not gpx.is_queue(gpx.uploads(spark, str(tmp_path / "a")))
    n = {r["track_id"]: r["count"] for r in gpx.track_points(files.where("error is null"), "track_id").groupBy("track_id").count().collect()}
    assert sorted(n.values()) == [2, 3, 4, 7, 9]
    own = {r["track_id"]: r["count"] for r in gpx.read_gpx(spark, str(tmp_path / "*" / "*.gpx")).groupBy("track_id").count().collect()}
    assert own == {"a/ride.gpx": 3, "b%20c/ride.gpx": 4}
