"""Tile indexes from the headers of files: georeferenced TIFF rasters and shapefiles of footprints.

    headers.register(spark)
    found = spark.read.format("tiff_headers").option("path", "hdfs:///tiles").load()
    index = headers.raster_index(found)

Only headers are read: of a raster its tags, of a shapefile the boxes of its records and their attributes. Files are
dealt to partitions; a file that can't be read gives a row with `error` and hinders no other.
"""

from __future__ import annotations

import contextlib
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.window import Window

from trackloom.functions import crs, formats

from .stores import base_name, dealt, listed, opened

HEADER = "path string, name string, width long, height long, epsg int, xmin double, ymin double, xmax double, ymax double, error string"
SHAPE = "path string, shp string, record int, xmin double, ymin double, xmax double, ymax double, attributes map<string,string>, prj string, error string"

#: Bytes and struct codes of the TIFF field types that carry numbers.
TIFF_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}

#: TIFF tags of size and place, and GeoTIFF keys of the coordinate system and the meaning of a pixel.
WIDTH, HEIGHT, SCALE, TIE, MATRIX, KEYS = 256, 257, 33550, 33922, 34264, 34735
GEOGRAPHIC, PROJECTED, PIXEL_TYPE, POINT = 2048, 3072, 1025, 2

#: Files of one partition.
FILES = 64


def tiff_tags(f) -> dict[int, tuple]:
    """Numbers of the first directory of a TIFF (classic or big, of either byte order)."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF")
    kind = struct.unpack(order + "H", head[2:4])[0]
    if kind not in (42, 43):
        raise ValueError("not a TIFF")
    big = kind == 43
    at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
    f.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    each = 20 if big else 12
    entries, out = f.read(each * n), {}
    if len(entries) < each * n:
        raise ValueError("cut short")
    for i in range(n):
        tag, code = struct.unpack(order + "HH", entries[each * i : each * i + 4])
        count = struct.unpack(order + ("Q" if big else "I"), entries[each * i + 4 : each * i + (12 if big else 8)])[0]
        value = entries[each * i + (12 if big else 8) : each * (i + 1)]
        if tag not in (WIDTH, HEIGHT, SCALE, TIE, MATRIX, KEYS) or code not in TIFF_TYPES:
            continue
        form = f"{order}{count}{TIFF_TYPES[code]}"
        size = struct.calcsize(form)
        if size > len(value):
            f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
            value = f.read(size)
        out[tag] = struct.unpack(form, value[:size])
    return out


def raster_box(tags: dict[int, tuple]) -> tuple[int, int, int | None, float, float, float, float]:
    """width, height, EPSG code and box of a raster in its own coordinates."""
    width, height = int(tags[WIDTH][0]), int(tags[HEIGHT][0])
    if MATRIX in tags:
        a, b, _, x0, c, d, _, y0 = tags[MATRIX][:8]
    elif SCALE in tags and TIE in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIE][:5]
        a, b, c, d, x0, y0 = sx, 0.0, 0.0, -sy, x - i * sx, y + j * sy
    else:
        raise ValueError("no place on earth")
    keys = tags.get(KEYS, ())
    code = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    if code.get(PIXEL_TYPE) == POINT:
        x0, y0 = x0 - (a + b) / 2, y0 - (c + d) / 2
    epsg = code.get(PROJECTED, code.get(GEOGRAPHIC))
    xs = [x0 + a * u + b * v for u in (0, width) for v in (0, height)]
    ys = [y0 + c * u + d * v for u in (0, width) for v in (0, height)]
    return width, height, epsg, min(xs), min(ys), max(xs), max(ys)


class TiffHeaders(DataSource):
    """Read: path (file or folder), recursive (true)."""

    @classmethod
    def name(cls) -> str:
        return "tiff_headers"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options)


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.recursive = options["path"], options.get("recursive", "true").lower() == "true"

    def partitions(self):
        return dealt(listed(self.uri, (".tif", ".tiff"), self.recursive), FILES)

    def read(self, partition) -> Iterator[tuple]:
        store, _ = opened(self.uri)
        for path in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    yield path, base_name(path), *raster_box(tiff_tags(f)), None
            except (ValueError, KeyError, struct.error, OSError) as e:
                yield path, base_name(path), None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def shape_boxes(f) -> Iterator[tuple[float, float, float, float] | None]:
    """Box of each record of a .shp file, in order; None for shapes without a place. Points are boxes of no size."""
    head = f.read(100)
    if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    while len(record := f.read(8)) == 8:
        size = 2 * struct.unpack(">2i", record)[1]
        body = f.read(min(size, 44))
        f.seek(max(0, size - 44), 1)
        kind = struct.unpack("<i", body[:4])[0] if len(body) >= 4 else 0
        if kind in (1, 11, 21):
            x, y = struct.unpack("<2d", body[4:20])
            yield x, y, x, y
        elif kind:
            yield struct.unpack("<4d", body[4:36])
        else:
            yield None


def attribute_rows(f) -> Iterator[dict[str, str]]:
    """Attributes of each record of a .dbf file, as trimmed text. Records marked as deleted keep their place, as shapes
    keep theirs."""
    head = f.read(32)
    n, start, size = struct.unpack("<IHH", head[4:12])
    fields, at = [], 1
    described = f.read(start - 32)
    for k in range(0, len(described) - 31, 32):
        if described[k] == 13:
            break
        name, width = described[k : k + 11].split(b"\0")[0].decode("latin-1"), described[k + 16]
        fields.append((name, at, at + width))
        at += width
    for _ in range(n):
        row = f.read(size)
        if len(row) < size:
            return
        yield {name: _decoded(row[a:b].strip(b" \0")) for name, a, b in fields}


def _decoded(v: bytes) -> str:
    try:
        return v.decode("utf-8")
    except UnicodeDecodeError:
        return v.decode("latin-1")


class ShapeRecords(DataSource):
    """Read: path (a .shp file, a .zip that holds some, or a folder of both), shp (name of the one to take, else all)."""

    @classmethod
    def name(cls) -> str:
        return "shape_records"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(self.options)


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.shp = options["path"], options.get("shp", "").lower()

    def partitions(self):
        return dealt(listed(self.uri, (".shp", ".zip")), 1)

    def read(self, partition) -> Iterator[tuple]:
        import zipfile

        store, _ = opened(self.uri)
        for path in partition.paths:
            try:
                if path.lower().endswith(".shp"):
                    yield from self.records(path, [path], lambda p: store.open_input_file(p), lambda p: store.get_file_info(p).is_file)
                else:
                    with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                        names = z.namelist()
                        yield from self.records(path, [n for n in names if n.lower().endswith(".shp")], z.open, lambda p, known=frozenset(names): p in known)
            except (ValueError, struct.error, OSError, zipfile.BadZipFile) as e:
                yield path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def records(self, path: str, shapes: list[str], open_, is_there) -> Iterator[tuple]:
        for shp in shapes:
            name = base_name(shp).lower()
            if self.shp and self.shp not in (name, name[:-4]):
                continue
            beside = lambda ext, shp=shp: next((p for p in (shp[:-4] + ext, shp[:-4] + ext.upper()) if is_there(p)), None)
            prj = None
            if at := beside(".prj"):
                with open_(at) as f:
                    prj = f.read().decode("utf-8", "ignore")
            with contextlib.ExitStack() as held:
                at = beside(".dbf")
                rows = attribute_rows(held.enter_context(open_(at))) if at else iter(())
                for k, box in enumerate(shape_boxes(held.enter_context(open_(shp)))):
                    attributes = next(rows, {})
                    if box is not None:
                        yield path, base_name(shp), k, *box, attributes, prj, None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiffHeaders)
    spark.dataSource.register(ShapeRecords)


def wkt_code(wkt: Column) -> Column:
    """EPSG code of a coordinate system in well-known text: the code that it names last, else by its name; 4326 where
    there is no text, null where the system is not known."""
    named = F.regexp_extract(wkt, r'(?is)^.*AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]', 1).try_cast("int")
    zone = F.regexp_extract(wkt, r"(?i)(?:ETRS|GRS).*?UTM_?\s*zone_?\s*(\d+)N", 1).try_cast("int")
    flat = F.upper(F.regexp_replace(wkt, r"[^A-Za-z0-9]", ""))
    by_name = F.when(zone.isNotNull(), 25800 + zone).when(flat.contains("LAEA") | flat.contains("LAMBERTAZIMUTHALEQUALAREA"), 3035).when(flat.startswith("GEOGCS"), 4326)
    return F.when(F.coalesce(wkt, F.lit("")) == "", 4326).otherwise(F.coalesce(named, by_name))


def degree_boxes(df: DataFrame, keys: list[str], steps: int = 16) -> DataFrame:
    """df (keys, epsg, xmin, ymin, xmax, ymax) with west, south, east, north: the box of its outline in degrees, `steps`
    places to a side. Coordinate systems that are not known give no row."""
    t = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / float(steps))
    at = lambda a, b, f: F.col(a) + (F.col(b) - F.col(a)) * f
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    flat = lambda y: F.transform(t, lambda f: place(at("xmin", "xmax", f), F.col(y)))
    upright = lambda x: F.transform(t, lambda f: place(F.col(x), at("ymin", "ymax", f)))
    sides = [flat("ymin"), flat("ymax"), upright("xmin"), upright("xmax")]
    outline = df.select(*keys, "epsg", F.explode(F.concat(*sides)).alias("p")).select(*keys, "epsg", F.col("p.x").alias("easting"), F.col("p.y").alias("northing"))
    turned = crs.in_degrees(outline, "easting", "northing", "epsg").where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    box = turned.groupBy(*keys).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    return df.join(box, keys)


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """tile_id from `base`: a name that comes again gets _1, _2, ... in order."""
    n = F.row_number().over(Window.partitionBy("base").orderBy(*order)) - 1
    return df.withColumn("__n", n).withColumn("tile_id", F.when(F.col("__n") > 0, F.concat("base", F.lit("_"), "__n")).otherwise(F.col("base"))).drop("__n", "base")


def raster_index(found: DataFrame, id_from: str = "stem", url: str = "") -> DataFrame:
    """tile_id, path, url, west, south, east, north of raster headers. Ids are the names of files (with or without their
    ending) in safe characters. `url` may hold {id}, {name} and {stem}. Files in error, or in a coordinate system that is
    not known or not given, go."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    good = degree_boxes(found.where("error is null and epsg is not null"), ["path"])
    good = good.withColumn("stem", stem).withColumn("base", formats.safe_name(F.col("stem") if id_from == "stem" else F.col("name")))
    rank = F.when(F.col("name").endswith(".tif"), 0).when(F.col("name").endswith(".tiff"), 1).otherwise(2)
    out = _numbered(good, [rank, F.col("path")])
    made = F.lit(url)
    for part, c in (("{id}", "tile_id"), ("{name}", "name"), ("{stem}", "stem")):
        made = F.replace(made, F.lit(part), F.col(c))
    return out.select("tile_id", "path", made.alias("url"), "west", "south", "east", "north")


#: Attributes that may name a tile or its address, the first there is.
ID_FIELDS = ("id", "tile_id", "name", "kachel", "kachelname", "kachel_nr", "sheet", "blatt", "secuencial")
URL_FIELDS = ("url", "download", "link", "href")


def norm(v: Column) -> Column:
    """Letters and digits in lower case, by which names of tiles and files are compared."""
    return F.regexp_replace(F.lower(v), "[^a-z0-9]+", "")


def chosen(attributes: Column, fields: tuple[str, ...]) -> Column:
    """The attribute of the first of `fields` there is, whatever the case of its name; if there is none, the first whose
    name holds one of them."""
    lower = F.transform_keys(attributes, lambda k, v: F.lower(k))
    hold = F.map_values(F.map_filter(lower, lambda k, v: F.exists(F.array(*map(F.lit, fields)), lambda f: F.contains(k, f))))
    return F.coalesce(*[F.try_element_at(lower, F.lit(f)) for f in fields], F.get(hold, F.lit(0)))


def coverage_index(records: DataFrame, files: DataFrame | None = None, id_fields=ID_FIELDS, url_fields=URL_FIELDS, path: str = "{id}.tif", url: str = "", epsg: int | None = None) -> DataFrame:
    """tile_id, path, url, west, south, east, north of the records of shapefiles. Records without an id go. The path is
    that of the file (path, name of `files`) with the same name in letters and digits, else of the first by path whose
    name holds the id or is held by it, else the template `path`; the url the record's own, else the template `url`."""
    good = records.where("error is null").withColumn("epsg", F.lit(epsg) if epsg else wkt_code(F.col("prj")))
    good = degree_boxes(good.withColumnRenamed("path", "source"), ["source", "shp", "record"], steps=1)
    good = good.withColumn("raw", chosen(F.col("attributes"), tuple(id_fields))).withColumn("base", formats.safe_name(F.col("raw"))).where("base <> ''")
    out = _numbered(good, [F.col("source"), F.col("shp"), F.col("record")]).withColumn("own_url", F.trim(chosen(F.col("attributes"), tuple(url_fields))))
    if files is None:
        out = out.withColumn("file", F.lit(None).cast("string"))
    else:
        out = out.join(matched(out.select(norm(F.col("raw")).alias("key")).distinct(), files), norm(F.col("raw")) == F.col("key"), "left")
    fill = lambda t: F.replace(F.lit(t), F.lit("{id}"), F.col("tile_id"))
    return out.select("tile_id", F.coalesce("file", fill(path)).alias("path"), F.coalesce(F.nullif("own_url", F.lit("")), fill(url)).alias("url"), "west", "south", "east", "north")


def matched(keys: DataFrame, files: DataFrame) -> DataFrame:
    """key, file: the file (path, name) of each key by its name without ending, in letters and digits. What has no equal
    is looked for by parts of names: a name holds or is held by another if it equals one of its parts, so the join is
    on equal text."""
    named = files.select("path", norm(F.regexp_replace("name", r"\.[^.]*$", "")).alias("stem")).where("stem <> ''")
    first = named.groupBy("stem").agg(F.min("path").alias("path"))
    exact = keys.join(first, keys["key"] == first["stem"]).select("key", F.col("path").alias("file"))
    left = keys.where("key <> ''").join(exact, "key", "left_anti")
    part = lambda v: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.transform(F.sequence(F.lit(1), F.length(v) - i + 1), lambda n: F.substring(v, i, n)))))
    held = first.select("path", F.explode(part(F.col("stem"))).alias("key")).join(left, "key")
    holds = left.select("key", F.explode(part(F.col("key"))).alias("stem")).join(first, "stem")
    loose = held.select("key", "path").unionByName(holds.select("key", "path")).groupBy("key").agg(F.min("path").alias("file"))
    return exact.unionByName(loose)
