"""Other inputs: structures, encoded lines, raster grids, tile catalogues, and tables out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trackloom.functions import formats

OSM = "elements ARRAY<STRUCT<type: STRING, id: LONG, tags: MAP<STRING, STRING>, geometry: ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>>>"


def structures(responses: DataFrame, key: str, text_col: str = "body") -> DataFrame:
    """key, kind, id, name, geometry of the ways in map-server responses. Each count element opens a section,
    of bridges and of tunnels in turn; ways before the first have no kind and go. Nodes off the map are left out, ways of under two nodes too."""
    e = responses.select(key, F.posexplode(F.from_json(text_col, OSM)["elements"]).alias("pos", "e"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("section", F.sum((F.col("e.type") == "count").cast("int")).over(w)).where((F.col("e.type") == "way") & (F.col("section") > 0))
    kind = F.when(F.col("section") % 2 == 1, "bridge").otherwise("tunnel")
    nodes = F.filter("e.geometry", lambda n: n["lat"].between(-80, 80) & n["lon"].between(-180, 180))
    tags = F.coalesce("e.tags", F.create_map().cast("map<string,string>"))
    return e.select(key, kind.alias("kind"), F.col("e.id").alias("id"), formats.structure_name(tags).alias("name"), nodes.alias("geometry")).where(F.size("geometry") >= 2)


def unique_structures(found: DataFrame, order: str = "id") -> DataFrame:
    """The first of those that share id and kind."""
    w = Window.partitionBy("id", "kind").orderBy(order)
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def tile_box(south: Column, west: Column, north: Column, east: Column, parts: int = 2) -> Column:
    """The box cut into parts x parts boxes: array of (south, west, north, east)."""
    cut = lambda a, b, i: F.when(i == parts, b).otherwise(a + (b - a) * i / parts)
    cells = [(F.lit(i), F.lit(j)) for i in range(parts) for j in range(parts)]
    return F.array(*[F.struct(cut(south, north, i).alias("south"), cut(west, east, j).alias("west"), cut(south, north, i + 1).alias("north"), cut(west, east, j + 1).alias("east")) for i, j in cells])


def decode_line(text: str | None, precision: int = 6) -> list[tuple[float, float]]:
    """Coordinates of an encoded polyline: zig-zag differences in groups of five bits, each char less 63."""
    out, value, shift, last, odd = [], 0, 0, [0, 0], 0
    for c in text or "":
        bits = ord(c) - 63
        value |= (bits & 31) << shift
        shift += 5
        if bits < 32:
            last[odd] += ~(value >> 1) if value & 1 else value >> 1
            if odd:
                out.append((last[0] / 10**precision, last[1] / 10**precision))
            odd, value, shift = 1 - odd, 0, 0
    return out


def decoded(lines: DataFrame, text_col: str) -> DataFrame:
    """lines with coordinates, an array of (lat, lon), decoded in Arrow batches."""
    point = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
    schema = T.StructType([*lines.schema.fields, T.StructField("coordinates", T.ArrayType(point))])
    at = lines.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
        for b in batches:
            made = [[{"lat": p, "lon": q} for p, q in decode_line(t.as_py())] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], names=[*lines_names, "coordinates"])

    lines_names = list(lines.columns)
    return lines.mapInArrow(run, schema)


def encode_line(places: list[tuple[float, float]], precision: int = 6) -> str:
    out, last = [], [0, 0]
    for place in places:
        for k, v in enumerate(place):
            whole = int(np.floor(v * 10**precision + 0.5))
            d, last[k] = whole - last[k], whole
            d = ~(d << 1) if d < 0 else d << 1
            while d >= 32:
                out.append(chr((32 | d & 31) + 63))
                d >>= 5
            out.append(chr(d + 63))
    return "".join(out)


def encoded(points: DataFrame) -> DataFrame:
    """track_id, line: each track as an encoded polyline."""
    listed = points.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))).alias("p"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lines = [encode_line([(x["lat"], x["lon"]) for x in p.as_py()]) for p in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.string())], names=["track_id", "line"])

    return listed.mapInArrow(run, T.StructType([points.schema["track_id"], T.StructField("line", T.StringType())]))


def route_batches(waypoints: DataFrame, size: int = 20) -> DataFrame:
    """route_id, batch, legs of waypoints (route_id, ord, lat, lon): groups of `size` that share their end point."""
    listed = waypoints.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ord", "lat", "lon"))).alias("w")).where(F.size("w") >= 2)
    starts = F.sequence(F.lit(1), F.size("w") - 1, F.lit(size - 1))
    return listed.select("route_id", "w", F.posexplode(starts).alias("batch", "s")).select("route_id", "batch", F.slice("w", F.col("s"), F.lit(size)).alias("points"))


def merged_legs(legs: DataFrame) -> DataFrame:
    """route_id, idx, lat, lon: legs (route_id, leg, coordinates) one after another, each later one without its first
    point."""
    p = legs.select("route_id", "leg", F.posexplode("coordinates").alias("pos", "c")).where((F.col("leg") == 0) | (F.col("pos") > 0))
    idx = F.row_number().over(Window.partitionBy("route_id").orderBy("leg", "pos")) - 1
    return p.select("route_id", idx.cast("long").alias("idx"), "c.lat", "c.lon")


def ascii_grid(files: DataFrame, key: str, text_col: str = "value") -> DataFrame:
    """key, row, col, z, west, south, size of Arc/Info ASCII grids; no-data cells are null. Text before the header (a
    multipart envelope) is skipped."""
    body = F.regexp_extract(text_col, r"(?is)(ncols\s.*)", 1)
    number = lambda name: F.regexp_extract(body, rf"(?i){name}\s+(\S+)", 1).try_cast("double")
    cells = F.split(F.trim(F.regexp_replace(body, r"(?i)^(\s*[a-z_]+\s+\S+\s*\n)+", "")), r"\s+")
    head = files.select(key, number("ncols").cast("int").alias("ncols"), number("xll(?:corner|center)").alias("west"), number("yll(?:corner|center)").alias("south"), number("cellsize").alias("size"), number("nodata_value").alias("nodata"), cells.alias("cells"))
    z = head.select(key, "ncols", "west", "south", "size", "nodata", F.posexplode("cells").alias("pos", "text")).where("text <> ''")
    value = F.col("text").try_cast("double")
    return z.select(key, F.floor(F.col("pos") / F.col("ncols")).alias("row"), (F.col("pos") % F.col("ncols")).alias("col"), F.when(~value.eqNullSafe(F.col("nodata")), value).alias("z"), "west", "south", "size")


def catalogue(rows: DataFrame) -> DataFrame:
    """tile_id, path, west, south, east, north, ord of tile records (id, tile_id, name, path, url, bbox, ord); records
    without a box of four are left out, and paths that climb out of their folder are made safe."""
    ident = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("id", "tile_id", "name", "path", "url")])
    kept = rows.where((F.size("bbox") == 4) & ident.isNotNull())
    side = [F.element_at("bbox", i + 1).alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    return kept.select(formats.safe_name(ident).alias("tile_id"), formats.safe_path(F.col("path"), F.concat(formats.safe_name(ident), F.lit(".tif"))).alias("path"), *side, "ord")


def write_table(df: DataFrame, path: str, separator: str = ",", extra: dict | None = None) -> None:
    """Delimited text with a header, null as empty, and extra columns of one value."""
    for name, value in (extra or {}).items():
        df = df.withColumn(name, F.lit(value))
    df.write.option("header", True).option("sep", separator).option("nullValue", "").option("emptyValue", "").csv(path)


def split_points(points: DataFrame, splits: DataFrame) -> DataFrame:
    """Points of each split (track_id, split, start_idx, end_idx), both ends included, numbered anew. A split names its
    points, and the join is on them."""
    named = splits.where("start_idx <= end_idx").select("track_id", "split", "start_idx", F.explode(F.sequence(F.col("start_idx").cast("long"), F.col("end_idx").cast("long"))).alias("__i"))
    met = named.join(points.withColumnRenamed("idx", "__i"), ["track_id", "__i"])
    return met.select("track_id", "split", (F.col("__i") - F.col("start_idx")).alias("idx"), "lat", "lon", "ele")
