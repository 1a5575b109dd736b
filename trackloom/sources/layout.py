"""Tables laid out by place: tiles, ways and raster cells in folders of a coarse grid, so that a batch of points reads
only the folders it lies in.

A row is put into every cell of the grid that its box touches. The cells that a batch needs are few and counted; they
are broadcast, and Spark prunes the folders of the table by them when the query runs (dynamic partition pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trackloom import scratch
from trackloom.functions import formats
from trackloom.operators import catalogues

#: Cells of a batch that are broadcast at most (8 bytes each); a batch that needs more reads the whole table.
MOST_CELLS = 200_000

#: Ways of a cell that meet its tracks in one task.
PIECE = 10_000

BOX = ("south", "west", "north", "east")

ENTRY = "id: string, tile_id: string, name: string, path: string, url: string, bbox: array<double>, secuencial: string, sec: string, cod_serie: string, codSerie: string"


def cell_key(y: Column, x: Column) -> Column:
    """One number for a cell, as pruning by two columns would read all rows and columns of the grid that the batch
    touches, and not the cells alone."""
    return y * (1 << 22) + x


def by_cell(df: DataFrame, size: float, box: tuple[str, str, str, str] = BOX) -> DataFrame:
    """df with cell, a row for each cell of `size` degrees that its box (south, west, north, east) touches."""
    south, west, north, east = (F.floor(F.col(c) / size) for c in box)
    rows = df.withColumn("__y", F.explode(F.sequence(south, north))).withColumn("__x", F.explode(F.sequence(west, east)))
    return rows.withColumn("cell", cell_key(F.col("__y"), F.col("__x"))).drop("__y", "__x")


def points_by_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("cell", cell_key(F.floor(F.col("lat") / size), F.floor(F.col("lon") / size)))


def write_by_cell(df: DataFrame, path: str, *order: str) -> None:
    """Write rows with cell as Parquet in folders by cell. Small cells share a task and large ones are split over
    several (rebalance); rows are sorted by `order`, so that the footers of a folder's files prune too."""
    even = df.hint("rebalance", F.col("cell"))
    even.sortWithinPartitions("cell", *order).write.partitionBy("cell").parquet(path)


def read_by_cell(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def needed_cells(points: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """cell: the cells within `margin` degrees of any point."""
    box = points.select((F.col("lat") - margin).alias("s"), (F.col("lon") - margin).alias("w"), (F.col("lat") + margin).alias("n"), (F.col("lon") + margin).alias("e"))
    return by_cell(box, size, ("s", "w", "n", "e")).select("cell").distinct()


def pruned(table: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of a table laid out by cell that lie in `cells`. Up to MOST_CELLS cells are broadcast, and only their
    folders are read."""
    few = scratch.stored(cells.select("cell"), "needed-cells")
    if few.count() > MOST_CELLS:
        return table.join(few, "cell", "left_semi")
    # The range holds for all cells on earth; a condition makes Spark take the cells as worth pruning by.
    return table.join(F.broadcast(few.where(F.col("cell") > -(1 << 60))), "cell", "left_semi")


def first_tile(points: DataFrame, table: DataFrame, size: float) -> DataFrame:
    """points with tile_id of the first tile (by ord) of a laid-out table (tile_id, ord, south, west, north, east,
    cell) whose box holds them, edges included; null if none does."""
    tiles = pruned(table, needed_cells(points, size))
    here = points_by_cell(points.select("track_id", "idx", "lat", "lon"), size)
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    best = here.join(tiles, "cell").where(inside).groupBy("track_id", "idx").agg(F.min_by("tile_id", F.struct("ord", "tile_id")).alias("tile_id"))
    return points.join(best, ["track_id", "idx"], "left")


def cell_heights(points: DataFrame, table: DataFrame, size: float, step: float) -> DataFrame:
    """points with z of the raster cell they lie in: a laid-out table of cells (row, col, z, cell), rows and columns
    counted `step` degrees from the equator and the meridian."""
    cells = pruned(table, needed_cells(points, size)).select("cell", "row", "col", "z")
    at = points_by_cell(points, size).withColumn("row", F.floor(F.col("lat") / step)).withColumn("col", F.floor(F.col("lon") / step))
    return at.join(cells, ["cell", "row", "col"], "left").drop("cell", "row", "col")


def ways_by_cell(ways: DataFrame, size: float) -> DataFrame:
    """Ways (id, tags, nodes: array of lat and lon) of a map extract, ready to be laid out: closed (whether the line ends
    where it begins), their box, and a row for each cell that the box touches. Ways of under two nodes go."""
    side = lambda f, c: f(F.transform("nodes", lambda n: n[c]))
    ends = F.col("nodes")[0] == F.element_at("nodes", -1)
    boxed = ways.where(F.size("nodes") >= 2).select(
        "id", "tags", "nodes", ends.alias("closed"), side(F.array_min, "lat").alias("south"), side(F.array_min, "lon").alias("west"), side(F.array_max, "lat").alias("north"), side(F.array_max, "lon").alias("east")
    )
    return by_cell(boxed, size)


def structures_around(boxes: DataFrame, table: DataFrame, size: float) -> DataFrame:
    """track_id, id, kind, nodes: bridges and tunnels of roads (catalogues.road_ways) of a laid-out extract whose box
    meets that of a track (track_id, south, west, north, east). Only the cells of the tracks are read.

    A way and a track that share several cells are met in one: that of the south-west corner of what their boxes share. So
    the pairs, which are many more than ways and tracks, go nowhere once they are found; only those of an id that comes
    with several boxes are brought together. Crowded cells are cut into pieces, each of which meets all its tracks."""
    asked = by_cell(_versions(boxes.select("track_id", *BOX), ["track_id"]), size).select("track_id", "cell", "__many", *[F.col(c).alias(f"t_{c}") for c in BOX])
    found = catalogues.road_kinds(pruned(table, asked.select("cell").distinct()))
    ways = scratch.stored(_versions(found.select("id", "kind", "nodes", "cell", *BOX), ["id", "kind"], "cell"), "ways-asked")
    crowded = F.broadcast(ways.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("__n")).where("__n > 1"))
    n = F.coalesce("__n", F.lit(1))
    asked = asked.join(crowded, "cell", "left").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("__n")
    # Few rows that make many pairs: as many tasks as there may be, however small their input is.
    asked = asked.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "__piece")
    ways = ways.join(crowded, "cell", "left").withColumn("__piece", F.pmod(F.xxhash64("id", "kind"), n)).drop("__n")
    meets = catalogues.boxes_meet({c: F.col(c) for c in BOX}, {c: F.col(f"t_{c}") for c in BOX})
    corner = cell_key(*[F.floor(F.greatest(c, f"t_{c}") / size) for c in ("south", "west")])

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        return some.drop("__many").join(others.drop("__many"), ["cell", "__piece"]).where(meets & (corner == F.col("cell"))).select("track_id", "id", "kind", "nodes")

    many = F.col("__many")
    again = met(asked, ways.where(many)).unionByName(met(asked.where(many), ways.where(~many)))
    return met(asked.where(~many), ways.where(~many)).unionByName(again.groupBy("track_id", "id", "kind").agg(F.any_value("nodes").alias("nodes")))


def _versions(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """df with one row for each of its keys, boxes and `more`, and __many: whether the keys come with several boxes."""
    rest = [F.any_value(c).alias(c) for c in df.columns if c not in (*keys, *BOX, *more)]
    one = df.repartition(*keys).groupBy(*keys, *BOX, *more).agg(*rest, F.lit(True).alias("__many"))
    own, box = Window.partitionBy(*keys), F.struct(*BOX)
    return one.withColumn("__many", F.min(box).over(own) != F.max(box).over(own))


def write_catalogues(tiles: DataFrame, path: str) -> None:
    """Catalogues (their key, tiles: array of tile records) as JSON text, an object a line that names its key. A task
    writes one file, however many catalogues it has."""
    tiles.write.json(path)


def read_catalogues(spark: SparkSession, path: str, key: str, kind: str = "long") -> DataFrame:
    """key, value: the catalogues of write_catalogues, each the text of its object."""
    return spark.read.text(path).select(F.from_json("value", f"`{key}` {kind}")[key].alias(key), "value")


def catalogue_entries(files: DataFrame, key: str, text_col: str = "value") -> DataFrame:
    """key, ord and the fields of every tile record in catalogue files: a JSON object with `tiles`, or a bare list. Text
    that is neither gives none."""
    listed = F.coalesce(F.from_json(text_col, f"tiles array<struct<{ENTRY}>>")["tiles"], F.from_json(text_col, f"array<struct<{ENTRY}>>"))
    return files.select(key, F.posexplode(listed).alias("ord", "t")).select(key, "ord", "t.*")


def tile_index(entries: DataFrame, key: str, dataset: str, serie: str = "") -> DataFrame:
    """key, tile_id, ord, path, url, box, secuencial and cod_serie of catalogue entries; those without a box of four
    numbers go. The id is the first there is of id, tile_id, name, path and url, in safe characters, else the dataset
    and the number of tiles before it. Of entries that share an id the last holds, in the place of the first. A path that
    climbs out of its folder gives way to a file named after series and number, or the id."""
    full = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    kept = entries.where((F.size("bbox") == 4) & ~F.exists("bbox", lambda x: x.isNull())).withColumn("__name", formats.safe_name(full("id", "tile_id", "name", "path", "url")))
    own = Window.partitionBy(key, "__name").orderBy("ord")
    new = F.when(F.col("__name").isNull() | (F.row_number().over(own) == 1), 1).otherwise(0)
    kept = kept.withColumn("__new", new)
    before = F.coalesce(F.sum("__new").over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("tile_id", F.coalesce("__name", F.concat(F.lit(f"{dataset}_"), before.cast("string"))))
    kept = kept.withColumn("secuencial", F.trim(F.coalesce(full("secuencial", "sec"), F.lit("")))).withColumn("cod_serie", F.upper(F.trim(F.coalesce(full("cod_serie", "codSerie"), F.lit(serie)))))
    numbered = F.when((F.col("secuencial") != "") & (F.col("cod_serie") != ""), F.concat("cod_serie", F.lit("_"), "secuencial")).otherwise(F.col("tile_id"))
    kept = kept.withColumn("path", formats.safe_path(F.col("path"), F.concat(numbered, F.lit(".tif"))))
    last = F.max_by(F.struct("path", F.coalesce("url", F.lit("")).alias("url"), "bbox", "secuencial", "cod_serie"), "ord")
    one = kept.groupBy(key, "tile_id").agg(F.min("ord").alias("ord"), last.alias("t"))
    side = [F.element_at("t.bbox", i + 1).alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    return one.select(key, "tile_id", "ord", "t.path", "t.url", *side, "t.secuencial", "t.cod_serie")
