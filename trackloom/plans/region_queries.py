"""Registered queries of elevation by region, of tables laid out by place, and of archives and headers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom import scratch
from trackloom.functions import crs
from trackloom.operators import catalogues, edit_log, intervals, regions
from trackloom.sources import archives, gpx, layout

from .queries import GRD, TRK, graded, points, q, r6, registered

#: Where the tracks are moved to: places at which the boxes of states begin, end or overlap, and one outside them all.
PLACES = [(53.047, 13.2), (52.297, 13.2), (50.247, 9.0), (49.347, 9.0), (46.0, 14.5), (51.297, 11.5)]
GRID = 50.0


def moved(spark, sf_dir):
    lat, lon = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, (y, x) in enumerate(PLACES):
        here = F.col("track_id") % len(PLACES) == k
        lat, lon = F.when(here, F.col("lat") - 46.0 + y).otherwise(lat), F.when(here, F.col("lon") - 14.5 + x).otherwise(lon)
    return points(spark, sf_dir).select("track_id", "idx", lat.alias("lat"), lon.alias("lon"))


def mercator_sql(epsg: int) -> tuple[str, str]:
    """Easting and northing of zone `epsg` in SQL, by the same series."""
    meridian, scale, east, north = crs.ZONES[epsg]
    n = (1 / crs.INVERSE) / (2 - 1 / crs.INVERSE)
    radius = crs.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    s = "sin(radians(lat))"
    t = f"sinh(atanh({s})-{crs.E1!r}*atanh({crs.E1!r}*{s}))"
    lam = f"radians(lon-{meridian})"
    xi, eta = f"atan2({t},cos({lam}))", f"atanh(sin({lam})/sqrt(1+({t})*({t})))"
    x = "+".join([eta, *[f"{a!r}::DOUBLE*cos({2 * (k + 1)}*{xi})*sinh({2 * (k + 1)}*{eta})" for k, a in enumerate(terms)]])
    y = "+".join([xi, *[f"{a!r}::DOUBLE*sin({2 * (k + 1)}*{xi})*cosh({2 * (k + 1)}*{eta})" for k, a in enumerate(terms)]])
    return f"{east}+{scale}::DOUBLE*{radius!r}::DOUBLE*({x})", f"{north}+{scale}::DOUBLE*{radius!r}::DOUBLE*({y})"


_CASE = lambda at, i: "CASE " + " ".join(f"WHEN track_id%{len(PLACES)}={k} THEN {p[i]}::DOUBLE" for k, p in enumerate(PLACES)) + " END"
_ZONE = {code: mercator_sql(code) for code in (25832, 25833)}
STATES = TRK + f""",
mv AS (SELECT track_id, idx, lat-46.0::DOUBLE+{_CASE('lat', 0)} AS lat, lon-14.5::DOUBLE+{_CASE('lon', 1)} AS lon FROM trk),
st(region, ord, epsg, south, north, west, east) AS (VALUES {', '.join(f"('{n}',{k},{c},{s}::DOUBLE,{t}::DOUBLE,{w}::DOUBLE,{e}::DOUBLE)" for k, (n, c, s, t, w, e) in enumerate(regions.GERMAN_STATES))}),
met AS (SELECT track_id, idx, lat, lon, region, ord, epsg, row_number() OVER (PARTITION BY track_id, idx ORDER BY ord) - 1 AS k FROM mv JOIN st ON lat BETWEEN south AND north AND lon BETWEEN west AND east)"""


@registered("state_routing", q("SELECT track_id, idx, region, CAST(k AS INTEGER) AS k FROM met", STATES))
def state_routing(spark, sf_dir):
    """All states whose box holds a point, in order."""
    return regions.regions_at(moved(spark, sf_dir), regions.german_states(spark)).select("track_id", "idx", "region", "k")


@registered("state_runs", q("""SELECT track_id, CAST(run AS BIGINT) AS run, any_value(region) AS region, min(idx) AS first_idx, max(idx) AS last_idx FROM (
 SELECT *, sum(b) OVER (PARTITION BY track_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR region IS DISTINCT FROM lag(region) OVER w THEN 1 ELSE 0 END AS b
 FROM (SELECT m.track_id, m.idx, met.region FROM mv m LEFT JOIN met ON met.track_id=m.track_id AND met.idx=m.idx AND k = 0) WINDOW w AS (PARTITION BY track_id ORDER BY idx))) GROUP BY track_id, run""", STATES))
def state_runs(spark, sf_dir):
    """Consecutive points whose first state is the same, or that none holds."""
    p = moved(spark, sf_dir)
    runs = regions.primary_runs(p, regions.regions_at(p, regions.german_states(spark)))
    return runs.groupBy("track_id", "run").agg(F.first("region").alias("region"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def heights(met):
    """Rasters of all states around the tracks, a third to two thirds of their cells without a height (no value, the
    sentinel, or zero)."""
    cells = met.select("region", F.floor(F.col("y") / GRID).alias("row"), F.floor(F.col("x") / GRID).alias("col")).distinct()
    kind = (F.col("row") * 3 + F.col("col") + F.length("region")) % 5
    z = F.when(kind == 1, -9999.0).when(kind == 2, 0.0).when(kind > 2, 100.0 + (F.col("row") * 7 + F.col("col")) % 13)
    return cells.withColumn("z", z)


@registered("state_heights", q(f"""SELECT m.track_id, m.idx, b.z AS ele, b.region, CAST(coalesce(b.k + 1, held, 0) AS INTEGER) AS asked FROM mv m
 LEFT JOIN (SELECT track_id, idx, max(k) + 1 AS held FROM met GROUP BY 1, 2) h ON h.track_id=m.track_id AND h.idx=m.idx
 LEFT JOIN (SELECT track_id, idx, arg_min(z, k) AS z, arg_min(region, k) AS region, min(k) AS k FROM (SELECT *, CASE WHEN (r*3+c+length(region))%5 > 2 THEN 100.0::DOUBLE + (r*7+c)%13 END AS z FROM (
  SELECT *, CAST(floor((CASE WHEN epsg=25832 THEN {_ZONE[25832][1]} ELSE {_ZONE[25833][1]} END)/{GRID}) AS BIGINT) AS r, CAST(floor((CASE WHEN epsg=25832 THEN {_ZONE[25832][0]} ELSE {_ZONE[25833][0]} END)/{GRID}) AS BIGINT) AS c FROM met)) WHERE z IS NOT NULL GROUP BY 1, 2) b
 ON b.track_id=m.track_id AND b.idx=m.idx""", STATES))  # fmt: skip
def state_heights(spark, sf_dir):
    """Heights of the first state, and of the others where it has none: up to three states hold a point."""
    p = moved(spark, sf_dir)
    met = regions.routed(p, regions.german_states(spark))
    out = regions.asked_in_turn(p, met, regions.grid_answers(heights(met), GRID))
    return out.select("track_id", "idx", "ele", "region", "asked")


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


#: Degrees of a tile, and of a cell of the layout.
TILE, CELL = 0.0016, 0.004
TILES = TRK + f""",
ti AS (SELECT DISTINCT CAST(floor(lat/{TILE}) AS BIGINT) AS a, CAST(floor(lon/{TILE}) AS BIGINT) AS b FROM trk),
tl AS (SELECT 't'||a||'_'||b AS tile_id, (a*7+b*3)%11 AS ord, a*{TILE}::DOUBLE-0.0002::DOUBLE AS south, b*{TILE}::DOUBLE-0.0002::DOUBLE AS west, (a+1)*{TILE}::DOUBLE+0.0002::DOUBLE AS north, (b+1)*{TILE}::DOUBLE+0.0002::DOUBLE AS east FROM ti WHERE a%5 <> 0)"""


def tiles(spark, sf_dir):
    """Tiles around all tracks, overlapping each other at their edges; every fifth row of them is missing."""
    at = points(spark, sf_dir).select(F.floor(F.col("lat") / TILE).alias("a"), F.floor(F.col("lon") / TILE).alias("b")).distinct().where("a % 5 <> 0")
    edge = lambda c, k, by: (F.col(c) + k) * F.lit(TILE) + F.lit(by)
    return at.select(F.concat(F.lit("t"), "a", F.lit("_"), "b").alias("tile_id"), ((F.col("a") * 7 + F.col("b") * 3) % 11).alias("ord"), edge("a", 0, -0.0002).alias("south"), edge("b", 0, -0.0002).alias("west"), edge("a", 1, 0.0002).alias("north"), edge("b", 1, 0.0002).alias("east"))


@registered("tiles_by_cell", q("SELECT p.track_id, p.idx, t.tile_id FROM (SELECT * FROM trk WHERE track_id%3 = 0) p LEFT JOIN (SELECT track_id, idx, arg_min(tile_id, (ord, tile_id)) AS tile_id FROM trk JOIN tl ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY 1, 2) t ON t.track_id=p.track_id AND t.idx=p.idx", TILES))
def tiles_by_cell(spark, sf_dir):
    """The first tile that holds each point of a batch, from tiles that lie in folders by place."""
    laid = scratch.stored(layout.by_cell(tiles(spark, sf_dir), CELL), "tiles", "cell")
    batch = points(spark, sf_dir).where("track_id % 3 = 0")
    return layout.first_tile(batch, laid, CELL).select("track_id", "idx", "tile_id")


@registered("heights_by_cell", q("""SELECT track_id, idx, CASE WHEN r%4 = 0 THEN NULL ELSE 100.0::DOUBLE + (r*3+c)%50 END AS z FROM (SELECT track_id, idx, CAST(floor(lat/0.0001) AS BIGINT) AS r, CAST(floor(lon/0.0001) AS BIGINT) AS c FROM trk WHERE track_id%3 = 1)""", TRK))
def heights_by_cell(spark, sf_dir):
    """Heights of a raster whose cells lie in folders by place; a quarter of the cells is missing."""
    p = points(spark, sf_dir)
    r, c = F.floor(F.col("lat") / 0.0001), F.floor(F.col("lon") / 0.0001)
    cells = layout.points_by_cell(p, CELL).select("cell", r.alias("row"), c.alias("col")).distinct().where("row % 4 <> 0").withColumn("z", 100.0 + (F.col("row") * 3 + F.col("col")) % 50)
    laid = scratch.stored(cells, "heights", "cell")
    return layout.cell_heights(p.where("track_id % 3 = 1").select("track_id", "idx", "lat", "lon"), laid, CELL, 0.0001).select("track_id", "idx", "z")


@registered("structures_around", q("""SELECT DISTINCT t.track_id, w.id, w.kind FROM (SELECT track_id, min(lat)-0.0004::DOUBLE AS s, min(lon)-0.0004::DOUBLE AS w, max(lat)+0.0004::DOUBLE AS n, max(lon)+0.0004::DOUBLE AS e FROM trk WHERE track_id%10 = 0 GROUP BY 1) t
 JOIN (SELECT id, kind, least(la, lb) AS s, greatest(la, lb) AS n, least(oa, ob) AS w, greatest(oa, ob) AS e FROM (SELECT event_id AS id, 46.0::DOUBLE+(event_id%997)*0.0001::DOUBLE AS la, 46.0::DOUBLE+(event_id%997)*0.0001::DOUBLE+0.0007::DOUBLE AS lb, 14.49::DOUBLE+(event_id%131)*0.0001::DOUBLE AS oa, 14.49::DOUBLE+(event_id%131)*0.0001::DOUBLE+0.0003::DOUBLE AS ob,
 CASE WHEN event_id%4=3 THEN 'tunnel' ELSE 'bridge' END AS kind FROM events WHERE event_id%11 <> 0 AND ((event_id%4=0 AND (event_id%6 <> 0 OR event_id%5=0)) OR event_id%4=1 OR (event_id%4=3 AND event_id%3 <> 0)))) w
 ON w.n >= t.s AND w.s <= t.n AND w.e >= t.w AND w.w <= t.e""", TRK))  # fmt: skip
def structures_around(spark, sf_dir):
    """Bridges and tunnels of roads around the tracks of a batch, from a map extract in folders by place."""
    i = F.col("event_id")
    tag = lambda when, k, v: F.when(when, F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")))
    tags = F.array(
        tag(i % 4 == 0, "bridge", "yes"), tag(i % 6 == 0, "railway", "rail"), tag(i % 5 == 0, "highway", "cycleway"), tag(i % 4 == 1, "man_made", "viaduct"),
        F.when(i % 4 == 3, F.struct(F.lit("tunnel").alias("key"), F.when(i % 3 == 0, "building_passage").otherwise("yes").alias("value"))),
    )
    lat, lon = F.lit(46.0) + i % 997 * F.lit(0.0001), F.lit(14.49) + i % 131 * F.lit(0.0001)
    node = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    line = F.array(node(lat, lon), node(lat + 0.0007, lon + 0.0003))
    ring = F.array(node(lat, lon), node(lat + 0.0007, lon + 0.0003), node(lat, lon))
    kind = F.map_from_entries(F.array_compact(tags))
    ways = events(spark, sf_dir).select(i.alias("id"), F.when(i % 4 == 3, F.map_filter(kind, lambda k, v: k != "railway")).otherwise(kind).alias("tags"), F.when(i % 11 == 0, ring).otherwise(line).alias("nodes"))
    laid = scratch.stored(layout.ways_by_cell(ways, CELL), "ways", "cell")
    t = points(spark, sf_dir).where("track_id % 10 = 0").groupBy("track_id").agg((F.min("lat") - 0.0004).alias("south"), (F.min("lon") - 0.0004).alias("west"), (F.max("lat") + 0.0004).alias("north"), (F.max("lon") + 0.0004).alias("east"))
    return layout.structures_around(t, laid, CELL).select("track_id", "id", "kind")


CATALOGUE = """
e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord, event_id AS i FROM events),
k AS (SELECT *, CASE i%7 WHEN 0 THEN 'id '||(i%40) WHEN 1 THEN 'tile_'||i WHEN 2 THEN 'n_'||(i%40) WHEN 3 THEN '/d/x'||i||'.tif' WHEN 4 THEN NULL WHEN 5 THEN '../../etc' ELSE 'u:'||i END AS nm FROM e WHERE i%9 <> 0),
n AS (SELECT *, regexp_replace(nm, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM k),
f AS (SELECT *, CASE WHEN safe IS NULL OR row_number() OVER (PARTITION BY user_id, safe ORDER BY ord) = 1 THEN 1 ELSE 0 END AS fresh FROM n),
d AS (SELECT *, coalesce(safe, 'DS_'||CAST(coalesce(sum(fresh) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)) AS tile_id FROM f)"""


@registered("catalogue_scan", q("""SELECT user_id, tile_id, min(ord) AS ord, arg_max(CASE WHEN i%7=3 THEN 'd/x'||i||'.tif' WHEN i%5=1 THEN 'MDT_'||i||'.tif' ELSE tile_id||'.tif' END, ord) AS path, arg_max(i, ord)/100.0::DOUBLE AS west, arg_max(CASE WHEN i%5=1 THEN CAST(i AS VARCHAR) ELSE '' END, ord) AS secuencial FROM d GROUP BY 1, 2""", CATALOGUE))
def catalogue_scan(spark, sf_dir):
    """Tile records of one catalogue file a user, as an object or a bare list; ids of five kinds, some repeated; a path
    that climbs out; records without a whole box; numbers of a series."""
    i = F.col("event_id")
    text = lambda when, v: F.when(when, v)
    box = F.when(i % 18 == 0, F.array(F.lit(1.0), F.lit(2.0))).when(i % 9 == 0, F.lit(None)).otherwise(F.array(i / 100.0, F.lit(1.0), i / 100.0 + 1, F.lit(2.0)))
    path = text(i % 7 == 3, F.concat(F.lit("/d/x"), i, F.lit(".tif"))).when(i % 7 == 5, "../../etc")
    entry = F.struct(
        i.alias("at"), text(i % 7 == 0, F.concat(F.lit("id "), i % 40)).alias("id"), text(i % 7 == 1, F.concat(F.lit("tile/"), i)).alias("tile_id"), text(i % 7 == 2, F.concat(F.lit("n?"), i % 40)).alias("name"),
        path.alias("path"), text(i % 7 >= 5, F.concat(F.lit("u:"), i)).alias("url"), box.alias("bbox"), text(i % 5 == 1, F.concat(F.lit(" "), i)).alias("sec"), text(i % 5 == 1, F.lit("mdt ")).alias("codSerie"),
    )
    files = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("tiles"))
    files = files.select("user_id", F.when(F.col("user_id") % 2 == 0, F.to_json("tiles")).otherwise(F.to_json(F.struct("tiles"))).alias("value"))
    found = layout.tile_index(layout.catalogue_entries(files, "user_id"), "user_id", "DS")
    return found.select("user_id", "tile_id", F.col("ord").cast("long").alias("ord"), "path", "west", "secuencial")


@registered("archive_round_trip", q("SELECT 'r'||track_id AS track, idx, round(lat, 8) AS lat, round(lon, 8) AS lon, floor(ele*8)/8 AS ele FROM trk", TRK))
def archive_round_trip(spark, sf_dir):
    """All tracks as GPX documents in archives of twenty, and back."""
    archives.register(spark)
    p = points(spark, sf_dir).withColumn("track", F.concat(F.lit("r"), "track_id")).withColumn("ele", F.floor(F.col("ele") * 8) / 8)
    docs = gpx.to_gpx(p, "track").select(F.concat("track", F.lit(".gpx")).alias("name"), F.col("gpx").alias("content"), F.lit(0).alias("ord"))
    out = f"{scratch.folder(spark)}/bundles-{uuid.uuid4().hex}"
    archives.bundled(docs, 20).write.format("zip_archives").mode("append").save(out)
    members = spark.read.format("zip_members").option("suffixes", ".gpx").load(out).where("error is null")
    texts = members.select(F.regexp_replace("name", r"\.gpx$", "").alias("track"), F.col("content").cast("string").alias("gpx"))
    back = gpx.track_points(gpx.parsed(texts), "track")
    return back.select("track", "idx", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("ele", 3).alias("ele"))


EDITS = GRD + """,
zn AS (SELECT track_id, idx AS zone, idx AS alo, idx+6 AS ahi, idx%4 < 2 AS acc FROM (SELECT *, max(idx) OVER (PARTITION BY track_id) AS last FROM grd) WHERE idx%9=4 AND idx+20 <= last),
lg AS (SELECT track_id, (zone*37)%997 AS seq, CASE zone%3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'drag' END AS act, zone, 'hi' AS side, zone+13 AS a, CAST(NULL AS BIGINT) AS b FROM zn UNION ALL
 SELECT track_id, 1000+(zone*37)%997, CASE zone%2 WHEN 0 THEN 'drag' ELSE 'accept' END, zone, 'lo', zone-3, NULL FROM zn UNION ALL
 SELECT track_id, 2000+(zone*37)%997, CASE zone%5 WHEN 0 THEN 'remove' ELSE 'accept' END, zone, NULL, NULL, NULL FROM zn WHERE zone%5 < 3),
ln AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS k FROM lg WHERE track_id%4 <> 1),
base AS (SELECT track_id, list(ele ORDER BY idx) AS raw, list(dist ORDER BY idx) AS ds FROM grd GROUP BY 1),
zl AS (SELECT track_id, list({'zone': zone, 'alo': alo, 'ahi': ahi, 'acc': acc, 'rej': FALSE, 'gone': FALSE} ORDER BY alo) AS zs FROM zn GROUP BY 1),
ini AS (SELECT b.track_id, coalesce(z.zs, []) AS zs, list_transform(raw, lambda e, i: coalesce(list_extract(list_transform(list_filter(coalesce(z.zs, []), lambda x: x.acc AND i-1 > x.alo AND i-1 < x.ahi), lambda x: raw[x.alo+1]+(ds[i]-ds[x.alo+1])/(ds[x.ahi+1]-ds[x.alo+1])*(raw[x.ahi+1]-raw[x.alo+1])), 1), e)) AS es FROM base b LEFT JOIN zl z ON z.track_id=b.track_id),
run AS (SELECT track_id, CAST(0 AS BIGINT) AS k, zs, es FROM ini UNION ALL
 SELECT track_id, k, list_transform(zs, lambda x: CASE WHEN x.zone=zid AND on_ THEN {'zone': x.zone, 'alo': nlo, 'ahi': nhi, 'acc': nacc, 'rej': nrej, 'gone': act='remove'} ELSE x END) AS zs,
  CASE WHEN draws THEN list_transform(es1, lambda e, i: CASE WHEN i-1 > nlo AND i-1 < nhi THEN es1[nlo+1]+(ds[i]-ds[nlo+1])/(ds[nhi+1]-ds[nlo+1])*(es1[nhi+1]-es1[nlo+1]) ELSE e END) ELSE es1 END AS es FROM (
 SELECT *, CASE WHEN backs THEN list_transform(es, lambda e, i: CASE WHEN i-1 BETWEEN least(z.alo, nlo) AND greatest(z.ahi, nhi) THEN raw[i] ELSE e END) ELSE es END AS es1 FROM (
 SELECT *, on_ AND ((act='accept' AND NOT nacc) OR (act='reject' AND nrej) OR act='remove' OR (act='drag' AND nacc)) AS backs, on_ AND nacc AND act IN ('accept', 'drag') AS draws FROM (
 SELECT *, NOT z.gone AS on_, CASE WHEN act='accept' THEN NOT z.acc WHEN act='reject' THEN z.rej AND z.acc ELSE z.acc END AS nacc, CASE WHEN act='accept' THEN z.rej AND z.acc WHEN act='reject' THEN NOT z.rej ELSE z.rej END AS nrej,
  CASE WHEN act='drag' AND side='lo' THEN least(a, z.ahi-1) ELSE z.alo END AS nlo, CASE WHEN act='drag' AND side='hi' THEN greatest(a, z.alo+1) ELSE z.ahi END AS nhi FROM (
 SELECT r.track_id, l.k, r.zs, r.es, b.raw, b.ds, l.act, l.side, l.a, l.zone AS zid, list_filter(r.zs, lambda x: x.zone=l.zone)[1] AS z FROM run r JOIN ln l ON l.track_id=r.track_id AND l.k=r.k+1 JOIN base b ON b.track_id=r.track_id))))),
fin AS (SELECT track_id, arg_max(es, k) AS es, arg_max(zs, k) AS zs FROM run GROUP BY 1)"""


def edited(spark, sf_dir):
    """Straight zones of six points, and up to three edits of each; the tracks of one in four are left alone."""
    g = graded(spark, sf_dir)
    i = F.col("idx")
    last = F.max("idx").over(intervals.Window.partitionBy("track_id"))
    z = g.withColumn("last", last).where("idx % 9 = 4 AND idx + 20 <= last").select("track_id", i.alias("zone"), i.alias("alo"), (i + 6).alias("ahi"), F.lit("suspect").alias("type"), F.lit("none").alias("interp"), F.lit(0.0).alias("m0"), F.lit(0.0).alias("m1"), (i % 4 < 2).alias("accepted"), F.lit(False).alias("rejected"))
    n = F.col("zone")
    part = lambda k, act, side=None, a=None: z.select("track_id", (k * 1000 + n * 37 % 997).alias("seq"), act.alias("action"), "zone", F.lit(side).cast("string").alias("side"), (a if a is not None else F.lit(None)).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    log = part(0, F.when(n % 3 == 0, "accept").when(n % 3 == 1, "reject").otherwise("drag"), "hi", n + 13)
    log = log.unionByName(part(1, F.when(n % 2 == 0, "drag").otherwise("accept"), "lo", n - 3)).unionByName(part(2, F.when(n % 5 == 0, "remove").otherwise("accept")).where("zone % 5 < 3"))
    return g, z, log.where("track_id % 4 <> 1")


@registered("edits_replayed", "WITH RECURSIVE " + EDITS.strip() + """
SELECT track_id, CAST(i AS BIGINT) AS idx, round(e, 6) AS ele_fixed FROM (SELECT track_id, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS i FROM fin)""")
def edits_replayed(spark, sf_dir):
    """The profile after a log of edits, of which only the tracks that it names are worked out anew."""
    g, z, log = edited(spark, sf_dir)
    done, _ = edit_log.replayed(g, z, log.limit(0))
    return edit_log.revised(done, g, z, log).select("track_id", "idx", r6("ele_fixed").alias("ele_fixed"))


@registered("zones_after_edits", "WITH RECURSIVE " + EDITS.strip() + """
SELECT f.track_id, x.zone, x.alo, x.ahi, x.acc AS accepted, x.rej AS rejected, CASE WHEN x.acc THEN 'uniform' ELSE 'none' END AS interp, round(ds[x.ahi+1]-ds[x.alo+1], 6) AS span, round(100*(raw[x.ahi+1]-raw[x.alo+1])/(ds[x.ahi+1]-ds[x.alo+1]), 5) AS grade
FROM (SELECT track_id, unnest(zs) AS x FROM fin) f JOIN base b ON b.track_id=f.track_id WHERE NOT x.gone""")
def zones_after_edits(spark, sf_dir):
    g, z, log = edited(spark, sf_dir)
    _, left = edit_log.replayed(g, z, log)
    return left.select("track_id", "zone", "alo", "ahi", "accepted", "rejected", "interp", r6("span").alias("span"), F.round("grade", 5).alias("grade"))


@registered("best_resources", """WITH rs AS (SELECT user_id, event_id AS pos, 'https://' || CASE event_id%4 WHEN 0 THEN 'data.gv.at' WHEN 1 THEN 'x.data.gv.at' WHEN 2 THEN 'evildata.gv.at' ELSE 'gis.at:443' END || '/' || CASE event_id%5 WHEN 0 THEN 'a.TIF' WHEN 1 THEN 'b.zip' WHEN 2 THEN 'wms?x' WHEN 3 THEN 'c' ELSE 'N' || user_id || '.tiff' END AS url,
 CASE event_id%3 WHEN 0 THEN 'GeoTIFF' WHEN 1 THEN 'zip' END AS fmt, CASE event_id%7 WHEN 0 THEN 'DTM model' WHEN 1 THEN 'Service' ELSE '' END AS name FROM events),
hy AS (SELECT *, lower(url) || ' ' || lower(coalesce(fmt,'')) || ' ' || lower(name) AS hay FROM rs WHERE pos%4 <> 2),
sc AS (SELECT *, CASE WHEN contains(hay, 'n' || user_id) THEN 20 ELSE 0 END + CASE WHEN contains(lower(url), '.tif') THEN 8 ELSE 0 END + CASE WHEN contains(lower(url), '.zip') THEN 6 ELSE 0 END + CASE WHEN fmt='GeoTIFF' THEN 5 ELSE 0 END + CASE WHEN fmt='zip' THEN 4 ELSE 0 END
 + CASE WHEN contains(hay, 'dtm') THEN 3 ELSE 0 END - CASE WHEN contains(hay, 'wms') OR contains(hay, 'service') THEN 6 ELSE 0 END AS score FROM hy WHERE contains(hay, '.tif') OR contains(hay, '.zip') OR contains(hay, 'geotiff') OR contains(hay, 'dtm'))
SELECT user_id, arg_max(pos, (score, -pos)) AS pos, arg_max(url, (score, -pos)) AS url FROM sc GROUP BY 1""")
def best_resources(spark, sf_dir):
    """Of the resources of a record the one to download: by host, words, endings and the code that is expected."""
    i = F.col("event_id")
    host = F.when(i % 4 == 0, "data.gv.at").when(i % 4 == 1, "x.data.gv.at").when(i % 4 == 2, "evildata.gv.at").otherwise("gis.at:443")
    file = F.when(i % 5 == 0, "a.TIF").when(i % 5 == 1, "b.zip").when(i % 5 == 2, "wms?x").when(i % 5 == 3, "c").otherwise(F.concat(F.lit("N"), "user_id", F.lit(".tiff")))
    r = events(spark, sf_dir).select("user_id", i.alias("pos"), F.concat(F.lit("https://"), host, F.lit("/"), file).alias("url"), F.when(i % 3 == 0, "GeoTIFF").when(i % 3 == 1, "zip").alias("format"), F.when(i % 7 == 0, "DTM model").when(i % 7 == 1, "Service").otherwise("").alias("name"), F.lit(None).cast("string").alias("description"))
    return catalogues.best_resource(r, ["user_id"], ["data.gv.at", "gis.at"], F.concat(F.lit("N"), "user_id"))
