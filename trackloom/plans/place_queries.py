"""Registered queries of structures, catalogues and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import catalogues, intervals, structures
from trackloom.sources import gpx, records

from .function_queries import events
from .more_queries import gc
from .queries import GRD, PTS, TRK, graded, points, q, r6, registered
from .recurrences import vec

CUR = "((2*{t}*{t}*{t}-3*{t}*{t}+1)*e0 + ({t}*{t}*{t}-2*{t}*{t}+{t})*(d1-d0)*m0 + (3*{t}*{t}-2*{t}*{t}*{t})*e1 + ({t}*{t}*{t}-{t}*{t})*(d1-d0)*m1)"

CUT = "CASE WHEN bends THEN " + CUR.format(t="((ds[i]-d0)/(d1-d0))") + " ELSE e0+(ds[i]-d0)/(d1-d0)*(e1-e0) END"

COR = GRD + f""",
tot AS (SELECT track_id, max(idx) AS last FROM grd GROUP BY 1),
loc AS (SELECT g.track_id, g.idx AS struct_id, CASE WHEN g.idx%2=0 THEN 'bridge' ELSE 'tunnel' END AS kind, g.idx AS a0, g.idx+4 AS b0, last FROM grd g JOIN tot USING (track_id) WHERE g.idx%9=5 AND g.idx+4 <= last),
wid AS (SELECT track_id, struct_id, kind, last, coalesce((SELECT max(g.idx) FROM grd g WHERE g.track_id=l.track_id AND g.idx < a0 AND abs(g.gr) < 25), a0) AS alo, coalesce(least((SELECT min(g.idx)+1 FROM grd g WHERE g.track_id=l.track_id AND g.idx >= b0 AND abs(g.gr) < 25), last), b0) AS ahi FROM loc l),
agg AS (SELECT w.track_id, struct_id, kind, alo, ahi, max(CASE WHEN idx=alo THEN ele END) AS e0, max(CASE WHEN idx=ahi THEN ele END) AS e1, max(CASE WHEN idx=alo THEN dist END) AS d0, max(CASE WHEN idx=ahi THEN dist END) AS d1, min(CASE WHEN idx BETWEEN alo AND ahi THEN ele END) AS low, max(CASE WHEN idx BETWEEN alo AND ahi THEN ele END) AS high,
 coalesce(avg(CASE WHEN idx < alo THEN gr END),0.0)/100 AS m0, coalesce(avg(CASE WHEN idx >= ahi AND idx < least(ahi+8, last) THEN gr END),0.0)/100 AS m1 FROM wid w JOIN grd p ON p.track_id=w.track_id AND p.idx BETWEEN alo-8 AND ahi+8 WHERE alo < ahi GROUP BY 1,2,3,4,5),
ben AS (SELECT *, (e0+e1)/2-low >= (CASE WHEN kind='bridge' THEN 0.0 ELSE 1.0 END) AS sinks, high-(e0+e1)/2 >= (CASE WHEN kind='tunnel' THEN 0.0 ELSE 1.0 END) AS rises, list_max(list_transform(range(21), lambda k: abs({CUR.format(t='(k/20.0)')} - (e0+(k/20.0)*(e1-e0))))) AS off FROM agg),
itp AS (SELECT *, CASE WHEN NOT sinks OR off < 0.5 THEN 'uniform' WHEN m0 > 0 AND m1 < 0 THEN 'hermite_convex' WHEN m0 < 0 AND m1 > 0 THEN 'hermite_concave' ELSE 'uniform' END AS i0 FROM ben),
cor AS (SELECT *, CASE WHEN sinks THEN CASE i0 WHEN 'hermite_convex' THEN 'bridge' WHEN 'hermite_concave' THEN 'bridge_sag' ELSE 'ramp' END WHEN rises THEN 'tunnel' ELSE 'artifact' END AS t0 FROM itp)"""


def located(spark, sf_dir):
    g = graded(spark, sf_dir)
    last = F.max("idx").over(intervals.Window.partitionBy("track_id"))
    z = g.withColumn("last", last).where("idx % 9 = 5 AND idx + 4 <= last")
    return g, z.select(F.col("idx").alias("struct_id"), "track_id", F.when(F.col("idx") % 2 == 0, "bridge").otherwise("tunnel").alias("kind"), F.col("idx").alias("alo"), (F.col("idx") + 4).alias("ahi"))


@registered("structure_corrections", q("""SELECT track_id, struct_id, CAST(alo AS BIGINT) AS alo, CAST(ahi AS BIGINT) AS ahi, CASE WHEN kind='tunnel' THEN 'tunnel' WHEN i0='uniform' AND t0 <> 'tunnel' THEN 'bridge' ELSE t0 END AS type, CASE WHEN kind='bridge' AND i0='uniform' AND t0 <> 'tunnel' THEN 'hermite_convex' ELSE i0 END AS interp,
 round(CASE WHEN sinks THEN m0 ELSE 0.0 END,8) AS m0, round(CASE WHEN sinks THEN m1 ELSE 0.0 END,8) AS m1 FROM cor""", COR))  # fmt: skip
def structure_corrections(spark, sf_dir):
    found = structures.corrections(*located(spark, sf_dir))
    return found.select("track_id", "struct_id", "alo", "ahi", "type", "interp", F.round("m0", 8).alias("m0"), F.round("m1", 8).alias("m1"))


FIX = COR + f""",
one AS (SELECT track_id, alo, ahi, e0, e1, d0, d1, CASE WHEN kind='bridge' AND i0='uniform' AND t0 <> 'tunnel' THEN TRUE ELSE i0 <> 'uniform' END AS bends, CASE WHEN sinks THEN m0 ELSE 0.0 END AS m0, CASE WHEN sinks THEN m1 ELSE 0.0 END AS m1 FROM cor WHERE struct_id%27=5 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY struct_id) = 1),
fit AS (SELECT p.track_id, p.idx, p.ele, z.*, (p.dist-d0)/nullif(d1-d0,0.0) AS t FROM grd p LEFT JOIN one z ON z.track_id=p.track_id AND p.idx > z.alo AND p.idx < z.ahi AND d1 > d0)"""


@registered("corrected_profile", q(f"SELECT track_id, idx, round(CASE WHEN t IS NULL THEN ele WHEN bends THEN {CUR.format(t='t')} ELSE e0+t*(e1-e0) END,6) AS ele_fixed FROM fit", FIX))
def corrected_profile(spark, sf_dir):
    """The profile after the first structure of each track is drawn."""
    g, z = located(spark, sf_dir)
    w = intervals.Window.partitionBy("track_id").orderBy("struct_id")
    first = structures.corrections(g, z).where("struct_id % 27 = 5").withColumn("n", F.row_number().over(w)).where("n = 1")
    return structures.corrected(g, first).select("track_id", "idx", r6("ele_fixed").alias("ele_fixed"))


LONG = "g.idx+4+g.idx%4*9"
TURNS = COR.replace("g.idx+4", LONG) + """,
zs AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY kind, struct_id) AS k, CASE WHEN kind='bridge' AND i0='uniform' AND t0 <> 'tunnel' THEN TRUE ELSE i0 <> 'uniform' END AS bends, CASE WHEN sinks THEN m0 ELSE 0.0 END AS s0, CASE WHEN sinks THEN m1 ELSE 0.0 END AS s1 FROM cor WHERE ahi-alo >= 2 AND d1 > d0),
prof AS (SELECT track_id, list(ele ORDER BY idx) AS es, list(dist ORDER BY idx) AS ds FROM grd GROUP BY 1),
app AS (SELECT track_id, CAST(0 AS BIGINT) AS k, es FROM prof UNION ALL SELECT track_id, k, list_transform(es, lambda e, i: CASE WHEN i-1 <= alo OR i-1 >= ahi THEN e ELSE """ + CUT + """ END) FROM
 (SELECT a.track_id, z.k, a.es, p.ds, z.alo, z.ahi, z.d0, z.d1, z.bends, z.s0 AS m0, z.s1 AS m1, a.es[z.alo+1] AS e0, a.es[z.ahi+1] AS e1 FROM app a JOIN zs z ON z.track_id=a.track_id AND z.k=a.k+1 JOIN prof p ON p.track_id=a.track_id)),
fin AS (SELECT track_id, arg_max(es, k) AS es FROM app GROUP BY 1)"""


def crowded(spark, sf_dir):
    """Structures of 4 to 31 points: many overlap, nest or share an end with others."""
    g = graded(spark, sf_dir)
    last = F.max("idx").over(intervals.Window.partitionBy("track_id"))
    long = F.col("idx") + 4 + F.col("idx") % 4 * 9
    z = g.withColumn("last", last).where("idx % 9 = 5").withColumn("ahi", long).where("ahi <= last")
    return g, z.select(F.col("idx").alias("struct_id"), "track_id", F.when(F.col("idx") % 2 == 0, "bridge").otherwise("tunnel").alias("kind"), F.col("idx").alias("alo"), "ahi")


@registered("corrections_in_turn", "WITH RECURSIVE " + TURNS.strip() + """
SELECT track_id, CAST(i AS BIGINT) AS idx, round(e, 6) AS ele_fixed FROM (SELECT track_id, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS i FROM fin)""")
def corrections_in_turn(spark, sf_dir):
    """The profile after bridges and then tunnels are drawn, each on what those before it have left."""
    g, z = crowded(spark, sf_dir)
    return structures.corrected(g, structures.corrections(g, z), ("kind", "struct_id")).select("track_id", "idx", r6("ele_fixed").alias("ele_fixed"))


@registered("inner_shapes", q(f"""SELECT track_id, alo, ahi, CASE WHEN d1-d0 < 1 THEN 'artifact' WHEN sink >= 1 AND sink > rise THEN 'bridge' WHEN rise >= 1 AND rise > sink THEN 'tunnel' WHEN off >= 0.5 THEN 'artifact' ELSE 'clean' END AS type FROM (SELECT track_id, alo, ahi, max(d0) AS d0, max(d1) AS d1, max((e0+e1)/2-ele) AS sink, max(ele-(e0+e1)/2) AS rise, max(abs(ele-{CUR.format(t='t')})) AS off FROM
 (SELECT z.*, p.ele, (p.dist-d0)/nullif(d1-d0,0.0) AS t FROM (SELECT a.track_id, a.idx AS alo, b.idx AS ahi, a.ele AS e0, b.ele AS e1, a.dist AS d0, b.dist AS d1, a.tg AS m0, b.tg AS m1 FROM tg a JOIN tg b ON b.track_id=a.track_id AND b.idx=a.idx+4 AND a.idx%9=5) z JOIN pts p ON p.track_id=z.track_id AND p.idx > alo AND p.idx < ahi) GROUP BY 1,2,3)""", PTS + """,
tg AS (SELECT *, coalesce((last_value(ele) OVER w - first_value(ele) OVER w)/nullif(last_value(dist) OVER w - first_value(dist) OVER w,0.0),0.0) AS tg FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING))"""))  # fmt: skip
def inner_shapes(spark, sf_dir):
    g, z = located(spark, sf_dir)
    return structures.inner_shapes(g, z.select("track_id", "alo", "ahi")).select("track_id", "alo", "ahi", "type")


FAR = TRK + """,
far AS (SELECT track_id, idx, lat + track_id%5*CAST(1.7 AS DOUBLE) AS lat, lon, count(*) OVER (PARTITION BY track_id) AS n FROM trk),
ccs AS (SELECT *, CASE WHEN lat <= 46.88 THEN 'SI' WHEN lat <= 49.02 THEN 'AT' WHEN lat <= 54.84 THEN 'PL' END AS cc FROM far)"""


def far(spark, sf_dir):
    return points(spark, sf_dir).withColumn("lat", F.col("lat") + F.col("track_id") % 5 * F.lit(1.7))


@registered("primary_country", q("SELECT track_id, cc FROM ccs WHERE idx = n // 2", FAR))
def primary_country(spark, sf_dir):
    return catalogues.primary_country(far(spark, sf_dir))


@registered("target_resolution", q("SELECT track_id, least(min(CASE cc WHEN 'AT' THEN 10 ELSE 1 END), 5) AS metres FROM ccs WHERE idx IN (0, n//4, n//2, 3*n//4, n-1) GROUP BY 1", FAR))
def target_resolution(spark, sf_dir):
    return catalogues.target_resolution(far(spark, sf_dir))


@registered("raster_stats", "SELECT user_id AS tile_id, max(event_id%10)+1 AS rows, max(event_id//10%10)+1 AS cols, round(min(CASE WHEN event_id%4 > 0 THEN value END),6) AS lowest, round(max(CASE WHEN event_id%4 > 0 THEN value END),6) AS highest, count(*) FILTER (event_id%4 = 0 OR value IS NULL) AS missing FROM events GROUP BY 1")
def raster_stats(spark, sf_dir):
    i = F.col("event_id")
    s = catalogues.raster_stats(events(spark, sf_dir).select(F.col("user_id").alias("tile_id"), (i % 10).alias("row"), (F.floor(i / 10) % 10).alias("col"), F.when(i % 4 > 0, F.col("value")).alias("z")))
    return s.select("tile_id", "rows", "cols", r6("lowest").alias("lowest"), r6("highest").alias("highest"), "missing")


@registered("seam_sample", q("""SELECT track_id, idx, CASE WHEN lat <= 46.004 AND r0%3 > 0 THEN r0 WHEN lat <= 46.004 AND lat >= 46.002 THEN 100+r1 WHEN lat <= 46.008 THEN 200+r2 END AS ele FROM (SELECT *, CAST(floor((46.004-lat)/0.001) AS DOUBLE) AS r0, CAST(floor((46.006-lat)/0.001) AS DOUBLE) AS r1, CAST(floor((46.008-lat)/0.001) AS DOUBLE) AS r2 FROM (SELECT track_id, idx, lat+0.00003 AS lat FROM trk))""", TRK))
def seam_sample(spark, sf_dir):
    """A first tile with gaps, under a small one on part of it and a large one."""
    tiles = spark.createDataFrame([("a", 0, 14.49, 46.0, 14.51, 46.004), ("b", 2, 14.49, 46.002, 14.51, 46.006), ("c", 1, 14.49, 46.0, 14.51, 46.008)], "tile_id string, ord int, west double, south double, east double, north double")
    n = F.col("id")
    at = [F.floor(n / 20).alias("row"), (n % 20).alias("col")]
    cell = lambda t, rows, z: spark.range(rows * 20).select(F.lit(t).alias("tile_id"), *at, z.alias("z"))
    row = F.floor(n / 20).cast("double")
    cells = cell("a", 5, F.when(row % 3 > 0, row)).unionByName(cell("b", 5, row + 100)).unionByName(cell("c", 9, row + 200))
    p = points(spark, sf_dir).select("track_id", "idx", (F.col("lat") + 0.00003).alias("lat"), "lon")
    return catalogues.seam_sampled(p, tiles, cells, 0.001, 0.002).select("track_id", "idx", "ele")


@registered("catalogue_fields", """SELECT event_id, CASE WHEN event_id%4=0 THEN 'OWN' WHEN event_id%4=1 THEN 'DATA' WHEN event_id%4=2 THEN 'SI_WCS' ELSE 'SI_REST' END AS tag, CAST(date_diff('day', DATE '0001-01-01', make_date(2010+event_id%14, 1+event_id%12, 1+event_id%28))+1 AS BIGINT) AS day,
 NOT (46.5 < 46+event_id%9*CAST(0.1 AS DOUBLE) OR 46.2 > 46+event_id%9*CAST(0.1 AS DOUBLE)+0.15) AS meets, round(14+event_id%9*CAST(0.1 AS DOUBLE),6) AS west, round(CAST(46.5 AS DOUBLE)+event_id%5,6) AS north, event_id%3 > 0 AS degrees FROM events""")  # fmt: skip
def catalogue_fields(spark, sf_dir):
    i = F.col("event_id")
    title = F.format_string("ALS DTM %02d.%02d.%d", 1 + i % 28, 1 + i % 12, 2010 + i % 14)
    here = {"south": 46 + i % 9 * 0.1, "north": 46 + i % 9 * 0.1 + 0.15, "west": F.lit(14.0), "east": F.lit(15.0)}
    there = {"south": F.lit(46.2), "north": F.lit(46.5), "west": F.lit(14.9), "east": F.lit(16.0)}
    x = (14 + i % 9 * 0.1).cast("string")
    text = F.concat(F.lit('{"features":[{"geometry":{"coordinates":[[['), x, F.lit(", 46.25],[15.5,"), (46.5 + i % 5).cast("string"), F.lit("]]]}}]}"))
    box = catalogues.coordinates_box(text)
    big = F.when(i % 3 > 0, 14.0).otherwise(4_500_000.0)
    return events(spark, sf_dir).select(
        "event_id", catalogues.source_tag(F.when(i % 4 == 0, "OWN"), F.when(i % 4 < 2, "DATA"), F.when(i % 4 == 2, "wcs").otherwise("rest"), F.lit("SI")).alias("tag"), catalogues.date_ordinal(title).alias("day"),
        catalogues.boxes_meet(here, there).alias("meets"), r6(box["west"]).alias("west"), r6(box["north"]).alias("north"), catalogues.degree_box(big, F.lit(46.0), F.lit(13.0), F.lit(45.0)).isNotNull().alias("degrees"),
    )


@registered("best_records", """SELECT user_id, arg_max(event_id, (ord + event_id%3, ord, -event_id)) AS pos FROM (SELECT user_id, event_id, event_type, date_diff('day', DATE '0001-01-01', make_date(2010+event_id%14, 1+event_id%12, 1+event_id%28))+1 AS ord FROM events) WHERE event_type <> 'error' GROUP BY 1""")
def best_records(spark, sf_dir):
    i = F.col("event_id")
    title = F.concat(F.when(F.col("event_type") == "error", "ALS DSM ").otherwise("DTM Randomsdorf "), F.format_string("%02d.%02d.%d", 1 + i % 28, 1 + i % 12, 2010 + i % 14))
    r = events(spark, sf_dir).select("user_id", i.alias("pos"), title.alias("title"))
    return catalogues.best_record(r, ["user_id"], F.col("pos") % 3).select("user_id", "pos")


@registered("discovery_points", q("""SELECT track_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx) AS r FROM (SELECT * FROM (SELECT *, max(idx) OVER (PARTITION BY track_id) AS last FROM trk) WHERE idx%5=0 OR idx=last QUALIFY row_number() OVER (PARTITION BY track_id, floor(lat/0.001), floor(lon/0.001) ORDER BY idx) = 1)) WHERE r <= 6""", TRK))
def discovery_points(spark, sf_dir):
    return catalogues.discovery_points(points(spark, sf_dir), 0.001, 5, 6).select("track_id", "idx")


@registered("road_ways", """SELECT event_id AS id, CASE WHEN event_id%4=3 THEN 'tunnel' ELSE 'bridge' END AS kind FROM events WHERE event_id%11 <> 0 AND ((event_id%4=0 AND (event_id%6 <> 0 OR event_id%5=0)) OR event_id%4=1 OR (event_id%4=3 AND event_id%3 <> 0))""")
def road_ways(spark, sf_dir):
    i = F.col("event_id")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    tags = F.array(
        F.when(i % 4 == 0, entry("bridge", F.lit("yes"))), F.when(i % 4 == 1, entry("man_made", F.lit("viaduct"))), F.when(i % 4 == 3, entry("tunnel", F.when(i % 3 == 0, "building_passage").otherwise("yes"))),
        F.when((i % 4 == 0) & (i % 6 == 0), entry("railway", F.lit("tram"))), F.when((i % 4 == 0) & (i % 5 == 0), entry("highway", F.lit("cycleway"))),
    )
    return catalogues.road_ways(events(spark, sf_dir).select(i.alias("id"), F.map_from_entries(F.array_compact(tags)).alias("tags"), (i % 11 == 0).alias("closed")))


@registered("unsupported_countries", """SELECT n_name AS cc, list_sort(list(o))::VARCHAR AS others FROM (SELECT a.n_name, CASE WHEN b.n_nationkey%3=0 THEN b.n_name END AS o FROM nation a JOIN nation b ON b.n_regionkey=a.n_regionkey WHERE a.n_nationkey%3 > 0) WHERE o IS NOT NULL GROUP BY 1""")
def unsupported_countries(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    near = n.select(F.col("n_name").alias("cc"), "n_regionkey").join(n.select("n_regionkey", F.col("n_name").alias("other"), F.col("n_name").alias("priority")), "n_regionkey").drop("n_regionkey")
    found = catalogues.unsupported(n.select(F.col("n_name").alias("cc")), n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("cc")), near)
    return found.where(F.size("others") > 0).select("cc", F.concat(F.lit("["), F.array_join("others", ", "), F.lit("]")).alias("others"))


UX, UY = vec("(lat+0.00001)", "(lon+0.00002)", "lat", "lon")
VX, VY = vec("(lat+0.00001)", "(lon+0.00002)", "nlat", "nlon")


@registered("road_tests", q(f"""SELECT track_id, idx, coalesce({gc('(lat+0.00001)', '(lon+0.00002)', 'lat', 'lon')} < 0.05 OR {gc('(lat+0.00001)', '(lon+0.00002)', 'nlat', 'nlon')} < 0.05 OR (f >= 0 AND f <= 1 AND off <= 1), FALSE) AS on_line FROM (SELECT *, -(ux*(vx-ux)+uy*(vy-uy))/(pow(vx-ux,2)+pow(vy-uy,2)) AS f, abs(ux*(vy-uy)-uy*(vx-ux))/sqrt(pow(vx-ux,2)+pow(vy-uy,2)) AS off FROM
 (SELECT *, {UX} AS ux, {UY} AS uy, {VX} AS vx, {VY} AS vy FROM (SELECT *, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY idx)) WHERE nlat IS NOT NULL))""", TRK))  # fmt: skip
def road_tests(spark, sf_dir):
    nxt = lambda c: F.lead(c).over(intervals.in_order())
    p = points(spark, sf_dir).select("track_id", "idx", "lat", "lon", nxt("lat").alias("nlat"), nxt("lon").alias("nlon")).where(F.col("nlat").isNotNull())
    place = (F.col("lat") + 0.00001, F.col("lon") + 0.00002)
    return p.select("track_id", "idx", catalogues.on_line(place, (F.col("lat"), F.col("lon")), (F.col("nlat"), F.col("nlon"))).alias("on_line"))


@registered("seeded_corrections", q("""SELECT track_id, alo, ahi, source FROM (SELECT track_id, idx AS alo, idx+2 AS ahi, 'structure' AS source FROM trk WHERE idx%9=4 UNION ALL SELECT z.track_id, z.idx, z.idx+3, 'own' FROM trk z WHERE z.idx%14=2 AND NOT EXISTS (SELECT 1 FROM trk o WHERE o.track_id=z.track_id AND o.idx%9=4 AND z.idx+3 > o.idx AND z.idx < o.idx+2))""", TRK))
def seeded_corrections(spark, sf_dir):
    """Corrections of structures, and those of before that overlap none of them."""
    p = points(spark, sf_dir)
    zone = lambda cond, n, source: p.where(cond).select("track_id", F.col("idx").alias("alo"), (F.col("idx") + n).alias("ahi"), F.lit(source).alias("source"))
    new = zone("idx % 9 = 4", 2, "structure")
    return new.unionByName(intervals.without_overlap(zone("idx % 14 = 2", 3, "own"), new))


@registered("gpx_all_points", "SELECT user_id, count(*)*3 AS n, round(sum(46+event_id%10*CAST(0.5 AS DOUBLE))*3,6) AS lat, count(*) AS known FROM events GROUP BY 1")
def gpx_all_points(spark, sf_dir):
    """Track points, route points and waypoints of GPX text; only the first have elevations here."""
    e = events(spark, sf_dir)
    at = lambda tag, more: F.concat_ws("", F.collect_list(F.format_string(f'<{tag} lat="%.2f" lon="14.5">{more}</{tag}>', 46 + F.col("event_id") % 10 * 0.5)))
    t = e.groupBy("user_id").agg(F.concat(F.lit(gpx.HEAD + "<trk><trkseg>"), at("trkpt", "<ele>7</ele>"), F.lit("</trkseg></trk><rte>"), at("rtept", ""), F.lit("</rte>"), at("wpt", ""), F.lit("</gpx>")).alias("gpx"))
    p = gpx.all_points(gpx.parsed(t), "user_id")
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("lat")).alias("lat"), F.count("ele").alias("known"))


@registered("map_structures", "SELECT user_id, CASE WHEN event_id%2=0 THEN 'bridge' ELSE 'tunnel' END AS kind, event_id AS id, event_type AS name FROM events WHERE event_id%7 > 0")
def map_structures(spark, sf_dir):
    """Ways read from map-server answers: a count element opens the bridges and another the tunnels."""
    e = events(spark, sf_dir)
    node = F.when(F.col("event_id") % 7 > 0, F.lit(',{"lat":46.1,"lon":14.2}')).otherwise(F.lit(""))
    way = F.concat(F.lit('{"type":"way","id":'), F.col("event_id").cast("string"), F.lit(',"tags":{"name":"'), "event_type", F.lit('"},"geometry":[{"lat":46.0,"lon":14.1}'), node, F.lit("]}"))
    ways = lambda k: F.concat_ws("", F.collect_list(F.when(F.col("event_id") % 2 == k, F.concat(F.lit(","), way))))
    body = F.concat(F.lit('{"elements":[{"type":"count"}'), ways(0), F.lit(',{"type":"count"}'), ways(1), F.lit("]}"))
    return records.structures(e.groupBy("user_id").agg(body.alias("body")), "user_id").select("user_id", "kind", "id", "name")


@registered("grid_texts", "SELECT user_id, CAST(n//3 AS BIGINT) AS row, CAST(n%3 AS BIGINT) AS col, z FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS n, CASE WHEN event_id%5 > 0 THEN CAST(event_id%90 AS DOUBLE) END AS z FROM events)")
def grid_texts(spark, sf_dir):
    """Rasters as ASCII grids: three cells a row, no data written as -9999."""
    e = events(spark, sf_dir)
    z = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 90).cast("string")).otherwise("-9999")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("event_id", z.alias("z")))), lambda x: x["z"])
    t = e.groupBy("user_id").agg(F.concat(F.lit("--part\nContent-Type: text\n\nncols 3\nnrows 9\nxllcorner 14.5\nyllcorner 46\ncellsize 0.5\nNODATA_value -9999\n"), F.array_join(cells, " ")).alias("value"))
    g = records.ascii_grid(t, "user_id")
    return g.select("user_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "z")


@registered("split_boxes", "SELECT event_id, k, round(46+event_id%7+(k//2)*CAST(0.5 AS DOUBLE),6) AS south, round(14+(k%2)*CAST(1.0 AS DOUBLE),6) AS west FROM (SELECT event_id, unnest(range(4)) AS k FROM events)")
def split_boxes(spark, sf_dir):
    s = 46.0 + F.col("event_id") % 7
    b = records.tile_box(s, F.lit(14.0), s + 1, F.lit(16.0))
    return events(spark, sf_dir).select("event_id", F.posexplode(b).alias("k", "b")).select("event_id", F.col("k").cast("long").alias("k"), r6("b.south").alias("south"), r6("b.west").alias("west"))
