"""Further registered queries: fields of polished lines, edits, projections, views and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import crs, formats, geo, viewport
from trackloom.operators import asof, edits, elevation, fields, tracks
from trackloom.sources import providers, records

from .queries import BACK, PTS, TRK, W, graded, out_and_back, points, q, r6, registered

K = "(20037392.0/pi())"
#: Direction of a leg in radians, 0 = east, from (a, b) to (c, d) in lat/lon.
DIR = "atan2(radians({c}-{a})*" + K + ", radians({d}-{b})*" + K + "*cos(radians(({a}+{c})/2)))"
GC = "2*" + K + "*atan2(sqrt({h}), sqrt(1-{h}))"


def gc(a, b, c, d):
    h = f"(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))"
    return GC.format(h=h)


LEG = TRK + f""",
lg AS (SELECT *, lag(lat) OVER {W} AS plat, lag(lon) OVER {W} AS plon, lead(lat) OVER {W} AS nlat, lead(lon) OVER {W} AS nlon, lead(ele) OVER {W} AS nele FROM trk),
dr AS (SELECT *, {DIR.format(a='plat', b='plon', c='lat', d='lon')} AS da, {DIR.format(a='lat', b='lon', c='nlat', d='nlon')} AS db, {gc('plat', 'plon', 'lat', 'lon')} AS la, {gc('lat', 'lon', 'nlat', 'nlon')} AS lb FROM lg),
tn AS (SELECT *, (db-da) - 2*pi()*floor(0.5+(db-da)/(2*pi())) AS dd FROM dr)"""


@registered("direction_fields", q("""SELECT track_id, idx, round(coalesce(CASE WHEN da IS NULL OR db IS NULL THEN 0.0 ELSE 2*dd/(least(la,10.0)+least(lb,10.0)) END,0.0),6) AS curve, round(cos(o),6) AS east, round(sin(o),6) AS north
 FROM (SELECT *, coalesce(CASE WHEN da IS NULL THEN db WHEN db IS NULL THEN da ELSE da+0.5*dd END, 0.0) AS o FROM tn)""", LEG))  # fmt: skip
def direction_fields(spark, sf_dir):
    d = fields.with_direction(points(spark, sf_dir))
    return d.select("track_id", "idx", r6("curve").alias("curve"), r6(F.cos("direction")).alias("east"), r6(F.sin("direction")).alias("north"))


@registered("course_field", q("SELECT track_id, idx, round(sum(coalesce(la,0.0)) OVER (PARTITION BY track_id ORDER BY idx ROWS UNBOUNDED PRECEDING),5) AS course FROM dr", LEG))
def course_field(spark, sf_dir):
    return fields.with_course(points(spark, sf_dir)).select("track_id", "idx", F.round("course", 5).alias("course"))


@registered("quality_score", q("""SELECT track_id, round(100*sum(t*t)/sum(lb),6) AS score_direction, round(10*sum(coalesce(ch*ch,0.0))/sum(lb*(s*s+1e-4)),6) AS score_altitude FROM (SELECT *, lead(s) OVER (PARTITION BY track_id ORDER BY idx) - s AS ch FROM
 (SELECT *, (nele-ele)/sqrt((nele-ele)*(nele-ele)+lb*lb) AS s, coalesce(dd,0.0) AS t FROM tn WHERE lb >= 0.01 AND NOT (lb < 0.1 AND abs(nele-ele) < 0.01))) GROUP BY 1""", LEG))  # fmt: skip
def quality_score(spark, sf_dir):
    s = fields.quality(points(spark, sf_dir))
    return s.select("track_id", r6("score_direction").alias("score_direction"), r6("score_altitude").alias("score_altitude"))


@registered("chord_deviation", q("""SELECT track_id, round(avg(o),5) AS mean, round(max(o),5) AS most, round(sqrt(avg(o*o)),5) AS rms FROM (SELECT p.track_id, abs(ux*vy-uy*vx)/sqrt(ux*ux+uy*uy) AS o FROM (SELECT p.track_id, radians(b.lon-a.lon)*k*cos(radians((a.lat+b.lat)/2)) AS ux, radians(b.lat-a.lat)*k AS uy, radians(p.lon-a.lon)*k*cos(radians((a.lat+p.lat)/2)) AS vx, radians(p.lat-a.lat)*k AS vy
 FROM (SELECT *, 20037392.0/pi() AS k FROM trk) p JOIN trk a ON a.track_id=p.track_id AND a.idx=5 JOIN trk b ON b.track_id=p.track_id AND b.idx=25 WHERE p.idx > 5 AND p.idx < 25) p) GROUP BY 1""", TRK))  # fmt: skip
def chord_deviation(spark, sf_dir):
    d = fields.deviation(points(spark, sf_dir), 5, 25)
    return d.select("track_id", *[F.round(c, 5).alias(c) for c in ("mean", "most", "rms")])


@registered("ends_meet", q(f"SELECT track_id, max(CASE WHEN idx = n THEN {gc('lat0', 'lon0', 'lat', 'lon')} END) < 40 AS near FROM (SELECT *, max(idx) OVER (PARTITION BY track_id) AS n, first_value(lat) OVER {W} AS lat0, first_value(lon) OVER {W} AS lon0 FROM bk) GROUP BY 1", BACK))
def ends_meet(spark, sf_dir):
    p = out_and_back(spark, sf_dir)
    end = p.groupBy("track_id").agg(F.max_by(F.struct("lat", "lon"), "idx").alias("e"), F.min_by(F.struct("lat", "lon"), "idx").alias("s"))
    return end.select("track_id", (geo.great_circle(F.col("s.lat"), F.col("s.lon"), F.col("e.lat"), F.col("e.lon")) < 40).alias("near"))


@registered("view_points", q("""SELECT track_id, idx FROM (SELECT *, lag(dist) OVER w AS b, lead(dist) OVER w AS a FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY idx)) WHERE (dist >= 100 OR coalesce(a >= 100, TRUE)) AND (dist <= 300 OR coalesce(b < 300, TRUE))"""))
def view_points(spark, sf_dir):
    return edits.visible(points(spark, sf_dir), 100.0, 300.0).select("track_id", "idx")


@registered("view_span", """SELECT event_id, round(CASE WHEN e > 1 THEN greatest(0.0, 1-sp) ELSE greatest(0.0, s) END, 9) AS s, round(least(CASE WHEN s < 0 THEN least(1.0, sp) ELSE e END, 1.0), 9) AS e FROM (SELECT event_id, s, s+sp AS e, sp FROM (SELECT event_id, 0.2 + ((event_id%11)/10.0 - 0.5) AS s, CAST(0.5 AS DOUBLE) AS sp FROM events))""")
def view_span(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s, t = viewport.panned(F.lit(0.2), F.lit(0.7), (F.col("event_id") % 11) / 10 - 0.5)
    return e.select("event_id", F.round(s, 9).alias("s"), F.round(t, 9).alias("e"))


@registered("crop_points", q("""SELECT track_id, count(*) AS n, round(min(dist),5) AS first_m, round(max(dist),5) AS last_m FROM (SELECT track_id, dist FROM pts WHERE dist BETWEEN 55.5 AND 255.5 UNION ALL
 SELECT track_id, cut FROM (SELECT track_id, dist, lead(dist) OVER (PARTITION BY track_id ORDER BY idx) AS nd, unnest([55.5, 255.5]) AS cut FROM pts) WHERE cut > dist AND cut < nd) GROUP BY 1"""))
def crop_points(spark, sf_dir):
    c = edits.cropped(points(spark, sf_dir), 55.5, 255.5)
    return c.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("dist"), 5).alias("first_m"), F.round(F.max("dist"), 5).alias("last_m"))


@registered("zones_after_trim", q("SELECT track_id, greatest(0, idx-12) AS alo, least(39, idx+4-12) AS ahi FROM trk WHERE idx % 9 = 4 AND idx+4 > 12 AND least(39, idx+4-12) > greatest(0, idx-12)", TRK))
def zones_after_trim(spark, sf_dir):
    z = points(spark, sf_dir).where("idx % 9 = 4").select("track_id", F.col("idx").alias("alo"), (F.col("idx") + 4).alias("ahi"))
    return edits.moved_zones(z, "start", 3, 12, 40)


@registered("zone_hit", q("""SELECT track_id, arg_min(zone, (CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN 0.0 ELSE abs((s+e)/2-200) END, zone)) AS zone FROM (SELECT track_id, idx AS zone, dist AS s, dist+25.0 AS e, dist <= 200 AND dist+25 >= 200 AS inside FROM pts WHERE idx%9=4) GROUP BY 1"""))
def zone_hit(spark, sf_dir):
    z = points(spark, sf_dir).where("idx % 9 = 4").select("track_id", F.col("idx").alias("zone"), F.col("dist").alias("start"), (F.col("dist") + 25.0).alias("end"))
    return edits.hit(z, 200.0)


@registered("tile_codes", q("""SELECT track_id, idx, 'CRS3035RES50000mN' || CAST(CAST(floor(y/50000)*50000 AS BIGINT) AS VARCHAR) || 'E' || CAST(CAST(floor(x/50000)*50000 AS BIGINT) AS VARCHAR) AS code FROM (SELECT track_id, idx, 4321000 + b*d*cos(be)*sin(l) AS x, 3210000 + b/d*(cos(b0)*sin(be)-sin(b0)*cos(be)*cos(l)) AS y
 FROM (SELECT *, rq*sqrt(2/(1+sin(b0)*sin(be)+cos(b0)*cos(be)*cos(l))) AS b, 6378137.0*cos(f0)/(sqrt(1-e2*pow(sin(f0),2))*rq*cos(b0)) AS d FROM (SELECT *, asin(qq/qp) AS be, asin(q0/qp) AS b0, 6378137.0*sqrt(qp/2) AS rq FROM (SELECT *, (1-e2)*(s/(1-e2*s*s)+atanh(e1*s)/e1) AS qq, (1-e2)*(1/(1-e2)+atanh(e1)/e1) AS qp, (1-e2)*(s0/(1-e2*s0*s0)+atanh(e1*s0)/e1) AS q0
 FROM (SELECT track_id, idx, sin(radians(lat+idx*0.02)) AS s, radians(lon-10) AS l, radians(52.0) AS f0, sin(radians(52.0)) AS s0, (2-1/298.257222101)/298.257222101 AS e2, sqrt((2-1/298.257222101)/298.257222101) AS e1 FROM trk)))))""", TRK))  # fmt: skip
def tile_codes(spark, sf_dir):
    return points(spark, sf_dir).select("track_id", "idx", crs.tile_code(F.col("lat") + F.col("idx") * F.lit(0.02), F.col("lon")).alias("code"))


RULES = {
    "wcs": "v IS NULL OR abs(v) > 1e37 OR v < -9998 OR v = 0", "wcs-coast": "v IS NULL OR abs(v) > 1e37 OR v < -9998", "de": "v IS NULL OR abs(v) > 1e37 OR v < -100 OR v = 0",
    "us": "v IS NULL OR abs(v) > 1e37 OR v < -500", "no": "v IS NULL OR abs(v) > 1e37 OR v < -100", "dk": "v IS NULL OR abs(v) > 1e37 OR v < -100", "pl": "v IS NULL OR abs(v) > 1e37",
}
SENSED = "SELECT event_id, CASE event_id%8 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN -9999.0 WHEN 3 THEN -200.0 WHEN 4 THEN 1e38 WHEN 5 THEN -600.0 WHEN 6 THEN 77.0 ELSE value END AS v FROM events"


@registered("sensor_missing", "SELECT event_id, " + ", ".join(f"{rule} AS {name.replace('-', '_')}" for name, rule in RULES.items()) + f", v IS NULL OR abs(v) > 1e37 OR v = 77 AS tagged FROM ({SENSED})")
def sensor_missing(spark, sf_dir):
    """What counts as no data by the rules of every provider family, and by a raster's own tag."""
    i, v = F.col("event_id") % 8, F.col("value")
    for k, z in ((6, 77.0), (5, -600.0), (4, 1e38), (3, -200.0), (2, -9999.0), (1, None), (0, 0.0)):
        v = F.when(i == k, F.lit(z).cast("double")).otherwise(v)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", v.alias("v"))
    found = [elevation.is_missing(F.col("v"), **rule).alias(name.replace("-", "_")) for name, rule in elevation.MISSING_RULES.items()]
    return e.select("event_id", *found, elevation.is_missing(F.col("v"), tag=F.lit(77.0)).alias("tagged"))


@registered("raster_sample", q("""SELECT track_id, idx, 1000*(CASE WHEN lat > 46.0039 THEN 2 ELSE 0 END + CASE WHEN lon > 14.50007 THEN 1 ELSE 0 END) + r*10 + c AS ele FROM (SELECT *, floor(((CASE WHEN lat > 46.0039 THEN 46.0139 ELSE 46.0039 END)-lat)/0.001) AS r, floor((lon-(CASE WHEN lon > 14.50007 THEN 14.50007 ELSE 14.49 END))/0.001) AS c FROM (SELECT track_id, idx, lat+0.00003 AS lat, lon FROM trk) WHERE lat <= 46.0139)""", TRK))
def raster_sample(spark, sf_dir):
    """Four tiles, two by two; points north of them have no height."""
    tiles = [("t0", 0, 14.49, 45.9939, 14.50007, 46.0039), ("t1", 1, 14.50007, 45.9939, 14.51, 46.0039), ("t2", 2, 14.49, 46.0039, 14.50007, 46.0139), ("t3", 3, 14.50007, 46.0039, 14.51, 46.0139)]
    n = F.col("id")
    cells = spark.range(400).select(F.concat(F.lit("t"), F.floor(n / 100).cast("string")).alias("tile_id"), (F.floor(n / 10) % 10).alias("row"), (n % 10).alias("col"), (F.floor(n / 100) * 1000 + n % 100).cast("double").alias("z"))
    cells = cells.unionByName(cells.where("col = 9").withColumn("col", F.col("col") + 1).withColumn("z", F.col("z") + 1))
    grid = spark.createDataFrame(tiles, "tile_id string, ord int, west double, south double, east double, north double")
    p = points(spark, sf_dir).select("track_id", "idx", (F.col("lat") + 0.00003).alias("lat"), "lon").where("lat <= 46.0139")
    return providers.raster(cells, grid, 0.001)(p)


@registered("header_counts", "SELECT user_id, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2")
def header_counts(spark, sf_dir):
    """Counts written as a header and read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    h = e.groupBy("user_id").agg(F.array_join(F.collect_list(F.concat_ws(":", "event_type", "n")), ",").alias("h"))
    return h.select("user_id", F.explode(formats.source_counts(F.col("h"))).alias("source", "n"))


@registered("file_parts", r"""SELECT event_id, trim(regexp_replace(regexp_replace(event_type || '/ a:' || user_id || '  *b', '[<>:"/\\|?*\x00-\x1F]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM events""")
def file_parts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", formats.file_part(F.concat("event_type", F.lit("/ a:"), F.col("user_id").cast("string"), F.lit("  *b"))).alias("name"))


@registered("leg_merge", q("SELECT track_id AS route_id, idx, round(lat,9) AS lat, round(lon,9) AS lon FROM trk", TRK))
def leg_merge(spark, sf_dir):
    """Tracks cut into legs that share their end points, and put together again."""
    p = points(spark, sf_dir)
    last = F.max("idx").over(tracks.Window.partitionBy("track_id"))
    own = F.floor(F.col("idx") / 10)
    shared = (F.col("idx") % 10 == 0) & (F.col("idx") > 0)
    leg = F.explode(F.array_compact(F.array(F.when(shared, own - 1), F.when(~shared | (F.col("idx") < F.col("last")), own))))
    legs = p.withColumn("last", last).select("track_id", "idx", "lat", "lon", leg.alias("leg")).groupBy(F.col("track_id").alias("route_id"), "leg").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))).alias("coordinates"))
    return records.merged_legs(legs).select("route_id", "idx", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@registered("line_round_trip", q("SELECT track_id, idx, round(lat,6) AS lat, round(lon,6) AS lon FROM trk", TRK))
def line_round_trip(spark, sf_dir):
    """Tracks encoded as polylines and decoded again."""
    lines = records.decoded(records.encoded(points(spark, sf_dir)), "line")
    return lines.select("track_id", F.posexplode("coordinates").alias("idx", "c")).select("track_id", F.col("idx").cast("long").alias("idx"), F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@registered("dense_enough", q("SELECT track_id, m > 11.2 AS sparse, CASE WHEN m > 11.2 THEN CAST(greatest(2, floor(d/5+0.5)+1) AS BIGINT) END AS n FROM (SELECT track_id, max(dist) AS d, max(dist)/nullif(max(idx),0) AS m FROM pts GROUP BY 1)", PTS))
def dense_enough(spark, sf_dir):
    """Tracks whose points lie too far apart on average: only those are resampled before a lookup, to n points."""
    p = points(spark, sf_dir)
    mean = p.groupBy("track_id").agg((F.max("dist") / F.nullif(F.max("idx"), F.lit(0))).alias("m"))
    sparse = mean.select("track_id", (F.col("m") > 11.2).alias("sparse"))
    made = asof.resampled(p.join(sparse.where("sparse"), "track_id"), 5.0).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    return sparse.join(made, "track_id", "left").select("track_id", "sparse", "n")


for _name, _change in {"shape_arcs": "with_arcs", "shape_loops": "with_loops", "shape_straight": "straightened", "shape_prune": "pruned", "shape_all": "shaped"}.items():

    @registered(_name)
    def _shape(spark, sf_dir, change=_change):
        from trackloom.operators import shape

        return shape.on_tracks(points(spark, sf_dir), getattr(shape, change))
