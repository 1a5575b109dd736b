"""Registered queries of the expression functions, and of edits of queues, zones and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import crs, formats, geo, viewport
from trackloom.operators import edits, fields, kernels, lines, tracks
from trackloom.sources import gpx
from trackloom.streaming import queue

from .queries import TRK, W, points, q, r6, registered
from .recurrences import K

PI2 = "(2*pi())"


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def reduced(x: str) -> str:
    return f"(({x}) - {PI2}*floor(0.5+({x})/{PI2}))"


XY = "SELECT event_id, (event_id%37-18)*CAST(0.41 AS DOUBLE) AS x, (event_id%53-26)*CAST(0.33 AS DOUBLE) AS y FROM events"


def xy(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", ((F.col("event_id") % 37 - 18) * F.lit(0.41)).alias("x"), ((F.col("event_id") % 53 - 26) * F.lit(0.33)).alias("y"))


@registered("angle_functions", f"""SELECT event_id, round({reduced('x')},9) AS reduced, round({reduced('y-x')},9) AS delta, round({reduced('x+0.5*' + reduced('y-x'))},9) AS mean, round((y-x)*97 - 360*floor(0.5+(y-x)*97/360),9) AS degrees,
 round(CASE WHEN x/7 < -1 THEN 1.0 WHEN x/7 > 1 THEN 0.0 ELSE (1-sin(x/7*pi()/2))/2 END,9) AS wave, round(CASE WHEN event_id%2=0 THEN (y-x)-5*floor(0.5+(y-x)/5) ELSE y-x END,9) AS round_loop FROM ({XY})""")  # fmt: skip
def angle_functions(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    made = {
        "reduced": geo.reduce_angle(x), "delta": geo.delta_angle(x, y), "mean": geo.average_angles(x, y), "degrees": geo.delta_longitude(x * 97, y * 97),
        "wave": geo.transition(x / 7), "round_loop": geo.loop_difference(x, y, F.lit(5.0), F.col("event_id") % 2 == 0),
    }
    return xy(spark, sf_dir).select("event_id", *[F.round(c, 9).alias(n) for n, c in made.items()])


@registered("plane_vectors", f"""SELECT event_id, round(d,9) AS dot, round(c,9) AS crossed, round(atan2(c,d),9) AS turn, coalesce(d < -0.98, FALSE) AS u_turn, round(46+degrees(y*100/{K}),9) AS lat, round(14+degrees(x*100/({K}*cos(radians(46+degrees(y*100/{K})/2)))),9) AS lon,
 round(46+degrees(-3*cos(x)/{K}),9) AS right_lat, round(sqrt(x*x+y*y)*sqrt((x-2)*(x-2)+(y-1)*(y-1))*sqrt(CAST(5 AS DOUBLE))/nullif(2*abs(x*1-y*2),0.0),6) AS radius
 FROM (SELECT *, (x*2+y)/nullif(sqrt((x*x+y*y)*5),0.0) AS d, (x-y*2)/nullif(sqrt((x*x+y*y)*5),0.0) AS c FROM ({XY}))""")  # fmt: skip
def plane_vectors(spark, sf_dir):
    v = (F.col("x"), F.col("y"), F.lit(2.0), F.lit(1.0))
    lat, lon = geo.add_vector(F.lit(46.0), F.lit(14.0), v[0] * 100, v[1] * 100)
    right, _ = geo.shift_point(F.lit(46.0), F.lit(14.0), v[0], F.lit(3.0))
    r9 = lambda c, n: F.round(c, 9).alias(n)
    return xy(spark, sf_dir).select(
        "event_id", r9(geo.dot(*v), "dot"), r9(geo.cross(*v), "crossed"), r9(geo.vertex_angle(*v), "turn"), geo.is_u_turn(*v).alias("u_turn"), r9(lat, "lat"), r9(lon, "lon"), r9(right, "right_lat"),
        F.round(geo.circle_radius(F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y"), F.lit(2.0), F.lit(1.0)), 6).alias("radius"),
    )


@registered("hermite_curve", "SELECT event_id, round((2*t*t*t-3*t*t+1)*300 + (t*t*t-2*t*t+t)*80*0.05 + (3*t*t-2*t*t*t)*310 + (t*t*t-t*t)*80*-0.02,9) AS ele FROM (SELECT event_id, (event_id%101)/CAST(100 AS DOUBLE) AS t FROM events)")
def hermite_curve(spark, sf_dir):
    t = (F.col("event_id") % 101) / 100.0
    return events(spark, sf_dir).select("event_id", F.round(geo.hermite(t, F.lit(300.0), F.lit(310.0), F.lit(0.05), F.lit(-0.02), F.lit(80.0)), 9).alias("ele"))


@registered("text_formats", """SELECT event_id, CASE WHEN s >= 3600 THEN CAST(floor(s/3600) AS BIGINT) || 'h ' || CAST(floor(s/60) AS BIGINT)%60 || 'm' ELSE CAST(floor(s/60) AS BIGINT) || 'm ' || lpad(CAST(CAST(floor(s-60*floor(s/60)+0.5) AS BIGINT) AS VARCHAR),2,'0') || 's' END AS long_time,
 CASE WHEN m >= 1000 THEN printf('%.1f km', m/1000) ELSE printf('%.0f m', m) END AS metres, printf('%.2f km', m/1000) AS km, printf('%.0f m', m) AS height, printf('%.1f', m/300) || '%' AS grade, format('{:,}', event_id*12345) AS counted, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.0f KB', b/1024.0) ELSE printf('%.1f MB', b/1048576.0) END AS bytes
 FROM (SELECT event_id, CAST(event_id%9000 AS DOUBLE) AS s, (event_id%977)*CAST(3.7013 AS DOUBLE) AS m, event_id*332+1 AS b FROM events)""")  # fmt: skip
def text_formats(spark, sf_dir):
    s, m, b = (F.col("event_id") % 9000).cast("double"), (F.col("event_id") % 977) * F.lit(3.7013), F.col("event_id") * 332 + 1
    return events(spark, sf_dir).select(
        "event_id", formats.time_long(s).alias("long_time"), formats.distance(m).alias("metres"), formats.kilometres(m).alias("km"), formats.elevation(m).alias("height"), formats.grade(m / 300).alias("grade"),
        formats.thousands(F.col("event_id") * 12345).alias("counted"), formats.file_size(b).alias("bytes"),
    )


@registered("name_formats", r"""SELECT event_id, trim(substring(event_type || ' street',1,9)) AS clipped, CASE WHEN event_id%3=0 THEN event_type || ' road' WHEN event_id%3=1 THEN 'town ' || user_id ELSE 'Here' END AS place,
 CASE WHEN event_id%5=0 THEN 'fallback' WHEN event_id%5=1 THEN 'a b-loop' ELSE 'a b-' || event_type END AS download, printf('%.5f,%.5f', 46+event_id%90*0.00101, 14+event_id%70*0.00203) AS key, CASE WHEN event_id%4=0 THEN event_type WHEN event_id%4=1 THEN 'Path' WHEN event_id%4=2 THEN 'Bridge' ELSE 'Tunnel' END AS structure,
 regexp_replace(event_type || ' x/' || user_id, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, CASE WHEN event_id%3=0 THEN 'else' ELSE 'd/' || event_type || '.tif' END AS path, event_id%2=0 AS is_number FROM events""")  # fmt: skip
def name_formats(spark, sf_dir):
    i, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    address = F.when(i % 3 == 0, F.create_map(F.lit("road"), F.concat(kind, F.lit(" road")))).when(i % 3 == 1, F.create_map(F.lit("town"), F.concat(F.lit("town "), user)))
    tags = F.when(i % 4 == 0, F.create_map(F.lit("name"), kind)).when(i % 4 == 1, F.create_map(F.lit("highway"), F.lit("path"))).when(i % 4 == 2, F.create_map(F.lit("bridge"), F.lit("yes")))
    return events(spark, sf_dir).select(
        "event_id", formats.clip(F.concat(kind, F.lit(" street")), 9).alias("clipped"), formats.place_label(address, F.lit("Here, there")).alias("place"),
        formats.download_name(F.when(i % 5 > 0, F.lit(' a/b ')), F.when(i % 5 == 1, F.lit("A B")).otherwise(kind), F.lit("fallback")).alias("download"),
        formats.coordinate_key(46 + i % 90 * 0.00101, 14 + i % 70 * 0.00203).alias("key"), formats.structure_name(tags).alias("structure"), formats.safe_name(F.concat(kind, F.lit(" x/"), user)).alias("safe"),
        formats.safe_path(F.when(i % 3 == 0, F.lit("a/../b")).otherwise(F.concat(F.lit("/d/"), kind, F.lit(".tif"))), F.lit("else")).alias("path"), geo.is_numeric(F.when(i % 2 == 0, F.lit("12.5")).otherwise(kind)).alias("is_number"),
    )


@registered("chart_places", """SELECT event_id, round(CASE WHEN e0 > 1 THEN greatest(0.0, 1-sp) ELSE greatest(0.0, s) END,9) AS zoom_from, round(least(e0, 1.0),9) AS zoom_to, round(greatest(0.0, least(lo, 1.0)),9) AS around_from, round(least(1.0, hi),9) AS around_to,
 round(10 + (v-20)/30*400,6) AS pixel, round(sqrt(pow(v - t*40, 2) + pow(5 - t*9, 2)),6) AS off, CAST(round_even(v*0.5, 0) AS BIGINT) AS whole, CAST(50000 AS BIGINT) AS tile_size, CAST(event_id%40*50000 AS BIGINT) AS tile_north
 FROM (SELECT *, CASE WHEN s < 0 THEN least(1.0, sp) ELSE s+sp END AS e0, greatest(0.0, least(1.0, (v*40+5*9)/(CAST(1681 AS DOUBLE)))) AS t, greatest(0.0, (v*10-pad)/1000) AS lo, least(1.0, (v*10+50+pad)/1000) AS hi FROM (SELECT *, 0.3 + least(1.0, c)*0.4 - c*sp AS s, greatest(50*0.8, 10.0) AS pad FROM
 (SELECT event_id, (event_id%11)/CAST(10 AS DOUBLE) AS c, CAST(0.4*1.5 AS DOUBLE) AS sp, CAST(event_id%60 AS DOUBLE) AS v FROM events)))""")  # fmt: skip
def chart_places(spark, sf_dir):
    i = F.col("event_id")
    v, c = (i % 60).cast("double"), (i % 11) / 10.0
    a, b = viewport.zoomed(F.lit(0.3), F.lit(0.7), c, 1.5)
    s, t = viewport.around(v * 10, v * 10 + 50, F.lit(1000.0))
    code = crs.parsed_tile_code(F.concat(F.lit("x CRS3035RES50000mN"), (i % 40 * 50000).cast("string"), F.lit("E4500000.tif")))
    return events(spark, sf_dir).select(
        "event_id", F.round(a, 9).alias("zoom_from"), F.round(b, 9).alias("zoom_to"), F.round(s, 9).alias("around_from"), F.round(t, 9).alias("around_to"),
        r6(viewport.to_pixel(v, F.lit(20.0), F.lit(50.0), 400.0, 10.0)).alias("pixel"), r6(viewport.pixel_distance(v, F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(40.0), F.lit(9.0))).alias("off"),
        crs.pixels(v, 0.5).alias("whole"), code["size"].alias("tile_size"), code["north"].alias("tile_north"),
    )


@registered("queue_states", """SELECT id, CASE WHEN id%10=3 AND st <> 'done' THEN 'parked' ELSE st END AS status, size, id%10=3 AND st <> 'done' AND source IS NULL AS raw FROM (SELECT event_id AS id, CASE WHEN event_id%7=0 THEN 'done' ELSE 'pending' END AS st, CASE WHEN event_id%7=0 THEN 1.0 ELSE value END AS size, CASE WHEN event_id%4=0 THEN 'WCS' END AS source FROM events) WHERE size > 0 AND id%13 <> 5""")
def queue_states(spark, sf_dir):
    """A queue of files whose rows are replaced, parked and removed."""
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.lit("pending").alias("status"), F.col("value").alias("size"), F.when(F.col("event_id") % 4 == 0, "WCS").alias("source"))
    done = e.where("id % 7 = 0").withColumn("status", F.lit("done")).withColumn("size", F.lit(1.0))
    state = queue.advanced(queue.upsert(queue.smallest_first(e.unionByName(done.limit(0))), done), e.where("id % 10 = 3"), "parked")
    kept = queue.removed(state, e.where("id % 13 = 5"))
    raw = queue.parked_raw(kept).select("id", F.lit(True).alias("raw"))
    return kept.join(raw, "id", "left").select("id", "status", "size", F.coalesce("raw", F.lit(False)).alias("raw"))


@registered("route_edits", q("""SELECT route_id, leg, round(alat,6) AS alat, round(blat,6) AS blat FROM (SELECT track_id AS route_id, row_number() OVER w - 1 AS leg, lat AS alat, lead(lat) OVER w AS blat, ord FROM (SELECT track_id, CAST(idx AS DOUBLE) AS ord, lat FROM trk WHERE idx < 9 AND idx <> 5 UNION ALL SELECT DISTINCT track_id, 2.5, CAST(45.5 AS DOUBLE) FROM trk) WINDOW w AS (PARTITION BY track_id ORDER BY ord)) WHERE blat IS NOT NULL AND leg IN (2, 3, 5)""", TRK))
def route_edits(spark, sf_dir):
    """A waypoint put in and one taken out: the legs that have to be routed anew."""
    w = points(spark, sf_dir).where("idx < 9").select(F.col("track_id").alias("route_id"), F.col("idx").alias("ord"), "lat", "lon")
    after = queue.without_waypoint(queue.with_waypoint(w, 3, 45.5, 14.5), 6)
    anew = queue.legs_to_route(queue.legs(w), queue.legs(after))
    return anew.where(F.col("leg").isin(2, 3, 5)).select("route_id", "leg", F.round("alat", 6).alias("alat"), F.round("blat", 6).alias("blat"))


@registered("zone_edits", q("SELECT track_id, zone, (zone%2=0) <> (zone IN (4, 13)) AS accepted, CASE WHEN zone IN (4, 13) AND zone%2<>0 THEN 'uniform' ELSE 'none' END AS interp, zone = 22 AS rejected FROM (SELECT track_id, idx AS zone FROM trk WHERE idx%9=4)", TRK))
def zone_edits(spark, sf_dir):
    """Zones accepted and rejected by hand. Zone 13 is accepted and so gets a shape; 4, which was, no longer is."""
    z = points(spark, sf_dir).where("idx % 9 = 4").select("track_id", F.col("idx").alias("zone"), (F.col("idx") % 2 == 0).alias("accepted"), F.lit("none").alias("interp"), F.lit(False).alias("rejected"))
    done = edits.rejected(edits.accepted(z, [4, 13]), [22])
    return done.select("track_id", "zone", "accepted", "interp", "rejected")


@registered("restored_points", q("SELECT track_id, idx, round(CASE WHEN idx BETWEEN 5 AND 9 THEN ele WHEN idx%3=0 THEN ele+2 WHEN idx%3=1 THEN ele+1 ELSE ele END,6) AS best FROM trk", TRK))
def restored_points(spark, sf_dir):
    """Smoothed, else fixed, else measured elevation, and the measured one again in a range."""
    p = points(spark, sf_dir).withColumn("ele_smoothed", F.when(F.col("idx") % 3 == 0, F.col("ele") + 2)).withColumn("ele_fixed", F.when(F.col("idx") % 3 == 1, F.col("ele") + 1))
    return edits.restored(p.withColumn("best", edits.best_elevation()), 5, 9, "best").select("track_id", "idx", r6("best").alias("best"))


@registered("reversed_line", q("SELECT track_id, n-idx AS idx, round(lat,9) AS lat, round(ele,6) AS ele FROM (SELECT *, max(idx) OVER (PARTITION BY track_id) AS n FROM trk)", TRK))
def reversed_line(spark, sf_dir):
    return tracks.reversed_tracks(points(spark, sf_dir)).select("track_id", "idx", F.round("lat", 9).alias("lat"), r6("ele").alias("ele"))


LANE = TRK + f""",
lm AS (SELECT track_id, idx, radians(lon-avg(lon) OVER t)*{K}*cos(radians(avg(lat) OVER t)) AS x, radians(lat-avg(lat) OVER t)*{K} AS y, avg(lat) OVER t AS mlat, avg(lon) OVER t AS mlon FROM trk WINDOW t AS (PARTITION BY track_id)),
ld AS (SELECT *, lead(x) OVER {W} - x AS dx, lead(y) OVER {W} - y AS dy FROM lm),
lu AS (SELECT *, dy/greatest(sqrt(dx*dx+dy*dy),1e-12) AS nx, -dx/greatest(sqrt(dx*dx+dy*dy),1e-12) AS ny FROM ld),
lb AS (SELECT *, lag(nx) OVER {W} AS px, lag(ny) OVER {W} AS py FROM lu),
lc AS (SELECT *, coalesce(px,0)+coalesce(nx,0) AS bx, coalesce(py,0)+coalesce(ny,0) AS by_ FROM lb),
le AS (SELECT *, bx/greatest(sqrt(bx*bx+by_*by_),1e-12) AS ux, by_/greatest(sqrt(bx*bx+by_*by_),1e-12) AS uy FROM lc),
lf AS (SELECT *, least(1.5/greatest(CASE WHEN px IS NULL OR nx IS NULL THEN 1.0 ELSE ux*px+uy*py END, 0.25), 3.0) AS reach FROM le)"""


@registered("shape_lane", q(f"SELECT track_id, idx, round(mlat + degrees((y+uy*reach)/{K}),8) AS lat, round(mlon + degrees((x+ux*reach)/({K}*cos(radians(mlat)))),8) AS lon FROM lf", LANE))
def shape_lane(spark, sf_dir):
    return lines.lane_shifted(points(spark, sf_dir), 1.5).select("track_id", "idx", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@registered("gpx_kernels", q("""SELECT 'ride-' || track_id || '.gpx' AS track_id, count(*) AS n, round(max(dist),3) AS length FROM pts GROUP BY 1"""))
def gpx_kernels(spark, sf_dir):
    """GPX text with names for track ids, read and run through kernels; what they return has the track's length."""
    made = gpx.to_gpx(tracks.derived_tracks(events(spark, sf_dir)).withColumn("track_id", F.concat(F.lit("ride-"), F.col("track_id").cast("string"), F.lit(".gpx"))))
    p = tracks.with_distance(gpx.track_points(gpx.parsed(made), "track_id"))
    bare = kernels.box_groups(kernels.dip_smoothed(kernels.vegetation_filtered(p)))
    return bare.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("dist"), 3).alias("length"))


@registered("reversed_fields", q(f"SELECT track_id, n-idx AS idx, round(t-course,5) AS course FROM (SELECT *, max(idx) OVER (PARTITION BY track_id) AS n, max(course) OVER (PARTITION BY track_id) AS t FROM (SELECT track_id, idx, sum(coalesce(2*{K}*atan2(sqrt(h),sqrt(1-h)),0.0)) OVER (PARTITION BY track_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS course FROM (SELECT *, pow(sin(radians(lat-lag(lat) OVER {W})/2),2)+cos(radians(lag(lat) OVER {W}))*cos(radians(lat))*pow(sin(radians(lon-lag(lon) OVER {W})/2),2) AS h FROM trk)))", TRK))
def reversed_fields(spark, sf_dir):
    f = fields.reversed_fields(fields.with_course(fields.with_direction(points(spark, sf_dir))))
    return f.select("track_id", "idx", F.round("course", 5).alias("course"))
