"""Registered queries of matching, of what is written and read back, and of versions and queues."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom import scratch
from trackloom.functions import geo
from trackloom.operators import matching
from trackloom.sources import gpx, layout, providers, records
from trackloom.streaming import queue

from .function_queries import events
from .queries import BACK, TRK, W, hav, out_and_back, points, q, registered

MATCH = BACK + f""",
pla AS (SELECT track_id, idx // 7 AS ord, lat + 0.00003::DOUBLE AS lat, lon - 0.00002::DOUBLE AS lon FROM bk WHERE idx%7 = 3),
cnt AS (SELECT track_id, max(idx) AS last FROM bk GROUP BY 1),
mat AS (SELECT track_id, CAST(-1 AS BIGINT) AS ord, CAST(-1 AS BIGINT) AS idx FROM cnt UNION ALL
 SELECT track_id, ord, arg_min(idx, (round(d, 6), idx)) AS idx FROM (SELECT p.track_id, p.ord, b.idx, {hav('p.lat', 'p.lon', 'b.lat', 'b.lon')} AS d FROM mat m JOIN pla p ON p.track_id=m.track_id AND p.ord=m.ord+1 JOIN cnt c ON c.track_id=m.track_id
 JOIN bk b ON b.track_id=m.track_id AND b.idx >= least(m.idx+1, c.last) AND b.idx < least(m.idx+1, c.last) + greatest(200, CAST(floor((c.last+1)*0.3) AS BIGINT))) GROUP BY 1, 2)"""


def places(spark, sf_dir):
    p = out_and_back(spark, sf_dir)
    at = p.where("idx % 7 = 3").select("track_id", F.floor(F.col("idx") / 7).alias("ord"), (F.col("lat") + 0.00003).alias("lat"), (F.col("lon") - 0.00002).alias("lon"))
    return at, p


@registered("waypoint_match", "WITH RECURSIVE " + MATCH.strip() + "\nSELECT track_id, ord, idx FROM mat WHERE ord >= 0")
def waypoint_match(spark, sf_dir):
    """Waypoints of rides out and back on the points they belong to, in order."""
    return matching.matched(*places(spark, sf_dir))


@registered("leg_rebuild", "WITH RECURSIVE " + MATCH.strip() + """
SELECT s.track_id, s.ord AS split, b.idx - s.idx AS idx, round(b.lat, 8) AS lat FROM (SELECT *, lead(idx) OVER (PARTITION BY track_id ORDER BY ord) AS nxt FROM mat WHERE ord >= 0) s JOIN bk b ON b.track_id=s.track_id AND b.idx BETWEEN s.idx AND s.nxt WHERE s.nxt > s.idx""")
def leg_rebuild(spark, sf_dir):
    """The points between waypoints that follow each other, both ends included."""
    at, p = places(spark, sf_dir)
    legs = records.split_points(p, matching.between(matching.matched(at, p)))
    return legs.select("track_id", "split", "idx", F.round("lat", 8).alias("lat"))


@registered("table_round_trip", q("SELECT 'r' AS run, track_id, idx, lat, CASE WHEN idx%4 > 0 THEN ele END AS ele FROM trk", TRK))
def table_round_trip(spark, sf_dir):
    """Points as delimited text with a column of one value more, and read back: null is empty, doubles keep all digits."""
    out = f"{scratch.folder(spark)}/table-{uuid.uuid4().hex}"
    p = points(spark, sf_dir).select("track_id", "idx", "lat", F.when(F.col("idx") % 4 > 0, F.col("ele")).alias("ele"))
    records.write_table(p, out, "\t", {"run": "r"})
    back = spark.read.option("header", True).option("sep", "\t").schema("track_id long, idx long, lat double, ele double, run string").csv(out)
    return back.select("run", "track_id", "idx", "lat", "ele")


@registered("catalogue_round_trip", "SELECT user_id AS catalogue, 'tile_' || event_id AS tile_id, event_id/8.0::DOUBLE AS west, event_id/8.0::DOUBLE + 1 AS east, 'tile_' || event_id || '.tif' AS path FROM events")
def catalogue_round_trip(spark, sf_dir):
    """Tile indexes written as JSON, one a user, and scanned again."""
    i = F.col("event_id")
    tile = F.struct(i.alias("at"), F.concat(F.lit("tile_"), i).alias("id"), F.array(i / 8.0, F.lit(0.0), i / 8.0 + 1, F.lit(1.0)).alias("bbox"))
    made = events(spark, sf_dir).groupBy(F.col("user_id").alias("catalogue")).agg(F.array_sort(F.collect_list(tile)).alias("tiles"))
    out = f"{scratch.folder(spark)}/catalogues-{uuid.uuid4().hex}"
    layout.write_catalogues(made, out)
    files = layout.read_catalogues(spark, out, "catalogue")
    found = layout.tile_index(layout.catalogue_entries(files, "catalogue"), "catalogue", "DS")
    return found.select("catalogue", "tile_id", "west", "east", "path")


@registered("plane_products", q(f"""SELECT track_id, idx, round(dl - 360.0*floor(0.5+dl/360.0), 8) AS delta, round((ax*by_-ay*bx)/nullif(sqrt((ax*ax+ay*ay)*(bx*bx+by_*by_)), 0.0), 6) AS crossed FROM (SELECT track_id, idx, lead(lon*13) OVER {W} - lon*13 + (idx%5)*170 AS dl, radians(lead(lon) OVER {W}-lon) AS ax, radians(lead(lat) OVER {W}-lat) AS ay, radians(lead(lon, 2) OVER {W}-lon) AS bx, radians(lead(lat, 2) OVER {W}-lat) AS by_ FROM trk)""", TRK))
def plane_products(spark, sf_dir):
    """Differences of longitude by the short way, and cross products of directions."""
    from trackloom.operators.tracks import in_order

    nxt = lambda c, n=1: F.radians(F.lead(c, n).over(in_order()) - F.col(c))
    far = F.lead(F.col("lon") * 13).over(in_order()) + F.col("idx") % 5 * 170
    return points(spark, sf_dir).select("track_id", "idx", F.round(geo.delta_longitude(F.col("lon") * 13, far), 8).alias("delta"), F.round(geo.cross(nxt("lon"), nxt("lat"), nxt("lon", 2), nxt("lat", 2)), 6).alias("crossed"))


@registered("version_walk", "SELECT user_id, count(*) AS n, 2 AS version FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def version_walk(spark, sf_dir):
    """Versions of a table: four are pushed of which three are kept, undone twice, redone once, and one is pushed over the
    rest: what is current then, with how many versions there are."""
    e = events(spark, sf_dir)
    h = queue.History(spark, f"{scratch.folder(spark)}/versions", most=3)
    for n in (7, 5, 4, 2):
        h.push(e.where(F.col("event_id") % n == 0))
    h.undo(), h.undo(), h.undo(), h.redo()  # to the first that is kept, and on
    h.undo()
    h.push(e.where(F.col("event_id") % 3 == 0))
    return h.current().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.lit(len(h.versions)).alias("version"))


@registered("first_pending", "SELECT event_id AS id, seq, TRUE AS pending FROM (SELECT event_id, event_id%977*100000 + event_id AS seq FROM events WHERE event_type <> 'error' AND event_id%3 > 0) ORDER BY seq LIMIT 1")
def first_pending(spark, sf_dir):
    """The entry that the worker takes next."""
    i = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "failed").when(i % 3 == 0, "done").otherwise("pending")
    state = events(spark, sf_dir).select(i.alias("id"), (i % 977 * 100000 + i).alias("seq"), status.alias("status"))
    return queue.first_pending(state).select("id", "seq", F.lit(queue.has_pending(state)).alias("pending"))


@registered("provider_replay", q("""SELECT track_id, idx, CASE WHEN (idx+m)%3 = 0 AND idx%6 <> 0 THEN 200.0::DOUBLE+idx WHEN idx%2 = 0 THEN 300.0::DOUBLE+idx END AS ele, CASE WHEN (idx+m)%3 = 0 AND idx%6 <> 0 THEN 'FINE' WHEN idx%2 = 0 THEN 'COARSE' END AS source FROM (SELECT track_id, idx, CAST(round((lon-14.5)/0.00002) AS BIGINT) AS m FROM trk)""", TRK))
def provider_replay(spark, sf_dir):
    """Heights from recorded answers of two providers, of which the second is asked only for what the first has no
    answer for, or none that can be true."""
    p = points(spark, sf_dir).select("track_id", "idx", "lat", "lon")
    m = F.round((F.col("lon") - 14.5) / 0.00002).cast("long")
    spots = p.select("lat", "lon", "idx", m.alias("m")).distinct()
    fine = spots.where("(idx + m) % 3 = 0").select("lat", "lon", F.when(F.col("idx") % 6 == 0, 99999.0).otherwise(200.0 + F.col("idx")).alias("ele"))
    coarse = spots.where("idx % 2 = 0").select("lat", "lon", (300.0 + F.col("idx")).alias("ele"))
    out = providers.with_elevation(p, [("FINE", providers.replay(fine)), ("COARSE", providers.replay(coarse))])
    return out.select("track_id", "idx", "ele", "source")


@registered("response_scan", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_id%4 ORDER BY event_id) AS n FROM events),
k AS (SELECT user_id, event_id, CASE event_id%4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS kind, CASE WHEN event_id%4 < 2 THEN event_id%4 ELSE 0 END AS seg FROM e)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY kind, seg, event_id) - 1 AS idx, event_id/1000.0::DOUBLE AS lat, 14.5::DOUBLE AS lon, CASE WHEN event_id%5 > 0 THEN event_id/4.0::DOUBLE END AS ele FROM k""")
def response_scan(spark, sf_dir):
    """Points of service answers in any of their forms: two segments of a track, then a route, then waypoints; heights may
    be missing."""
    i = F.col("event_id")
    ele = F.when(i % 5 > 0, F.concat(F.lit("<ele>"), i / 4.0, F.lit("</ele>"))).otherwise("")
    point = lambda tag: F.concat(F.lit(f'<{tag} lat="'), i / 1000.0, F.lit('" lon="14.5">'), ele, F.lit(f"</{tag}>"))
    listed = lambda k, tag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(i % 4 == k, F.struct(i.alias("i"), point(tag).alias("t"))))), lambda x: x["t"]), "")
    parts = [F.lit(gpx.HEAD + "<trk><trkseg>"), listed(0, "trkpt"), F.lit("</trkseg><trkseg>"), listed(1, "trkpt"), F.lit("</trkseg></trk><rte>"), listed(2, "rtept"), F.lit("</rte>"), listed(3, "wpt"), F.lit("</gpx>")]
    texts = events(spark, sf_dir).groupBy("user_id").agg(F.concat(*parts).alias("gpx"))
    return gpx.all_points(gpx.parsed(texts), "user_id").select("user_id", "idx", "lat", "lon", "ele")
