"""SQL twins of the operators whose next step depends on the last one, as recursive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import fields, intervals, kernels, lines, spatial, tracks

from .more_queries import gc
from .queries import BACK, GRD, PTS, RUN, TIM, TRK, bear, graded, hav, out_and_back, points, q, r6, registered


def rq(body: str, ctes: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{body}"


@registered("distance_gaussian", q("""SELECT track_id, idx, round(sum(w*v)/sum(w),6) AS ele_gauss FROM (SELECT a.track_id, a.idx, b.ele AS v, exp(-(b.dist-a.dist)*(b.dist-a.dist)/200.0)
 * ((CASE WHEN b.nd - a.dist < 40 THEN b.nd ELSE b.dist END) - (CASE WHEN a.dist - b.pd < 40 THEN b.pd ELSE b.dist END))/2 AS w FROM pts a JOIN (SELECT *, lag(dist) OVER o AS pd, lead(dist) OVER o AS nd FROM pts WINDOW o AS (PARTITION BY track_id ORDER BY dist)) b
 ON a.track_id=b.track_id AND abs(b.dist-a.dist) < 40) GROUP BY 1, 2"""))  # fmt: skip
def distance_gaussian(spark, sf_dir):
    return tracks.distance_gaussian(points(spark, sf_dir), "ele", 10.0).select("track_id", "idx", r6("ele_gauss").alias("ele_gauss"))


K = "(20037392.0/pi())"
VEC = "radians({d}-{b})*" + K + "*cos(radians(({a}+{c})/2))", "radians({c}-{a})*" + K


def vec(a, b, c, d):
    return [v.format(a=a, b=b, c=c, d=d) for v in VEC]


AX, AY = vec("hlat", "hlon", "lat0", "lon0")
BX, BY = vec("lat0", "lon0", "olat", "olon")


@registered("loop_check", q(f"""SELECT track_id, coalesce(n > 2 AND gap < 40 AND ({AX}*{BX} + {AY}*{BY})/nullif(sqrt(({AX}*{AX}+{AY}*{AY})*({BX}*{BX}+{BY}*{BY})),0.0) > -0.1, FALSE) AS is_loop FROM (SELECT track_id, count(*) AS n, arg_max(d, idx) AS gap, min(lat0) AS lat0, min(lon0) AS lon0,
 arg_min(lat, idx) FILTER (d >= 10) AS olat, arg_min(lon, idx) FILTER (d >= 10) AS olon, arg_max(lat, idx) FILTER (d >= 10) AS hlat, arg_max(lon, idx) FILTER (d >= 10) AS hlon FROM (SELECT *, {gc('lat', 'lon', 'lat0', 'lon0')} AS d
 FROM (SELECT *, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0 FROM bk WINDOW w AS (PARTITION BY track_id ORDER BY idx))) GROUP BY 1)""", BACK))  # fmt: skip
def loop_check(spark, sf_dir):
    return fields.is_loop(out_and_back(spark, sf_dir))


TURN = PTS + """,
tv AS (SELECT *, sqrt(px*px+py*py) AS ma, sqrt(qx*qx+qy*qy) AS mb FROM (SELECT *, lag(lat) OVER w - lat AS px, lag(lon) OVER w - lon AS py, lead(lat) OVER w - lat AS qx, lead(lon) OVER w - lon AS qy FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY idx))),
tu AS (SELECT track_id, idx, lat, lon, dist, coalesce(CASE WHEN ma < 1e-12 OR mb < 1e-12 THEN 0.0 ELSE 180 - degrees(acos(greatest(-1.0, least(1.0, (px*qx+py*qy)/(ma*mb))))) END, 0.0) AS turn FROM tv)"""


@registered("corner_clusters", q(f"""SELECT track_id, min(idx) AS start_idx, max(idx) AS end_idx, round(sum(turn),5) AS total_turn FROM (SELECT *, sum(b) OVER (PARTITION BY track_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} > 12 THEN 1 ELSE 0 END AS b
 FROM tu WHERE turn >= 3 WINDOW w AS (PARTITION BY track_id ORDER BY idx))) GROUP BY track_id, g HAVING sum(turn) >= 40 AND (max(dist)-min(dist) = 0 OR sum(turn) >= 0.5*(max(dist)-min(dist)))""", TURN))  # fmt: skip
def corner_clusters(spark, sf_dir):
    found = fields.corners(tracks.with_bearing(points(spark, sf_dir)), least=40.0, gap=12.0, density=0.5)
    return found.withColumn("total_turn", F.round("total_turn", 5))


@registered("overlap_snap", q("""SELECT b.track_id, b.idx, round(coalesce(t.lat, b.lat),9) AS lat, round(coalesce(t.lon, b.lon),9) AS lon FROM bk b LEFT JOIN (SELECT track_id, j, arg_min(i, (round(m,7), i)) AS i FROM bs WHERE m <= 8 GROUP BY 1, 2) s ON s.track_id=b.track_id AND s.j=b.idx LEFT JOIN bk t ON t.track_id=s.track_id AND t.idx=s.i""", BACK))
def overlap_snap(spark, sf_dir):
    p = out_and_back(spark, sf_dir)
    pairs = spatial.self_proximity(p, 8.0, 20).withColumn("metres", F.round("metres", 7))
    return fields.snapped(pairs, p).select("track_id", "idx", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@registered("kept_structures", rq("""SELECT track_id, struct_id, 1 AS pass FROM (SELECT *, lead(act) OVER (PARTITION BY track_id ORDER BY rn) AS nxt FROM (SELECT track_id, struct_id, rn, act FROM sw WHERE act <> 'no')) WHERE nxt IS NULL OR nxt <> 'instead'""", PTS + """,
cand AS (SELECT track_id, idx AS struct_id, CASE WHEN idx%2=0 THEN 'bridge' ELSE 'tunnel' END AS kind, dist AS s, dist+150 AS e, CAST(idx%7 AS DOUBLE) AS off, row_number() OVER (PARTITION BY track_id ORDER BY dist) AS rn FROM pts WHERE idx%9=4),
sw AS (SELECT track_id, struct_id, rn, 'and' AS act, kind AS lk, s AS ls, e AS le, off AS lo FROM cand WHERE rn = 1 UNION ALL
 SELECT track_id, struct_id, rn, act, CASE WHEN act = 'no' THEN lk ELSE kind END, CASE WHEN act = 'no' THEN ls ELSE s END, CASE WHEN act = 'no' THEN le ELSE e END, CASE WHEN act = 'no' THEN lo ELSE off END FROM (SELECT c.*, w.lk, w.ls, w.le, w.lo, CASE WHEN c.s >= w.le OR w.ls >= c.e OR c.kind <> w.lk THEN 'and' WHEN c.off < w.lo THEN 'instead' ELSE 'no' END AS act FROM sw w JOIN cand c ON c.track_id=w.track_id AND c.rn=w.rn+1))"""))
def kept_structures(spark, sf_dir):
    p = points(spark, sf_dir).where("idx % 9 = 4")
    c = p.select("track_id", F.col("idx").alias("struct_id"), F.lit(1).alias("pass"), F.when(F.col("idx") % 2 == 0, "bridge").otherwise("tunnel").alias("kind"), F.col("dist").alias("start"), (F.col("dist") + 150).alias("end"), (F.col("idx") % 7).cast("double").alias("mean_off"))
    return fields.kept_structures(c)


@registered("labelled_zones", q("""SELECT track_id, alo, ahi, CASE WHEN (sl <= 2 AND sh <= 2) OR (span >= 200 AND rev <= 5 AND mg >= 8) THEN 'suspect' WHEN (elo+ehi)/2 - low >= 1 THEN 'bridge' WHEN high - (elo+ehi)/2 >= 1 THEN 'tunnel' ELSE 'artifact' END AS kind FROM (
 SELECT z.track_id, CAST(z.alo AS BIGINT) AS alo, CAST(z.ahi AS BIGINT) AS ahi, max(CASE WHEN idx=ahi THEN dist END)-max(CASE WHEN idx=alo THEN dist END) AS span, max(CASE WHEN idx=alo THEN ele END) AS elo, max(CASE WHEN idx=ahi THEN ele END) AS ehi,
 min(CASE WHEN idx BETWEEN alo AND ahi THEN ele END) AS low, max(CASE WHEN idx BETWEEN alo AND ahi THEN ele END) AS high, coalesce(avg(CASE WHEN idx>=alo AND idx<ahi THEN abs(gr) END),0.0) AS mg,
 floor(CAST(100 AS DOUBLE)*sum(CASE WHEN idx>alo AND idx<ahi AND sign(gr)<>sign(pg) AND gr<>0 AND pg<>0 THEN 1 ELSE 0 END)/greatest(1,max(ahi-alo)-1)+0.5) AS rev,
 coalesce(max(CASE WHEN idx > alo-8 AND idx > 0 AND idx <= least(alo+8, ahi) THEN sharp END),0.0) AS sl, coalesce(max(CASE WHEN idx > greatest(alo, ahi-8) AND idx <= ahi+8 THEN sharp END),0.0) AS sh
 FROM zone z JOIN (SELECT *, lag(gr) OVER w AS pg, CASE WHEN dist > lag(dist) OVER w THEN abs(gr-lag(gr) OVER w)/(dist-lag(dist) OVER w) END AS sharp FROM grd WINDOW w AS (PARTITION BY track_id ORDER BY idx)) p ON p.track_id=z.track_id AND idx BETWEEN alo-8 AND ahi+8 GROUP BY 1,2,3)""", RUN))  # fmt: skip
def labelled_zones(spark, sf_dir):
    g = graded(spark, sf_dir)
    s = intervals.zone_stats(g, intervals.spike_zones(g, calm=20.0, gap=3))
    ends = lambda c, n: g.select("track_id", F.col("idx").alias(c), F.col("ele").alias(n))
    found = intervals.labelled(s.join(ends("alo", "e_lo"), ["track_id", "alo"]).join(ends("ahi", "e_hi"), ["track_id", "ahi"]))
    return found.select("track_id", F.col("alo").cast("long").alias("alo"), F.col("ahi").cast("long").alias("ahi"), "kind")


@registered("splits", rq("""SELECT s.track_id, CAST(s.k AS BIGINT) AS split, CAST(s.a AS BIGINT) AS start_idx, CAST(s.b AS BIGINT) AS end_idx, round(y.cum_time-x.cum_time,5) AS time, round(y.dist-x.dist,5) AS dist FROM sp s JOIN tim x ON x.track_id=s.track_id AND x.idx=s.a JOIN tim y ON y.track_id=s.track_id AND y.idx=s.b WHERE s.k > 0""", TIM + """,
tot AS (SELECT track_id, max(cum_time) AS total, max(idx) AS last, greatest(1, floor(max(cum_time)/60.0+0.5)) AS n FROM tim GROUP BY 1 HAVING max(cum_time) > 0),
goal AS (SELECT *, CASE WHEN k = n THEN total ELSE total/n*k END AS g FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT)+1)) AS k FROM tot)),
hit AS (SELECT track_id, k, g, last, CASE WHEN c > 0 AND NOT (abs(tc-g) < abs(tp-g)) THEN c-1 ELSE c END AS near, c FROM (SELECT g.track_id, g.k, g.g, g.last, least(min(t.idx) FILTER (t.cum_time >= g.g), g.last) AS c, arg_min(t.cum_time, t.idx) FILTER (t.cum_time >= g.g) AS tc, arg_max(t.cum_time, t.idx) FILTER (t.cum_time < g.g) AS tp FROM goal g JOIN tim t USING (track_id) GROUP BY 1,2,3,4)),
sp AS (SELECT track_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM tot UNION ALL SELECT h.track_id, h.k, s.b, CASE WHEN h.c > s.b+1 THEN greatest(h.near, least(s.b+1, h.last)) ELSE least(s.b+1, h.last) END FROM sp s JOIN hit h ON h.track_id=s.track_id AND h.k=s.k+1)"""))
def splits(spark, sf_dir):
    found = kernels.splits(tracks.timing(points(spark, sf_dir)), 60.0)
    return found.select("track_id", "split", "start_idx", "end_idx", F.round("time", 5).alias("time"), F.round("dist", 5).alias("dist"))


@registered("bbox_chunks", rq("SELECT track_id, idx, box FROM bx", TRK + """,
bx AS (SELECT track_id, idx, CAST(0 AS BIGINT) AS box, lat AS s, lat AS n, lon AS w, lon AS e FROM trk WHERE idx = 0 UNION ALL
 SELECT track_id, idx, CASE WHEN wide THEN box+1 ELSE box END, CASE WHEN wide THEN lat ELSE s END, CASE WHEN wide THEN lat ELSE n END, CASE WHEN wide THEN lon ELSE w END, CASE WHEN wide THEN lon ELSE e END FROM (SELECT t.track_id, t.idx, t.lat, t.lon, b.box, least(b.s,t.lat) AS s, greatest(b.n,t.lat) AS n, least(b.w,t.lon) AS w, greatest(b.e,t.lon) AS e,
 greatest(b.n,t.lat)-least(b.s,t.lat) > 0.00105 OR greatest(b.e,t.lon)-least(b.w,t.lon) > 0.00105 AS wide FROM bx b JOIN trk t ON t.track_id=b.track_id AND t.idx=b.idx+1))"""))
def bbox_chunks(spark, sf_dir):
    return kernels.box_groups(points(spark, sf_dir), 0.00105).select("track_id", "idx", "box")


@registered("overlap_pipeline", rq(f"""SELECT track_id, cluster, CASE WHEN (CASE WHEN d > 180 THEN 360-d ELSE d END) < 90 THEN 'same' ELSE 'opposite' END AS way FROM (SELECT c.track_id, c.cluster, abs({bear('a0.lat', 'a0.lon', 'a1.lat', 'a1.lon')} - {bear('b0.lat', 'b0.lon', 'b1.lat', 'b1.lon')}) AS d
 FROM (SELECT track_id, cluster, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM cl GROUP BY 1, 2) c JOIN bk a0 ON a0.track_id=c.track_id AND a0.idx=i0 JOIN bk a1 ON a1.track_id=c.track_id AND a1.idx=i1 JOIN bk b0 ON b0.track_id=c.track_id AND b0.idx=j0 JOIN bk b1 ON b1.track_id=c.track_id AND b1.idx=j1)""", BACK + """,
pr AS (SELECT track_id, i, j, row_number() OVER (PARTITION BY track_id ORDER BY i, j) AS rn FROM bs WHERE m <= 8),
cl AS (SELECT track_id, i, j, rn, CAST(0 AS BIGINT) AS cluster, j AS lo, j AS hi FROM pr WHERE rn = 1 UNION ALL
 SELECT track_id, i, j, rn, CASE WHEN cut THEN cluster+1 ELSE cluster END, CASE WHEN cut THEN j ELSE least(lo, j) END, CASE WHEN cut THEN j ELSE greatest(hi, j) END FROM (SELECT p.*, c.cluster, c.lo, c.hi, p.i-c.i > 3 OR least(abs(p.j-c.lo), abs(p.j-c.hi)) > 3 AS cut FROM cl c JOIN pr p ON p.track_id=c.track_id AND p.rn=c.rn+1))"""))
def overlap_pipeline(spark, sf_dir):
    """Self-overlaps of tracks, gathered into clusters, with the way the second pass runs."""
    p = out_and_back(spark, sf_dir)
    return fields.overlap_directions(kernels.clustered_overlaps(spatial.self_proximity(p, 8.0, 20)), p)


@registered("snap_points", rq("SELECT track_id, CAST(k AS BIGINT) AS ord, idx FROM (SELECT track_id, k, idx FROM wp UNION ALL SELECT w.track_id, max(w.k)+1, last FROM wp w JOIN cu c ON c.track_id=w.track_id AND c.idx=0 GROUP BY w.track_id, last HAVING max(w.idx) <> last)", PTS + f""",
cb AS (SELECT *, radians(CASE WHEN abs(n-b) > 180 THEN 360-abs(n-b) ELSE abs(n-b) END) AS tu FROM (SELECT *, {bear('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS b, {bear('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS n FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY idx))),
cu AS (SELECT track_id, idx, dist, max(idx) OVER (PARTITION BY track_id) AS last, CASE WHEN tu IS NULL THEN 0.0 ELSE least(coalesce((coalesce(sum(tu) OVER r,0.0)-tu)/nullif(count(tu) OVER r - 1,0),0.0)/(pi()/4),1.0) END AS cv FROM cb WINDOW r AS (PARTITION BY track_id ORDER BY dist RANGE BETWEEN 100.0 PRECEDING AND 100.0 FOLLOWING)),
wp AS (SELECT track_id, 0 AS k, idx, dist + 60.0*(1-0.65*cv) AS goal FROM cu WHERE idx = 0 UNION ALL
 SELECT n.track_id, n.k, n.idx, c.dist + 60.0*(1-0.65*c.cv) FROM (SELECT w.track_id, w.k+1 AS k, arg_min(c.idx, (round(abs(c.dist-w.goal),7), c.idx)) AS idx, max(c.last) AS last FROM wp w JOIN cu c ON c.track_id=w.track_id AND c.idx > w.idx GROUP BY w.track_id, w.k) n JOIN cu c ON c.track_id=n.track_id AND c.idx=n.idx WHERE n.idx < n.last)"""))
def snap_points(spark, sf_dir):
    return kernels.snap_waypoints(tracks.curvature(points(spark, sf_dir)), 60.0)


METRE = "(6371000.0*pi()/180)"

#: Tracks whose points are of different heights, so that no two triangles or distances are equal but for rounding.
UNEVEN = TRK.replace("trk AS (", "even AS (") + """,
trk AS (SELECT track_id, idx, lat, lon, ele + CAST((idx*idx*idx*31 + track_id*17)%100003 AS DOUBLE)*CAST(0.00001 AS DOUBLE) AS ele FROM even)"""


def uneven(spark, sf_dir):
    return points(spark, sf_dir).withColumn("ele", F.col("ele") + ((F.col("idx") * F.col("idx") * F.col("idx") * 31 + F.col("track_id") * 17) % 100003).cast("double") * F.lit(0.00001))



@registered("reduce_line", rq("SELECT DISTINCT track_id, idx FROM (SELECT track_id, a AS idx FROM cut UNION ALL SELECT track_id, b FROM cut)", UNEVEN + f""",
xy AS (SELECT track_id, idx, lon*{METRE}*cos(radians(avg(lat) OVER t)) AS x, lat*{METRE} AS y, ele AS z, max(idx) OVER t AS last FROM trk WINDOW t AS (PARTITION BY track_id)),
cut AS (SELECT track_id, CAST(0 AS BIGINT) AS a, last AS b FROM xy WHERE idx = 0 UNION ALL SELECT track_id, CASE WHEN side = 0 THEN a ELSE m END, CASE WHEN side = 0 THEN m ELSE b END FROM (SELECT track_id, a, b, arg_max(idx, (round(off,9), -idx)) AS m, max(off) AS most FROM
 (SELECT c.track_id, c.a, c.b, p.idx, sqrt(pow(p.x-q.x-t*(r.x-q.x),2)+pow(p.y-q.y-t*(r.y-q.y),2))/2.0 + abs(p.z-q.z-t*(r.z-q.z)) AS off FROM (SELECT c.*, p.idx AS i, greatest(0.0, least(1.0, ((p.x-q.x)*(r.x-q.x)+(p.y-q.y)*(r.y-q.y))/nullif(pow(r.x-q.x,2)+pow(r.y-q.y,2),0.0))) AS t
 FROM cut c JOIN xy q ON q.track_id=c.track_id AND q.idx=c.a JOIN xy r ON r.track_id=c.track_id AND r.idx=c.b JOIN xy p ON p.track_id=c.track_id AND p.idx > c.a AND p.idx < c.b) c JOIN xy q ON q.track_id=c.track_id AND q.idx=c.a JOIN xy r ON r.track_id=c.track_id AND r.idx=c.b JOIN xy p ON p.track_id=c.track_id AND p.idx=c.i)
 GROUP BY track_id, a, b HAVING max(off) > 1), (SELECT unnest([0, 1]) AS side))"""))
def reduce_line(spark, sf_dir):
    return kernels.reduced(uneven(spark, sf_dir)).select("track_id", "idx")


@registered("simplify", rq("""SELECT p.track_id, row_number() OVER (PARTITION BY p.track_id ORDER BY p.idx) - 1 AS idx, p.idx AS orig_idx FROM trk p LEFT JOIN (SELECT track_id, arg_max(gone, k) AS gone FROM gr GROUP BY 1) g USING (track_id) WHERE NOT list_contains(coalesce(gone, []), p.idx)""", UNEVEN + f""",
m3 AS (SELECT track_id, idx, lat, lon, ele, count(*) OVER t AS n, lon*{METRE}*cos(radians(max(CASE WHEN idx = h THEN lat END) OVER t)) AS x, lat*{METRE} AS y FROM (SELECT *, count(*) OVER (PARTITION BY track_id) // 2 AS h FROM trk) WINDOW t AS (PARTITION BY track_id)),
tr AS (SELECT track_id, idx, n, x, lag(x) OVER w AS xa, lead(x) OVER w AS xb, y, lag(y) OVER w AS ya, lead(y) OVER w AS yb, ele AS z, lag(ele) OVER w AS za, lead(ele) OVER w AS zb, (lag(lon) OVER w-lon)*{METRE}*cos(radians(lat)) AS ux, (lag(lat) OVER w-lat)*{METRE} AS uy, (lead(lon) OVER w-lon)*{METRE}*cos(radians(lat)) AS vx, (lead(lat) OVER w-lat)*{METRE} AS vy FROM m3 WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
ar AS (SELECT track_id, idx, n, 0.5*sqrt(pow((y-ya)*(zb-za)-(z-za)*(yb-ya),2)+pow((z-za)*(xb-xa)-(x-xa)*(zb-za),2)+pow((x-xa)*(yb-ya)-(y-ya)*(xb-xa),2)) AS area, CASE WHEN abs(ux*vy-uy*vx) < 1e-10 THEN 1e300 ELSE sqrt(ux*ux+uy*uy)*sqrt(vx*vx+vy*vy)*sqrt(pow(ux-vx,2)+pow(uy-vy,2))/(2*abs(ux*vy-uy*vx)) END < 20 AS tight FROM tr WHERE xa IS NOT NULL AND xb IS NOT NULL AND n >= 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(area,9), idx) AS r FROM ar QUALIFY r <= (n-2)//5),
gr AS (SELECT track_id, 0 AS k, CAST([] AS BIGINT[]) AS gone FROM trk WHERE idx = 0 UNION ALL SELECT g.track_id, g.k+1, CASE WHEN NOT tight AND NOT list_contains(gone, idx-1) AND NOT list_contains(gone, idx+1) THEN list_append(gone, idx) ELSE gone END FROM gr g JOIN rk ON rk.track_id=g.track_id AND rk.r=g.k+1)"""))
def simplify(spark, sf_dir):
    return kernels.simplified(uneven(spark, sf_dir)).select("track_id", "idx", "orig_idx")


@registered("shape_spacing", q("""SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx, part) - 1 AS idx, round(lat + part/parts*(nlat-lat),8) AS lat, round(lon + part/parts*(nlon-lon),8) AS lon, round(ele + part/parts*(nele-ele),6) AS ele FROM (SELECT *, unnest(range(CAST(parts AS BIGINT))) AS part FROM
 (SELECT *, CASE WHEN nlat IS NULL THEN 1.0 ELSE greatest(1.0, floor(sqrt(pow(radians(nlon-lon)*r*cos(radians(mean)),2)+pow(radians(nlat-lat)*r,2))/4.0+0.5)) END AS parts FROM (SELECT track_id, idx, lat, lon, ele, coalesce(lead(lat) OVER w, NULL) AS nlat, lead(lon) OVER w AS nlon, lead(ele) OVER w AS nele, avg(lat) OVER (PARTITION BY track_id) AS mean, 20037392.0/pi() AS r FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY idx)))) WHERE nlat IS NOT NULL
 UNION ALL SELECT track_id, CAST(NULL AS BIGINT), round(arg_max(lat, idx),8), round(arg_max(lon, idx),8), round(arg_max(ele, idx),6) FROM trk GROUP BY 1""", TRK))  # fmt: skip
def shape_spacing(spark, sf_dir):
    p = lines.evenly_spaced(points(spark, sf_dir), 4.0)
    last = F.max("idx").over(tracks.Window.partitionBy("track_id"))
    # The last point's number depends on all before it: it is left out here as it is in the SQL.
    return p.select("track_id", F.when(F.col("idx") < last, F.col("idx")).alias("idx"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), r6("ele").alias("ele"))


SPLINE = TRK + """,
me AS (SELECT *, avg(lat) OVER w AS mlat, avg(lon) OVER w AS mlon, radians(1)*20037392.0/pi() AS ky FROM trk WINDOW w AS (PARTITION BY track_id)),
pl AS (SELECT *, (lon-mlon)*ky*cos(radians(mlat)) AS x, (lat-mlat)*ky AS y FROM me),
tn AS (SELECT *, abs(coalesce(atan2((x-lag(x) OVER w)*(lead(y) OVER w-y)-(y-lag(y) OVER w)*(lead(x) OVER w-x), (x-lag(x) OVER w)*(lead(x) OVER w-x)+(y-lag(y) OVER w)*(lead(y) OVER w-y)), 0.0)) AS k FROM pl WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
cn AS (SELECT *, lag(x) OVER w AS ax, lead(x) OVER w AS cx, lead(x, 2) OVER w AS dx, lag(y) OVER w AS ay, lead(y) OVER w AS cy, lead(y, 2) OVER w AS dy, lag(ele) OVER w AS ae, lead(ele) OVER w AS ce, lead(ele, 2) OVER w AS de, lead(k) OVER w AS k2 FROM tn WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
np AS (SELECT *, CASE WHEN ax IS NOT NULL AND dx IS NOT NULL AND ((k > radians(10) AND k <= radians(60)) OR (k2 > radians(10) AND k2 <= radians(60))) THEN CAST(greatest(1, ceil((k+k2)/radians(5))) AS BIGINT) ELSE 1 END AS n FROM cn),
ex AS (SELECT *, j/CAST(n AS DOUBLE) AS t FROM (SELECT *, unnest(range(n)) AS j FROM np))"""
#: Added before rounding: many values end in a half of the last place, and doubles fall on either side of it.
OFF = 1.3e-9
CURVE = "CASE WHEN j = 0 THEN {b} ELSE 0.5*(2*{b}+({c}-{a})*t+(2*{a}-5*{b}+4*{c}-{d})*t*t+(3*{b}-{a}-3*{c}+{d})*t*t*t) END"


@registered("shape_splines", q(f"""SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx, j) - 1 AS idx, round(mlat + {CURVE.format(a='ay', b='y', c='cy', d='dy')}/ky + {OFF}, 8) AS lat, round(mlon + {CURVE.format(a='ax', b='x', c='cx', d='dx')}/(ky*cos(radians(mlat))) + {OFF}, 8) AS lon, round({CURVE.format(a='ae', b='ele', c='ce', d='de')} + {OFF}, 6) AS ele FROM ex""", SPLINE))
def shape_splines(spark, sf_dir):
    p = lines.splined(points(spark, sf_dir))
    return p.select("track_id", "idx", *[F.round(F.col(c) + F.lit(OFF), n).alias(c) for c, n in (("lat", 8), ("lon", 8), ("ele", 6))])
