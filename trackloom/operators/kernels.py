"""Operators whose next step depends on the last one: a numpy function per track, run with applyInArrow.

Tracks are independent, so these scale with their number; a track itself must fit in a worker, as one long ride does.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

R = 6_371_000.0


def metres(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Lengths of the segments of a line."""
    p, q = np.radians(lat), np.radians(lon)
    a = np.sin(np.diff(p) / 2) ** 2 + np.cos(p[:-1]) * np.cos(p[1:]) * np.sin(np.diff(q) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(a))


def along(lat, lon) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(metres(np.asarray(lat), np.asarray(lon)))])


def per_track(points: DataFrame, kernel, schema: str, columns: list[str]) -> DataFrame:
    """Apply kernel(arrays sorted by idx, by name) -> dict of columns to each track, whatever the type of its id.

    A kernel that gives `row`, the positions of the points that its rows are made from, keeps their other columns:
    all those of points that schema does not name."""
    made = T.StructType.fromDDL(schema)
    names = [f.name for f in made if f.name != "row"]
    carried = [f for f in points.schema if f.name not in (*names, "track_id")] if "row" in made.names else []
    out = T.StructType([points.schema["track_id"], *[made[n] for n in names], *carried])

    def run(track):
        import pyarrow as pa

        types = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        track = track.sort_by("idx")
        found = kernel({c: track[c].to_numpy() for c in ("idx", *columns)})
        n = len(found[names[0]])
        own = [pa.array(np.asarray(found[f]), types[made[f].dataType.simpleString()]) for f in names]
        kept = track.select([f.name for f in carried]).take(pa.array(np.asarray(found["row"], np.int64))).columns if carried else []
        ident = track["track_id"].take(pa.array(np.zeros(n, np.int64)))
        return pa.Table.from_arrays([ident, *own, *kept], names=out.names)

    needed = points if "row" in made.names else points.select("track_id", "idx", *columns)
    return needed.groupBy("track_id").applyInArrow(run, out)


# Simplifying


def smallest_triangles(lat, lon, ele, least_radius: float = 20.0, share: int = 5) -> np.ndarray:
    """Whether each point stays: of the fifth of inner points with the smallest triangles, in that order, those go
    whose neighbours stay and that lie on no tight curve. Areas count to nine decimals, as what lies beyond is rounding
    of coordinates; of equal ones the first point comes first."""
    n = len(lat)
    stays = np.ones(n, bool)
    if n < 4:
        return stays
    k = R * math.pi / 180
    x, y = np.asarray(lon) * k * math.cos(math.radians(lat[n // 2])), np.asarray(lat) * k
    p = np.stack([x, y, np.asarray(ele)], 1)
    area = 0.5 * np.linalg.norm(np.cross(p[1:-1] - p[:-2], p[2:] - p[:-2]), axis=1)
    tight = bend_radius(np.asarray(lat), np.asarray(lon)) < least_radius
    for i in np.argsort(np.floor(area * 1e9 + 0.5), kind="stable")[: len(area) // share] + 1:
        if not tight[i - 1] and stays[i - 1] and stays[i + 1]:
            stays[i] = False
    return stays


def bend_radius(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Radius of the circle through each inner point and its neighbours."""
    k = R * math.pi / 180
    c = np.cos(np.radians(lat[1:-1]))
    a = np.stack([(lon[:-2] - lon[1:-1]) * k * c, (lat[:-2] - lat[1:-1]) * k], 1)
    b = np.stack([(lon[2:] - lon[1:-1]) * k * c, (lat[2:] - lat[1:-1]) * k], 1)
    area2 = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    sides = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) * np.linalg.norm(a - b, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(area2 < 1e-10, np.inf, sides / (2 * area2))


def simplified(points: DataFrame) -> DataFrame:
    def kernel(f):
        s = np.flatnonzero(smallest_triangles(f["lat"], f["lon"], f["ele"]))
        return {"row": s, "idx": np.arange(len(s)), "orig_idx": f["idx"][s], "dist": along(f["lat"][s], f["lon"][s])}

    return per_track(points, kernel, "row long, idx long, orig_idx long, dist double", ["lat", "lon", "ele"])


# Waypoints


def waypoints(dist: np.ndarray, curvature: np.ndarray, spacing: float = 200.0, forced=()) -> list[int]:
    """Points to route through: spacing shrinks by up to 65 % with the curvature at the last one; forced points are
    taken on the way; the last point always is."""
    n = len(dist)
    if n < 2:
        return [0]
    out, at = [0], 0.0
    queue = sorted({i for i in forced if 0 < i < n - 1})
    while True:
        here = out[-1]
        queue = [i for i in queue if i > here]
        step = spacing * (1 - 0.65 * curvature[here])
        goal = at + step
        if queue and dist[queue[0]] < goal:
            nxt = queue[0]
        else:
            beyond = np.flatnonzero(dist[here + 1 :] > goal + step / 2)
            end = here + 2 + (beyond[0] if len(beyond) else n)
            nxt = here + 1 + int(np.argmin(np.abs(dist[here + 1 : end] - goal))) if here + 1 < n else n
        if nxt >= n - 1:
            break
        out.append(nxt)
        at = float(dist[nxt])
    return out + [n - 1] * (out[-1] != n - 1)


def snap_waypoints(points: DataFrame, spacing: float = 200.0) -> DataFrame:
    """track_id, ord, idx. points has dist and curvature."""

    def kernel(f):
        found = waypoints(f["dist"], f["curvature"], spacing)
        return {"ord": np.arange(len(found)), "idx": found}

    return per_track(points, kernel, "ord long, idx long", ["dist", "curvature"])


def matched_forward(lat, lon, places: list[tuple[float, float]]) -> list[int]:
    """For each place in turn, the nearest point from the one before on, within a third of the track or 200 points."""
    out, start, n = [], 0, len(lat)
    for plat, plon in places:
        end = min(n, start + max(200, int(0.3 * n)))
        d = [metres(np.array([plat, a]), np.array([plon, b]))[0] for a, b in zip(lat[start:end], lon[start:end], strict=True)]
        start += int(np.argmin(d)) if d else 0
        out.append(start)
    return out


# Dips


#: What a dip of a source with that grid looks like, in metres and shares.
DIP_PROFILES = {
    "MDT02": {"narrow": 8, "wide": 22, "target": 14, "shallow": 1.0, "deep": 4.0, "sigma": 3.0, "taper": 4.0, "most": 2.5, "slope": 0.22},
    "MDT05": {"narrow": 10, "wide": 28, "target": 18, "shallow": 1.5, "deep": 5.0, "sigma": 4.5, "taper": 6.0, "most": 3.5, "slope": 0.2},
}
DIP_SOURCES = {"ES_MDT02_LOCAL": "MDT02", "ES_WCS_5M": "MDT05", "ES_MDT05_LOCAL": "MDT05"}


def dips(dist: np.ndarray, ele: np.ndarray, p: dict, closed: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(lo, apex, hi) of dips that don't share points: for each low point in turn the pair of sides with the best
    depth, less three hundredths of a metre for each metre that its width is off the target."""
    n, out, free = len(ele), [], 0
    closed = np.zeros(n, bool) if closed is None else closed
    for i in range(2, n - 2):
        if i < free or closed[i] or not np.isfinite(ele[i - 1 : i + 2]).all() or ele[i] > min(ele[i - 1], ele[i + 1]):
            continue
        wall = np.flatnonzero(closed[:i])
        lo = np.arange(max(1, wall[-1] + 1 if len(wall) else 1), i)
        wall = np.flatnonzero(closed[i + 1 :])
        hi = np.arange(i + 1, min(n - 1, i + 1 + wall[0] if len(wall) else n - 1))
        lo = lo[(dist[i] - dist[lo] <= p["wide"]) & (dist[i] - dist[lo] >= 1)][::-1]
        hi = hi[(dist[hi] - dist[i] <= p["wide"]) & (dist[hi] - dist[i] >= 1)]
        if not len(lo) or not len(hi):
            continue
        a, b = np.meshgrid(lo, hi, indexing="ij")
        width = dist[b] - dist[a]
        t = (dist[i] - dist[a]) / width
        depth = ele[a] + (ele[b] - ele[a]) * t - ele[i]
        rise = 0.45 * p["shallow"]
        fits = (
            (width >= p["narrow"]) & (width <= p["wide"]) & (t > 0.2) & (t < 0.8) & (depth >= p["shallow"]) & (depth <= p["deep"])
            & (ele[a] - ele[i] >= rise) & (ele[b] - ele[i] >= rise)
            & (np.abs(ele[i] - ele[a]) <= p["slope"] * (dist[i] - dist[a])) & (np.abs(ele[b] - ele[i]) <= p["slope"] * (dist[b] - dist[i]))
        )
        if not fits.any():
            continue
        score = np.where(fits, depth - 0.03 * np.abs(width - p["target"]), -np.inf)
        k = np.unravel_index(int(np.argmax(score)), score.shape)
        out.append((int(a[k]), i, int(b[k])))
        free = out[-1][2] + 1
    return out


def filled_dips(dist: np.ndarray, ele: np.ndarray, p: dict, closed: np.ndarray | None = None) -> np.ndarray:
    out = ele.copy()
    for lo, _, hi in dips(dist, ele, p, closed):
        i = np.arange(lo + 1, hi)
        if closed is not None:
            i = i[~closed[i]]
        t = (dist[i] - dist[lo]) / (dist[hi] - dist[lo])
        short = out[lo] + (out[hi] - out[lo]) * t - out[i]
        edge = np.minimum(1, np.minimum(dist[i] - dist[lo], dist[hi] - dist[i]) / p["taper"])
        bell = np.exp(-0.5 * ((dist[i] - (dist[lo] + dist[hi]) / 2) / p["sigma"]) ** 2)
        lift = np.minimum(p["most"], short) * (0.5 - 0.5 * np.cos(np.pi * edge)) * bell
        out[i] += np.where((short > 0) & (lift >= 0.01), lift, 0.0)
    return out


def dip_smoothed(points: DataFrame, source: str = "ES_MDT02_LOCAL") -> DataFrame:
    """The points, with dips filled in ele where the source is known to make them."""
    profile = DIP_PROFILES.get(DIP_SOURCES.get(source, ""))

    def kernel(f):
        return {"row": np.arange(len(f["ele"])), "ele": filled_dips(f["dist"], f["ele"], profile) if profile else f["ele"]}

    return per_track(points, kernel, "row long, ele double", ["dist", "ele"])


# Corners


def fillet(prev, vertex, nxt, radius: float, spacing: float, share: float = 0.9) -> np.ndarray | None:
    """Points (lat, lon) of the arc that touches both legs of a corner; none for legs under 10 cm, straight lines and
    U-turns. Where a leg is too short the radius shrinks."""
    k = np.array([R * math.pi / 180, R * math.pi / 180 * math.cos(math.radians(vertex[0]))])
    a, b = (np.subtract(prev, vertex) * k)[::-1], (np.subtract(nxt, vertex) * k)[::-1]
    la, lb = np.hypot(*a), np.hypot(*b)
    if min(la, lb) < 0.1:
        return None
    u, v = a / la, b / lb
    theta = math.acos(max(-1.0, min(1.0, float(u @ v))))
    if theta > math.pi - 0.02 or theta < 0.35:
        return None
    half = math.tan(theta / 2)
    reach = min(radius / half, min(la, lb) * share)
    r = reach * half
    middle = (u + v) / np.linalg.norm(u + v) * (r / math.sin(theta / 2))
    start = math.atan2(*(u * reach - middle)[::-1])
    sweep = -math.copysign(math.pi - theta, u[0] * v[1] - u[1] * v[0])
    n = max(2, math.ceil(abs(sweep) * r / spacing))
    angle = start + sweep * np.arange(n + 1) / n
    return np.stack([vertex[0] + (middle[1] + r * np.sin(angle)) / k[0], vertex[1] + (middle[0] + r * np.cos(angle)) / k[1]], 1)


def rounded(lat, lon, ele, least_turn: float = 100.0, radius: float = 6.0, spacing: float = 0.3):
    """The line with arcs at its sharp corners; elevation is linear over each arc."""
    p = np.stack([lat, lon], 1)
    a, b = p[:-2] - p[1:-1], p[2:] - p[1:-1]
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    cos = np.divide((a * b).sum(1), size, out=np.full(len(size), -1.0), where=size > 1e-24)
    sharp = np.flatnonzero(180 - np.degrees(np.arccos(np.clip(cos, -1, 1))) >= least_turn) + 1
    parts, done = [], 0
    for i in sharp:
        if i <= done and done:
            continue
        arc = fillet(p[i - 1], p[i], p[i + 1], radius, spacing)
        if arc is None:
            continue
        parts.append(np.column_stack([p[done:i], ele[done:i]]))
        parts.append(np.column_stack([arc, np.linspace(ele[i - 1], ele[i + 1], len(arc))]))
        done = i + 1
    parts.append(np.column_stack([p[done:], ele[done:]]))
    return np.concatenate(parts)


def filleted(points: DataFrame, least_turn: float = 100.0) -> DataFrame:
    def kernel(f):
        out = rounded(f["lat"], f["lon"], f["ele"], least_turn)
        return {"idx": np.arange(len(out)), "lat": out[:, 0], "lon": out[:, 1], "ele": out[:, 2], "dist": along(out[:, 0], out[:, 1])}

    return per_track(points, kernel, "idx long, lat double, lon double, ele double, dist double", ["lat", "lon", "ele"])


# Vegetation


def _extreme(dist: np.ndarray, v: np.ndarray, radius: float, f) -> np.ndarray:
    """f (np.minimum or np.maximum) of v within `radius` of each point: of two runs of a power of two points that
    cover the window together, from a table of all such runs."""
    lo, hi = np.searchsorted(dist, dist - radius - 1e-12), np.searchsorted(dist, dist + radius + 1e-12, "right")
    level = np.frexp(hi - lo)[1] - 1
    out, run = np.empty(len(v)), v
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = f(run[lo[at]], run[hi[at] - (1 << k)])
        run = f(run[: len(run) - (1 << k)], run[1 << k :])
    return out


def raised(dist, ele, closed=None, radius=75.0, least=1.5, buffer=15.0, narrow=5.0) -> list[tuple[int, int]]:
    """(lo, hi) of regions that stand out from the opening."""
    floor = _extreme(dist, _extreme(dist, ele, radius, np.minimum), radius, np.maximum)
    flag = ele - floor > least
    if closed is not None:
        flag &= ~closed
    edge = np.diff(np.concatenate([[0], flag.astype(int), [0]]))
    out: list[list[int]] = []
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True):
        lo = int(np.searchsorted(dist, dist[a] - buffer))
        hi = min(len(dist) - 1, int(np.searchsorted(dist, dist[b] + buffer + 1)) - 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out if dist[b] - dist[a] >= narrow]


def lowered(dist, ele, lo: int, hi: int, context=100.0, blend=10.0) -> np.ndarray:
    """The profile with a region replaced by a line (under 50 m) or parabola through its surroundings, blended in at
    both edges; by a straight line where the surroundings don't determine it."""
    out = ele.copy()
    a, b = dist[lo], dist[hi]
    near = ((dist >= a - context) & (dist < a)) | ((dist > b) & (dist <= b + context))
    degree = 1 if b - a < 50 else 2
    x = dist[near] - (a + b) / 2
    if len(np.unique(x)) > degree:
        new = np.polyval(np.polyfit(x, ele[near], degree), dist[lo : hi + 1] - (a + b) / 2)
    else:
        p, q = max(0, lo - 1), min(len(ele) - 1, hi + 1)
        new = np.interp(dist[lo : hi + 1], [dist[p], dist[q]], [ele[p], ele[q]]) if dist[q] > dist[p] else np.full(hi - lo + 1, ele[p])
    i = np.arange(lo, hi + 1)
    left = min(hi, int(np.searchsorted(dist, a + blend)))
    right = max(lo, int(np.searchsorted(dist, b - blend)))
    wave = lambda k, n: (1 - np.cos(np.pi * k / max(1, n))) / 2
    share = np.ones(len(i))
    share = np.where((i <= left) & (i < right), wave(i - lo, left - lo), share)
    share = np.where((i >= right) & (i > left), wave(hi - i, hi - right), share)
    out[i] = (1 - share) * ele[i] + share * new
    return out


def without_vegetation(dist, ele, closed=None, passes: int = 3, settled: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(elevations, points flagged at first): regions are found and lowered again until their points hardly change."""
    out, first, before = ele.copy(), np.zeros(len(ele), bool), 0
    for k in range(passes):
        regions = raised(dist, out, closed)
        count = sum(b - a + 1 for a, b in regions)
        if k == 0:
            for a, b in regions:
                first[a : b + 1] = True
        if not regions:
            break
        for a, b in regions:
            out = lowered(dist, out, a, b)
        if abs(count - before) < settled:
            break
        before = count
    return out, first


def vegetation_filtered(points: DataFrame) -> DataFrame:
    """The points, with vegetation taken off ele, and flagged: those that stood out at first."""

    def kernel(f):
        e, flag = without_vegetation(f["dist"], f["ele"])
        return {"row": np.arange(len(e)), "ele": e, "flagged": flag}

    return per_track(points, kernel, "row long, ele double, flagged boolean", ["dist", "ele"])


# Rides and overlaps


def equal_time_parts(time: np.ndarray, seconds: float) -> list[tuple[int, int]]:
    """(start, end) of parts of about equal time; each is one point long at least."""
    total = float(time[-1]) if len(time) else 0.0
    if total <= 0:
        return []
    n, out, start = max(1, math.floor(total / seconds + 0.5)), [], 0
    for k in range(1, n + 1):
        goal = total if k == n else total / n * k
        i = max(start + 1, int(np.searchsorted(time, goal)))
        i = min(i, len(time) - 1)
        if i > start + 1 and not abs(time[i] - goal) < abs(time[i - 1] - goal):
            i -= 1
        end = max(i, min(start + 1, len(time) - 1))
        out.append((start, end))
        start = end
    return out


def splits(timed: DataFrame, seconds: float = 600.0) -> DataFrame:
    """track_id, split, start_idx, end_idx, time, dist, climb, avg_speed. timed comes from timing()."""

    def kernel(f):
        t, d, c = (f[k] for k in ("cum_time", "cum_dist", "cum_climb"))
        cut = np.array(equal_time_parts(t, seconds), int).reshape(-1, 2)
        a, b = cut[:, 0], cut[:, 1]
        took = t[b] - t[a]
        return {"split": np.arange(1, len(cut) + 1), "start_idx": a, "end_idx": b, "time": took, "dist": d[b] - d[a], "climb": c[b] - c[a], "avg_speed": np.divide(d[b] - d[a], took, out=np.zeros(len(cut)), where=took > 0)}

    return per_track(timed, kernel, "split long, start_idx long, end_idx long, time double, dist double, climb double, avg_speed double", ["cum_time", "cum_dist", "cum_climb"])


def overlap_clusters(first: np.ndarray, second: np.ndarray, gap: int = 3) -> np.ndarray:
    """Cluster number of each pair, pairs sorted by first: a cluster ends where first jumps by more than gap, or second
    lies more than gap from the range of the cluster's seconds."""
    out, k = np.zeros(len(first), int), 0
    lo = hi = second[0] if len(second) else 0
    for i in range(1, len(first)):
        if first[i] - first[i - 1] > gap or min(abs(second[i] - lo), abs(second[i] - hi)) > gap:
            k, lo, hi = k + 1, second[i], second[i]
        else:
            lo, hi = min(lo, second[i]), max(hi, second[i])
        out[i] = k
    return out


def clustered_overlaps(pairs: DataFrame) -> DataFrame:
    """The pairs (track_id, i, j) with cluster."""

    def kernel(f):
        return {"row": np.arange(len(f["i"])), "cluster": overlap_clusters(f["i"], f["j"])}

    ordered = pairs.withColumn("idx", F.shiftleft(F.col("i").cast("long"), 32) + F.col("j"))
    return per_track(ordered, kernel, "row long, cluster long", ["i", "j"]).drop("idx")


def boxes(lat: np.ndarray, lon: np.ndarray, side: float) -> np.ndarray:
    """Group number of each point: groups follow the track and end where their box would be wider than `side`."""
    out, k = np.zeros(len(lat), int), 0
    s = n = lat[0] if len(lat) else 0.0
    w = e = lon[0] if len(lon) else 0.0
    for i in range(1, len(lat)):
        s, n, w, e = min(s, lat[i]), max(n, lat[i]), min(w, lon[i]), max(e, lon[i])
        if n - s > side or e - w > side:
            k, s, n, w, e = k + 1, lat[i], lat[i], lon[i], lon[i]
        out[i] = k
    return out


def box_groups(points: DataFrame, side: float = 0.001) -> DataFrame:
    """The points, with box: the number of the group, whose box is `side` wide at most."""

    def kernel(f):
        return {"row": np.arange(len(f["lat"])), "box": boxes(f["lat"], f["lon"], side)}

    return per_track(points, kernel, "row long, box long", ["lat", "lon"])


# Shape


def douglas_peucker(x: np.ndarray, y: np.ndarray, z: np.ndarray, side: float, height: float) -> np.ndarray:
    """Whether each point stays: lines are cut at the point that is furthest off, in units of `side` and `height`,
    until none is further than one unit. A stack in place of recursion, for long tracks."""
    stays = np.zeros(len(x), bool)
    stays[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        i = np.arange(a + 1, b)
        d = np.array([x[b] - x[a], y[b] - y[a]])
        n = float(d @ d)
        t = np.clip(((x[i] - x[a]) * d[0] + (y[i] - y[a]) * d[1]) / n, 0, 1) if n else np.zeros(len(i))
        off = np.hypot(x[i] - x[a] - t * d[0], y[i] - y[a] - t * d[1]) / side + np.abs(z[i] - z[a] - t * (z[b] - z[a])) / height
        k = int(np.argmax(off))
        if off[k] > 1:
            stays[i[k]] = True
            todo += [(a, int(i[k])), (int(i[k]), b)]
    return stays


def reduced(points: DataFrame, side: float = 2.0, height: float = 1.0) -> DataFrame:
    def kernel(f):
        k = R * math.pi / 180
        s = np.flatnonzero(douglas_peucker(f["lon"] * k * math.cos(math.radians(f["lat"].mean())), f["lat"] * k, f["ele"], side, height))
        return {"row": s, "idx": f["idx"][s]}

    return per_track(points, kernel, "row long, idx long", ["lat", "lon", "ele"])


#: Registered without an SQL twin, over tracks with dist and gr.
QUERIES = {"dip_smooth": dip_smoothed, "fillets": filleted, "veg_filter": vegetation_filtered}
