"""Shaping of a line in local metres: arcs, loops at U-turns, least radius, splines, lanes, straightening, spacing.

Each works on an array of rows (x, y, z) east, north and up in metres, and gives a new one. `on_tracks` brings a track
into that plane, around its mean place, and back.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame

from trackloom.functions.geo import POLISH_RADIUS

from .kernels import per_track


def lengths(p: np.ndarray) -> np.ndarray:
    return np.hypot(*np.diff(p[:, :2], axis=0).T)


def turns(p: np.ndarray) -> np.ndarray:
    """Signed turn at each inner point, in radians."""
    d = np.diff(p[:, :2], axis=0)
    a, b = d[:-1], d[1:]
    return np.arctan2(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(1))


def circle(a, b, c) -> tuple[np.ndarray, float] | None:
    """Centre and radius of the circle through three points; none if they are in line."""
    u, v = b - a, c - a
    area2 = u[0] * v[1] - u[1] * v[0]
    if abs(area2) < 1e-12:
        return None
    uu, vv = u @ u, v @ v
    o = np.array([v[1] * uu - u[1] * vv, u[0] * vv - v[0] * uu]) / (2 * area2)
    return a + o, float(np.hypot(*o))


def spaced(p: np.ndarray, spacing: float) -> np.ndarray:
    """Every leg in equal parts of about `spacing`."""
    n = np.maximum(1, np.floor(lengths(p) / spacing + 0.5).astype(int))
    leg = np.repeat(np.arange(len(n)), n)
    t = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) / n[leg]
    return np.concatenate([p[leg] + t[:, None] * (p[leg + 1] - p[leg]), p[-1:]])


def bends(p: np.ndarray, least: int = 4, alike: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of runs of points that all turn one way, with curvatures within a share `alike` of their mean."""
    if len(p) < least:
        return []
    d = lengths(p)
    k = 2 * turns(p) / np.maximum(np.minimum(d[:-1], 10) + np.minimum(d[1:], 10), 1e-9)
    out, start = [], None
    for i in range(len(k) + 1):
        good = i < len(k) and abs(k[i]) > 1e-4
        if good and start is not None:
            mean = k[start:i].mean()
            good = k[i] * mean > 0 and abs(k[i] - mean) <= alike * abs(mean)
        if not good:
            if start is not None and i - start + 1 >= least:
                out.append((start, i + 1))
            start = i if i < len(k) and abs(k[i]) > 1e-4 else None
        elif start is None:
            start = i
    return out


def arc(p: np.ndarray, step: float = math.radians(6), off: float = 1.0) -> np.ndarray | None:
    """An arc in place of a run of points: from its first to its last through the mean of the circles that they make
    with each point between. None if a point lies further than `off` from it, or the circles disagree."""
    a, c = p[0, :2], p[-1, :2]
    found = [f for f in (circle(a, q, c) for q in p[1:-1, :2]) if f is not None]
    if not found:
        return None
    centre = np.mean([f[0] for f in found], axis=0)
    # The centre has to be on the line of points as far from the one end as from the other.
    mid, along = (a + c) / 2, (c - a) / max(np.hypot(*(c - a)), 1e-12)
    centre = centre - along * ((centre - mid) @ along)
    r = float(np.hypot(*(a - centre)))
    if np.abs(np.hypot(*(p[:, :2] - centre).T) - r).max() > off:
        return None
    start = math.atan2(*(a - centre)[::-1])
    sweep = math.remainder(math.atan2(*(c - centre)[::-1]) - start, 2 * math.pi)
    whole = float(turns(p).sum())
    if whole and sweep * whole < 0:
        sweep += math.copysign(2 * math.pi, whole)
    n = max(2, math.ceil(abs(sweep) / step))
    t = np.arange(n + 1) / n
    d = np.concatenate([[0], np.cumsum(lengths(p))])
    z = np.interp(t * d[-1], d, p[:, 2])
    out = np.column_stack([centre + r * np.column_stack([np.cos(start + t * sweep), np.sin(start + t * sweep)]), z])
    out[0], out[-1] = p[0], p[-1]
    return out


def with_arcs(p: np.ndarray) -> np.ndarray:
    """Runs that bend evenly become arcs."""
    parts, done = [], 0
    for a, b in bends(p):
        if a < done:
            continue
        made = arc(p[a : b + 1])
        if made is not None:
            parts += [p[done:a], made[:-1]]
            done = b
    return np.concatenate([*parts, p[done:]])


def with_loops(p: np.ndarray, radius: float = 6.0, steps: int = 24) -> np.ndarray:
    """Where the line turns straight back, it goes round a circle of `radius` that touches it."""
    cos = np.cos(turns(p)) if len(p) > 2 else np.array([])
    out = [p[:1]]
    for i in range(1, len(p) - 1):
        out.append(p[i : i + 1])
        if cos[i - 1] < -0.98:
            d = p[i, :2] - p[i - 1, :2]
            d = d / max(np.hypot(*d), 1e-12)
            side = np.array([d[1], -d[0]])
            t = 2 * math.pi * np.arange(1, steps) / steps
            ring = p[i, :2] + radius * (np.sin(t)[:, None] * d + (1 - np.cos(t))[:, None] * side)
            out.append(np.column_stack([ring, np.full(len(t), p[i, 2])]))
    return np.concatenate([*out, p[-1:]]) if len(p) > 1 else p


def eased(p: np.ndarray, radius: float = 6.0, rounds: int | None = None) -> np.ndarray:
    """Points of bends tighter than `radius` are drawn towards the middle of their neighbours, a little each round,
    until there are none or nothing moves any more (or for `rounds` rounds). Ends stay. It ends, as the squares of the
    legs add up to less in every round."""
    p = p.copy()
    for _ in itertools.count() if rounds is None else range(rounds):
        if len(p) < 3:
            break
        d = lengths(p)
        with np.errstate(divide="ignore"):
            r = (d[:-1] + d[1:]) / 2 / np.abs(turns(p))
        tight = np.flatnonzero(r < radius) + 1
        if not len(tight):
            break
        moved = p[tight, :2] + 0.25 * ((p[tight - 1, :2] + p[tight + 1, :2]) / 2 - p[tight, :2])
        if np.abs(moved - p[tight, :2]).max() < 1e-9:
            break
        p[tight, :2] = moved
    return p


def splined(p: np.ndarray, least: float = math.radians(10), most: float = math.radians(60), step: float = math.radians(5)) -> np.ndarray:
    """Points on the curve through four points, put into legs at whose ends the line turns by more than `least` and
    not more than `most`."""
    if len(p) < 4:
        return p
    k = np.concatenate([[0], np.abs(turns(p)), [0]])
    due = (k > least) & (k <= most)
    out = []
    for i in range(len(p) - 1):
        out.append(p[i : i + 1])
        if 0 < i < len(p) - 2 and (due[i] or due[i + 1]):
            n = max(1, math.ceil((k[i] + k[i + 1]) / step))
            t = (np.arange(1, n) / n)[:, None]
            a, b, c, d = p[i - 1 : i + 3]
            out.append(0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t**2 + (3 * b - a - 3 * c + d) * t**3))
    return np.concatenate([*out, p[-1:]])


def shifted(p: np.ndarray, right: float) -> np.ndarray:
    """The line moved to its right, corners mitred, by less where it bends too tightly for that."""
    d = np.diff(p[:, :2], axis=0)
    u = d / np.maximum(np.hypot(*d.T), 1e-12)[:, None]
    normal = np.column_stack([u[:, 1], -u[:, 0]])
    both = np.concatenate([normal[:1], normal[:-1] + normal[1:], normal[-1:]])
    size = np.hypot(*both.T)[:, None]
    both = both / np.maximum(size, 1e-12)
    cos = np.concatenate([[1.0], (both[1:-1] * normal[:-1]).sum(1), [1.0]])
    reach = np.minimum(abs(right) / np.maximum(cos, 0.25), 2 * abs(right))
    out = p.copy()
    out[:, :2] += math.copysign(1.0, right) * both * reach[:, None]
    return out


def straight(p: np.ndarray, a: int, b: int) -> np.ndarray:
    """The points between a and b put on the line from a to b."""
    out = p.copy()
    u = p[b, :2] - p[a, :2]
    n = u @ u
    if n:
        out[a:b, :2] = p[a, :2] + ((p[a:b, :2] - p[a, :2]) @ u / n)[:, None] * u
    return out


def straightened(p: np.ndarray, least: float = 100.0, off: float = 0.3) -> np.ndarray:
    """Runs of `least` metres or more, whose points lie within `off` of their chord, made straight; each is as long as
    it can be from where it begins."""
    d = np.concatenate([[0], np.cumsum(lengths(p))])
    a = 0
    while a < len(p) - 2:
        best = None
        for b in range(a + 2, len(p)):
            u = p[b, :2] - p[a, :2]
            v = p[a + 1 : b, :2] - p[a, :2]
            if np.abs(u[0] * v[:, 1] - u[1] * v[:, 0]).max() > off * max(np.hypot(*u), 1e-12):
                break
            best = b
        if best is not None and d[best] - d[a] >= least:
            p, a = straight(p, a, best), best
        else:
            a += 1
    return p


def pruned(p: np.ndarray, off: float = 1.0, slope: float = 0.02) -> np.ndarray:
    """Points on the line from the last that stays to the next, with nearly one slope on both sides, go."""
    keep = [0]
    for i in range(1, len(p) - 1):
        a, b, c = p[keep[-1]], p[i], p[i + 1]
        u, v = c[:2] - a[:2], b[:2] - a[:2]
        n = max(np.hypot(*u), 1e-12)
        g1 = (b[2] - a[2]) / max(np.hypot(*v), 1e-12)
        g2 = (c[2] - b[2]) / max(np.hypot(*(c[:2] - b[:2])), 1e-12)
        if not (abs(u[0] * v[1] - u[1] * v[0]) / n <= off and 0 <= u @ v <= n * n and abs(g1 - g2) <= slope):
            keep.append(i)
    return p[[*keep, len(p) - 1]] if len(p) > 1 else p


def long_loops(p: np.ndarray, reach: float = 100.0, whole: float = 0.85) -> list[tuple[int, int]]:
    """(start, end) of stretches under `reach` metres in which the line turns by more than `whole` of a full circle."""
    if len(p) < 4:
        return []
    d = np.concatenate([[0], np.cumsum(lengths(p))])
    heading = np.concatenate([[0], np.cumsum(turns(p))])
    out, free = [], 0
    for i in range(len(heading)):
        if i < free:
            continue
        far = np.flatnonzero((d[i + 1 : len(heading)] - d[i] < reach) & (np.abs(heading[i + 1 :] - heading[i]) > whole * 2 * math.pi))
        if len(far):
            out.append((i, i + 1 + int(far[0])))
            free = out[-1][1]
    return out


def on_tracks(points: DataFrame, change) -> DataFrame:
    """track_id, idx, lat, lon, ele of each track after change(rows of x, y, z)."""

    def kernel(f):
        lat, lon = f["lat"], f["lon"]
        k = np.array([math.radians(1) * POLISH_RADIUS * math.cos(math.radians(lat.mean())), math.radians(1) * POLISH_RADIUS])
        o = np.array([lon.mean(), lat.mean()])
        p = change(np.column_stack([(np.column_stack([lon, lat]) - o) * k, f["ele"]]))
        return {"idx": np.arange(len(p)), "lat": o[1] + p[:, 1] / k[1], "lon": o[0] + p[:, 0] / k[0], "ele": p[:, 2]}

    return per_track(points, kernel, "idx long, lat double, lon double, ele double", ["lat", "lon", "ele"])


def shaped(p: np.ndarray) -> np.ndarray:
    """What polishing does to the shape: arcs, loops at U-turns, and no bend tighter than six metres."""
    return eased(with_loops(with_arcs(p)))
