"""Polishing a line: duplicates and zig-zags out, then smoothing of places and elevations along it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .kernels import along, per_track


def distinct_points(p: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Runs of points in one place become their mean."""
    new = np.concatenate([[True], (np.abs(np.diff(p[:, :2], axis=0)) > tolerance).any(1)])
    starts = np.flatnonzero(new)
    return np.add.reduceat(p, starts) / np.diff(starts, append=len(p))[:, None]


def without_zigzags(p: np.ndarray, reach: float = 100.0) -> np.ndarray:
    """Two U-turns within `reach` metres are one slip: what lies between them goes. All pairs that share no U-turn go
    in one round, and rounds follow until there are none."""
    while len(p) >= 5:
        v = np.diff(p[:, :2], axis=0) * [1.0, np.cos(np.radians(p[:, 0].mean()))]
        n = np.linalg.norm(v, axis=1)
        cos = (v[:-1] * v[1:]).sum(1) / np.maximum(n[:-1] * n[1:], 1e-300)
        turns = np.flatnonzero(cos < -0.9) + 1
        d = along(p[:, 0], p[:, 1])
        keep, i = np.ones(len(p), bool), 0
        while i < len(turns) - 1:
            a, b = turns[i], turns[i + 1]
            if d[b] - d[a] < reach:
                keep[a:b] = False
                i += 1
            i += 1
        if keep.all():
            break
        p = p[keep]
    return p


def smoothed(p: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Every column is averaged along the line with a bell of `sigma` metres; each point stands for half the way to its
    neighbours; ends stay."""
    d = along(p[:, 0], p[:, 1])
    half = np.gradient(d) if len(d) > 1 else np.ones(len(d))
    out = p.copy()
    lo, hi = np.searchsorted(d, d - 4 * sigma), np.searchsorted(d, d + 4 * sigma, "right")
    for i in range(1, len(p) - 1):
        s = slice(lo[i], hi[i])
        w = np.exp(-0.5 * ((d[s] - d[i]) / sigma) ** 2) * half[s]
        out[i] = w @ p[s] / w.sum()
    return out


def polished(points: DataFrame, sigma: float = 2.0) -> DataFrame:
    """track_id, idx, lat, lon, ele, dist after all three."""

    def kernel(f):
        p = smoothed(without_zigzags(distinct_points(np.column_stack([f["lat"], f["lon"], f["ele"]]))), sigma)
        return {"idx": np.arange(len(p)), "lat": p[:, 0], "lon": p[:, 1], "ele": p[:, 2], "dist": along(p[:, 0], p[:, 1])}

    return per_track(points, kernel, "idx long, lat double, lon double, ele double, dist double", ["lat", "lon", "ele"])
