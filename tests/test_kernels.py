"""Sequential operators on made-up tracks: what they must keep and what they must change."""

import math

import numpy as np

from trackloom.operators import kernels as k
from trackloom.operators import polish


def line(n=50, step=0.0001):
    return 46.0 + np.arange(n) * step, np.full(n, 14.5)


def test_simplify_keeps_ends_and_never_drops_neighbours():
    lat, lon = line()
    lon = lon + np.where(np.arange(50) % 2, 1e-5, 0)
    s = k.smallest_triangles(lat, lon, np.zeros(50), least_radius=0)
    assert s[0] and s[-1] and 0 < (~s).sum() <= 9
    assert not (~s[1:] & ~s[:-1]).any()


def test_simplify_leaves_short_tracks():
    assert k.smallest_triangles([46, 46.1, 46.2], [14, 14, 14], [0, 0, 0]).all()


def test_waypoints_are_increasing_and_closer_in_bends():
    d = np.arange(0, 3000, 10.0)
    straight, bent = k.waypoints(d, np.zeros(len(d))), k.waypoints(d, np.ones(len(d)))
    assert straight[0] == 0 and straight[-1] == len(d) - 1 and (np.diff(straight) > 0).all()
    assert len(bent) > len(straight)
    assert 77 in k.waypoints(d, np.zeros(len(d)), forced=[77])
    assert k.waypoints(d[:1], np.zeros(1)) == [0]


def test_dips_are_filled_only_inside():
    d = np.arange(41.0)
    e = 100 + 0.01 * d
    e[15:26] -= 2.2 * (1 - np.abs(np.arange(-5, 6)) / 5)
    p = k.DIP_PROFILES["MDT02"]
    assert len(k.dips(d, e, dict(p, slope=9))) == 1
    out = k.filled_dips(d, e, dict(p, slope=9))
    assert (out >= e - 1e-12).all() and out[20] > e[20] + 0.5
    assert (out[:10] == e[:10]).all() and (out[30:] == e[30:]).all()
    assert (k.filled_dips(d, 100 + 0.01 * d, p) == 100 + 0.01 * d).all()


def test_fillet_touches_both_legs():
    arc = k.fillet((46.0, 14.5), (46.0005, 14.5), (46.0005, 14.5007), 6.0, 0.3)
    assert arc is not None and len(arc) > 10
    c = math.cos(math.radians(46.0005))
    assert abs(arc[0][1] - 14.5) * 111195 * c < 0.01 and abs(arc[-1][0] - 46.0005) * 111195 < 0.01
    assert k.fillet((46.0, 14.5), (46.001, 14.5), (46.002, 14.5), 6.0, 0.3) is None
    assert k.fillet((46.0, 14.5), (46.001, 14.5), (46.0, 14.5), 6.0, 0.3) is None


def test_vegetation_is_lowered_and_ground_stays():
    d = np.arange(0, 2000, 5.0)
    ground = 300 + 80 * np.sin(d / 2000 * math.pi)
    e = ground + np.where((d > 900) & (d < 960), 8.0, 0)
    out, flag = k.without_vegetation(d, e)
    assert flag.any() and out.max() < e.max() - 2
    assert np.abs(out[d < 600] - e[d < 600]).max() == 0
    same, none = k.without_vegetation(d, np.full(len(d), 5.0))
    assert not none.any() and (same == 5.0).all()


def test_splits_cover_the_ride():
    t = np.arange(0, 1000, 7.0)
    parts = k.equal_time_parts(t, 100)
    assert parts[0][0] == 0 and parts[-1][1] == len(t) - 1 and len(parts) == round(t[-1] / 100)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and all(b > a for a, b in parts)
    assert k.equal_time_parts(np.zeros(3), 10) == []


def test_overlap_clusters_and_boxes():
    assert k.overlap_clusters(np.array([1, 2, 3, 20, 21]), np.array([90, 89, 88, 50, 49])).tolist() == [0, 0, 0, 1, 1]
    assert k.overlap_clusters(np.array([], int), np.array([], int)).tolist() == []
    assert k.boxes(np.array([0, 0.4, 0.8, 1.2]), np.zeros(4), 1.0).tolist() == [0, 0, 0, 1]


def test_matching_goes_forward():
    lat, lon = line()
    assert k.matched_forward(lat, lon, [(46.001, 14.5), (46.0005, 14.5), (46.004, 14.5)]) == [10, 10, 40]


def test_line_reduction_keeps_what_stands_out():
    x = np.arange(11.0)
    y, z = np.zeros(11), np.zeros(11)
    y[5] = 9
    assert np.flatnonzero(k.douglas_peucker(x, y, z, 2, 1)).tolist() == [0, 4, 5, 6, 10]


def test_polish():
    p = np.array([[46, 14, 1], [46, 14, 3], [46.001, 14, 5]], float)
    assert polish.distinct_points(p).tolist() == [[46, 14, 2], [46.001, 14, 5]]
    lat, lon = line(20)
    zig = np.concatenate([np.stack([lat[:10], lon[:10], lon[:10]], 1), np.stack([lat[8:6:-1], lon[:2], lon[:2]], 1), np.stack([lat[8:], lon[8:], lon[8:]], 1)])
    out = polish.without_zigzags(zig)
    assert len(out) < len(zig) and (np.diff(out[:, 0]) >= 0).all()
    s = polish.smoothed(np.stack([lat, lon, np.where(np.arange(20) == 9, 10.0, 0)], 1), 20.0)
    assert s[9, 2] < 10 and (s[[0, -1], :2] == np.stack([lat, lon], 1)[[0, -1]]).all()


def test_all_slips_of_a_long_track_go():
    """50 slips back over two points, at turns of 180 and of about 160 degrees."""
    for aside in (0.0, 0.00003):
        lat = np.concatenate([np.array([0, 1, 2, 3, 2, 1, 2, 3, 4, 5]) + 20 * i for i in range(50)]) * 1e-4 + 46
        lon = 14 + np.tile([0, 0, 0, 0, 1, 2, 2, 2, 2, 2], 50) * aside
        out = polish.without_zigzags(np.stack([lat, lon, lat], 1))
        assert (np.diff(out[:, 0]) > -1e-12).all() and len(out) >= 350


def test_simplify_takes_the_first_of_areas_that_differ_by_rounding():
    """A line that is the same from both ends: its first and last inner triangle are equal but for the last digits."""
    heights, seen = np.array([0, 0.1, 3, 9, 3, 0.1, 0.0]), 0
    for south in range(40):
        lat = 46.0 + south * 0.0137 + np.arange(7) * 0.0001
        x = lat * (k.R * math.pi / 180)
        rise = lambda a, b, c: abs((x[b] - x[a]) * (heights[c] - heights[a]) - (heights[b] - heights[a]) * (x[c] - x[a])) / 2
        first, last = rise(0, 1, 2), rise(4, 5, 6)
        if last < first and round(first, 9) == round(last, 9):
            seen += 1
            assert list(np.flatnonzero(~k.smallest_triangles(lat, np.full(7, 14.5), heights, least_radius=0))) == [1]
    assert seen
