"""Lines shaped by column expressions, against the same on arrays."""

import random

import numpy as np
import pytest

from trackloom.operators import lines, shape


@pytest.fixture(scope="module")
def rides(spark):
    rng = random.Random(6)
    rows = []
    for t, n in (("a", 60), ("b", 5), ("c", 3), ("d", 2), ("e", 1)):
        lat, lon = 46.0 + rng.random(), 14.0
        for i in range(n):
            rows.append((t, i, lat, lon, rng.uniform(0, 90), 7))
            if not (t == "a" and i in (20, 21)):  # repeated places
                lat, lon = lat + rng.uniform(-1, 2) * 1e-4, lon + rng.uniform(-1, 2) * 1e-4
    return rows, spark.createDataFrame(rows, "track_id string, idx long, lat double, lon double, ele double, x int")


def by_track(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["track_id"], r["idx"])):
        out.setdefault(r["track_id"], []).append((r["idx"], r["lat"], r["lon"], r["ele"]))
    return out


CHANGES = {
    "lane": (lambda p: lines.lane_shifted(p, 2.5), lambda p: shape.shifted(p, 2.5), 2), "left": (lambda p: lines.lane_shifted(p, -1.5), lambda p: shape.shifted(p, -1.5), 2),
    "spacing": (lambda p: lines.evenly_spaced(p, 3.0), lambda p: shape.spaced(p, 3.0), 2), "splines": (lines.splined, shape.splined, 1),
}


@pytest.mark.parametrize("name", CHANGES)
def test_as_on_arrays(name, rides):
    rows, df = rides
    here, there, least = CHANGES[name]
    got = by_track(here(df.drop("x") if name != "lane" else df.drop("x")))
    assert set(got) == set("abcde")
    whole = df.drop("x").where(f"track_id in ({', '.join(repr(t) for t in 'abcde' if sum(r[0] == t for r in rows) >= least)})")
    want = by_track(shape.on_tracks(whole, there))
    for t, rows_ in want.items():
        assert [r[0] for r in got[t]] == [r[0] for r in rows_], t
        assert np.allclose(np.array([r[1:] for r in got[t]]), np.array([r[1:] for r in rows_]), atol=1e-8, rtol=0), t
    assert got["e"] == [(0, *[r for r in rows if r[0] == "e"][0][2:5])]


def test_turns(spark):
    p = spark.createDataFrame([("a", i, 46.0 + y * 1e-4, 14.0 + x * 1e-4 / np.cos(np.radians(46.00005)).item(), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (2, 1)])], "track_id string, idx long, lat double, lon double, ele double")
    got = [r["turn"] for r in lines.with_turns(p).orderBy("idx").collect()]
    assert np.allclose(got, [0, np.pi / 2, -np.pi / 2, 0], atol=1e-5)
