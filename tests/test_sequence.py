"""Zones drawn in turn, against the same done one after another on a list."""

import random

from trackloom.operators import sequence, structures


def plain(eles, dists, zones):
    out = list(eles)
    for lo, hi, m0, m1 in zones:
        if hi >= len(out) or hi - lo < 2 or dists[hi] <= dists[lo]:
            continue
        e0, e1, d0, span = out[lo], out[hi], dists[lo], dists[hi] - dists[lo]
        for j in range(lo + 1, hi):
            t = (dists[j] - d0) / span
            line = e0 + t * (e1 - e0)
            cubic = (2 * t**3 - 3 * t**2 + 1) * e0 + (t**3 - 2 * t**2 + t) * span * (m0 or 0) + (3 * t**2 - 2 * t**3) * e1 + (t**3 - t**2) * span * (m1 or 0)
            out[j] = line if m0 is None or m1 is None else cubic
    return out


def run(spark, tracks, zones):
    p = spark.createDataFrame([(t, i, d, e, 7) for t, (es, ds) in tracks.items() for i, (e, d) in enumerate(zip(es, ds, strict=True))], "track_id string, idx long, dist double, ele double, owner int")
    z = spark.createDataFrame(zones, "track_id string, n int, alo long, ahi long, m0 double, m1 double")
    rows = sequence.drawn_in_turn(p, z, ["n"]).collect()
    got = {}
    for r in rows:
        assert r["owner"] == 7
        got.setdefault(r["track_id"], {})[r["idx"]] = r["ele_fixed"]
    return {t: [v[i] for i in range(len(v))] for t, v in got.items()}


def same(got, want):
    return len(got) == len(want) and all(abs(a - b) < 1e-6 for a, b in zip(got, want, strict=True))


def test_overlapped_zone_keeps_its_part(spark):
    es, ds = [0.0, 0.0, 50.0, 50.0, 50.0, 50.0, 50.0, 0.0, 0.0, 0.0], [10.0 * i for i in range(10)]
    got = run(spark, {"a": (es, ds)}, [("a", 0, 1, 6, None, None), ("a", 1, 5, 9, None, None)])["a"]
    assert got[2:5] == [10.0, 20.0, 30.0] and got == plain(es, ds, [(1, 6, None, None), (5, 9, None, None)])


def test_nested_equal_and_chained(spark):
    rng = random.Random(2)
    tracks, zones, want = {}, [], {}
    for name in "abcdef":
        n = 60
        ds = [0.0]
        for _ in range(n - 1):
            ds.append(ds[-1] + rng.choice([0.0, 5.0, 11.0]))
        es = [rng.uniform(0, 50) for _ in range(n)]
        mine = []
        for _ in range(25):
            lo = rng.randrange(n)
            slopes = rng.choice([(None, None), (rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2)), (0.1, None)])
            mine.append((lo, lo + rng.randrange(0, 20), *slopes))
        mine += [mine[3], (mine[4][0], mine[4][0] + 19, None, None), (5, 10, None, None), (5, 30, 0.1, 0.2), (0, n - 1, None, None) if name == "b" else (2, 4, None, None)]
        tracks[name], want[name] = (es, ds), plain(es, ds, mine)
        zones += [(name, k, *z) for k, z in enumerate(mine)]
    rng.shuffle(zones)
    got = run(spark, tracks, zones)
    assert all(same(got[t], want[t]) for t in tracks)


def test_long_line_of_zones(spark):
    """Each zone begins inside the one before it: as many rounds as zones."""
    es, ds = [float(i * i % 17) for i in range(80)], [3.0 * i for i in range(80)]
    zones = [(3 * k, 3 * k + 5, None, None) for k in range(12)]
    got = run(spark, {"a": (es, ds)}, [("a", k, *z) for k, z in enumerate(zones)])
    assert same(got["a"], plain(es, ds, zones))
    back = run(spark, {"a": (es, ds)}, [("a", -k, *z) for k, z in enumerate(zones)])
    assert same(back["a"], plain(es, ds, zones[::-1]))


def test_nothing_to_draw(spark):
    es, ds = [1.0, 9.0, 2.0], [0.0, 0.0, 0.0]
    assert run(spark, {"a": (es, ds)}, [("a", 0, 0, 2, None, None), ("b", 0, 0, 2, None, None), ("a", 1, 0, 9, None, None)]) == {"a": es}
    assert run(spark, {"a": (es, ds)}, []) == {"a": es}


def test_one_beginning_for_two_structures(spark):
    """Two structures widened to one beginning are both drawn, in the order of their ids."""
    es, ds = [0.0, 0.0, 50.0, 50.0, 50.0, 50.0, 50.0, 0.0, 0.0, 0.0], [10.0 * i for i in range(10)]
    p = spark.createDataFrame([("a", i, d, e) for i, (e, d) in enumerate(zip(es, ds, strict=True))], "track_id string, idx long, dist double, ele double")
    found = spark.createDataFrame([(2, "a", 1, 4, "uniform", 0.0, 0.0), (1, "a", 1, 8, "uniform", 0.0, 0.0)], "struct_id long, track_id string, alo long, ahi long, interp string, m0 double, m1 double")
    got = [r["ele_fixed"] for r in structures.corrected(p, found).orderBy("idx").collect()]
    assert got == plain(es, ds, [(1, 8, None, None), (1, 4, None, None)])
