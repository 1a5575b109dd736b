"""Zones and what overlaps them, against all pairs."""

import random

from trackloom.operators import intervals, spatial
from trackloom.sources import records


def spans(rng, n, top=4000, most=900):
    out = []
    for k in range(n):
        a = rng.randrange(top)
        out.append((rng.choice("pq"), k, float(a), float(a + rng.choice([0, 0, 10, 100, most]))))
    return out


def test_first_and_no_overlap(spark):
    rng = random.Random(4)
    zones, structs = spans(rng, 80), spans(rng, 60)
    z = spark.createDataFrame(zones, "track_id string, zone long, start double, end double")
    s = spark.createDataFrame([(t, k, f"k{k}", a, b) for t, k, a, b in structs], "track_id string, ord long, kind string, s_start double, s_end double")
    want = {k: min((o for u, o, c, d in structs if u == t and a < d and b > c), default=None) for t, k, a, b in zones}
    for stretch in (37.0, 500.0, 1e6):
        got = {r["zone"]: r["kind"] for r in intervals.first_overlap(z, s, stretch).collect()}
        assert got == {k: None if o is None else f"k{o}" for k, o in want.items()}
    whole = lambda rows: spark.createDataFrame([(t, int(a), int(b), k) for t, k, a, b in rows], "track_id string, alo long, ahi long, n long")
    left = intervals.without_overlap(whole(zones), whole(structs))
    assert sorted(r["n"] for r in left.collect()) == sorted(k for t, k, a, b in zones if not any(u == t and b > c and a < d for u, _, c, d in structs)) and left.columns == ["track_id", "alo", "ahi", "n"]
    assert intervals.without_overlap(whole(zones), whole(structs).limit(0)).count() == 80


def test_lines_and_splits_name_their_points(spark):
    p = spark.createDataFrame([(t, i, float(i * 10 % 360), 46.0 + i, 14.0, 0.0) for t in "ab" for i in range(40)], "track_id string, idx long, bearing double, lat double, lon double, ele double")
    lines = spark.createDataFrame([(1, "a", 3, 8, 60.0), (2, "a", 20, 25, 60.0), (3, "b", 9, 4, 60.0), (4, "b", 30, 99, 130.0), (5, "c", 0, 9, 10.0)], "struct_id long, track_id string, alo int, ahi int, bearing double")
    # 4: 300 to 350 and then 0 to 30 degrees; 130 is 310 the other way.
    assert {r["struct_id"] for r in spatial.aligned(lines, p, 10.0).collect()} == {1, 2, 4}
    cut = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 10, 39), ("b", 0, 5, 5), ("b", 1, 6, 5)], "track_id string, split long, start_idx long, end_idx long")
    got = sorted((r["track_id"], r["split"], r["idx"], r["lat"]) for r in records.split_points(p, cut).collect())
    assert got == [("a", 0, i, 46.0 + i) for i in range(11)] + [("a", 1, i, 56.0 + i) for i in range(30)] + [("b", 0, 0, 51.0)]


def test_places_in_order(spark):
    from trackloom.operators import matching

    out = [(46.0 + i * 1e-4, 14.5) for i in range(300)]
    line = out + out[::-1]
    p = spark.createDataFrame([("a", i, y, x) for i, (y, x) in enumerate(line)] + [("b", 0, 46.0, 14.5)], "track_id string, idx long, lat double, lon double")
    spots = [("a", 0, *line[5]), ("a", 1, *line[5]), ("a", 2, *line[150]), ("a", 3, *line[290]), ("a", 4, *line[200]), ("b", 0, 47.0, 14.0), ("b", 1, 46.0, 14.5), ("none", 0, 46.0, 14.5)]
    got = matching.matched(spark.createDataFrame(spots, "track_id string, ord int, lat double, lon double"), p)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 5), ("a", 1, 6), ("a", 2, 150), ("a", 3, 290), ("a", 4, 399), ("b", 0, 0), ("b", 1, 0)]
    cut = sorted(map(tuple, matching.between(got).collect()))
    assert cut == [("a", 0, 5, 6), ("a", 1, 6, 150), ("a", 2, 150, 290), ("a", 3, 290, 399)]
