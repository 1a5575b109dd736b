"""The two vector operators against plain Lloyd rounds on Python integers."""

import hashlib
import math

import numpy as np
import pytest

from trackloom.llm import centroids, vector_codes, vectors
from trackloom.llm.queries import ORACLE_SQL, QUERIES


def floors(v, by):
    return [math.floor(by * x) for x in v]


def lloyd(points, starts, rounds):
    """Plain rounds: (centroids, nearest of each point, squared distance of each point)."""
    cents = [list(s) for s in starts]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(cents)) for p in points]
        if r == rounds:
            return cents, [j for _, j in near], [d for d, _ in near]
        for j in range(len(cents)):
            mine = [p for p, (_, i) in zip(points, near, strict=True) if i == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    raise AssertionError


def plain_clusters(rows, k, rounds, scale, dims):
    kept = [(i, floors(v, scale)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents, near, dist = lloyd([v for _, v in kept], [v for _, v in first], rounds)
    own = {j: sum(d for d, i in zip(dist, near, strict=True) if i == j) for j in near}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, j, d, own[j], sum(dist), sha[j]) for (i, _), j, d in zip(kept, near, dist, strict=True)]


def plain_codes(rows, parts, entries, rounds, scale, dims):
    kept = [(i, lab, floors(v, scale)) for i, v, lab in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    w, books, codes, errors = dims // parts, [], [""] * len(kept), [0] * len(kept)
    for p in range(parts):
        cut = lambda v, p=p: v[p * w : (p + 1) * w]
        cents, near, dist = lloyd([cut(v) for *_, v in kept], [cut(v) for *_, v in first], rounds)
        books += [c for e in cents for c in e]
        codes = [c + f"{j:02x}" for c, j in zip(codes, near, strict=True)]
        errors = [a + b for a, b in zip(errors, dist, strict=True)]
    of = {}
    for (_, lab, _), e in zip(kept, errors, strict=True):
        of[lab] = of.get(lab, 0) + e
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return [(i, c, e, of[lab], sha) for (i, lab, _), c, e in zip(kept, codes, errors, strict=True)]


def edge_vectors(dims=16, n=60):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.integers(-3, 4, dims) / 4], i % 3) for i in range(n)]
    return [
        *good, *[(1000 + i, good[7][1], None) for i in range(25)], (3, good[4][1], 1), (3, good[5][1], 1), (None, good[6][1], 2), (None, [0.1] * dims, None), (7, good[7][1], 1),
        (70, None, 1), (71, [], 1), (72, [None] * dims, 1), (73, [float("nan")] + [0.0] * (dims - 1), 1), (74, [float("inf")] * dims, 1), (75, [1.0] * (dims - 1), 1), (76, [1.0] * (dims - 1) + [None], 1), (77, [2.0] * (2 * dims), 0),
    ]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.selectExpr("*", "1 as cluster", "2 as error", "3 as vec", "4 as salt", "5 as of").repartition(5, "vec_id")


def ordered(rows):
    return sorted(map(str, map(tuple, rows)))


def test_clusters_against_plain_rounds(spark):
    rows = edge_vectors()
    for k, rounds in ((6, 3), (6, 0), (200, 2)):
        got = centroids.clustered(frame(spark, rows), k, rounds, 64, 16).collect()
        assert ordered(got) == ordered(plain_clusters([r[:2] for r in rows], k, rounds, 64, 16)), (k, rounds)


def test_codes_against_plain_rounds(spark, monkeypatch):
    rows = edge_vectors()
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 13)
    for parts, entries, rounds in ((4, 10, 2), (16, 6, 4), (2, 250, 1)):
        got = vector_codes.compressed(frame(spark, rows), parts, entries, rounds, 256).collect()
        assert ordered(got) == ordered(plain_codes(rows, parts, entries, rounds, 256, 16)), (parts, entries, rounds)


def test_many_labels_are_joined_by_salt(spark, monkeypatch):
    rows = edge_vectors()
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    got = vector_codes.compressed(frame(spark, rows), 4, 10, 2).collect()
    assert ordered(got) == ordered(plain_codes(rows, 4, 10, 2, 256, 16))


def test_nothing_kept(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 64, 1), (3, [], None)]):
        df = frame(spark, rows)
        assert centroids.clustered(df).count() == 0 and vector_codes.compressed(df).count() == 0
        assert centroids.clustered(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert vector_codes.compressed(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_one_vector(spark):
    df = frame(spark, [(5, [0.5] * 64, None)])
    r = centroids.clustered(df).first()
    assert (r["cluster"], r["distance"], r["inertia"]) == (0, 0, 0)
    assert vector_codes.compressed(df).first()["code"] == "00" * 16


def test_components_beyond_the_bound_are_refused(spark):
    with pytest.raises(Exception, match="is 16777216 or more"):
        centroids.clustered(frame(spark, [(1, [1e20] * 64, 1)])).collect()


def test_bounds_hold_and_prune():
    """Elkan's bounds never pass the true distances, and they spare most of them on clustered data."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 8)) * 400)[rng.integers(0, 12, 3000)].astype("int64") + rng.integers(-9, 10, (3000, 8))
    cents = x[:12].copy()
    n, k = len(x), len(cents)
    cluster, upper, lower, drift, worked = np.zeros(n, dtype="int64"), np.full(n, np.inf), np.zeros((n, k)), np.zeros(k), []
    for _ in range(4):
        upper, lower = np.nextafter(upper + drift[cluster], np.inf), np.maximum(np.nextafter(lower - drift, -np.inf), 0)
        worked.append(centroids.nearest(x, cents, centroids.half_apart(cents), cluster, upper, lower))
        true = vectors.all_gaps(x, cents)
        assert (cluster == true.argmin(axis=1)).all() and (upper >= np.sqrt(true[np.arange(n), cluster])).all() and (lower <= np.sqrt(true)).all()
        sums = np.stack([x[cluster == c].sum(axis=0) for c in range(k)])
        after = centroids.moved(cents, np.bincount(cluster, minlength=k), sums)
        drift, cents = vectors.root_up(vectors.gaps(after, cents)), after
    assert worked[-1] < n * k / 10


def test_heaps_pop_what_drift_has_reached():
    rng = np.random.default_rng(4)
    x, books = rng.integers(-50, 50, (800, 4)), rng.integers(-50, 50, (1, 9, 4))
    drift, code, rows, keys, counts = np.zeros((1, 9)), None, None, None, []
    for _ in range(6):
        code, rows, keys, popped = vector_codes.reassigned(x, books[0], drift[0], code, rows, keys)
        true = ((x[:, None] - books[0][None]) ** 2).sum(axis=2)
        assert (code == true.argmin(axis=1)).all()
        counts.append(len(popped))
        after = books.copy()
        after[0, :3] += rng.integers(-1, 2, (3, 4))
        drift, books = vector_codes.drifted(drift, books, after), after
    assert counts[0] == 800 and max(counts[1:]) < 600
    sizes = np.bincount(code, minlength=9)
    got = vector_codes.violated(keys, np.cumsum(sizes) - sizes, sizes, drift[0] + 3)
    assert sorted(got) == [i for i in range(800) if keys[i] <= drift[0][code[rows[i]]] + 3]


def test_exact_distances_of_large_integers():
    x = np.array([[vectors.MOST - 1] * 64, [1 - vectors.MOST] * 64], dtype="int64")
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in x] for p in x]
    assert vectors.all_gaps(x, x).tolist() == want


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_centroids"])
def test_same_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])
