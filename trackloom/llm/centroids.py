"""Centroid clustering by Lloyd's rounds with Elkan's bounds, on integers.

Every vector keeps, beside its cluster, an upper bound of the distance to its own centroid and a lower bound of the
distance to each other one. A round moves the bounds by the drift of the centroids and works out only the distances
that bounds and the distances between centroids leave open. Bounds are rounded outwards and prune only where they are
strictly apart, so ties are always decided by exact integer distances, and the result is that of plain rounds.

State is a table with a row per vector, written to the shared folder after each round: a lost executor costs one task's
rows. The driver holds k centroids alone; sums come as k * (dims + 1) numbers from each task. Nothing else is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, stored, table
from .vectors import gaps, is_whole, matrix, root_down, root_up, scaled, summed

#: Rows that a task works on at once.
ROWS = 8192


def nearest(x, centroids, apart, cluster, upper, lower) -> int:
    """Give every row of x its nearest centroid (ties: the smaller number), changing cluster, upper and lower in place.

    apart[a, c] is no more than half the distance of two centroids. Returns the number of distances worked out.
    """
    import numpy as np

    k, worked = len(centroids), 0
    closest = np.where(np.eye(k, dtype=bool), np.inf, apart).min(axis=1)
    rows = np.flatnonzero(upper >= closest[cluster])
    open_ = (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= apart[cluster[rows]])
    open_[np.arange(len(rows)), cluster[rows]] = False
    rows = rows[open_.any(axis=1)]
    own, low = cluster[rows], lower[rows]
    best = gaps(x[rows], centroids[own])
    up = root_up(best)
    low[np.arange(len(rows)), own] = root_down(best)
    worked += len(rows)
    for c in range(k):
        t = np.flatnonzero((own != c) & (up >= low[:, c]) & (up >= apart[own, c]))
        d = gaps(x[rows[t]], centroids[c])
        worked += len(t)
        low[t, c] = root_down(d)
        wins = (d < best[t]) | ((d == best[t]) & (c < own[t]))
        t, d = t[wins], d[wins]
        own[t], best[t], up[t] = c, d, root_up(d)
    cluster[rows], upper[rows], lower[rows] = own, up, low
    return worked


def half_apart(centroids):
    """No more than half the distance of each two centroids."""
    import numpy as np

    return np.stack([root_down(gaps(centroids, c)) / 2 for c in centroids])


def moved(centroids, counts, sums):
    """Centroids after a round: componentwise floor(sum / count); those without vectors stay."""
    import numpy as np

    return np.where(counts[:, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, None]), centroids)


def assigned(state: DataFrame, centroids, drift, last: bool) -> DataFrame:
    """One pass over the state (of vec_id and vec alone, the first time). The last gives exact distances, not bounds."""
    first = "cluster" not in state.columns
    fields = T.StructType.fromDDL("cluster int, distance long" if last else "vec array<int>, cluster int, upper double, lower array<double>")
    schema = T.StructType([state.schema["vec_id"], *fields])

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        k, dims = centroids.shape
        apart = half_apart(centroids)
        for b in sliced(batches, ROWS):
            n, x = b.num_rows, matrix(b.column(1), dims)
            if first:
                cluster, upper, lower = np.zeros(n, dtype="int64"), np.full(n, np.inf), np.zeros((n, k))
            else:
                cluster = b.column(2).to_numpy().astype("int64")
                upper = np.nextafter(b.column(3).to_numpy() + drift[cluster], np.inf)
                lower = b.column(4).flatten().to_numpy().reshape(n, k)
                lower = np.maximum(np.nextafter(lower - drift, -np.inf), 0.0)
            nearest(x, centroids, apart, cluster, upper, lower)
            out = [b.column(0)]
            if last:
                out += [pa.array(cluster, pa.int32()), pa.array(gaps(x, centroids[cluster]), pa.int64())]
            else:
                bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(lower.ravel()))
                out += [b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), bounds]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return state.mapInArrow(run, schema)


def cluster_sums(state: DataFrame, k: int, dims: int):
    """Counts and component sums of all clusters."""

    def add(total, batch):
        import numpy as np

        for b in sliced([batch], ROWS):
            cluster, x = b.column(0).to_numpy(), matrix(b.column(1), dims)
            cells = total.reshape(k, dims + 1)
            for c in np.unique(cluster):
                mine = x[cluster == c]
                cells[c, 0] += len(mine)
                cells[c, 1:] += mine.sum(axis=0)

    cells = summed(state.select("cluster", "vec"), k * (dims + 1), add).reshape(k, dims + 1)
    return cells[:, 0], cells[:, 1:]


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Kept are vectors of exactly `dims` components, none null, NaN or infinite; each component becomes floor(scale * x).
    Centroids start as the k kept vectors of the smallest SHA-256 of "<seed>:<vec_id>" (rows that share an id by their
    components; null ids come last); if fewer are kept there are fewer centroids. Repeated rows count each and are dealt
    alike; no kept row gives no rows; other columns are not read. Components of 2^24 or more after scaling raise an error.
    """
    import numpy as np

    spark = vectors.sparkSession
    whole = is_whole(F.col(vec_col)) & (F.size(vec_col) == dims)
    kept = vectors.where(whole).select(F.col(id_col).alias("vec_id"), scaled(F.col(vec_col), scale).alias("vec"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.select(digest.alias("h"), "vec").orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    schema = T.StructType([kept.schema["vec_id"], *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")])
    if not starts:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["vec"] for r in starts], dtype="int64").reshape(len(starts), dims)
    state, drift = kept, np.zeros(len(starts))
    for _ in range(rounds):
        state = stored(assigned(state, centroids, drift, last=False), "clusters")
        after = moved(centroids, *cluster_sums(state, *centroids.shape))
        drift, centroids = np.where((after == centroids).all(axis=1), 0.0, root_up(gaps(after, centroids))), after
    done = stored(assigned(state, centroids, drift, last=True), "clustered")
    inertia = [0] * len(centroids)
    for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect():
        inertia[r["cluster"]] = r["d"]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return done.select("vec_id", "cluster", "distance", of(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(hashes, "string").alias("centroid_sha256"))


def op12_centroids(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    ctes = []
    for r in range(4):
        ctes.append(f"""a{r} AS MATERIALIZED (
  SELECT r, min(list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 16 + c) AS best FROM v, c{r} GROUP BY r)""")
        if r < 3:
            ctes.append(f"""s{r} AS (
  SELECT c, pos, sum(x) AS s, count(*) AS n
  FROM (SELECT best % 16 AS c, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{r} JOIN v USING (r)) GROUP BY c, pos),
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS m FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)""")
    steps = ",\n".join(ctes)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS BIGINT) AS c, q AS m FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
{steps},
d AS (SELECT vec_id, CAST(best % 16 AS INTEGER) AS cluster, CAST(best // 16 AS BIGINT) AS distance FROM a3 JOIN v USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM d JOIN c3 ON c = cluster
"""


OP12_SQL = _sql()
