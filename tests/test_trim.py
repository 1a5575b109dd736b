"""Cuts between two points of tracks that are hardly longer than the cut."""

import pytest

from trackloom.operators import tracks
from trackloom.plans.queries import ORACLE_SQL, QUERIES


def rode(spark, n):
    return spark.createDataFrame([("a", i, float(i)) for i in range(n)], "track_id string, idx long, ele double")


@pytest.mark.parametrize("n", [1, 2, 16, 20, 26, 36, 37])
def test_a_cut_in_the_middle_keeps_the_rest_behind_it(spark, n):
    got = [r["ele"] for r in tracks.trimmed(rode(spark, n), 15, 25, "mid").orderBy("idx").collect()]
    kept = [float(i) for i in range(n) if i <= 15 or i >= 25]
    assert got == ([kept[1], *kept[1:-1], kept[-2] if len(kept) > 2 else kept[1]] if len(kept) > 1 else kept)


def test_without_a_kind_the_end_goes_where_the_cut_is_near_it(spark):
    assert [tracks.trimmed(rode(spark, n), 15, 25).count() for n in (36, 37)] == [16, 28]


def test_trim_mid_as_its_sql_on_short_tracks(spark, tmp_path):
    import duckdb

    events = spark.range(90).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "CASE WHEN id < 30 THEN 1 ELSE 2 END AS user_id", "'error' AS event_type", "id * 1.5D AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT track_id, idx, ele FROM ({ORACLE_SQL['trim_mid']}) ORDER BY 1, 2").fetchall()
    assert [tuple(r) for r in QUERIES["trim_mid"](spark, str(tmp_path)).orderBy("track_id", "idx").collect()] == want


def test_points_are_not_joined_into_few_tasks(spark, sf_dir):
    """However few bytes they take, points lie in as many tasks as the session names, for span_mask too."""
    from trackloom.operators import intervals
    from trackloom.plans import queries

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = queries.points(spark, sf_dir)
    assert p.rdd.getNumPartitions() == n
    assert intervals.span_mask(p, queries.spans(spark, sf_dir)).rdd.getNumPartitions() >= n
