import zlib
from collections import Counter

from trackloom.llm import sharding as op
from trackloom.llm.queries import ORACLE_SQL, QUERIES

from .conftest import edge_rows


def check(rows, shards=16):
    count = Counter(r["shard"] for r in rows)
    sizes = [count.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(count) <= set(range(shards))
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert {r["law"] for r in rows} <= {"rows"} and {r["grown_shard"] for r in rows} <= {None}


def test_documents(spark, sf_dir, documents):
    rows = QUERIES["op3_interleaved_shards"](spark, sf_dir).collect()
    check(rows)
    texts = {r.doc_id: r for r in documents.collect()}
    assert len(rows) == len(texts)
    mixture = {}
    for r in rows:
        raw = texts[r["doc_id"]].text.encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        mixture.setdefault(texts[r["doc_id"]].source, Counter())[r["shard"]] += 1
    for source, c in mixture.items():
        fair = sum(c.values()) / 16
        assert all(abs(c.get(s, 0) - fair) < 2 for s in range(16)), source
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in QUERIES["op3_interleaved_shards"](spark, sf_dir).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_edges(edge, empty):
    rows = op.interleaved_shards(edge).collect()
    assert len(rows) == len(edge_rows())
    check(rows)
    check(op.interleaved_shards(edge, shards=3).collect(), 3)
    assert op.interleaved_shards(empty).count() == 0


def test_hot_source(spark):
    df = spark.range(9000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'hot', concat('s', id % 50)) as source")
    rows = op.interleaved_shards(df).collect()
    check(rows)
    hot = Counter(r["shard"] for r in rows if r["doc_id"] % 3 == 0)
    assert max(hot.values()) - min(hot.values()) <= 2


def test_same_as_sql(same_rows):
    same_rows(QUERIES["op3_interleaved_shards"], ORACLE_SQL["op3_interleaved_shards"])


def test_crowded_keys(spark):
    """Copies of one row may be any number: they get keys of their own, and places of their own."""
    df = spark.range(600).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'t' as text", "'s' as source", "if(id % 3 = 0, 'x', string(id)) as key")
    spread = op._spread(df, 50)
    assert spread.count() == 600 and spread.select("key").distinct().count() == 600
    check(op.interleaved_shards(df.drop("key")).collect())


def test_equal_fractions_do_not_share_a_bucket(spark):
    """A million rows, half of them of the fraction 1/2: no bucket holds twice the mean."""
    df = spark.range(1_000_000).selectExpr("id as doc_id", "cast(id % 1000 as string) as size", "id as text_crc32", "if(id % 2 = 0, 'hot', concat('s', id)) as source", "md5(cast(id as string)) as key", "if(id % 2 = 0, id / 1e6, 0.5D) as fraction")
    sizes = [r["count"] for r in op.ranges(df, 1_000_000).groupBy("range").count().collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) >= 40 and max(sizes) <= 2 * 1_000_000 / len(sizes)


def test_sources_of_one_row_are_spread(spark):
    """Every shard holds a large source and many of one row each in proportion."""
    n = 60_000
    df = spark.range(n).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'hot', concat('s', id)) as source")
    rows = op.interleaved_shards(df).collect()
    check(rows)
    hot = Counter(r["shard"] for r in rows if r["doc_id"] % 3 == 0)
    assert len(hot) == 16 and max(hot.values()) < 1.1 * n / 48 and min(hot.values()) > 0.9 * n / 48
