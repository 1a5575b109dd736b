import hashlib
import re
from collections import Counter

import pytest

from trackloom.llm import exact_dedup as op
from trackloom.llm.queries import ORACLE_SQL, QUERIES

from .conftest import edge_rows


def test_same_as_sql(same_rows):
    same_rows(QUERIES["op6_exact_dedup"], ORACLE_SQL["op6_exact_dedup"])


@pytest.mark.parametrize("fan_in", [2, 8])
def test_edges(edge, fan_in):
    got = op.exact_groups(edge.repartition(5), fan_in=fan_in).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = edge_rows()
    size = Counter(norm(t) for _, t in rows)
    best = {}
    for i, t in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)):
        best.setdefault(norm(t), i)
    want = Counter((i, best[norm(t)], size[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(size) and all(r.doc_id == r.keep_id for r in kept)


def test_filter_keeps_one_row_a_group(edge, empty):
    out = op.drop_exact_copies(edge)
    assert out.columns == edge.columns
    norm = Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect())
    assert set(norm.values()) == {1} and len(norm) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in edge_rows()})
    assert op.exact_groups(empty).count() == 0 and op.drop_exact_copies(empty).count() == 0


def test_hot_group(spark):
    df = spark.range(0, 3000, 1, 30).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) as text")
    got = op.exact_groups(df, fan_in=4)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000").count() == 1000 and got.where("kept and group_size = 1000").first().doc_id == 0


def test_fan_in_is_checked(empty):
    with pytest.raises(ValueError):
        op.exact_groups(empty, fan_in=3)


def test_filter_keeps_the_longest_of_one_id(spark):
    """Rows of one id whose texts differ in white space alone: the longest stays, whatever the partitions."""
    rows = [(3, "a b"), (3, "a  b   "), (3, "ab"), (4, "a b"), (5, "x"), (5, "x"), (None, "y "), (None, "y")]
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", op.F.lit(1)).repartition(n)
        out = op.drop_exact_copies(df)
        assert out.columns == df.columns and sorted(map(str, map(tuple, out.collect()))) == ["(3, 'a  b   ', 1)", "(5, 'x', 1)", "(None, 'y ', 1)"]
