from pyspark.sql import functions as F

from trackloom.llm import warc_fixity as op
from trackloom.llm.queries import ORACLE_SQL, QUERIES


def test_same_as_sql(same_rows):
    same_rows(QUERIES["op5_warc_fixity"], ORACLE_SQL["op5_warc_fixity"])


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_finds_what_differs(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(0, 5000, 7)] + [(None, None, None), (3, "u", None)]
    a = op.records(pages(spark, rows))
    assert op.audit(a, op.records(pages(spark, rows[::-1]))).count() == 0
    other = [r for r in rows if r[0] != 700]
    other = [(r[0], r[1], "changed") if r[0] in (7, 4900) else r for r in other] + [(99_999, "n", "new"), (3, "u", None)]
    found = {(r.slot, r.kind) for r in op.audit(a, op.records(pages(spark, other))).collect()}
    assert found == {(700, "missing"), (7, "altered"), (4900, "altered"), (99_999, "extra"), (3, "altered")}


def test_edges(spark):
    none = pages(spark, [])
    assert op.fixity(none, none).count() == 0
    one = pages(spark, [(1, "u", "h"), (1, "u", "h")])
    assert [r.fault for r in op.fixity(one, none).collect()] == ["missing", "missing"]
    assert [r.fault for r in op.fixity(one, one).collect()] == [None, None]


def test_many_records_in_one_slot(spark):
    """Pages without number, and copies of one page, share a slot: offsets have no gaps and every change is seen."""
    rows = [(None, f"u{i}", "x" * (i % 9)) for i in range(300)] + [(5, "same", "copy")] * 200 + [(6, "u", "h"), (1 << 60, "far", "away"), (-7, "below", "zero")]
    a = pages(spark, rows).withColumn("slot", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("kind", F.lit("y"))
    got = op.fixity(a, pages(spark, rows[::-1])).collect()
    assert len(got) == len(rows) and {r.fault for r in got} == {None}
    files = {}
    for r in got:
        files.setdefault(r.warc_file, []).append((r.offset, r.length))
    for own in files.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    for other in (rows[1:], [(None, "u0", "y"), *rows[1:]], rows[:300] + rows[301:], [*rows, (5, "same", "copy")]):
        bad = {r.page_id: r.fault for r in op.fixity(a, pages(spark, other)).where("fault IS NOT NULL").collect()}
        assert bad == {None if other[0] != rows[0] else 5: "altered"}, bad
    extra = op.fixity(pages(spark, rows[:1]), pages(spark, [rows[0], (9, None, None)])).collect()
    assert {(r.page_id, r.fault, r.length is None) for r in extra} == {(None, None, False), (9, "extra", True)}
    assert op.fixity(pages(spark, []), pages(spark, [(9, None, None)])).count() == 1


def test_very_long_page(spark):
    rows = [(1, "u", "x" * 3_000_000), (2, "u", "y")]
    got = {r.page_id: r for r in op.fixity(pages(spark, rows), pages(spark, [(1, "u", "x" * 2_999_999 + "z"), rows[1]])).collect()}
    assert got[1].fault == "altered" and got[1].length > 3_000_000 and got[2].fault is None and got[2].offset == got[1].length
