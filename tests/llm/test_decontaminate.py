import hashlib
from collections import Counter

from trackloom.llm import decontaminate as op
from trackloom.llm.queries import ORACLE_SQL, QUERIES

from .conftest import edge_rows, make, words_of


def test_same_as_sql(same_rows):
    same_rows(QUERIES["op1_decontaminate"], ORACLE_SQL["op1_decontaminate"])


def brute(docs, bench, size=10):
    wins = {}
    for item, text in bench:
        w = words_of(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, items = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


BENCH = [(1, "the the the the the the the the the the the the"), (2, "One two"), (10, "Alpha3 beta3 alpha4, beta4 alpha5 beta5 alpha6 beta6 alpha7 beta7 alpha8"), (3, None), (4, ""), (5, "..."), (6, "漢字 😀"), (7, "one two")]


def test_edges(spark, edge, empty):
    rows = [*edge_rows(), (20, "the " * 500), (21, "x one two one two y"), (22, "the " * 9), (22, "the " * 9)]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = op.contamination(make(spark, rows), bench).drop("seal").collect()
    assert Counter(map(tuple, got)) == brute(rows, BENCH)
    assert op.contamination(empty, bench).count() == 0
    none = op.contamination(edge, bench.where("false")).collect()
    assert len(none) == len(edge_rows()) and not any(r.contaminated for r in none)


def test_filter(spark, edge):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = op.drop_contaminated(edge, bench)
    assert out.columns == edge.columns
    assert {r.doc_id for r in out.collect()} == {None, 4, 5, 6, 7, 8, 9, 10, 13}
    assert [r.text for r in out.where("doc_id is null").collect()] == ["no id here"]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare1 a b c rare2"), (2, "rare1 " + "a " * 30 + "rare2"), (3, "rare2 rare1")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "rare1 a a rare2 a")], "item_id long, text string")
    assert {r.doc_id for r in op.near_matches(docs, bench, 8).collect()} == {1, 3}


def test_proximity_against_all_places(spark, edge, empty):
    """Places of the two rarest terms of every window, found by looking at every pair of words."""
    texts = [(i, t) for i, t in [*edge_rows(), (20, "the " * 60), (21, "x one two one two y"), (22, "two x x x x one"), (22, "two x x x x one"), (23, "one " + "x " * 9 + "two"), (24, "one " + "x " * 8 + "two")]]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = Counter((r.doc_id, r.start) for r in op.near_matches(make(spark, texts), bench).collect())
    count = Counter(w for _, t in texts for w in words_of(t))
    wins = {tuple(w[i : i + 10]) for _, t in BENCH for w in [words_of(t)] for i in range(max(len(w) - 9, 1) if w else 0)}
    # Terms of equal counts have no order that a reader could know: windows in which it matters are left out of both.
    plain = [w for w in wins if len(set(w)) < 3 or len({count[t] for t in set(w)}) == len(set(w))]
    want = Counter()
    for i, t in texts:
        words = words_of(t)
        for w in plain:
            rare = sorted(set(w), key=lambda x: count[x])[:2]
            if len(rare) == 1:
                want.update((i, k) for k, x in enumerate(words) if x == rare[0])
            else:
                want.update({(i, min(k, m)) for k, x in enumerate(words) if x == rare[0] for m in range(max(0, k - 9), k + 10) if m < len(words) and words[m] == rare[1]})
    assert len(plain) >= 3 and want and all(got[k] >= n for k, n in want.items())
    assert {i for i, _ in got} >= {20, 21, 22, 24} and 23 not in {i for i, _ in got} and got[22, 0] == 2
    # No exact occurrence is missed.
    hit = {r.doc_id for r in op.contamination(make(spark, texts), bench).where("contaminated").collect()}
    assert hit <= {i for i, _ in got}
    assert op.near_matches(empty, bench).count() == 0 and op.near_matches(edge, bench.where("false")).count() == 0
