import re

from trackloom.llm import url_filter as op
from trackloom.llm.queries import ORACLE_SQL, QUERIES

URLS = [
    None, "", "no scheme", "://", "http://", "http://a.org", "http://a.org/", "HTTP://A.ORG/x?y#z", "http://example.org/es/1", "http://EXAMPLE.org/es/", "http://example.org/ES/", "http://sub.example.org/en/12",
    "http://badexample.org/en/12", "http://example.org/en/2", "http://shop.com/fr/1", "http://shop.com/de/1", "http://shop.com/dex", "http://com/de/", "http://org.evil/", "http://a.net/?q=http://b.org/",
    "http://cheap-pills.net/", "http://cheap.net/", "http://cheap.net/cheap/cheap", "http://cheapads.net/ads", "http://ads-ads-track.net", "http://casino.net/", "http://casinos.net/", "http://ÄCASINOÄ.net", "http://casino.org/",
    "http://a.com/de?x", "http://h:8080/free#bets", "http://h?free/bets", "x://FREE_win", "http://a\nb.org/c\nd", "http://x.net/" + "free" * 30_000, "http://x.net/" + "free/" * 30_000 + "win", "http://adult-x.net", "http://adult--x.net",
]


def plain_judge(url, rules=op.RULES, vocabulary=op.VOCABULARY, limit=op.LIMIT):
    """The contract, read off a URL character by character."""
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    host, tail = lower(rest[:cut]), rest[cut:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    low, hits = lower(url), []
    for t in vocabulary:
        for i in range(len(low) - len(t) + 1):
            around = low[i - 1 : i] + low[i + len(t) : i + len(t) + 1]
            if low.startswith(t, i) and not re.search(r"[0-9a-z\x80-\U0010ffff]", around):
                hits.append(t)
    weight = sum(vocabulary[t] for t in set(hits))
    strict = sum(vocabulary[t] >= limit for t in hits)
    soft = sum(vocabulary[t] < limit for t in set(hits))
    return host, path, best and best[0], best[1] if best else "block" if weight >= limit else "allow", strict, len(hits) - strict, soft, weight, sorted(set(hits))


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' as host", "1 as found", "'v' as verdict", "2 as weight")


def test_edges_against_plain_reading(spark):
    got = {r["page_id"]: tuple(r)[1:] for r in op.judged(frame(spark, URLS)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        if u is None or len(u) < 1000:
            assert got[i] == plain_judge(u), u
    assert got[34][3:8] == ("allow", 0, 0, 0, 0) and got[35][3:8] == ("block", 0, 30_001, 2, 2)
    assert got[6][2:4] == ("org/", "allow") and got[5][2] is None and got[28][2:4] == ("org/", "allow")


def test_repeats_and_empty_tables(spark):
    df = frame(spark, ["http://cheap-pills.net/"] * 3)
    assert [r["verdict"] for r in op.judged(df.union(df)).collect()] == ["block"] * 6
    assert op.judged(frame(spark, [])).count() == 0
    assert op.allowed(df).count() == 0 and op.allowed(frame(spark, URLS[:8])).columns == df.columns


def test_other_rules_and_terms(spark):
    rules, terms = (("block", "net/"), ("allow", "net/ok"), ("block", "net/ok/not")), {"a": 1, "b": 1, "c": 3}
    urls = ["http://x.net/ok/1", "http://x.net/ok/not", "http://x.net/1", "http://x.org/a", "http://x.org/a/b", "http://x.org/a/b/z/a", "http://x.org/c"]
    got = {r["page_id"]: tuple(r)[1:] for r in op.judged(frame(spark, urls), rules, terms, limit=3).collect()}
    assert [got[i] for i in range(len(urls))] == [plain_judge(u, rules, terms, 3) for u in urls]
    assert [r["verdict"] for r in op.judged(frame(spark, urls[3:]), (), {}).collect()] == ["allow"] * 4
    assert {r["page_id"] for r in op.allowed(frame(spark, urls), rules, vocabulary=terms, limit=3).collect()} == {0, 3, 4, 5}


def test_pages_against_plain_reading(spark, sf_dir):
    rows = QUERIES["op13_url_filter"](spark, sf_dir).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(urls) and all(tuple(r)[1:] == plain_judge(urls[r["page_id"]]) for r in rows)


def test_same_as_sql(same_rows):
    same_rows(QUERIES["op13_url_filter"], ORACLE_SQL["op13_url_filter"])


def test_sql_of_edges(spark, duck):
    """The twin on the edge cases too (without the longest)."""
    import pandas as pd

    some = [u for u in URLS if u is None or len(u) < 1000]
    duck.execute("CREATE SCHEMA IF NOT EXISTS edges")
    frame_ = pd.DataFrame({"page_id": range(len(some)), "url": some})
    duck.register("edge_pages", frame_)
    rows = duck.execute(ORACLE_SQL["op13_url_filter"].replace("FROM pages", "FROM edge_pages")).fetchall()
    duck.unregister("edge_pages")
    assert sorted(rows)[0][1:] == plain_judge(some[0]) and {r[0]: r[1:] for r in rows} == {i: plain_judge(u) for i, u in enumerate(some)}
