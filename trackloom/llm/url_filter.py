"""URL filters: rules by host and path first, then a weighted vocabulary of terms that an Aho-Corasick automaton counts.

A strict term rejects alone, soft ones by the weight of the distinct terms together. A term counts only where neither a
letter nor a digit touches it (`[0-9a-z]` and all beyond ASCII), so "ads" is not found in "roads". Rules, hosts and
paths are column expressions; only the URL itself goes to the workers' automaton, in Arrow batches, and nothing is
shuffled. Work per URL is linear in its length, whatever the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: The rules of the registered query: (verdict, host/path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Distinct terms whose weights add up to this reject a URL; a term that weighs as much alone is a strict one.
LIMIT = 2
STRICT = ("adult-x", "casino", "escorts", "hardcore", "porn", "viagra", "xxx")
SOFT = ("ads", "adult", "bets", "cheap", "dating", "farm", "free", "nude", "pills", "poker", "sex", "spam", "track", "win")
VOCABULARY = dict.fromkeys(STRICT, LIMIT) | dict.fromkeys(SOFT, 1)

COUNTS = "n_strict long, n_soft long, n_soft_terms long, weight long, terms array<string>"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z lower-cased; empty if there is no ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What stands after the host up to ?, # or the end; empty if there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, rest = rule.partition("/")
    return host.lower(), slash + rest


def longest_rule(rules: Iterable[tuple[str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. A rule fits its host and all subdomains of
    that, if the path starts with the rule's path; of two verdicts for one rule the first given holds."""
    ordered = sorted(dict(reversed([(r, v) for v, r in rules])).items(), key=lambda x: -len(x[0]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(ordered):
        at, start = split_rule(rule)
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def is_inner(c: str) -> bool:
    """Whether a character joins a term to what stands beside it."""
    return "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f"


_automata: dict[tuple, object] = {}


def automaton_for(terms: tuple[str, ...]):
    import ahocorasick

    if terms not in _automata:
        made = ahocorasick.Automaton()
        for t in terms:
            made.add_word(t, t)
        if terms:
            made.make_automaton()
        _automata[terms] = made
    return _automata[terms]


def whole_terms(automaton, url: str) -> list[str]:
    """Every occurrence of a term in a lower-cased URL that nothing touches, overlapping ones too."""
    if not len(automaton):
        return []
    last, out = len(url) - 1, []
    for end, term in automaton.iter(url):
        start = end - len(term) + 1
        before = start > 0 and is_inner(url[start - 1]) and is_inner(term[0])
        after = end < last and is_inner(url[end + 1]) and is_inner(term[-1])
        if not (before or after):
            out.append(term)
    return out


def term_counts(url: Column, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> Column:
    """A struct of COUNTS: occurrences of strict terms (weight of `limit` at least) and of soft ones, the distinct soft
    terms, the weight of all distinct terms, and these in order. Null has none. Terms must be in lower case."""
    weights = dict(vocabulary)
    if any(not t or t != t.lower() for t in weights):
        raise ValueError("terms must be non-empty and in lower case")
    terms = tuple(sorted(weights))
    to_lower = {c: c + 32 for c in range(65, 91)}

    def count(urls: pa.Array) -> pa.Array:
        automaton, rows = automaton_for(terms), []
        for u in urls:
            hits = whole_terms(automaton, (u.as_py() or "").translate(to_lower))
            found = sorted(set(hits))
            strict = sum(weights[t] >= limit for t in hits)
            rows.append({
                "n_strict": strict, "n_soft": len(hits) - strict, "n_soft_terms": sum(weights[t] < limit for t in found),
                "weight": sum(weights[t] for t in found), "terms": found,
            })
        fields = [(n, pa.int64()) for n in ("n_strict", "n_soft", "n_soft_terms", "weight")]
        return pa.array(rows, pa.struct([*fields, ("terms", pa.list_(pa.string()))]))

    return F.arrow_udf(count, f"struct<{COUNTS.replace(' long', ':long').replace('terms array', 'terms:array')}>")(url)


def judged(
    pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """A row per page: page_id, host, path, rule (the longest that fits, else null), verdict and the counts of terms.

    The verdict is the rule's; where none fits it is block if the distinct terms of the whole URL weigh `limit` at least,
    else allow. Null URLs, empty ones and those without :// have an empty host and path, so no rule fits (but one of
    host and path empty); a null or empty one is allowed, of others the whole text is searched. Repeated rows are judged
    alike, an empty table gives none, other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "found": term_counts(F.col("url"), vocabulary, limit)})
    rows = rows.withColumn("fits", longest_rule(rules, F.col("host"), F.col("path")))
    by_terms = F.when(F.col("found.weight") >= limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", by_terms).alias("verdict"), "found.*")


def allowed(pages: DataFrame, *args, url_col: str = "url", **named) -> DataFrame:
    """The pages that are not blocked, with all their columns."""
    fits = longest_rule(named.get("rules", args[0] if args else RULES), host_of(F.col(url_col)), path_of(F.col(url_col)))
    limit = named.get("limit", LIMIT)
    weight = term_counts(F.col(url_col), named.get("vocabulary", VOCABULARY), limit)["weight"]
    return pages.where(F.coalesce(fits["verdict"], F.when(weight >= limit, "block").otherwise("allow")) == "allow")


def op13_url_filter(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The twin: each term as a regular expression over the URL, whose boundaries are doubled so that two terms may share one."""
    inner = r"0-9a-z\x{80}-\x{10FFFF}"
    terms = ", ".join(f"('{t}', '{t.replace('-', '--')}', {w})" for t, w in VOCABULARY.items())
    rules = ", ".join(f"('{r}', '{split_rule(r)[0]}', '{split_rule(r)[1]}', '{v}')" for v, r in RULES)
    return rf"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
s AS (
  SELECT r, page_id, low,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
terms(term, doubled, w) AS (VALUES {terms}),
rules(rule, top, head, verdict) AS (VALUES {rules}),
hits AS (
  SELECT r, term, w,
         len(regexp_extract_all(regexp_replace(low, '([^{inner}])', '\1\1', 'g'), '(?:^|[^{inner}])' || doubled || '(?:[^{inner}]|$)')) AS n
  FROM s, terms),
counted AS (
  SELECT r, CAST(coalesce(sum(n) FILTER (w >= {LIMIT}), 0) AS BIGINT) AS n_strict, CAST(coalesce(sum(n) FILTER (w < {LIMIT}), 0) AS BIGINT) AS n_soft,
         count(*) FILTER (n > 0 AND w < {LIMIT}) AS n_soft_terms, CAST(coalesce(sum(w) FILTER (n > 0), 0) AS BIGINT) AS weight,
         coalesce(list(term ORDER BY term) FILTER (n > 0), []) AS terms
  FROM hits GROUP BY r),
fits AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM s, rules WHERE (host = top OR ends_with(host, '.' || top)) AND starts_with(path, head) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft, n_soft_terms, weight, terms
FROM s JOIN counted USING (r) LEFT JOIN fits USING (r)
"""


OP13_SQL = _sql()
