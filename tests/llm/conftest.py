from __future__ import annotations

import re

import pytest

#: Columns that documents may have besides their own, with names that the operators use inside.
EXTRA = ["row", "node", "seal", "w", "term", "pos", "text_sha256", "root", "best", "keep_id", "score", "n"]

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def edge_rows():
    long = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
    base = " ".join(f"alpha{i} beta{i}" for i in range(60))
    return [
        (1, base), (2, base), (3, base + "  \n"), (3, base + "  \n"), (4, None), (5, ""), (6, " \t\n"), (7, long), (8, long.replace("w5x", "q5x")),
        (9, "x" * 50_000), (10, "one"), (11, "One two\nthree"), (None, "no id here"), (None, base), (12, "ÄÖ ß 漢字 😀"), (13, base.replace("alpha7 ", "gamma7 ")),
    ]


def make(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for c in EXTRA:
        docs = docs.withColumn(c, F.lit(7))
    return docs


@pytest.fixture(scope="session")
def edge(spark):
    return make(spark, edge_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
