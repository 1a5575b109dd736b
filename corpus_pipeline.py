"""The corpus pipeline: five operators in a row, each over all that the one before it kept.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import bpe_automaton, common, decontaminate, exact_dedup, near_dedup, toxicity

#: A document goes if more than this share of its words lies in benchmark windows.
MOST_HIT = 0.0


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network predicts toxic go. Null and empty texts stay; repeated rows are judged alike;
    an empty table teaches nothing and gives no rows; other columns are kept as they are."""
    network = toxicity.trained_network(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, network)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays: the longest, then that of the smallest id (null last).
    Null and empty texts are equal, so one of them stays; of rows that repeat wholly one stays. An empty table gives no
    rows; other columns are kept as they are."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of the smallest id stays (null last). Texts without words (null
    and empty ones) are alike to none, so each of them stays. An empty table gives no rows; other columns are kept."""
    return near_dedup.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark text go. Null and empty texts hold none and stay; repeated rows are
    judged alike; an empty table gives no rows; other columns are kept as they are."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"), MOST_HIT)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of what is left. Null and empty texts give no ids and an empty text; repeated rows
    give repeated rows; an empty table gives none."""
    return bpe_automaton.encode_documents(docs, bpe_automaton.default_vocabulary())


STAGES = [
    ("toxicity", toxic_documents),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("bpe", encoded),
]

#: The network and the sampling of near duplicates can't be said in SQL: tests/llm/test_pipeline.py holds run()
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs, f"stage-{name.replace(' ', '-')}")
    return docs
