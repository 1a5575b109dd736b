"""The pipeline against its stages done by hand."""

import re

import corpus_pipeline
from tokenizers import Tokenizer
from trackloom.llm import bpe_automaton, toxicity

from .conftest import edge_rows
from .test_decontaminate import brute
from .test_near_dedup import brute_classes


def test_same_as_by_hand(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    net = toxicity.trained_network(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = net.probabilities(net.text_logits([toxicity.words_of(t) for _, t in rows])) >= 0.5
    rows = [r for r, b in zip(rows, bad, strict=True) if not b]

    best = {}
    for i, t in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i)
    rows = [r for r in rows if r[0] in set(best.values())]

    classes = brute_classes([t for _, t in rows])
    first = {}
    for (i, _), c in zip(rows, classes, strict=True):
        first.setdefault(c, i)
    rows = [r for r in rows if r[0] in set(first.values())]

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute(rows, bench) if r[5]}
    rows = [r for r in rows if r[0] not in hit]

    library = Tokenizer.from_file(bpe_automaton.default_vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        assert list(got[i].ids) == library.encode(t, add_special_tokens=False).ids


def test_stages():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and len({n for n, _ in corpus_pipeline.STAGES}) == len(corpus_pipeline.STAGES)


def test_edges_of_every_stage(spark, sf_dir, edge, empty):
    """Null, empty, very long and repeated texts, null ids, and columns with names that are used inside."""
    rows = edge_rows()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, sf_dir)
        none = stage(spark, empty, sf_dir)
        assert none.count() == 0 and none.columns == out.columns, name
        ids = [r.doc_id for r in out.collect()]
        if name == "bpe":
            assert len(ids) == len(rows) and out.columns == ["doc_id", "ids", "decoded"]
            continue
        assert set(edge.columns) <= set(out.columns), name
        wordless = [i for i in ids if i in (4, 5, 6)]
        assert len(wordless) == (1 if name == "exact dedup" else 3), name
        assert len(ids) == {"toxicity": len(rows), "decontamination": len(rows)}.get(name, len(ids)), name
        if name == "exact dedup":
            # 1, 2, both rows of 3 and a row without id are one text; the longest, with the smallest id, stays.
            assert 3 in ids and ids.count(3) == 1 and not {1, 2} & set(ids)
        if name == "near dedup":
            assert {7, 8} - set(ids) == {8} and {1, 13} - set(ids) == {13}
