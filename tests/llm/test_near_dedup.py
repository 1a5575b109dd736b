import random
from collections import defaultdict

import numpy as np
import pytest

from trackloom.llm import near_dedup as op
from trackloom.llm.queries import QUERIES
from trackloom.llm.shingles import Block, blocks, word_hashes

from .conftest import edge_rows, make, words_of


def brute_classes(texts, threshold=0.8):
    """Class of each text by comparing all pairs that share a shingle, over plain word tuples."""
    block = Block([t or "" for t in texts])
    seen = np.unique(block.doc.astype(np.int64) << op.FEATURE_BITS | op.feature_of(block.shingle)) & ((1 << op.FEATURE_BITS) - 1)
    idf = op.idf_table(np.bincount(seen, minlength=1 << op.FEATURE_BITS), int((np.diff(block.bounds) > 0).sum()))
    vec, holders = [], defaultdict(list)
    for i in range(len(texts)):
        s = slice(block.bounds[i], block.bounds[i + 1])
        vec.append((block.shingle[s], block.tf[s] * idf[op.feature_of(block.shingle[s])]))
        for h in block.shingle[s].tolist():
            holders[h].append(i)
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(p, q) for h in holders.values() for k, q in enumerate(h) for p in h[:k]}:
        if op.weighted_jaccard(*vec[a], *vec[b]) >= threshold:
            up[root(a)] = root(b)
    return [root(i) for i in range(len(texts))]


def partition(ids, classes):
    out = defaultdict(set)
    for i, c in zip(ids, classes, strict=True):
        out[c].add(i)
    return {frozenset(s) for s in out.values()}


def test_words_and_shingles_by_plain_python():
    texts = [t or "" for _, t in edge_rows()]
    block = Block(texts)
    for i, t in enumerate(texts):
        w = words_of(t)
        assert block.word_bounds[i + 1] - block.word_bounds[i] == len(w)
        want = len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0
        assert block.bounds[i + 1] - block.bounds[i] == want
    a, b = word_hashes(b"abc, ABC abd")[0], word_hashes(b"abc")[0]
    assert a[0] == a[1] == b[0] != a[2]
    parts = list(blocks(["x " * 400_000, "y", "z " * 700_000, ""]))
    assert sum(p.n for _, p in parts) == 4 and [s for s, _ in parts][0] == 0


def test_samples_agree_as_often_as_texts_are_alike():
    r = random.Random(1)
    a = [f"w{r.random()}" for _ in range(400)]
    b = list(a)
    for k in range(0, 400, 50):
        b[k] = "changed"
    block = Block([" ".join(a), " ".join(b)])
    w = np.ones(len(block.shingle), np.float32) * 3
    s = op.Sampler(2000).samples(block.shingle, np.log(w), block.bounds[:-1])
    half = block.bounds[1]
    real = op.weighted_jaccard(block.shingle[:half], w[:half], block.shingle[half:], w[half:])
    assert abs((s[0] == s[1]).mean() - real) < 0.05


def test_documents(spark, sf_dir, documents):
    docs = documents.select("doc_id", "text").toPandas()
    got = {r.doc_id: r for r in QUERIES["op8_near_dedup"](spark, sf_dir).collect()}
    want = partition(docs.doc_id, brute_classes(docs.text.tolist()))
    assert partition(docs.doc_id, [got[i].class_id for i in docs.doc_id]) == want
    for group in want:
        assert sum(got[i].kept for i in group) == 1 and {got[i].class_size for i in group} == {len(group)} and got[min(group)].kept


def near_copies(n, seed=0):
    r = random.Random(seed)
    base = [f"t{r.randrange(10**6)}" for _ in range(300)]
    out = []
    for i in range(n):
        t = list(base)
        t[r.randrange(300)] = f"own{i}"
        out.append(" ".join(t))
    return out


def test_large_group_of_near_copies(spark):
    texts = near_copies(400) + [" ".join(f"x{i}y{j}" for j in range(50)) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op.near_classes(df).collect()
    assert {r.class_size for r in got if r.doc_id < 400} == {400} and {r.class_size for r in got if r.doc_id >= 400} == {1}


@pytest.mark.parametrize("edges, n", [([], 0), ([(b"a", b"b")], 1), ([(bytes([i]), bytes([i + 1])) for i in range(40)], 1), ([(b"a", b"b"), (b"c", b"d"), (b"b", b"e")], 2)])
def test_components(spark, edges, n):
    got = op.components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    assert len({bytes(r.root) for r in got}) == n and all(bytes(r.root) < bytes(r.node) for r in got)


def test_edges(spark, edge, empty):
    got = op.near_classes(edge).collect()
    assert len(got) == len(edge_rows())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {r.class_id for i in (1, 2, 3, 13) for r in by[i]} == {1} and by[7][0].class_id == by[8][0].class_id == 7
    assert all(r.class_size == 1 for i in (4, 5, 6, 9, 10, 11, 12) for r in by[i])
    out = op.drop_near_copies(edge)
    assert out.columns == edge.columns and out.count() == sum(r.kept for r in got)
    assert op.near_classes(empty).count() == 0 and op.drop_near_copies(empty).count() == 0
    assert op.near_classes(make(spark, [(1, None), (1, None)])).where("kept").count() == 2


def test_pairs_among_texts_of_one_passage(spark):
    """Many texts share a passage that is most of them, and are not alike; pairs among them share more."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(120)]
    texts = []
    for k in range(60):
        own = [f"o{k}x{r.randrange(10**6)}" for _ in range(80)]
        texts += [" ".join(passage + own), " ".join(passage + own[:76] + [f"z{k}"] * 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in op.near_classes(df).collect()}
    assert partition(range(len(texts)), [got[i] for i in range(len(texts))]) == partition(range(len(texts)), brute_classes(texts))


def test_thousands_of_texts_of_one_passage(spark):
    """2,000 strangers by a passage (similarity 0.7) in 1,000 pairs of 0.85: buckets are full of strangers."""
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(700))
    texts = []
    for k in range(1000):
        own = [f"o{k}x{r.randrange(10**6)}" for _ in range(20)]
        texts += [" ".join([passage, *own]), " ".join([passage, *own[:11], *(f"z{k}y{j}" for j in range(9))])]
    block = Block(texts)
    seen = np.unique(block.doc.astype(np.int64) << op.FEATURE_BITS | op.feature_of(block.shingle)) & ((1 << op.FEATURE_BITS) - 1)
    idf = op.idf_table(np.bincount(seen, minlength=1 << op.FEATURE_BITS), len(texts))
    cut = lambda i: slice(block.bounds[i], block.bounds[i + 1])
    side = lambda i: (block.shingle[cut(i)], idf[op.feature_of(block.shingle[cut(i)])])
    assert all(op.weighted_jaccard(*side(2 * k), *side(2 * k + 1)) >= 0.8 for k in range(1000))
    assert all(op.weighted_jaccard(*side(k), *side(k + 2)) < 0.75 for k in range(0, 1998, 7))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.class_id for x in op.near_classes(df).collect()}
    assert partition(range(2000), [got[i] for i in range(2000)]) == {frozenset((2 * k, 2 * k + 1)) for k in range(1000)}
