import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from trackloom.llm import lm_score as op
from trackloom.llm.queries import QUERIES

from .conftest import edge_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return op.Lattice(MODEL)


def all_ways(lattice, word):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    inner, first = {}, {}
    n = 0
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            n += 1
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            if not p.startswith(op.MARK):
                inner[p] = n
                n += 1
            elif op.MARK not in p[1:]:
                first[p[1:]] = len(first)

    def rest(s):
        if s == len(word):
            return lattice.inner[lattice.n_inner]
        total = sum(lattice.inner[inner[word[s:e]]] * rest(e) for e in range(s + 1, len(word) + 1) if word[s:e] in inner)
        if word[s] not in inner:
            total += math.prod(lattice.inner[lattice.byte_at[b]] for b in word[s].encode()) * rest(s + 1)
        return total

    return math.log(sum(lattice.first[first[word[:e]]] * rest(e) for e in range(len(word) + 1) if word[:e] in first))


def test_sums_over_all_segmentations(lattice):
    words = ["the", "there", "a", "漢x", "ﬀzz", "hello,", "éà", "😀ab", "xy▁q", "thereou"]
    want = [all_ways(lattice, w) for w in words]
    assert np.allclose(lattice.ln_spelling(words), want)
    assert np.allclose([lattice._long(np.array([ord(c) for c in w], np.uint64)) for w in words], want)


def test_weights_are_probabilities(lattice):
    assert abs(lattice.inner.sum() - 1) < 1e-9 and abs(lattice.first.sum() - 1) < 1e-9
    inner, first = lattice.expected(["the", "thereou", "漢"], np.ones(3))
    assert abs(first.sum() - 3) < 1e-9 and abs(inner[-1] - 3) < 1e-9


def test_gamma():
    x = np.array([0.001, 0.3, 1, 2.5, 70, 1e5])
    assert np.allclose(op.ln_gamma(x), [math.lgamma(v) for v in x])
    assert np.allclose(op.ln_rising(np.array([0.5, 0.5]), np.array([1.0, 3.0])), [math.log(0.5), math.log(0.5 * 1.5 * 2.5)])


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def test_base_by_brute_force(spark, sf_dir, documents):
    rows = documents.collect()
    c = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            c.update(tokens(r.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in QUERIES["op7_lm_score"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        t, g = tokens(r.text), got[r.doc_id]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert abs(g.base_score - base) < 1e-6 * len(t) and g.score < 0 and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_head_and_tail_agree(documents):
    some = documents.where("doc_id < 40")
    a = {r.doc_id: r.score for r in op.lattice_scores(some, some, MODEL, head=5).collect()}
    b = {r.doc_id: r.score for r in op.lattice_scores(some, some, MODEL, head=100_000).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 * abs(b[i]) for i in a)


def test_probabilities_of_all_short_texts(spark):
    """Over a closed set of words the scores of all texts of up to two words must not sum to more than one."""
    train = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    texts = ["", "a", "b", "a a", "a b", "b a", "b b", "c", "a c", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = {texts[r.doc_id]: 10**r.score for r in op.lattice_scores(docs, train, MODEL).collect()}
    assert 0 < sum(p.values()) < 1 and p["a b"] == pytest.approx(p["b a"]) and p["a"] > p["c"] > p["zz"] > 0


def test_edges(spark, edge, empty):
    got = op.lattice_scores(edge, edge, MODEL, class_col="lang").collect()
    assert len(got) == len(edge_rows()) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert op.lattice_scores(empty, edge, MODEL).count() == 0
    untrained = op.lattice_scores(edge, empty, MODEL).collect()
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in untrained)


def test_training_helps(spark):
    r = random.Random(0)
    syllables = ["ka", "lo", "mi", "tu", "re"]
    text = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))
    train = spark.createDataFrame([(i, text(200)) for i in range(30)], "doc_id long, text string")
    docs = spark.createDataFrame([(1, text(200))], "doc_id long, text string")
    blind = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert op.lattice_scores(docs, train, MODEL).first().score > op.lattice_scores(docs, blind, MODEL).first().score


@functools.cache
def pieces_by_name():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    inner, first, n = {}, {}, 0
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            n += 1
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            if not p.startswith(op.MARK):
                inner[p] = n
                n += 1
            elif op.MARK not in p[1:]:
                first[p[1:]] = len(first)
    return inner, first


def plain_ln(lattice, word):
    """The forward recursion, a character at a time, over pieces by name."""
    inner, first = pieces_by_name()
    f = [math.log(lattice.first[first[""]])]
    for e in range(1, len(word) + 1):
        terms = [f[s] + math.log(lattice.inner[inner[word[s:e]]]) for s in range(max(0, e - lattice.longest), e) if word[s:e] in inner]
        if word[e - 1] not in inner:
            terms.append(f[e - 1] + sum(math.log(lattice.inner[lattice.byte_at[b]]) for b in word[e - 1].encode()))
        if word[:e] in first:
            terms.append(math.log(lattice.first[first[word[:e]]]))
        f.append(np.logaddexp.reduce(terms))
    return f[-1] + math.log(lattice.inner[lattice.n_inner])


def test_scores_by_brute_force(spark, documents, lattice):
    """Both scores of 50 texts by the formulas, word by word, with the class mixture; pooled classes too."""
    texts = [(r.doc_id, " ".join((r.text or "").split()[:25]), r.lang) for r in documents.orderBy("doc_id").limit(50).collect()]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    train = docs.where("doc_id % 3 > 0")
    for most in (32, 2):
        got = {r.doc_id: r for r in op.lattice_scores(docs, train, MODEL, class_col="lang", most_classes=most).collect()}
        sizes = Counter(x[2] for x in texts if x[0] % 3 > 0)
        names = sorted(sizes, key=lambda k: (-sizes[k], k))[: most - 1]
        rest = [k for k in sizes if k not in names]
        groups = [[k] for k in names] + [rest] * bool(rest)
        counts = [Counter(w for i, t, k in texts if i % 3 > 0 and k in g for w in tokens(t)[:-1]) for g in groups]
        ends = [sum(sizes[k] for k in g) for g in groups]
        number = F.lit(len(groups) - 1)
        for k, g in enumerate(groups):
            number = F.when(F.col("lang").isin(g), k).otherwise(number)
        weights = op.fit_weights(op.word_counts(train.select("text", number.cast("int").alias("class")), len(groups)), len(groups), MODEL)
        every = {w for _, t, _ in texts for w in tokens(t)[:-1]}
        old = lattice.inner.copy(), lattice.first.copy()
        want = {i: ([], []) for i, _, _ in texts}
        for c, n_ends, pair in zip(counts, ends, weights, strict=True):
            lattice.set_weights(*pair)
            spelt = {w: plain_ln(lattice, w) for w in every}
            n, end = sum(c.values()), (n_ends + 1) / (sum(c.values()) + n_ends + 2)
            prior = math.log((n_ends + 1) / (sum(ends) + len(groups)))
            for i, t, _ in texts:
                own, urn, alone = tokens(t)[:-1], 0.0, 0.0
                for k, w in enumerate(own):
                    base = (1 - end) * (max(c[w] - op.DISCOUNT, 0) / n + op.DISCOUNT * len(c) / n * math.exp(spelt[w]))
                    urn += math.log((op.URN * base + own[:k].count(w)) / (op.URN + k))
                    alone += math.log(1 - end) + spelt[w]
                urn += math.log(op.URN * end / (op.URN + len(own)))
                want[i][0].append(prior + urn)
                want[i][1].append(prior + alone + math.log(end))
        lattice.set_weights(*old)
        for i, (urn, alone) in want.items():
            assert got[i].score * math.log(10) == pytest.approx(np.logaddexp.reduce(urn), rel=1e-6)
            assert got[i].lattice_score * math.log(10) == pytest.approx(np.logaddexp.reduce(alone), rel=1e-6)


def test_long_tokens_have_their_own_likelihood(spark, lattice):
    r = random.Random(3)
    words = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (264, 3000)]
    words.append("".join(r.choice("abcdefghijklmnop0123456789+/") for _ in range(2500)))
    docs = spark.createDataFrame([*enumerate(words), (9, words[0] + " " + words[0])], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    a = op.URN
    for head in (0, 100_000):
        got = {x.doc_id: x.score * math.log(10) for x in op.lattice_scores(docs, none, MODEL, head=head).collect()}
        for i, w in enumerate(words):
            assert got[i] == pytest.approx(plain_ln(lattice, w) + math.log(a / 4 / (a + 1)), rel=1e-9)
        # The second time the urn holds the word.
        assert got[9] == pytest.approx(plain_ln(lattice, words[0]) + math.log(a / 4 / ((a + 1) * (a + 2))), rel=1e-9)
    known = {x.doc_id: x.score * math.log(10) for x in op.lattice_scores(docs, docs.where("doc_id = 9"), MODEL).collect()}
    assert min(known[0], known[9]) > -30 and max(known[1], known[2]) < -650


def test_long_words_count_in_training(lattice):
    r = random.Random(4)
    words = ["漢字" * 40, "".join(r.choice("abcdefgh") for _ in range(41)), "".join(r.choice("etaoin") for _ in range(3000))]
    own = np.array([1.0, 2.0, 3.0])
    inner, first = lattice.expected(words, own)
    assert abs(first.sum() - 6) < 1e-6 and abs(inner[-1] - 6) < 1e-6
    # Uses are the slopes of the log probability in the log weights.
    a, b = lattice.inner.copy(), lattice.first.copy()
    try:
        for piece in np.argsort(-inner[:-1])[:3]:
            up = lattice.ln_inner[piece]
            lattice.ln_inner[piece] = up + 1e-5
            more = own @ [lattice._long(np.array([ord(c) for c in w], np.uint64)) for w in words]
            lattice.ln_inner[piece] = up - 1e-5
            less = own @ [lattice._long(np.array([ord(c) for c in w], np.uint64)) for w in words]
            lattice.ln_inner[piece] = up
            assert (more - less) / 2e-5 == pytest.approx(inner[piece], rel=1e-3)
    finally:
        lattice.set_weights(a, b)
