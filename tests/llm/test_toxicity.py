import random

import numpy as np

from trackloom.llm import toxicity as op
from trackloom.llm.queries import QUERIES

from .conftest import edge_rows


def test_gradients():
    rng = np.random.default_rng(0)
    net = op.Network.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    f = op.word_features(["abc", "de", "fghij", "k", "häß"])
    ids, mask = rng.integers(0, 5, (5, 6)), np.arange(6) < np.array([6, 3, 1, 5, 6])[:, None]
    target, weight = np.array([1, 0, 1, 0, 1.0]), np.ones(5)

    def loss():
        z = net.run(net.gates(net.inputs(f)), ids, mask)
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    x = net.inputs(f)
    _, grads, d_x = net.gradients(x, net.gates(x), ids, mask, target, weight)
    for name, g in (grads | net.embedding_gradients(f, d_x)).items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        p, keep = net.p[name], net.p[name][i]
        p[i] = keep + 1e-3
        up = loss()
        p[i] = keep - 1e-3
        down = loss()
        p[i] = keep
        assert abs(g[i] - (up - down) / 2e-3) < 1e-3 * max(1, abs(g[i])), name


def texts(n, seed):
    """Made-up texts; every other one holds a bad stem with a random ending somewhere."""
    r = random.Random(seed)
    syllables = ["ta", "ro", "mi", "ke", "lu", "so", "ne", "vi"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        t = [word() for _ in range(r.randint(5, 120))]
        if i % 2:
            for _ in range(2):
                t[r.randrange(len(t))] = "grax" + word()
        out.append(t)
    return out, [i % 2 for i in range(n)]


def test_learns_stems_from_whole_texts():
    x, y = texts(600, 1)
    net = op.train(x, y, 0.5)
    x, y = texts(300, 2)
    p = net.probabilities(net.text_logits(x))
    assert ((p >= 0.5) == np.array(y)).mean() > 0.97
    assert net.probabilities(net.text_logits([[]]))[0] < 0.5


def test_windows_cover_all_words():
    for n in (1, 5, 24, 25, 36, 37, 100):
        s = op.window_starts(n)
        assert s[0] == 0 and s[-1] + op.LENGTH >= n and (np.diff(s) == op.STRIDE).all() and (s < n).all()
    x, _ = texts(40, 3)
    net = op.Network.fresh(np.random.default_rng(1))
    one = [float(net.text_logits([t])[0]) for t in x]
    assert np.allclose(net.text_logits(x), one, atol=1e-4)


def test_one_label_gives_its_share():
    net = op.train([["a"], ["b"]], [0, 0], 0.0)
    p = net.probabilities(net.text_logits([["a"], []]))
    assert (p < 0.5).all()
    assert (op.train([], [], 0.0).probabilities(np.array([-np.inf])) < 0.5).all()


def test_query(spark, sf_dir, edge, empty):
    rows = QUERIES["op2_toxicity"](spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    net = op.train(*texts(60, 4), 0.5)
    got = op.score_documents(edge, net).collect()
    assert len(got) == len(edge_rows()) and all(r.predicted == 0 for r in got if r.doc_id in (4, 5, 6))
    assert op.score_documents(empty, net).count() == 0
    kept = op.drop_toxic(edge, net)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_held_out_labels_do_not_teach(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    x, y, share = op.training_sample(documents, labels)
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert (x, y, share) == op.training_sample(documents, flipped)


def test_sample_has_one_text_for_an_id(spark):
    docs = spark.createDataFrame([(1, "b c"), (1, "a b"), (1, None), (2, "x y"), (2, "x y"), (3, "z" * (op.SAMPLE_CHARS + 1)), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    texts, marks, share = op.training_sample(docs, labels, folds=1 << 40)
    assert sorted(zip(texts, marks, strict=True)) == [(["a", "b"], 1), (["x", "y"], 0)] and share == 2 / 3


def plain_probability(net, words):
    """A text's probability by loops over its windows and their words, from the formulas of the network."""
    h, p = op.HIDDEN, net.p
    if not words:
        return net.blank
    logistic = lambda x: 1 / (1 + np.exp(-x))
    row = {w: net.inputs(op.word_features([w]))[0].astype(np.float64) for w in set(words)}
    best, first = -np.inf, 0
    while True:
        window = words[first : first + op.LENGTH]
        states = np.zeros((len(window), 2 * h))
        for way, order, at in (("f", range(len(window)), 0), ("b", range(len(window) - 1, -1, -1), h)):
            s = np.zeros(h)
            for t in order:
                x, y = row[window[t]] @ p[f"W{way}"] + p[f"c{way}"], s @ p[f"U{way}"]
                z, r = logistic(x[:h] + y[:h]), logistic(x[h : 2 * h] + y[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(x[2 * h :] + r * y[2 * h :])
                states[t, at : at + h] = s
        e = np.array([np.tanh(v @ p["A"] + p["ca"]) @ p["u"] for v in states])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        best = max(best, float((a @ states) @ p["o"] + p["co"][0]))
        if first + op.LENGTH >= len(words):
            return logistic(net.scale * best + net.shift)
        first += op.STRIDE


def test_query_against_plain_loops(spark, sf_dir, documents):
    """Every score of the query, worked out again window by window, word by word."""
    net = op.trained_network(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r.score for r in QUERIES["op2_toxicity"](spark, sf_dir).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert abs(got[r.doc_id] - plain_probability(net, op.words_of(r.text))) < 1e-4, r.doc_id


def test_held_out_labels_are_told(spark):
    """Of the held-out labels of the larger table, toxic documents score higher than others, and few others are flagged."""
    folder = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(label[r.doc_id], r.score) for r in QUERIES["op2_toxicity"](spark, folder).where("held_out").collect() if label.get(r.doc_id) is not None]
    bad, good = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert len(bad) >= 3 and auc > 0.8 and np.mean([g >= 0.5 for g in good]) < 0.05
