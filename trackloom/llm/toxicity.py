"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Input of a step is one word: its own embedding (by hash) beside the pooled embeddings of its character runs of
three to five bytes, marks of begin and end included, so a stem is known whatever follows it. A window of words
is read in both directions; attention weighs the states and a linear layer gives the window's logit. All
windows of a text, each overlapping the next by half, are scored; the largest logit is the text's, and a
logistic curve fitted on the training texts turns it into a probability.

Training: on the driver, from a sample of labelled documents of bounded size. A document's label is that of its
strongest window (multiple-instance learning): the first choice of windows comes from log-odds of the input
features, later ones from the network itself, for documents of both labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, crc_of, give_back, sliced, table

#: Words in a window, and words from one window's begin to the next's.
LENGTH, STRIDE = 24, 12

WORD_ROWS, GRAM_ROWS, WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 1 << 14, 1 << 15, 8, 8, 8, 8

#: Labelled documents that training takes at most of each label, in the order of a seeded hash, and the most
#: characters that such a document may have (longer ones are only scored).
SAMPLE, SAMPLE_CHARS = 2000, 200_000

#: Passes over the chosen windows: enough for STEPS steps, within these bounds.
EPOCHS, STEPS, BATCH, RATE, SEED = (8, 16), 500, 128, 0.01, 42

GRAMS = (3, 4, 5)

_word = re.compile(WORD)
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return _word.findall(text.translate(_lower) if text else "")


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_features(words: list[str], block: int = 30_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_word_features in parts, as its intermediate arrays are several times the size of its results."""
    parts = [_word_features(words[i : i + block]) for i in range(0, len(words), block)]
    shift = np.cumsum([0] + [len(p[1]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + s for p, s in zip(parts, shift, strict=False)])


def _word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word's own embedding; rows of the character runs of all words; where each word's runs begin.

    A very long word has as many runs as bytes. Every word has at least one run, as its two marks count."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    size = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    n, base = len(data), np.uint64(0x100000001B3)
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    room = np.repeat(starts + size, size) - np.arange(n)
    h, at_word, grams, owners = np.zeros(n, np.uint64), None, [], []
    for k in range(max(GRAMS)):
        own = n - k
        if own <= 0:
            break
        h[:own] = h[:own] * base + data[k:]
        if k + 1 in GRAMS:
            fits = np.flatnonzero(room >= k + 1)
            grams.append(_finish(h[fits] + np.uint64(k + 1)) & np.uint64(GRAM_ROWS - 1))
            owners.append(owner[fits])
    rows, owners = np.concatenate(grams).astype(np.int32), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    begins = np.searchsorted(owners[order], np.arange(len(words)))
    place = np.arange(n) - starts[owner]
    power = np.full(int(size.max()), base, np.uint64)
    power[0] = 1
    at_word = np.add.reduceat(data * np.multiply.accumulate(power)[place], starts)
    return (_finish(at_word) & np.uint64(WORD_ROWS - 1)).astype(np.int32), rows[order], begins


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of a text of n words; one at least, and the last reaches the end."""
    return np.arange(0, max(n - LENGTH, 0) + STRIDE, STRIDE) if n > LENGTH else np.zeros(1, np.int64)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, words in it) for every window, and the text each is of."""
    begin = np.cumsum(counts) - counts
    first, size, owner = [], [], []
    for d, n in enumerate(counts):
        s = window_starts(int(n))
        first.append(begin[d] + s)
        size.append(np.minimum(LENGTH, n - s))
        owner.append(np.full(len(s), d))
    return np.stack([np.concatenate(first), np.concatenate(size)], 1), np.concatenate(owner)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    #: The logistic curve from a text's logit to its probability, and the probability of a text without words.
    scale: float = 1.0
    shift: float = 0.0
    blank: float = 0.0

    @classmethod
    def fresh(cls, rng) -> Network:
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        p = {"word": normal(WORD_ROWS, WORD_DIM, s=0.1), "gram": normal(GRAM_ROWS, GRAM_DIM, s=0.1)}
        for way in "fb":
            p |= {f"W{way}": normal(d, 3 * h, s=d**-0.5), f"U{way}": normal(h, 3 * h, s=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        p |= {"A": normal(2 * h, ATTENTION, s=(2 * h) ** -0.5), "ca": np.zeros(ATTENTION, np.float32), "u": normal(ATTENTION, s=0.3)}
        p |= {"o": normal(2 * h, s=0.3), "co": np.zeros(1, np.float32)}
        return cls(p)

    def inputs(self, features) -> np.ndarray:
        """A row per word: own embedding beside the mean of its character runs, scaled up by their root."""
        own, rows, begins = features
        if len(own) > 30_000:
            ends = np.append(begins, len(rows))
            cut = [slice(i, i + 30_000) for i in range(0, len(own), 30_000)]
            return np.concatenate([self.inputs((own[c], rows[ends[c.start] : ends[min(c.stop, len(own))]], begins[c] - ends[c.start])) for c in cut])
        grams = np.add.reduceat(self.p["gram"][rows], begins, axis=0)
        n = np.diff(begins, append=len(rows)).astype(np.float32)
        return np.concatenate([self.p["word"][own], grams / np.sqrt(n)[:, None]], 1)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p[f"W{way}"] + self.p[f"c{way}"] for way in "fb"}

    def run(self, gates, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. ids: a row of word rows each; mask: 1 where there is a word. keep: with what the
        backward pass needs."""
        h, n, length = HIDDEN, len(ids), ids.shape[1]
        states = np.empty((length, n, 2 * h), np.float32)
        kept = {"f": [None] * length, "b": [None] * length}
        whole = mask.all(0)
        for way, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            U, g = self.p[f"U{way}"], gates[way]
            s = np.zeros((n, h), np.float32)
            for t in range(length) if way == "f" else range(length - 1, -1, -1):
                x, y = g[ids[:, t]], s @ U
                zr = sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
                after = new + z * (s - new)
                if not whole[t]:
                    after = np.where(mask[:, t, None], after, s)
                if keep:
                    kept[way][t] = (s, z, r, new, y[:, 2 * h :])
                s = states[t, :, at] = after
        flat = np.tanh(states.reshape(-1, 2 * h) @ self.p["A"] + self.p["ca"])
        e = np.where(mask.T, (flat @ self.p["u"]).reshape(length, n), np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ self.p["o"] + self.p["co"][0]
        return (logit, (states, kept, flat.reshape(length, n, -1), a, pooled)) if keep else logit

    def gradients(self, x, gates, ids, mask, target, weight):
        """Loss and gradients of all parameters but the embeddings, and of the input rows x."""
        h, n, length = HIDDEN, len(ids), ids.shape[1]
        logit, (states, kept, flat, a, pooled) = self.run(gates, ids, mask, True)
        prob = sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - target * logit)).sum())
        d = (weight * (prob - target)).astype(np.float32)
        out = {"o": pooled.T @ d, "co": np.array([d.sum()], np.float32)}
        d_pool = d[:, None] * self.p["o"]
        d_a = np.einsum("nh,tnh->tn", d_pool, states)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_states = a[:, :, None] * d_pool
        out["u"] = np.einsum("tn,tna->a", d_e, flat)
        d_flat = d_e[:, :, None] * self.p["u"] * (1 - flat * flat)
        out["A"] = states.reshape(-1, 2 * h).T @ d_flat.reshape(-1, ATTENTION)
        out["ca"] = d_flat.sum((0, 1))
        d_states += d_flat @ self.p["A"].T
        d_x = np.zeros_like(x)
        for way, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            U, W = self.p[f"U{way}"], self.p[f"W{way}"]
            d_U, d_gate = np.zeros_like(U), np.zeros((length, n, 3 * h), np.float32)
            d_s = np.zeros((n, h), np.float32)
            for t in range(length - 1, -1, -1) if way == "f" else range(length):
                s, z, r, new, y = kept[way][t]
                d_h = d_s + d_states[t, :, at]
                here = mask[:, t, None]
                d_in = np.where(here, d_h, 0)
                d_new = d_in * (1 - z) * (1 - new * new)
                d_z = d_in * (s - new) * z * (1 - z)
                d_r = d_new * y * r * (1 - r)
                d_y = np.concatenate([d_z, d_r, d_new * r], 1)
                d_U += s.T @ d_y
                d_gate[t] = np.concatenate([d_z, d_r, d_new], 1)
                d_s = np.where(here, d_in * z + d_y @ U.T, d_h)
            out[f"U{way}"], out[f"c{way}"] = d_U, d_gate.sum((0, 1))
            words = ids.T.reshape(-1)
            flat_gate = d_gate.reshape(-1, 3 * h)
            out[f"W{way}"] = x[words].T @ flat_gate
            d_word = flat_gate @ W.T
            for k in range(x.shape[1]):
                d_x[:, k] += np.bincount(words, d_word[:, k], len(x))
        return loss, out, d_x

    def embedding_gradients(self, features, d_x):
        own, rows, begins = features
        n = np.diff(begins, append=len(rows))
        d_gram = np.repeat(d_x[:, WORD_DIM:] / np.sqrt(n)[:, None], n, axis=0)
        word, gram = np.zeros((WORD_ROWS, WORD_DIM), np.float32), np.zeros((GRAM_ROWS, GRAM_DIM), np.float32)
        for k in range(WORD_DIM):
            word[:, k] = np.bincount(own, d_x[:, k], WORD_ROWS)
        for k in range(GRAM_DIM):
            gram[:, k] = np.bincount(rows, d_gram[:, k], GRAM_ROWS)
        return {"word": word, "gram": gram}

    def logits(self, gates, position: np.ndarray, spans: np.ndarray, block: int = 4096) -> np.ndarray:
        """Logits of the windows spans (first word, words) over texts whose words have the rows `position`."""
        out = np.empty(len(spans), np.float32)
        steps = np.arange(LENGTH)
        for b in range(0, len(spans), block):
            part = spans[b : b + block]
            mask = steps < part[:, 1:]
            ids = position[np.where(mask, part[:, :1] + steps, part[:, :1])]
            out[b : b + block] = self.run(gates, ids, mask)
        return out

    def text_logits(self, texts: list[list[str]]) -> np.ndarray:
        """The largest logit over all windows of each text; minus infinity for a text without words."""
        counts = np.array([len(t) for t in texts])
        out = np.full(len(texts), -np.inf)
        if counts.sum() == 0:
            return out
        index: dict[str, int] = {}
        position = np.array([index.setdefault(w, len(index)) for t in texts for w in t], np.int32)
        gates = self.gates(self.inputs(word_features(list(index))))
        some = np.flatnonzero(counts)
        spans, owner = windows_of(counts[some])
        out[some] = np.maximum.reduceat(self.logits(gates, position, spans), np.flatnonzero(np.diff(owner, prepend=-1)))
        return out

    def probabilities(self, logit: np.ndarray) -> np.ndarray:
        some = np.isfinite(logit)
        return np.where(some, sigmoid(self.scale * np.where(some, logit, 0.0) + self.shift), self.blank)


def first_choice(position, spans, owner, label, features, n_texts, counts) -> np.ndarray:
    """A value per window from log-odds of its words' features over the texts' labels."""
    own, rows, begins = features
    size = np.diff(begins, append=len(rows))
    text = np.repeat(np.arange(n_texts), counts)
    ends = np.cumsum(counts)
    bad, good = np.zeros(GRAM_ROWS, np.int64), np.zeros(GRAM_ROWS, np.int64)
    # Texts of each label that hold a character run, a few texts at a time.
    for t in range(0, n_texts, 20):
        part = slice(0 if t == 0 else ends[t - 1], ends[min(t + 20, n_texts) - 1])
        seen = np.unique((text[part] - t) * len(own) + position[part])
        seen_text, seen_word = seen // len(own), seen % len(own)
        reps = size[seen_word]
        at = np.repeat(begins[seen_word] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        pair = np.unique(np.repeat(seen_text, reps) * GRAM_ROWS + rows[at])
        is_bad = label[t + pair // GRAM_ROWS] == 1
        bad += np.bincount(pair[is_bad] % GRAM_ROWS, minlength=GRAM_ROWS)
        good += np.bincount(pair[~is_bad] % GRAM_ROWS, minlength=GRAM_ROWS)
    odds = np.log((bad + 0.5) / ((label == 1).sum() + 1)) - np.log((good + 0.5) / ((label == 0).sum() + 1))
    word_value = np.maximum.reduceat(odds[rows], begins)
    value = word_value[position]
    ends = spans[:, 0] + spans[:, 1]
    total = np.concatenate([[0], np.cumsum(np.maximum(value - 1.0, 0))])
    return total[ends] - total[spans[:, 0]]


def train(texts: list[list[str]], labels, share: float, seed: int = SEED) -> Network:
    """A network from tokenised texts with labels 0/1. share: the part of label 1 among all labelled texts."""
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Network.fresh(rng)
    net.blank = min(float(share), 0.49)
    some = [i for i, t in enumerate(texts) if t]
    texts, labels = [texts[i] for i in some], np.asarray([labels[i] for i in some], np.int64)
    if len(set(labels.tolist())) < 2:
        # Nothing to tell apart: every text gets the share of its label.
        net.scale, net.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    counts = np.array([len(t) for t in texts])
    index: dict[str, int] = {}
    position = np.array([index.setdefault(w, len(index)) for t in texts for w in t], np.int32)
    features = word_features(list(index))
    spans, owner = windows_of(counts)
    bound = np.flatnonzero(np.diff(owner, prepend=-1))
    value = first_choice(position, spans, owner, labels, features, len(texts), counts)
    own, rows, begins = features
    size = np.diff(begins, append=len(rows))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, epochs = 0, int(np.clip(STEPS * BATCH // (len(texts) + (labels == 0).sum()), *EPOCHS))
    each = {0: 0.5 / (labels == 0).sum(), 1: 0.5 / (labels == 1).sum()}
    steps = np.arange(LENGTH)
    for epoch in range(epochs):
        # The strongest window of each text, and a random one of those of label 0.
        best = np.maximum.reduceat(value, bound)[owner]
        top = np.flatnonzero(value == best)
        top = top[np.unique(owner[top], return_index=True)[1]]
        quiet = np.flatnonzero(labels == 0)
        width = np.diff(bound, append=len(spans))
        drawn = bound[quiet] + (rng.random(len(quiet)) * width[quiet]).astype(np.int64)
        chosen = rng.permutation(np.concatenate([top, drawn]))
        for b in range(0, len(chosen), BATCH):
            part = chosen[b : b + BATCH]
            mask = steps < spans[part, 1:]
            at = position[np.where(mask, spans[part, :1] + steps, spans[part, :1])]
            used, ids = np.unique(at, return_inverse=True)
            ids = ids.reshape(at.shape)
            reps = size[used]
            from_rows = np.repeat(begins[used] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            here = own[used], rows[from_rows], np.cumsum(reps) - reps
            x = net.inputs(here)
            target = labels[owner[part]].astype(np.float32)
            weight = np.where(target == 1, each[1], each[0]).astype(np.float32)
            weight = weight / weight.mean() / len(part)
            _, grads, d_x = net.gradients(x, net.gates(x), ids, mask, target, weight)
            grads |= net.embedding_gradients(here, d_x)
            step += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (RATE / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if epoch + 1 < epochs:
            value = net.logits(net.gates(net.inputs(features)), position, spans)
    logit = np.maximum.reduceat(net.logits(net.gates(net.inputs(features)), position, spans), bound).astype(np.float64)
    net.scale, net.shift = curve(logit, labels, share)
    return net


def curve(logit: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, with labels weighted to the share of label 1, by Newton steps."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    w = np.where(label == 1, share / (label == 1).sum(), (1 - share) / (label == 0).sum()) * len(label)
    # Targets off 0 and 1, so that separable texts give a finite curve.
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    y = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones_like(logit)], 1)
    for _ in range(50):
        p = sigmoid(x @ a)
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (w * (p - y)) + 1e-3 * (a - [1.0, 0.0]))
        a = a - move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a[0], 1e-3)), float(a[1])


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = SAMPLE) -> tuple[list[list[str]], list[int], float]:
    """Words and labels of at most `most` documents of each label, from rows outside fold 0, and the share of
    label 1 among all such labels. Rows without label or id teach nothing, nor do null texts and those of more than
    SAMPLE_CHARS characters; of rows that share an id one does."""
    usable = labels.where(F.col("toxic").isin(0, 1) & (crc_of(F.col("doc_id")) % folds != 0)).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    order = [F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("doc_id")]
    picked = usable.where("toxic = 1").orderBy(*order).limit(most).unionByName(usable.where("toxic = 0").orderBy(*order).limit(most))
    # One text for an id, however often it is there.
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]), reverse=True)
    one: dict[str, str] = {}  # equal words are one object
    texts, marks = [], []
    while rows:
        r = rows.pop()
        texts.append([one.setdefault(w, w) for w in words_of(r["text"])])
        marks.append(r["toxic"])
    return texts, marks, share


def score_documents(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, score, predicted (1 from 0.5 on). Texts without words (null, empty) get the
    share of label 1 in training, below 0.5. Long texts are scored whole, by their strongest window. Repeated rows
    give repeated rows, an empty table none. Other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator):
        import pyarrow as pa

        net = sent.value
        for b in sliced(batches, 256):
            score = net.probabilities(net.text_logits([words_of(t.as_py()) for t in b.column(1)])).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def trained_network(docs: DataFrame, labels: DataFrame) -> Network:
    return train(*training_sample(docs, labels))


def drop_toxic(docs: DataFrame, network: Network) -> DataFrame:
    """The documents that are not predicted toxic, with all columns, in one pass and without a shuffle. Null and empty
    texts stay, repeated rows are judged alike; the text column is named text."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index("text")

    def run(batches: Iterator):
        import pyarrow as pa

        net = sent.value
        for b in sliced(batches, 256):
            score = net.probabilities(net.text_logits([words_of(t.as_py()) for t in b.column(at)]))
            yield b.filter(pa.array(score < 0.5))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, trained_network(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_of(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
