"""Language-model scores: subword-lattice likelihood of whole documents.

A word's spelling probability sums over all segmentations into pieces of an existing vocabulary, by a forward
recursion in log space: a first piece that begins with the space mark, further pieces, then a stop. The weights
start from the vocabulary's own scores (their order, as a Zipf law) and are re-estimated over all word types of
the training documents by expectation-maximisation, with the vocabulary's weights as a prior.

A word's base measure is its discounted count in the training documents plus the freed mass times its spelling
probability (so the whole word is one more arc of its lattice); the end of a document is a token too. A document
is then a Polya urn over this base measure: each of its words adds an arc for that word to the lattices of the
words after it. The urn's probability needs only the document's word counts:

    P(d) = G(A) / G(A + n) * product over words w of G(A p(w) + tf(w)) / G(A p(w)),   G the gamma function

The marginal of the lattice alone, over the vocabulary's pieces and nothing else, is a score of its own
(lattice_score); whole words and the urn come on top of it.

Where training documents have a class (their language), each class has counts and weights of its own, and the
probability of a document, whose own class is not looked at, is the sum over the classes.

Counts cover all training documents. Words are looked up in two ways: the most frequent ones (a fixed number)
are sent to the workers, all others meet their counts in a shuffle join, in which no word can be hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of, gathered, sliced, stored, table

MARK = "▁"

#: The most words that are looked up from a table sent to the workers: about 10 MB.
HEAD = 150_000

#: The urn's weight, the discount of counts, and how many words the vocabulary's own weights count for.
URN, DISCOUNT, PRIOR = 3000.0, 0.75, 2000.0

ROUNDS = 2

#: Classes of training documents that are told apart; the rows of the others, if there are more, are one class.
CLASSES = 32

#: Distinct words that a worker gathers before it hands on their counts.
GATHER = 400_000

#: Words in a batch where the rows are words: enough that few have a length of their own.
WORD_ROWS = 60_000

#: Words of more characters are spelt one by one, and in parts of a batch.
LONG = 40

_token = re.compile(r"[^ \t-\r]+")


def tokens(text: str | None) -> list[str]:
    """Words between white space after lower-casing A-Z, without the end token."""
    return _token.findall(text.encode().lower().decode()) if text else []


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series after a shift of eight."""
    p = x * (x + 1) * (x + 2) * (x + 3)
    q = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    y = x + 8
    i = 1 / y
    s = i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.918938533204672741780 + s - np.log(p) - np.log(q)


def ln_rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln(x (x + 1) ... (x + n - 1))."""
    return ln_rising_at(np.log(x), n)


def ln_rising_at(ln_x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same from ln x, for any x however small: x may be nothing as a number."""
    out = ln_x.copy()
    many = np.flatnonzero(n > 1)
    if len(many):
        x = np.exp(ln_x[many])
        out[many] += ln_gamma(x + n[many]) - ln_gamma(x + 1)
    return out


class Lattice:
    """Piece weights and the sums over all segmentations."""

    _BITS = 18
    _B, _INNER, _FIRST = np.uint64(0x9E3779B97F4A7C15), np.uint64(17), np.uint64(91)

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        inner, first, self.byte_at = [], [], {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_at[int(piece[3:-1], 16)] = len(inner)
                inner.append((None, sp.get_score(i)))
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                if piece.startswith(MARK):
                    if MARK not in piece[1:]:
                        first.append((piece[1:], sp.get_score(i)))
                elif MARK not in piece:
                    inner.append((piece, sp.get_score(i)))
        self.n_inner, self.n_first = len(inner), len(first)
        self.longest = max(len(p) for p, _ in inner + first if p)
        self.inner_table = self._index([p for p, _ in inner], self._INNER)
        self.first_table = self._index([p for p, _ in first], self._FIRST)
        self.mark = next(i for i, (p, _) in enumerate(first) if p == "")
        # Weights: inner pieces, then the stop, then a place that is never taken; first pieces and such a place.
        self.set_weights(np.append(self._zipf([s for _, s in inner]) * 0.7, 0.3), self._zipf([s for _, s in first]))
        self.prior = self.inner.copy(), self.first.copy()

    @staticmethod
    def _zipf(scores: list[float]) -> np.ndarray:
        """Weights in the order of the scores, as one over rank; equal scores come in the order of the file."""
        order = np.argsort(-np.array(scores), kind="stable")
        w = np.empty(len(scores))
        w[order] = 1.0 / (np.arange(len(scores)) + 10.0)
        return w / w.sum()

    def set_weights(self, inner: np.ndarray, first: np.ndarray) -> None:
        self.inner, self.first = inner / inner.sum(), first / first.sum()
        self.ln_inner = np.append(np.log(self.inner), -np.inf)
        self.ln_first = np.append(np.log(self.first), -np.inf)
        self.ln_stop = float(self.ln_inner[self.n_inner])

    def _hash(self, text: str, seed: np.uint64) -> int:
        h = int(seed)
        for c in text:
            h = (h * int(self._B) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _index(self, pieces: list[str | None], seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Two tables of hashes and of numbers: a piece, or a beginning of pieces (number -2), is at its place in
        the one or the other."""
        wanted: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if p:
                wanted[p] = i
                for k in range(1, len(p)):
                    wanted.setdefault(p[:k], -2)
        named = {self._hash(p, seed): i for p, i in wanted.items()}
        if 0 in named or len(named) != len(wanted):
            raise ValueError("two pieces share a hash")
        h = np.array(list(named), np.uint64)
        place = [dict(zip(named, p.tolist(), strict=True)) for p in self._places(h)]
        held: list[dict[int, int]] = [{}, {}]
        for key in named:
            side = 0
            for _ in range(500):
                at = place[side][key]
                out = held[side].get(at)
                held[side][at] = key
                if out is None:
                    break
                key, side = out, 1 - side
            else:
                raise ValueError("the pieces don't fit into two tables")
        keys, ids = np.zeros((2, 1 << self._BITS), np.uint64), np.full((2, 1 << self._BITS), -1, np.int32)
        for side in (0, 1):
            at = np.array(list(held[side]), np.int64)
            keys[side, at] = np.array(list(held[side].values()), np.uint64)
            ids[side, at] = [named[k] for k in held[side].values()]
        return keys, ids

    @classmethod
    def _places(cls, h):
        shift = np.uint64(64 - cls._BITS)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> shift).astype(np.int64), ((h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) >> shift).astype(np.int64)

    @classmethod
    def _find(cls, keys, ids, h) -> np.ndarray:
        """Piece numbers; -2 for what only begins pieces, -1 for what doesn't."""
        a, b = cls._places(h)
        return np.where(keys[0][a] == h, ids[0][a], np.where(keys[1][b] == h, ids[1][b], np.int32(-1)))

    def _arcs(self, codes: np.ndarray):
        """(start, end, rows, inner piece numbers) and (end, rows, first piece numbers) for a matrix of words of
        one length, a row each, and by position the rows and characters that have no piece."""
        n, length = codes.shape
        inner, first, bare = [], [], {}
        for table, seed, last_start, arcs in ((self.inner_table, self._INNER, length, inner), (self.first_table, self._FIRST, 1, first)):
            for s in range(last_start):
                rows, h = np.arange(n), np.full(n, seed)
                for e in range(s + 1, length + 1):
                    # Rows whose substring begins no piece are left out from there on.
                    h = h * self._B + (codes[rows, e - 1] + np.uint64(1))
                    ids = self._find(*table, h)
                    hit = ids >= 0
                    if e == s + 1 and arcs is inner and not hit.all():
                        none = np.flatnonzero(~hit)
                        bare[s] = none, codes[none, s]
                    if hit.any():
                        arcs.append((s, e, rows[hit], ids[hit]))
                    alive = np.flatnonzero(ids != -1)
                    if not len(alive):
                        break
                    rows, h = rows[alive], h[alive]
        return inner, [a[1:] for a in first], bare

    def _byte_weight(self, chars: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(chars, return_inverse=True)
        return np.array([sum(self.ln_inner[self.byte_at[b]] for b in chr(int(c)).encode("utf-8", "surrogatepass")) for c in distinct])[at]

    def _forward(self, n, length, inner, first, bare) -> np.ndarray:
        f = np.full((length + 1, n), -np.inf)
        f[0] = self.ln_first[self.mark]
        by_end: dict[int, list] = {}
        for s, e, rows, ids in inner:
            by_end.setdefault(e, []).append((s, rows, ids))
        for e, rows, ids in first:
            f[e, rows] = self.ln_first[ids]
        for e in range(1, length + 1):
            for s, rows, ids in by_end.get(e, ()):
                f[e, rows] = np.logaddexp(f[e, rows], f[s, rows] + self.ln_inner[ids])
            if e - 1 in bare:
                rows, chars = bare[e - 1]
                f[e, rows] = np.logaddexp(f[e, rows], f[e - 1, rows] + self._byte_weight(chars))
        return f

    def _groups(self, words: list[str], block: int = 16384):
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            step = block if length <= LONG else max(1, block * LONG // length)
            for b in range(0, len(rows), step):
                part = rows[b : b + step]
                raw = "".join([words[i] for i in part]).encode("utf-32-le", "surrogatepass")
                yield np.array(part), np.frombuffer(raw, np.uint32).reshape(len(part), length).astype(np.uint64)

    def ln_spelling(self, words: list[str], weights: list | None = None) -> np.ndarray:
        """Log probability of each word: all segmentations, and the stop. weights: pairs for set_weights, for
        which there is a column each; without, those that are set now."""
        columns = weights or [(self.inner, self.first)]
        out = np.empty((len(words), len(columns)))
        for rows, codes in self._groups(words):
            short = codes.shape[1] <= LONG
            arcs = self._arcs(codes) if short else None
            for k, pair in enumerate(columns):
                self.set_weights(*pair)
                out[rows, k] = self._forward(*codes.shape, *arcs)[-1] + self.ln_stop if short else [self._long(c) for c in codes]
        return out if weights else out[:, 0]

    def _long(self, codes: np.ndarray) -> float:
        """The same for one long word, with the last `longest` values of the recursion alone."""
        length, reach = len(codes), self.longest
        recent = np.full(reach, -np.inf)
        powers = np.full(reach + 1, self._B)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        recent[-1] = self.ln_first[self.mark]
        first = {e: ids for e, _, ids in self._arcs(codes[None, : min(length, reach)])[1]}
        for e in range(1, length + 1):
            k = min(e, reach)
            # Hashes of the substrings of 1 to k characters that end here.
            terms = (codes[e - k : e] + np.uint64(1))[::-1] * powers[:k]
            h = np.cumsum(terms, dtype=np.uint64) + self._INNER * powers[1 : k + 1]
            ids = np.maximum(self._find(*self.inner_table, h), -1)
            new = np.logaddexp.reduce(recent[::-1][:k] + self.ln_inner[ids])
            if ids[0] < 0:
                new = np.logaddexp(new, recent[-1] + self._byte_weight(codes[e - 1 : e])[0])
            if e in first:
                new = np.logaddexp(new, self.ln_first[first[e][0]])
            recent = np.append(recent[1:], new)
        return float(recent[-1]) + self.ln_stop

    def expected(self, words: list[str], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of inner pieces (and the stop) and first pieces over all words."""
        inner_sum, first_sum = np.zeros(self.n_inner + 1), np.zeros(self.n_first)
        for rows, codes in self._groups(words):
            n, length = codes.shape
            inner, first, bare = self._arcs(codes)
            f = self._forward(n, length, inner, first, bare)
            b = np.full((length + 1, n), -np.inf)
            b[length] = self.ln_stop
            by_start: dict[int, list] = {}
            for s, e, at, ids in inner:
                by_start.setdefault(s, []).append((e, at, ids))
            z, w = f[length] + self.ln_stop, weight[rows]
            for s in range(length - 1, -1, -1):
                if s in bare:
                    at, chars = bare[s]
                    b[s, at] = self._byte_weight(chars) + b[s + 1, at]
                for e, at, ids in by_start.get(s, ()):
                    onward = self.ln_inner[ids] + b[e, at]
                    b[s, at] = np.logaddexp(b[s, at], onward)
                    uses = np.exp(f[s, at] + onward - z[at]) * w[at]
                    if len(ids) < 1024:
                        np.add.at(inner_sum, ids, uses)
                    else:
                        inner_sum += np.bincount(ids, uses, self.n_inner + 1)
            for e, at, ids in first:
                first_sum += np.bincount(ids, np.exp(self.ln_first[ids] + b[e, at] - z[at]) * w[at], self.n_first)
            first_sum[self.mark] += (np.exp(self.ln_first[self.mark] + b[0] - z) * w).sum()
            inner_sum[self.n_inner] += w.sum()
        return inner_sum, first_sum


_lattices: dict[str, Lattice] = {}


def lattice_for(model_path: str) -> Lattice:
    if model_path not in _lattices:
        _lattices[model_path] = Lattice(model_path)
    return _lattices[model_path]


def word_counts(texts: DataFrame, classes: int) -> DataFrame:
    """word, c0, c1, ... (count in each class) over the columns text and class of all rows, in the shared folder."""

    def count(batches: Iterator):
        import pyarrow as pa

        def out(seen: list[Counter]):
            words = [w for c in seen for w in c]
            number = np.repeat(np.arange(classes), [len(c) for c in seen])
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(number.astype(np.int32)), pa.array([n for c in seen for n in c.values()], pa.int64())], names=["word", "k", "c"]
            )

        seen = [Counter() for _ in range(classes)]
        for b in sliced(batches):
            for t, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[k].update(tokens(t.as_py()))
                if sum(map(len, seen)) >= GATHER:
                    yield out(seen)
                    seen = [Counter() for _ in range(classes)]
        if any(seen):
            yield out(seen)

    found = texts.select("text", "class").mapInArrow(count, "word string, k int, c long")
    each = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("c"))), F.lit(0).cast("long")).alias(f"c{k}") for k in range(classes)]
    return stored(found.groupBy("word").agg(*each), "word-counts")


def fit_weights(counts: DataFrame, classes: int, model_path: str, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights of inner and first pieces for each class, by expectation-maximisation over all its word types, each
    counted once."""
    lattice = lattice_for(model_path)
    weights = [lattice.prior] * classes
    n_inner, size = lattice.n_inner, lattice.n_inner + 1 + lattice.n_first
    for _ in range(rounds):
        sent = counts.sparkSession.sparkContext.broadcast(weights)

        def expect(batches: Iterator, sent=sent):
            import pyarrow as pa

            own = lattice_for(model_path)
            uses = np.zeros((classes, size))
            for b in gathered(batches, WORD_ROWS):
                words = np.array(b.column(0).to_pylist(), object)
                for k in range(classes):
                    here = words[b.column(1 + k).to_numpy() > 0].tolist()
                    if here:
                        own.set_weights(*sent.value[k])
                        uses[k] += np.concatenate(own.expected(here, np.ones(len(here))))
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses.reshape(-1)[at])], names=["piece", "uses"])

        got = counts.mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros(classes * size)
        uses[got["piece"].to_numpy()] = got["uses"].to_numpy()
        both = uses.reshape(classes, size) + np.concatenate(lattice.prior) * PRIOR
        weights = [(u[: n_inner + 1] / u[: n_inner + 1].sum(), u[n_inner + 1 :] / u[n_inner + 1 :].sum()) for u in both]
    return weights


def least_count(counts: DataFrame, head: int) -> int:
    """The smallest count such that `head` words at most have it or a higher one. Counts are put in bins of two
    hundredths of their logarithm first, so that few rows come to the driver."""
    bins = counts.groupBy(F.floor(F.ln("c") * 50).alias("bin")).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    least, words = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        words += r["n"]
        if words > head:
            break
        least = r["c"]
    return least


def lattice_scores(
    docs: DataFrame,
    train: DataFrame,
    model_path: str,
    urn: float = URN,
    head: int = HEAD,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = None,
    most_classes: int = CLASSES,
) -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, lattice_score, learning from
    `train` (same columns). Tokens are words and one end; scores are log10 probabilities. base_score: words by add-one
    counts; lattice_score: every word by the sum over its segmentations into pieces of the vocabulary. Null counts as empty: the end alone. Repeated rows give repeated rows, an empty table none; an empty
    train leaves spelling alone. class_col: a column of train that tells its documents' classes (null is one;
    the smallest are one together if there are more than most_classes); other columns are not read.
    """
    spark = docs.sparkSession
    label = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    sizes = train.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(most_classes - 1).collect()
    names = [r["label"] for r in sizes]
    others = train.count() - sum(r["n"] for r in sizes)
    ends = np.array([r["n"] for r in sizes] + [others] * (others > 0) or [0], np.int64)
    classes = len(ends)
    number = F.lit(len(names) if others else 0)
    for k, name in enumerate(names):
        number = F.when(label == name, k).otherwise(number)
    counts = word_counts(train.select(F.col(text_col).alias("text"), number.cast("int").alias("class")), classes)
    own = [f"c{k}" for k in range(classes)]
    total = counts.agg(
        F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in own], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"v{c}") for c in own]
    ).first()
    n_words, v_words = np.array([total[c] for c in own], np.float64), np.array([total[f"v{c}"] for c in own], np.float64)
    n_ends = int(ends.sum())
    n_all, v_all = int(n_words.sum()) + n_ends, int(total["v"]) + (n_ends > 0)
    weights = fit_weights(counts, classes, model_path)
    # Masses of each class: of the end, of words that are spelt, and of the class.
    p_end = (ends + 1.0) / (n_words + ends + 2.0)
    freed = np.where(n_words > 0, DISCOUNT * v_words / np.maximum(n_words, 1), 1.0)
    ln_class = np.log((ends + 1.0) / (n_ends + classes))
    ln_add, ln10 = float(np.log(n_all + v_all + 1.0)), float(np.log(10.0))

    def ln_measure(c: np.ndarray, ln_spelt: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            ln_known = np.log(np.maximum(c - DISCOUNT, 0.0) / np.maximum(n_words, 1))
        return np.log(urn * (1 - p_end)) + np.logaddexp(ln_known, np.log(freed) + ln_spelt)

    parts, whole_parts = [f"ln{k}" for k in range(classes)], [f"lattice{k}" for k in range(classes)]
    spelled_names = ["word", *own, *parts]
    pieces = spark.sparkContext.broadcast(weights)

    def spell(batches: Iterator):
        import pyarrow as pa

        for b in gathered(batches, WORD_ROWS):
            spelt = lattice_for(model_path).ln_spelling(b.column(0).to_pylist(), pieces.value)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, spelt.T.copy())], names=spelled_names)

    spelled = stored(counts.mapInArrow(spell, T.StructType([*counts.schema.fields, *[T.StructField(p, T.DoubleType()) for p in parts]])), "lm-spelled")
    every = sum(F.col(c) for c in own)
    top = spelled.where(every >= least_count(spelled.select(every.alias("c")), head)).toPandas()
    head_c = top[own].to_numpy(np.int64)
    head_spelt = top[parts].to_numpy()
    sent = spark.sparkContext.broadcast((top["word"].tolist(), ln_measure(head_c, head_spelt), np.log(head_c.sum(1) + 1.0) - ln_add, head_spelt + np.log(1 - p_end)))
    del top

    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("word", T.StringType())]
        + [T.StructField("tf", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType())]
        + [T.StructField(p, T.DoubleType()) for p in [*parts, *whole_parts]]
    )

    def open_documents(batches: Iterator):
        """For each document a row without word, which sums up the end and its frequent words (tf: its tokens),
        and a row for each of its other words."""
        import pyarrow as pa

        head_words, head_ln, head_base, head_lattice = sent.value
        head_x = np.exp(head_ln)
        head_gamma = ln_gamma(head_x + 1)
        place = {w: i for i, w in enumerate(head_words)}
        end_ln, end_base = np.log(urn * p_end), float(np.log(n_ends + 1.0)) - ln_add
        whole = float(ln_gamma(np.array([urn]))[0])
        for b in sliced(batches):
            at, tf, owner, rare, rare_tf, rare_owner, n = [], [], [], [], [], [], []
            for d, t in enumerate(b.column(2)):
                words = tokens(t.as_py())
                n.append(len(words) + 1)
                for w, k in Counter(words).items():
                    i = place.get(w)
                    if i is None:
                        rare.append(w)
                        rare_tf.append(k)
                        rare_owner.append(d)
                    else:
                        at.append(i)
                        tf.append(k)
                        owner.append(d)
            at, tf, owner = np.array(at, np.int64), np.array(tf, np.float64), np.array(owner, np.int64)
            m = b.num_rows
            of = lambda v: np.bincount(owner, v, m)
            once = whole - ln_gamma(urn + np.array(n, np.float64))
            many = np.flatnonzero(tf > 1)
            more, times = at[many], tf[many]
            lns = []
            for k in range(classes):
                ln = head_ln[at, k]
                ln[many] += ln_gamma(head_x[more, k] + times) - head_gamma[more, k]
                lns.append(of(ln) + end_ln[k] + once)
            alone = [of(tf * head_lattice[at, k]) + np.log(p_end[k]) for k in range(classes)]
            rows, ids = b.column(0), b.column(1)
            yield pa.RecordBatch.from_arrays(
                [rows, ids, pa.nulls(m, pa.string()), pa.array(n, pa.int64()), pa.array((of(tf) + (n_ends > 0)).astype(np.int64)), pa.array(of(tf * head_base[at]) + end_base), *map(pa.array, lns), *map(pa.array, alone)],
                names=schema.names,
            )
            for s in range(0, len(rare), 50_000):
                part = slice(s, s + 50_000)
                k = len(rare[part])
                yield pa.RecordBatch.from_arrays(
                    [rows.take(pa.array(rare_owner[part])), pa.nulls(k, ids.type), pa.array(rare[part]), pa.array(rare_tf[part], pa.int64()), pa.nulls(k, pa.int64())]
                    + [pa.nulls(k, pa.float64())] * (1 + 2 * classes),
                    names=schema.names,
                )

    opened = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(open_documents, schema), "lm-documents")

    def close_words(batches: Iterator):
        import pyarrow as pa

        for b in gathered(batches, WORD_ROWS):
            tf = b.column(2).to_numpy().astype(np.float64)
            c = np.stack([x.fill_null(0).to_numpy() for x in b.columns[3 : 3 + classes]], 1)
            spelt = np.stack([x.to_numpy(zero_copy_only=False) for x in b.columns[3 + classes :]], 1)
            new = np.flatnonzero(np.isnan(spelt[:, 0]))
            if len(new):
                words = b.column(1).take(pa.array(new)).dictionary_encode()
                spelt[new] = lattice_for(model_path).ln_spelling(words.dictionary.to_pylist(), pieces.value)[words.indices.to_numpy()]
            ln_x, seen = ln_measure(c, spelt), c.sum(1)
            lns = [ln_rising_at(ln_x[:, k], tf) for k in range(classes)]
            alone = [tf * (spelt[:, k] + np.log(1 - p_end[k])) for k in range(classes)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.where(seen > 0, tf, 0).astype(np.int64)), pa.array(tf * (np.log(seen + 1.0) - ln_add)), *map(pa.array, [*lns, *alone])],
                names=["row", "known", "base", *parts, *whole_parts],
            )

    rare = opened.where(F.col("word").isNotNull()).select("row", "word", "tf").join(spelled, "word", "left").select("row", "word", "tf", *own, *parts)
    closed = rare.mapInArrow(close_words, "row long, known long, base double, " + ", ".join(f"{p} double" for p in [*parts, *whole_parts]))
    sums = stored(closed.groupBy("row").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), *[F.sum(p).alias(f"sum_{p}") for p in [*parts, *whole_parts]]), "lm-words")
    whole_docs = opened.where(F.col("word").isNull()).select("row", "doc_id", F.col("tf").alias("n_tokens"), "known", "base", *parts, *whole_parts)
    each = lambda names: F.array(*[F.col(p) + F.coalesce(f"sum_{p}", F.lit(0.0)) + F.lit(float(ln_class[k])) for k, p in enumerate(names)])

    def over_classes(c: str) -> Column:
        most = F.array_max(c)
        return (most + F.ln(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x - most)))) / ln10

    return (
        whole_docs.join(sums, "row", "left")
        .withColumn("each", each(parts))
        .withColumn("alone", each(whole_parts))
        .select(
            "doc_id",
            "n_tokens",
            (F.col("known") + F.coalesce("k", F.lit(0).cast("long"))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            ((F.col("base") + F.coalesce("b", F.lit(0.0))) / ln10).alias("base_score"),
            over_classes("each").alias("score"),
            over_classes("alone").alias("lattice_score"),
        )
    )


def op7_lm_score(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(crc_of(F.col("doc_id")) % 7 == 2, F.lit(False))
    scored = lattice_scores(docs, docs.where(~fold), public_tokenizers.path("piece_bpe_32k.model"), class_col="lang")
    return scored.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
