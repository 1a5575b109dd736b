"""BPE encoding and decoding with a deterministic automaton compiled from the merge list.

The automaton reads tokens. It starts with one state for each base symbol, entered by that symbol's arc, and every
arc in every state. Each merge u + v -> w, in order, is a gadget put into it: wherever an arc u is followed by an
arc v, an arc w is laid beside both (so w is in a state if u is, provided that the state after u has v); the state
after w gets the arcs of the state after v; then the state after u loses its arc v. (Where u = v it loses w too, as
the path that w would lie beside is gone there.) What is left accepts exactly the token sequences that merging would
produce. All arcs of a token lead to one state.

`compiled` does this once for a vocabulary, over a table of bits (labels by states). States with the same arcs
become one row, labels that the same states have one column, and the table is packed: some 20 MB, of a size fixed
by the vocabulary. The driver sends it to the workers.

Encoding reads a pre-split word from left to right. A prefix has one accepted token sequence, so one state, and
one arc leads into it from the state of a shorter prefix: that whose label is the text between them and which
the table has. The path into the whole word is the encoding. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, give_back, sliced, table

#: The characters that \\s matches in the vocabulary file's patterns.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Distinct words, and chunks between white space, whose encoding a worker remembers, in each of two generations.
MEMO = 250_000

#: Lengths of the beginnings of words whose states are remembered, and how many of them.
SHARED, STATES = (9, 6), 150_000

#: Lengths of the tokens that are tried where no longer one ends.
SHORT = (2, 1)

#: Words and chunks longer than this are encoded but not remembered.
MEMO_CHARS = 64

#: The mark of a word's end in the file, and the one character that stands for it here.
END, STOP = "</w>", "\n"


#: Letters and numbers that the pattern engine's tables have and the vocabulary library's lack.
NO_WORD = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb "
    "\U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 "
    "\U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 "
    "\U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 "
    "\U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 "
    "\U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
)

#: Capitals that the library lowers and Python's tables don't know, and what they become. For a range,
#: what its first becomes.
LOWERED = {
    "\u1c89": "\u1c8a", "\ua7cb": "\u0264", "\ua7cc": "\ua7cd", "\ua7ce": "\ua7cf", "\ua7d2": "\ua7d3", "\ua7d4": "\ua7d5", "\ua7da": "\ua7db",
    "\ua7dc": "\u019b", "\U00010d50-\U00010d65": "\U00010d70", "\U00016ea0-\U00016eb8": "\U00016ebb",
}

#: Combining marks that the library's normal form takes for plain characters, as its tables are older.
PLAIN_MARKS = (
    "\u07fd \u0898-\u089f \u08ca-\u08d3 \u09fe \u0c3c \u0d3b-\u0d3c \u0eba \u1715 \u1abf-\u1ace \u1df6-\u1dfa \ua82c \U00010d24-\U00010d27 "
    "\U00010eab-\U00010eac \U00010efd-\U00010eff \U00010f46-\U00010f50 \U00010f82-\U00010f85 \U00011070 \U0001133b \U0001145e \U00011839-\U0001183a "
    "\U0001193d-\U0001193e \U00011943 \U000119e0 \U00011a34 \U00011a47 \U00011a99 \U00011d42 \U00011d44-\U00011d45 \U00011d97 \U00011f41-\U00011f42 "
    "\U00016ff0-\U00016ff1 \U0001e08f \U0001e130-\U0001e136 \U0001e2ae \U0001e2ec-\U0001e2ef \U0001e4ec-\U0001e4ef"
)

#: The two characters that the library's normal form leaves apart, for the same reason.
APART = "\U00011935", "\U00011930"


class Automaton:
    """The compiled table. Token t (a number, by `number`) leads to the state whose arcs are the bits of the row
    row_of[t] of `table`; its own bit as a label is label_of[t]. The start has the last number."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        names = [*base, *(u + v for u, v in merges)]
        self.number = {t: i for i, t in enumerate(names)}
        if len(self.number) != len(names):
            raise ValueError("two merges make one token")
        self.row_of, self.label_of, self.table = self._classes(self._bits(base, merges, names), len(names))

    def _bits(self, base, merges, names) -> tuple[np.ndarray, np.ndarray]:
        """(labels by states, packed; the state of each token, the start's last). Tokens that end a word have no arcs
        and share one state."""
        going = np.array([not t.endswith(STOP) for t in names])
        state = np.where(going, np.cumsum(going) - 1, going.sum())
        state = np.append(state, going.sum() + 1)
        bits = np.zeros((len(names), (int(state[-1]) >> 3) + 1), np.uint8)
        first = np.zeros(bits.shape[1] * 8, np.uint8)
        first[state[: len(base)][going[: len(base)]]] = 1
        first[state[-1]] = 1
        bits[: len(base)] = np.packbits(first, bitorder="little")
        for w, (u, v) in enumerate(merges, len(base)):
            if u not in self.number or v not in self.number or max(self.number[u], self.number[v]) >= w:
                raise ValueError(f"the merges make tokens from tokens made before: {u!r} {v!r}")
            u, v = self.number[u], self.number[v]
            at_u, bit_u = state[u] >> 3, np.uint8(1 << (state[u] & 7))
            if not bits[v, at_u] & bit_u:
                continue
            bits[w] = bits[u]
            if going[w]:
                bits[: w + 1, state[w] >> 3] |= (bits[: w + 1, state[v] >> 3] >> np.uint8(state[v] & 7) & np.uint8(1)) << np.uint8(state[w] & 7)
            bits[v, at_u] &= ~bit_u
            if u == v:
                bits[w, at_u] &= ~bit_u
        return bits, state

    @staticmethod
    def _classes(made: tuple[np.ndarray, np.ndarray], n: int):
        bits, state = made
        labels, label_of = np.unique(bits.view(f"V{bits.shape[1]}").ravel(), return_inverse=True)
        wide = np.unpackbits(labels.view(np.uint8).reshape(len(labels), -1), axis=1, bitorder="little")
        by_state = np.packbits(wide[:, : int(state[-1]) + 1].T, axis=1, bitorder="little")
        rows, row_of = np.unique(by_state.copy().view(f"V{by_state.shape[1]}").ravel(), return_inverse=True)
        return row_of[state].astype(np.int32), label_of.astype(np.int32), rows.view(np.uint8).reshape(len(rows), -1)

    def has(self, state: str | None, label: str) -> bool:
        """Whether the state after a token (None: the start) has an arc."""
        k = self.label_of[self.number[label]]
        return bool(self.table[self.row_of[-1 if state is None else self.number[state]], k >> 3] >> (k & 7) & 1)


def vocabulary(path: str) -> tuple[dict, list[str], list[tuple[str, str]]]:
    """(the file, base symbols, merges), a word's end written as STOP."""
    spec = json.load(open(path, encoding="utf-8"))
    model = spec["model"]
    if model["end_of_word_suffix"] != END or spec["decoder"] is not None:
        raise ValueError("a vocabulary with word ends and no decoder is needed")
    inner = lambda t: t.removesuffix(END) + STOP * t.endswith(END)
    merges = [tuple(map(inner, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    made, special = {u + v for u, v in merges}, {t["content"] for t in spec["added_tokens"]}
    return spec, [t for t in (inner(t) for t in model["vocab"] if t not in special) if t not in made], merges


@lru_cache(maxsize=2)
def compiled(path: str) -> Automaton:
    _, base, merges = vocabulary(path)
    return Automaton(base, merges)


class BpeCodec:
    """Encoder and decoder of a vocabulary file with word ends: NFC, white space runs to one space, lower case,
    words split by the file's pattern, bytes as printable characters, special strings matched in the raw text."""

    def __init__(self, path: str, automaton: Automaton | None = None):
        import regex

        spec, _, _ = vocabulary(path)
        automaton = automaton or compiled(path)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {t.removesuffix(END) + STOP * t.endswith(END): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.number = automaton.number
        self.size = [len(t) for t in self.number]
        self.ids = [ids[t] for t in self.number]
        rows = [r.tobytes() for r in automaton.table]
        self.rows = [rows[k] for k in automaton.row_of]
        self.column, self.bit = (automaton.label_of >> 3).tolist(), (1 << (automaton.label_of & 7)).tolist()
        self.labels = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in special.items()}
        self.label_of = np.array([self.labels.get(i, "") for i in range(max(self.labels) + 1)], object)
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        (pattern,) = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern)
        self.space = re.compile(f"[{SPACE}]+")
        self.no_word = re.compile("[" + NO_WORD.replace(" ", "") + "]")
        self.apart = re.compile(f"([{PLAIN_MARKS.replace(' ', '')}]|{APART[0]}(?={APART[1]}))")
        self.lower = {}
        for old, new in LOWERED.items():
            self.lower |= {c: ord(new) + c - ord(old[0]) for c in range(ord(old[0]), ord(old[-1]) + 1)}
        self.capital = re.compile("[" + "".join(LOWERED) + "]")
        self.bytes = self.byte_letters()
        lengths: dict[str, set[int]] = {}
        for t in self.number:
            if len(t) > 2:
                lengths.setdefault(t[-3:], set()).add(len(t))
        #: Lengths of the tokens that end in these three characters, longest first.
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in lengths.items()}
        self.states: dict[str, tuple[int, ...]] = {}
        self.memo, self.words = Memo(MEMO), Memo(MEMO // 2)

    @staticmethod
    def byte_letters() -> dict[int, str]:
        """Bytes that print stand for themselves, the others for characters from U+0100 on, in order."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def path_of(self, word: str) -> list[int]:
        """The arcs of a pre-split word, as token numbers."""
        text = "".join(map(self.bytes.__getitem__, word.encode())) + STOP
        n = len(text)
        number, rows, column, bit, lengths = self.number.get, self.rows, self.column, self.bit, self.lengths
        came = [-1] * (n + 1)
        # Words share beginnings: the arcs into the prefixes of a beginning are looked up together.
        begin = 1
        for k in SHARED:
            if k < n - 1 and (shared := self.states.get(text[:k])):
                came[1 : k + 1] = shared
                begin = k + 1
                break
        for to in range(begin, n + 1):
            if to == n - 1:
                continue  # the mark of the word's end belongs to the last symbol
            for size in lengths.get(text[to - 3 : to], SHORT) if to > 2 else SHORT:
                at = to - size
                if at >= 0:
                    t = number(text[at:to])
                    if t is not None and rows[came[at]][column[t]] & bit[t]:
                        came[to] = t
                        break
        for k in SHARED:
            if begin <= k < n - 1:
                if len(self.states) >= STATES:
                    self.states.clear()
                self.states[text[:k]] = tuple(came[1 : k + 1])
        arcs, at = [], n
        while at:
            arcs.append(came[at])
            at -= self.size[came[at]]
        return arcs[::-1]

    def encode_word(self, word: str) -> bytes:
        out = self.words.new.get(word) or self.words.old_value(word)
        if out is None:
            path = self.path_of(word)
            out = struct.pack(f"<{len(path)}I", *map(self.ids.__getitem__, path))
            if len(word) <= MEMO_CHARS:
                self.words.put(word, out)
        return out

    def split(self, chunk: str) -> list[str]:
        """The words of a piece of normalised text without white space, by the file's pattern."""
        # The common shapes are split without it: letters, and letters before one plain mark.
        if not chunk.isascii() and self.no_word.search(chunk):
            return [chunk[m.start() : m.end()] for m in self.word.finditer(self.no_word.sub("\uffff", chunk))]
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.word.findall(chunk)

    def encode_chunk(self, chunk: str) -> bytes:
        """A piece of normalised text without white space; splitting looks at no character beyond it."""
        out = self.memo.old_value(chunk)
        if out is not None:
            return out
        parts = [self.encode_word(w) for w in self.split(chunk)]
        out = parts[0] if len(parts) == 1 else b"".join(parts)
        if len(chunk) <= MEMO_CHARS:
            self.memo.put(chunk, out)
        return out

    def normal(self, text: str) -> str:
        """NFC and lower case, as the vocabulary's library has them."""
        if text.isascii():
            return text.lower()
        # Neither what stands before such a mark nor what follows it can join across it.
        text = "".join([p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(self.apart.split(text))])
        text = text.replace("Σ", "σ").lower()
        return text.translate(self.lower) if self.capital.search(text) else text

    def _plain(self, text: str) -> bytes:
        text = self.normal(text)
        known, slow = self.memo.new.get, self.encode_chunk
        return b"".join([known(c) or slow(c) for c in self.space.split(text) if c])

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text, 32 bits each, lowest byte first."""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join([struct.pack("<I", self.special[p]) if i % 2 else self._plain(p) for i, p in enumerate(parts) if p])

    def decode_bytes(self, ids: bytes) -> str:
        """Arc labels with a space between them, special ones too."""
        return " ".join(self.label_of[np.frombuffer(ids, "<u4")].tolist())

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, "<u4").tobytes())


    def shrink(self) -> None:
        """Forget most of what is remembered, at the end of a partition."""
        self.memo.shrink()
        self.words.shrink()
        self.states.clear()


_codecs: dict[str, BpeCodec] = {}


def _mapped(docs: DataFrame, path: str, fields: list[T.StructField], make, id_col: str, text_col: str) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *fields])
    sent = docs.sparkSession.sparkContext.broadcast(compiled(path))

    def run(batches: Iterator):
        import pyarrow as pa

        if path not in _codecs:
            _codecs[path] = BpeCodec(path, sent.value)
        codec = _codecs[path]
        for b in sliced(batches):
            rows = [make(codec, t.as_py() or "") for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
            types = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            arrays = [pa.array(c, types[f.dataType.simpleString()]) for c, f in zip(cols, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *(f.name for f in fields)])
        codec.shrink()
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, ids (array<int>), decoded. Null counts as empty: no ids, empty text.

    Repeated rows give repeated rows, an empty table none; other columns are not read. path must be readable
    on every worker.
    """

    def make(codec: BpeCodec, text: str):
        ids = codec.encode_bytes(text)
        return np.frombuffer(ids, "<i4"), codec.decode_bytes(ids)

    return _mapped(docs, path, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], make, id_col, text_col)


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, but with the count and SHA-256 digests in place of ids and text, so that neither
    leaves the worker: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make(codec: BpeCodec, text: str):
        ids = codec.encode_bytes(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode_bytes(ids).encode()).hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, path, fields, make, id_col, text_col)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_automaton(spark, sf_dir):
    return encoding_digests(table(spark, sf_dir, "documents"), default_vocabulary())
