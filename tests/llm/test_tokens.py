"""The BPE automaton and the prefix counts against the public libraries, on any text."""

import hashlib
import struct

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import bpe_automaton, token_counts

from .conftest import edge_rows

codec = bpe_automaton.BpeCodec(bpe_automaton.default_vocabulary())
library = Tokenizer.from_file(bpe_automaton.default_vocabulary())
MODEL = public_tokenizers.path("piece_bpe_32k.model")
counter = token_counts.PrefixCounter(MODEL)
pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)

bits = st.sampled_from(["a", "th", "the ", " ", "   ", "\n", "é", "é", "ß", "Σ", "İ", "漢", "😀", "...", "!!", "'s", "1", "<|endoftext|>", "<s>", "▁", "\x00", "\x85", "ing", "</w>", "ﬁ"])
texts = st.one_of(st.text(st.characters(exclude_categories=("Cs",)), max_size=30), st.lists(bits, max_size=25).map("".join))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_bpe_like_the_library(text):
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_like_the_library():
    """Normal forms and words of all code points, in blocks (bytes of a word are encoded alike, whatever they are)."""
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(codes), 200):
        part = codes[at : at + 200]
        text = " ".join([f"a{c}b" for c in part] + [f"1{c}\u0323\u0301 !{c}?\u0345{c}" for c in part if c < "\U00020000"])
        normal = library.normalizer.normalize_str(text)
        chunks = [c for c in codec.space.split(codec.normal(text)) if c]
        assert " ".join(chunks) == codec.space.sub(" ", normal).strip(" "), hex(at)
        words = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(normal)]
        assert ["".join(map(codec.bytes.get, w.encode())) for c in chunks for w in codec.split(c)] == words, hex(at)
    apart = "".join(bpe_automaton.APART)
    assert codec.encode(apart) == library.encode(apart, add_special_tokens=False).ids


def plain_merging(word, merges):
    parts = list(word)
    while True:
        at = min((k for k in range(len(parts) - 1) if tuple(parts[k : k + 2]) in merges), key=lambda k: (merges[tuple(parts[k : k + 2])], k), default=None)
        if at is None:
            return parts
        parts[at : at + 2] = ["".join(parts[at : at + 2])]


def test_compiled_automaton_accepts_what_merging_makes():
    base, merges = list("abc"), [("a", "a"), ("b", "c"), ("aa", "b"), ("aa", "bc"), ("c", "a"), ("aa", "aa"), ("ca", "aa")]
    automaton = bpe_automaton.Automaton(base, merges)
    rank = {m: i for i, m in enumerate(merges)}
    names = list(automaton.number)
    for a in names:
        assert automaton.has(None, a) == (plain_merging(a, rank) == [a])
        for b in names:
            if automaton.has(None, a) and automaton.has(None, b):
                assert automaton.has(a, b) == (plain_merging(a + b, rank) == [a, b]), (a, b)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_counts_at_every_prefix(text):
    want = [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]
    assert counter.all_counts(text) == want and counter.count(text) == want[-1]
    for budget in (0, 1, 5, 12):
        cut = counter.longest_prefix(text, budget)
        assert want[cut] <= budget and all(n > budget for n in want[cut + 1 :])
    assert counter.span_tokens(text, 0, len(text)) == want[-1]


def test_small_stores_change_nothing():
    small = bpe_automaton.BpeCodec(bpe_automaton.default_vocabulary())
    small.memo.size = small.words.size = 3
    text = " ".join(f"word{i % 7} thing{i % 5}." for i in range(60))
    assert small.encode(text) == library.encode(text, add_special_tokens=False).ids
    less = token_counts.PrefixCounter(MODEL)
    less.totals.size = less.parts.size = 2
    assert less.count(text) == len(pieces.encode(text))


def test_units_that_fit():
    assert counter.fits("one two three", [0, 1, 100]) == [0, 1, 3]


def test_encoding_query(edge, empty):
    got = {}
    for r in bpe_automaton.encoding_digests(edge, bpe_automaton.default_vocabulary()).collect():
        got.setdefault(r.doc_id, set()).add((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    for i, t in edge_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) in got[i]
    whole = bpe_automaton.encode_documents(edge, bpe_automaton.default_vocabulary()).collect()
    assert len(whole) == len(edge_rows()) and all(r.decoded == codec.decode(r.ids) for r in whole)
    assert bpe_automaton.encoding_digests(empty, bpe_automaton.default_vocabulary()).count() == 0


def test_count_query(edge, empty):
    short = {(r.doc_id, r.limit_chars) for r in token_counts.token_counts(edge, MODEL, limit=7).collect()}
    tables = token_counts.prefix_table(edge, MODEL).select("doc_id", token_counts.longest_within(F.col("counts"), F.lit(7)).alias("cut"), F.col("counts"), token_counts.tokens_between(F.col("counts"), F.lit(0), F.size("counts") - 1).alias("all"))
    for r in tables.collect():
        assert r.counts[r.cut] <= 7 and all(n > 7 for n in r.counts[r.cut + 1 :]) and r["all"] == r.counts[-1]
        assert (r.doc_id, r.cut) in short
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(edge, MODEL).collect())
    want = [(t or "", len(pieces.encode(t or ""))) for _, t in edge_rows()]
    assert got == sorted((str(i), len(t.encode()), n, n > 4096) for (i, _), (t, n) in zip(edge_rows(), want, strict=True))
    assert token_counts.token_counts(empty, MODEL).count() == 0
