"""Word and shingle hashes of whole batches of texts, in numpy over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words in a shingle.
WIDTH = 5

#: Bytes of text that are hashed at once; a longer text is hashed alone.
BLOCK = 1 << 20

_BYTES = np.arange(256, dtype=np.uint64)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + np.uint64(32), _BYTES)
#: Bytes that belong to words once A-Z are lower case: digits, letters and whatever is not ASCII.
_IN_WORD = ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_LOWER >= 128)
_VALUE = _LOWER + np.uint64(1)

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and the byte where each starts."""
    data = np.frombuffer(raw, np.uint8)
    inside = _IN_WORD[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64), at
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    begins = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))
    powers = _powers(_P, int(place.max()) + 1)
    return mix(np.add.reduceat(_VALUE[data[at]] * powers[place], begins)), at[begins]


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of WIDTH words of each document, and the documents' numbers. words and doc are aligned
    and documents stand together. A document of fewer words, but not none, is one shingle."""
    if len(words) == 0:
        return words, doc
    n = len(words)
    powers = _powers(_Q, WIDTH)
    count = np.bincount(doc, minlength=n_docs)
    hashes, owners = [], []
    if n >= WIDTH:
        whole = words[: n - WIDTH + 1].copy()
        for j in range(1, WIDTH):
            whole += words[j : n - WIDTH + 1 + j] * powers[j]
        same = doc[: n - WIDTH + 1] == doc[WIDTH - 1 :]
        hashes.append(whole[same])
        owners.append(doc[: n - WIDTH + 1][same])
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(few):
        starts = np.searchsorted(doc, few)
        for d, s in zip(few, starts, strict=True):
            w = words[s : s + count[d]]
            hashes.append((w * powers[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
            owners.append(np.array([d], doc.dtype))
    h, d = np.concatenate(hashes), np.concatenate(owners)
    return mix(h), d


class Block:
    """Hashes of a few documents: words in order, and distinct shingles with their counts, by document."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.n = len(texts)
        self.words, at = word_hashes(b"\n".join(raw))
        self.word_doc = np.searchsorted(ends, at, "right")
        h, d = shingle_hashes(self.words, self.word_doc, self.n)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        if len(h):
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        begins = np.flatnonzero(new)
        #: Distinct shingles, the document of each, and how often it occurs there.
        self.shingle, self.doc, self.tf = h[begins], d[begins], np.diff(begins, append=len(h))
        #: Where the shingles of document i begin and end: bounds[i], bounds[i + 1].
        self.bounds = np.searchsorted(self.doc, np.arange(self.n + 1))
        self.word_bounds = np.searchsorted(self.word_doc, np.arange(self.n + 1))


def blocks(texts: list[str]) -> Iterator[tuple[int, Block]]:
    """(position of the first text, hashes) for runs of texts of about BLOCK bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield start, Block(texts[start:i])
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, Block(texts[start:])
