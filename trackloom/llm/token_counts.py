"""Exact token counts at every prefix of a text, by dynamic programming over a BPE piece vocabulary.

Merges never join a piece that ends in a non-space with the space mark that follows it (checked against the
vocabulary when it is loaded), so a text falls into units, a run of marks and the characters after it, that are
encoded independently. Within a unit the last token of the encoding of every prefix is found from left to
right: token t can end at i only if the unit's prefix before it ends in a token a with which t is compatible,
that is, encoding a + t gives back exactly [a, t]. One such t exists for each i. count[i] is then
count[i - len(t)] + 1, so truncation and budget questions need no second encoding.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, give_back, sliced, table

MARK = "▁"

#: Distinct units that a worker remembers, in each of two generations.
MEMO = 600_000

#: Lengths of the beginnings of units whose entries are remembered, and how many of them.
SHARED, STATES = (9, 6), 200_000

#: Where no longer piece can end.
ALONE = (1,)

#: The most pairs of tokens that are remembered.
PAIRS = 400_000

#: Units longer than this are counted but not remembered.
MEMO_CHARS = 64


class PrefixCounter:
    """Counts of a piece-BPE vocabulary with byte fallback. model_path is a .model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        #: Every piece as one object, so that remembered encodings hold no copies.
        self.names = {p: p for p in self.score}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has a space mark after another character: units would not be independent")
        ends: dict[str, set[int]] = {}
        for p in self.score:
            ends.setdefault(p[-2:], set()).add(len(p))
        #: Lengths of the pieces that end in these two characters, longest first.
        self.lengths = {e: (*sorted(n, reverse=True), 1) for e, n in ends.items() if len(e) == 2}
        #: Characters that stand side by side in some piece; between others no merge can reach.
        self.meet = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.pair: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple] = {}
        self.runs = {0: 0, 1: 1}
        self.totals, self.parts = Memo(MEMO), Memo(MEMO // 2)
        self.unit = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def cost(self, piece: str) -> int:
        """Tokens of one symbol: one, or its bytes where the vocabulary lacks it."""
        return 1 if piece in self.score else len(piece.encode())

    def merge(self, text: str) -> list[str]:
        """Plain merging: the pair whose joined piece scores highest, leftmost first, until none is left."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (s := self.score.get(joined := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.pair.get(key)
        if known is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            known = self.pair[key] = self.merge(a + b) == [a, b]
        return known

    def last_tokens(self, unit: str) -> list[str]:
        """The last token of the encoding of every prefix of a unit with one leading mark at most."""
        names, lengths, pair, slow = self.names, self.lengths, self.pair, self.compatible
        last = [""] * (len(unit) + 1)
        # Units share beginnings: the entries of a beginning are looked up together.
        begin = 1
        for k in SHARED:
            if k <= len(unit) and (shared := self.states.get(unit[:k])):
                last[: k + 1] = shared
                begin = k + 1
                break
        for end in range(begin, len(unit) + 1):
            for n in lengths.get(unit[end - 2 : end] if end > 1 else "", ALONE):
                start = end - n
                if start < 0:
                    continue
                text = unit[start:end]
                piece = names.get(text)
                if piece is None:
                    if n > 1:
                        continue
                    piece = text
                if start:
                    fits = pair.get((last[start], piece))
                    if not (slow(last[start], piece) if fits is None else fits):
                        continue
                last[end] = piece
                break
            else:
                raise AssertionError(f"no token ends at {end} of {unit!r}")
        for k in SHARED:
            if begin <= k <= len(unit):
                if len(self.states) >= STATES:
                    self.states.clear()
                self.states[unit[:k]] = tuple(last[: k + 1])
        return last

    def table(self, unit: str) -> tuple[list[int], list[bool]]:
        """For every prefix of a unit with one leading mark at most: its tokens, and whether the first token is
        longer than one character."""
        last = self.last_tokens(unit)
        count, joined = [0] * len(last), [False] * len(last)
        for end in range(1, len(last)):
            start = end - len(last[end])
            count[end] = count[start] + self.cost(last[end])
            joined[end] = joined[start] if start else end > 1
        return count, joined

    def run_count(self, n: int) -> int:
        """Tokens of a run of n marks. The pieces of marks share one score, where ties go to the left, so a run
        is merged as it stands."""
        if n not in self.runs:
            self.runs[n] = len(self.merge(MARK * n))
        return self.runs[n]

    def prefix_counts(self, unit: str) -> list[int]:
        """Token counts of every prefix of a unit (length + 1 numbers)."""
        lead = len(unit) - len(unit.lstrip(MARK))
        if lead < 2:
            return self.table(unit)[0]
        return [self.run_count(i) for i in range(lead + 1)] + self.beyond_run(unit, lead)[2:]

    def beyond_run(self, unit: str, lead: int) -> list[int]:
        """Counts of the run and 0, 1, ... characters of its last mark and the word after it. Joined pieces of
        marks score lowest, so the word takes the last mark first if it takes one."""
        inner, joined = self.table(unit[lead - 1 :])
        with_last, without = self.run_count(lead) - 1, self.run_count(lead - 1)
        return [(without if j else with_last) + n for n, j in zip(inner, joined, strict=True)]

    def unit_total(self, unit: str) -> int:
        n = self.totals.old_value(unit)
        if n is None:
            lead = len(unit) - len(unit.lstrip(MARK))
            n = self.fresh_total(unit) if lead < 2 else self.run_count(lead) if lead == len(unit) else self.beyond_run(unit, lead)[-1]
            if len(unit) <= MEMO_CHARS:
                self.totals.put(unit, n)
        return n

    def fresh_total(self, unit: str) -> int:
        """Tokens of a unit with one leading mark at most. It is cut where no piece has the two characters side by
        side, as the parts are then encoded independently too."""
        meet, known = self.meet, self.parts.new
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in meet]
        total = 0
        for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True):
            part = unit[a:b]
            n = known.get(part) or self.parts.old_value(part)
            if n is None:
                last, n, at = self.last_tokens(part), 0, len(part)
                while at:
                    n += self.cost(last[at])
                    at -= len(last[at])
                if len(part) <= MEMO_CHARS:
                    self.parts.put(part, n)
            total += n
        return total

    def units(self, text: str) -> list[str]:
        """A mark stands for each space, and one is put before the text."""
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, text: str) -> int:
        total, known, slow = 0, self.totals.new, self.unit_total
        for u in self.units(text):
            n = known.get(u)
            total += slow(u) if n is None else n
        return total

    def all_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for every i from 0 to len(text)."""
        out, base = [0], 0
        for k, u in enumerate(self.units(text)):
            inner = self.prefix_counts(u)
            out.extend(base + n for n in inner[2 if k == 0 else 1 :])
            base += inner[-1]
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has `budget` tokens at most. Units add up, so it ends in the last
        unit whose beginning fits, or at its begin; counts may fall inside a unit, so all its prefixes are looked at."""
        if budget < 0:
            return 0
        chars, tokens = self.boundaries(text)
        k = bisect.bisect_right(tokens, budget) - 1
        if k + 1 == len(chars):
            return chars[-1]
        inner = self.prefix_counts(self.units(text)[k])[1 if k == 0 else 0 :]
        return chars[k] + max((i for i in range(1, len(inner)) if tokens[k] + inner[i] <= budget), default=0)

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """(characters, tokens) at the end of every unit: a sparse form of all_counts for range questions."""
        chars, tokens = [0], [0]
        for k, u in enumerate(self.units(text)):
            chars.append(chars[-1] + len(u) - (k == 0))
            tokens.append(tokens[-1] + (self.totals.new.get(u) or self.unit_total(u)))
        return chars, tokens

    def span_tokens(self, text: str, start: int, end: int) -> int:
        """Tokens of text[:end] less those of text[:start], from the table alone."""
        counts = self.all_counts(text)
        return counts[end] - counts[start]

    def fits(self, text: str, budgets: list[int]) -> list[int]:
        """Units of the text that fit whole into each budget."""
        _, tokens = self.boundaries(text)
        return [bisect.bisect_right(tokens, b) - 1 for b in budgets]


_counters: dict[str, PrefixCounter] = {}


def counter_for(model_path: str) -> PrefixCounter:
    if model_path not in _counters:
        _counters[model_path] = PrefixCounter(model_path)
    return _counters[model_path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit, limit_chars (characters of the longest prefix of
    `limit` tokens at most, from the prefix counts). Null counts as empty: no bytes, no tokens.

    Repeated rows give repeated rows, an empty table none; other columns are not read.
    model_path must be readable on every worker.
    """
    import pyarrow as pa

    def rows(counter: PrefixCounter, texts: list[str]):
        n = [counter.count(t) for t in texts]
        cut = [counter.longest_prefix(t, limit) if x > limit else len(t) for t, x in zip(texts, n, strict=True)]
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(cut, pa.int64())]

    return _mapped(docs, model_path, "n_bytes long, n_tokens long, over_limit boolean, limit_chars long", rows, id_col, text_col)


def prefix_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id and counts, the tokens of its first 0, 1, 2, ... characters. `longest_within` and
    `tokens_between` answer from it; edge cases as in token_counts (null and empty texts: [0])."""
    import pyarrow as pa

    rows = lambda counter, texts: [pa.array([counter.all_counts(t) for t in texts], pa.list_(pa.int32()))]
    return _mapped(docs, model_path, "counts array<int>", rows, id_col, text_col)


def longest_within(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix that has `budget` tokens at most."""
    return F.size(counts) - F.array_position(F.reverse(F.transform(counts, lambda n: n <= budget)), F.lit(True))


def tokens_between(counts: Column, start: Column, end: Column) -> Column:
    """Tokens of the first `end` characters less those of the first `start`."""
    return F.get(counts, end.cast("int")) - F.get(counts, start.cast("int"))


def _mapped(docs: DataFrame, model_path: str, fields: str, rows, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the columns that rows(counter, texts) gives."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(fields)])

    def run(batches: Iterator):
        import pyarrow as pa

        counter = counter_for(model_path)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *rows(counter, [t.as_py() or "" for t in b.column(1)])], names=schema.names)
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
