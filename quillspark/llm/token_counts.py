"""Token counts by prefix dynamic programming.

A score-ordered BPE has one property that a table over prefixes can use: the encoding of a prefix is the encoding of a
shorter prefix plus one last token, and exactly one vocabulary suffix qualifies: the one that would not merge with the
token before it. So one pass over a text gives the exact token count at every prefix, and truncation and budget
questions are lookups. No piece of the vocabulary has a space after another character, so the text falls into units of
spaces and what follows them, whose tables are independent and are kept for the units that recur.

Nulls and empty texts have no tokens. Null doc_ids, repeated rows and other columns are kept as they are.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table

#: The mark for a space in the vocabulary.
SPACE_MARK = "▁"
_UNIT = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+")
#: Units kept by a worker, and the longest of them in characters.
KEPT_UNITS, KEPT_LENGTH = 700_000, 48


class PrefixCounter:
    """Counts for a sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if sp.normalize("ﬁ  x") != f"{SPACE_MARK}ﬁ{SPACE_MARK}{SPACE_MARK}x" or any(SPACE_MARK in p.strip(SPACE_MARK) or p.endswith(SPACE_MARK) and p.strip(SPACE_MARK) for p in self.scores):
            raise ValueError("the model normalises texts or has pieces across spaces")
        self.pieces = ahocorasick.Automaton()
        for p in self.scores:
            self.pieces.add_word(p, p)
        self.pieces.make_automaton()
        self.reachable: dict[str, bool] = {}
        self.stays: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, int] = {}

    def merges(self, text: str) -> list[str]:
        """The encoding of a short string by merging the best pair, leftmost first among equals, until none is left."""
        parts: list[str | None] = list(text)
        prev, nxt = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap = [(-s, i, p) for i in range(len(text) - 1) if (s := self.scores.get(p := text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = nxt[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j], nxt[i] = p, None, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for left in (prev[i], i):
                if left >= 0 and nxt[left] >= 0 and (s := self.scores.get(q := parts[left] + parts[nxt[left]])) is not None:
                    heapq.heappush(heap, (-s, left, q))
        return [p for p in parts if p is not None]

    def _follows(self, before: str, token: str) -> bool:
        """Whether `token` can be the last one after `before`: the two encoded together stay as they are."""
        alone = self.reachable.get(token)
        if alone is None:
            alone = self.reachable[token] = len(token) == 1 or self.merges(token) == [token]
        ok = alone and (not before or self.merges(before + token) == [before, token])
        if len(self.stays) > 1_000_000:
            self.stays.clear()
        self.stays[before, token] = ok
        return ok

    def unit_counts(self, unit: str) -> list[int]:
        """Tokens of every prefix of a unit, the empty one first. One pass over all vocabulary pieces in the unit, by
        where they end; of those that end at a prefix one qualifies, and a character outside the vocabulary stands alone."""
        n, stays = len(unit), self.stays
        counts, last, done = [0] * (n + 1), [""] * (n + 1), 0
        for end, token in self.pieces.iter(unit):
            if end < done:
                continue
            if done < end:
                self._alone(unit, done, end, counts, last)
            start = end + 1 - len(token)
            before = last[start]
            ok = stays.get((before, token))
            if ok or ok is None and self._follows(before, token):
                done = end + 1
                last[done], counts[done] = token, counts[start] + 1
        self._alone(unit, done, n, counts, last)
        return counts

    @staticmethod
    def _alone(unit: str, at: int, end: int, counts: list[int], last: list[str]) -> None:
        """Characters outside the vocabulary: a token for each of their bytes."""
        for i in range(at, end):
            last[i + 1], counts[i + 1] = unit[i], counts[i] + len(unit[i].encode("utf-8", "surrogatepass"))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, kept = 0, self.kept
        for unit in _UNIT.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)):
            n = kept.get(unit)
            if n is None:
                n = self.unit_counts(unit)[-1]
                if len(unit) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_UNITS:
                        kept.clear()
                    kept[unit] = n
            total += n
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every i up to the whole text; 0 for the empty one."""
        out, base = [0], 0
        for unit in _UNIT.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else ():
            counts = self.unit_counts(unit)
            out += [base + c for c in counts[1:]]
            base += counts[-1]
        # the mark put in front isn't a character of the text
        return np.array([0, *out[2:]], np.int64)

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has `budget` tokens at most."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            found = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in found]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def truncate(docs: DataFrame, model_path: str, budget: int) -> DataFrame:
    """The same rows and columns, each text cut to its longest prefix of `budget` tokens at most."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            cut = [t if not t else t[: c.fitting(t, budget)] for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(cut, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
