"""Secret scans.

Three patterns find secrets by their form. Besides, every long token of an encoding (hexadecimal, letters of one case or
both, base 32, base 36, base 62, base 64) takes a battery of tests: chi-squared uniformity over its inferred alphabet
(digits, letters that are common in the corpus, others), the runs test on kinds of characters, and the serial test on
neighbouring letters. What is tested is "this is ordinary text", and what ordinary text is the corpus itself tells: one pass
counts its neighbouring letters, starts and ends of words among them, outside long tokens. These counts add up over tasks;
names are drawn from them as a chain of letters and written in the ways of programs and addresses, and the statistics of
such names, for hexadecimal ones, letters alone and the rest apart, are the null. The three scores, in deviations towards
uniform independent characters, add up to one p-value. Within a document a Benjamini-Hochberg step, weighted by token
length since long tokens give the tests more power, bounds the share of ordinary names among those reported at FDR. A
reported token must also pass for a random one: the same three tests against uniform independent characters, combined by
Fisher's method, reject a random token in one of 10,000 cases. Runs of name=value are cut at '=', and each field is tested
whole and in its parts between separators, which an encoding may have or not; of parts that overlap the longest one that
is reported counts.

Nulls and empty texts have no spans. A corpus of few letters says little of what is ordinary, so next to nothing is reported
beside the patterns. Null doc_ids, repeated rows and other columns are kept as they are.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Alphabets, smallest first, in the order of their values.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (("hex", _DIGITS + "abcdef"), ("hex", _DIGITS + "ABCDEF"), ("hex", _DIGITS + "abcdefABCDEF"), ("letters", _LOWER), ("letters", _UPPER), ("base32", _UPPER + "234567"), ("base36", _DIGITS + _LOWER), ("base36", _DIGITS + _UPPER), ("letters", _UPPER + _LOWER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64", _UPPER + _LOWER + _DIGITS + "-_"))
#: Least length of a token.
LEAST = 20
#: What may part a field, the separators of one base 64 or of the other or of both.
_PARTS = tuple(re.compile(x) for x in ("[^=]+", "[^=_-]+", "[^=/+]+", "[^=/+_-]+"))
#: Share of ordinary names among the reported tokens at most; chance that a random token fails to pass for one.
FDR, REFUSED = 0.005, 1e-4
#: Pairs of letters that count as seen before any text is; share of uniform letters that the serial test allows for.
PRIOR, UNIFORM = 1000, 0.1
#: Names that are drawn for a null, and the words that they are made of.
NAMES, WORDS = 800, 600

# ---- counts of the corpus ----

#: Codes of bytes: letters, what parts words, what is neither.
_EDGE, _NONE, _CODES = 26, 27, 28
_CODE = np.full(256, _NONE, np.int64)
_CODE[:128] = _EDGE
_CODE[48:58] = _NONE
_CODE[65:91] = _CODE[97:123] = np.arange(26)
_OF_TOKEN = np.zeros(256, bool)
_OF_TOKEN[[ord(c) for c in _DIGITS + _UPPER + _LOWER + "+/_=-"]] = True


def pair_counts(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """How often each letter or edge of a word follows each one in texts, long tokens left out, as 28 x 28 counts."""
    if not len(data):
        return np.zeros(_CODES * _CODES, np.int64)
    code = _CODE[data]
    own, edge = _OF_TOKEN[data], np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before, after = np.concatenate(([False], own[:-1])) & ~edge[:-1], np.concatenate((own[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1
    long = ends - starts >= LEAST
    depth = np.zeros(len(data) + 1, np.int64)
    np.add.at(depth, starts[long], 1)
    np.add.at(depth, ends[long], -1)
    code[np.cumsum(depth[:-1]) > 0] = _NONE
    pairs = code[:-1] * _CODES + code[1:]
    inner = offs[1:-1]
    pairs[inner[(inner > 0) & (inner < len(data))] - 1] = _NONE * _CODES + _NONE  # two texts
    return np.bincount(pairs, minlength=_CODES * _CODES)


def corpus_counts(docs: DataFrame) -> tuple[int, ...]:
    """pair_counts() of all texts: each task adds up its own, and sends a row for each pair that it saw."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES * _CODES, np.int64)
        for b in batches:
            for _, offs, data in texts(b.column(0)):
                total += pair_counts(offs, data)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["pair", "n"])

    out = [0] * (_CODES * _CODES)
    for r in docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 784 rows at most
        out[r.pair] = r.n
    return tuple(out)


def counts_of(given: Iterable[str | None]) -> tuple[int, ...]:
    """pair_counts() of texts at hand."""
    total = np.zeros(_CODES * _CODES, np.int64)
    for _, offs, data in texts(pa.array(list(given), pa.string())):
        total += pair_counts(offs, data)
    return tuple(int(x) for x in total)


# ---- the tests ----


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared by Wilson and Hilferty."""
    return _normal_tail(((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k)))


def infer(token: str) -> tuple[str, str] | None:
    """The smallest encoding that has all characters of the token; large alphabets must be used in both cases."""
    own = set(token)
    if not own - set(_DIGITS):
        return None
    for name, alphabet in ENCODINGS:
        if own <= set(alphabet):
            if name in ("base62", "base64") and not (own & set(_UPPER) and own & set(_LOWER) and own & set(_DIGITS)):
                return None
            return name, alphabet
    return None


def tokens(run: str) -> list[tuple[int, str, str]]:
    """(start, token, alphabet) of all fields of a run, and of their parts, that are long enough in an encoding."""
    out = {}
    for cut in _PARTS:
        for m in cut.finditer(run):
            if m.span() not in out and m.end() - m.start() >= LEAST and (kind := infer(m.group())):
                mixed = kind[0] == "hex" and len(kind[1]) > 16  # a digit's case says nothing
                out[m.span()] = (m.start(), m.group().lower() if mixed else m.group(), kind[1][:16] if mixed else kind[1])
    return list(out.values())


def random_p(token: str, alphabet: str) -> float:
    """Combined p-value of the three tests under independent uniform characters."""
    n, size = len(token), len(alphabet)
    at = [alphabet.index(c) for c in token]
    bins = max(2, min(size, n // 4))
    counts = [0] * bins
    for v in at:
        counts[v * bins // size] += 1
    width = [0] * bins
    for v in range(size):
        width[v * bins // size] += 1
    p = [_chi2_tail(sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, width, strict=True)), bins - 1)]
    high = [2 * v >= size for v in at]
    n1 = sum(high)
    n2 = n - n1
    if n1 and n2:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    m = sum(at) / n
    var = sum((v - m) ** 2 for v in at)
    r = sum((a - m) * (b - m) for a, b in zip(at, at[1:], strict=False)) / var if var else 1.0
    p.append(2 * _normal_tail(abs(r * n + 1) / math.sqrt(n)))
    fisher = -2 * sum(math.log(max(x, 1e-300)) for x in p)
    return _chi2_tail(fisher, 6)


# ---- the same tests against ordinary text ----


def _kind(c: str) -> int:
    return 0 if c in _DIGITS else 1 if c in _LOWER else 2 if c in _UPPER else 3


class Null:
    """What ordinary names of a corpus are like, from its counts of neighbouring letters."""

    def __init__(self, counts: tuple[int, ...]):
        n = np.array(counts, float).reshape(_CODES, _CODES)[:27, :27]
        n[_EDGE, _EDGE] = 0
        pairs = n[:26, :26]
        seen = (pairs + PRIOR / 676) / (pairs.sum() + PRIOR)
        self.scores = np.log((1 - UNIFORM) * seen * 676 + UNIFORM)
        order = np.argsort(pairs.sum(0) + pairs.sum(1), kind="stable")
        self.common = frozenset(_LOWER[i] for i in order[-10:])
        self.chain = n + PRIOR / 27 / 27
        self.chain[_EDGE, _EDGE] = 0
        self._norms = {kind: self._measured(kind) for kind in ("hex", "letters", "mixed")}

    def word(self, rnd: random.Random, letters: int = 26) -> str:
        """A word of the chain, of the first `letters` letters, with three at least."""
        out, at = "", _EDGE
        while len(out) < 14:
            row = self.chain[at, :letters].tolist()
            if len(out) >= 3 and rnd.random() * (sum(row) + self.chain[at, _EDGE]) >= sum(row):
                break
            at = rnd.choices(range(letters), row)[0]
            out += _LOWER[at]
        return out

    def name(self, rnd: random.Random, words: list[str], kind: str) -> str:
        """Words, some with numbers, in one of the ways that names are written."""
        way, out, size = rnd.randrange(7), [], rnd.randrange(LEAST, 48)
        while sum(map(len, out)) < size:
            out.append(rnd.choice(words) + (str(rnd.randrange(10 ** rnd.randrange(1, 5))) if kind != "letters" and rnd.random() < 0.25 else ""))
        if kind == "mixed" and not set("".join(out)) & set(_DIGITS):
            out[-1] += str(rnd.randrange(100))
        if kind == "hex":
            return "".join(out) if way % 2 else "".join(out).upper()
        caps = [w.capitalize() for w in out]
        if kind == "letters":
            return ["".join(caps), out[0] + "".join(caps[1:]), "".join(out), "".join(out).upper()][way % 4]
        return ["".join(caps), out[0] + "".join(caps[1:]), "_".join(out), "-".join(caps), "/".join(caps), "".join(out), "_".join(out).upper()][way]

    def _measured(self, kind: str) -> tuple[list[tuple[float, float]], float]:
        """Mean and deviation of an observation of each statistic in ordinary names, and the deviation of the scores' sum."""
        rnd = random.Random(5)
        words, rows = [self.word(rnd, 6 if kind == "hex" else 26) for _ in range(WORDS)], []
        for _ in range(NAMES):
            t = self.name(rnd, words, kind)
            rows.append(self.statistics(t, (infer(t) or ENCODINGS[-3])[1]))
        norms = []
        for i in range(3):
            mean = sum(r[i][0] for r in rows) / len(rows)
            norms.append((mean, math.sqrt(sum((r[i][0] - mean) ** 2 * r[i][1] for r in rows) / len(rows)) or 1.0))
        sums = [_sum(r, norms) for r in rows]
        return norms, math.sqrt(sum(x * x for x in sums) / len(sums)) or 1.0

    def statistics(self, token: str, alphabet: str) -> list[tuple[float, int]]:
        """(mean, observations) of chi-squared for a character, changes of kind, and the score of neighbouring letters; the
        first and last one are less in random tokens, the other more."""
        part = lambda c: 0 if c in _DIGITS else 3 if not c.isalpha() else 1 if c.lower() in self.common else 2
        n, want, have = len(token), [0.0] * 4, [0] * 4
        for c in alphabet:
            want[part(c)] += n / len(alphabet)
        for c in token:
            have[part(c)] += 1
        chi = sum((h - w) ** 2 / w for h, w in zip(have, want, strict=True) if w)
        kinds = [_kind(c) for c in token]
        turns = list(zip(kinds, kinds[1:], strict=False))
        changes = sum(x != y and 3 not in (x, y) and (x, y) != (2, 1) for x, y in turns)
        at = [ord(c) - 97 for c in token.lower()]
        letters = [float(self.scores[at[i], at[i + 1]]) for i, t in enumerate(turns) if t in ((1, 1), (2, 1), (2, 2))]
        return [(chi / n, n), (changes / (n - 1), n - 1), (sum(letters) / max(1, len(letters)), len(letters))]

    def ordinary_p(self, token: str, alphabet: str) -> float:
        """Combined p-value of the three tests under ordinary text."""
        kind = "hex" if len(alphabet) == 16 else "letters" if not set(token) - set(_UPPER + _LOWER) else "mixed"
        norms, sd = self._norms[kind]
        return _normal_tail(_sum(self.statistics(token, alphabet), norms) / sd)


@functools.lru_cache(4)
def null_of(counts: tuple[int, ...]) -> Null:
    return Null(counts)


def _sum(stats: list[tuple[float, int]], norms: list[tuple[float, float]]) -> float:
    z = [(x - mean) / sd * math.sqrt(n) for (x, n), (mean, sd) in zip(stats, norms, strict=True)]
    return z[1] - z[0] - z[2]


def rejected(found: list[tuple[int, float]], q: float = FDR) -> list[bool]:
    """Length-weighted Benjamini-Hochberg over (length, p): True where the hypothesis falls."""
    m, mean = len(found), sum(n for n, _ in found) / max(1, len(found))
    scaled = sorted((p * mean / n, i) for i, (n, p) in enumerate(found))
    last = max((k for k, (p, _) in enumerate(scaled, 1) if p <= q * k / m), default=0)
    out = [False] * m
    for _, i in scaled[:last]:
        out[i] = True
    return out


class _Taken:
    """Disjoint stretches of a text, in order."""

    def __init__(self, found: Iterable[tuple[int, int]]):
        self.spans: list[tuple[int, int]] = []
        for s, e in sorted(found):
            if self.spans and s < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(e, self.spans[-1][1]))
            else:
                self.spans.append((s, e))

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.spans, (start, start))
        return at < len(self.spans) and self.spans[at][0] < end or at > 0 and self.spans[at - 1][1] > start

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))


def spans(text: str | None, null: Null | None = None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) in order, code points, end exclusive; without a null those of the patterns."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    long = [(m.start(), m.group()) for m in _LONG.finditer(text)]
    for at, token in long:  # a run of 32 hexadecimal digits lies within a long token
        out += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(token) if m.end() - m.start() >= 32]
    if null is None or not long:
        return sorted(out)
    base, tested = _Taken((s, e) for s, _, e in out), []
    for at, run in long:
        for lo, token, alphabet in tokens(run):
            if not base.meets(at + lo, at + lo + len(token)):
                tested.append((at + lo, token, alphabet, null.ordinary_p(token, alphabet)))
    if tested:
        falls = rejected([(len(t), p) for _, t, _, p in tested])
        taken = _Taken(())
        for n, at in sorted((-len(t), at) for (at, t, alphabet, _), hit in zip(tested, falls, strict=True) if hit and random_p(t, alphabet) >= REFUSED):
            if not taken.meets(at, at - n):
                taken.add(at, at - n)
                out.append((at, 3, at - n))
    return sorted(out)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redacted(text: str | None, null: Null | None = None, mark: str = "[SECRET]") -> str | None:
    """The text with each stretch that spans cover replaced by `mark`."""
    found = spans(text, null)
    if not found:
        return text
    out, at = [], 0
    for s, _, e in found:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, counts: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, counts and spans of every document; what is ordinary, these documents tell, or counts of others."""
    prepare(docs.sparkSession)
    counts = corpus_counts(docs) if counts is None else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [spans(t, null_of(counts)) for t in b.column(1).to_pylist()]
            numbers = [pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in range(3)]
            base = [hashlib.sha256(_joined([x for x in r if x[1] < 3]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array(base, pa.string()), pa.array([_joined(r) for r in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", counts: tuple[int, ...] | None = None) -> DataFrame:
    """The same rows and columns with the secrets in the texts replaced; n_chars, if there, follows. What is ordinary, these
    documents tell, or counts of others."""
    prepare(docs.sparkSession)
    counts = corpus_counts(docs) if counts is None else counts
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [redacted(t, null_of(counts), mark) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if chars is not None:
                n = b.column(chars).to_pylist()
                cols[chars] = pa.array([x if a == c else len(c) for a, c, x in zip(old, new, n, strict=True)], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
