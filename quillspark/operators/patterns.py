"""Many literal patterns counted in one pass over texts.

Patterns are a table. They are built into an Aho-Corasick automaton, which finds all of them in one scan of a text, so the
time hardly depends on their number. The automaton holds MAX_CHARS characters of patterns at most; a longer table is cut
into slices of that size, each of which takes a pass of its own over the texts. A worker holds one automaton, of about 30
bytes a character.

Counts are those of a search for each pattern alone: from left to right, without overlaps with itself. Null texts hold
nothing; null and empty patterns occur nowhere.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of patterns in one automaton; patterns that are looked for one by one.
MAX_CHARS, FEW = 8_000_000, 50
#: Patterns that are taken out of a broadcast list at a time.
CHUNK = 10_000
#: Texts whose counts are held at a time: they grow with the patterns.
ROWS = 256

class Machine(NamedTuple):
    """An automaton of numbers, by which sizes and ids of the patterns' texts are found; few texts have more ids than one."""

    trie: ahocorasick.Automaton
    sizes: array
    ids: array
    more: dict[int, list[int]]


#: The automaton that this worker used last, by the name of its broadcast list.
_built: dict[str, Machine] = {}


def folded(text: str) -> str:
    """Lower case, one character for each: those whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(patterns: Iterable[tuple[int, str]], ignore_case: bool) -> Machine:
    out = Machine(ahocorasick.Automaton(ahocorasick.STORE_INTS), array("q"), array("q"), {})
    for i, p in patterns:
        p = folded(p) if ignore_case else p
        k = out.trie.get(p, -1)
        if k >= 0:
            out.more.setdefault(k, []).append(i)
            continue
        out.trie.add_word(p, len(out.ids))
        out.sizes.append(len(p))
        out.ids.append(i)
    out.trie.make_automaton()
    return out


def counts(machine: Machine, text: str) -> dict[int, int]:
    """id, number of occurrences; ids of several patterns get their sum."""
    ends: dict[int, int] = {}
    out: dict[int, int] = {}
    _, sizes, ids, more = machine
    for last, k in machine.trie.iter(text):
        if last - sizes[k] >= ends.get(k, -1):
            ends[k] = last
            out[ids[k]] = out.get(ids[k], 0) + 1
            for i in more.get(k, ()):
                out[i] = out.get(i, 0) + 1
    return out


def slices(patterns: DataFrame, chars: int = MAX_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The patterns (id, pattern), so many characters at a time."""
    own: list[tuple[int, str]] = []
    left = chars
    for r in patterns.where(F.length("pattern") > 0).where("id IS NOT NULL").select("id", "pattern").toLocalIterator():
        if own and len(r.pattern) > left:
            yield own
            own, left = [], chars
        own.append((r.id, r.pattern))
        left -= len(r.pattern)
    if own:
        yield own


def _pass(texts: DataFrame, key: Sequence[str], columns: Sequence[str], patterns: list[tuple[int, str]], ignore_case: bool) -> DataFrame:
    packed = pa.RecordBatch.from_arrays([pa.array([i for i, _ in patterns], pa.int64()), pa.array([p for _, p in patterns], pa.large_string())], names=["id", "pattern"])
    held, name, n = texts.sparkSession.sparkContext.broadcast(packed), uuid.uuid4().hex, len(key)

    def own_patterns() -> Iterator[tuple[int, str]]:
        for lo in range(0, held.value.num_rows, CHUNK):
            yield from zip(*(c.to_pylist() for c in held.value.slice(lo, CHUNK).columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = automaton(own_patterns(), ignore_case)
        machine = _built[name]
        for b in (x.slice(lo, ROWS) for x in batches for lo in range(0, x.num_rows, ROWS)):
            rows: list[int] = []
            ids: list[int] = []
            found: list[list[int]] = [[] for _ in columns]
            for row, own in enumerate(zip(*(b.column(n + i).to_pylist() for i in range(len(columns))), strict=True)):
                each = [counts(machine, folded(t) if ignore_case else t) if t else {} for t in own]
                for i in dict.fromkeys(k for x in each for k in x):
                    rows.append(row)
                    ids.append(i)
                    for total, x in zip(found, each, strict=True):
                        total.append(x.get(i, 0))
            kept = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in found)], names=[*key, "id", *(f"n_{c}" for c in columns)])

    kind = T.StructType(texts.select(*key).schema.fields).add("id", "long")
    for c in columns:
        kind = kind.add(f"n_{c}", "long")
    return texts.select(*key, *columns).mapInArrow(run, kind)


def pattern_counts(texts: DataFrame, key: Sequence[str], columns: Sequence[str], patterns: DataFrame, ignore_case: bool = False, chars: int = MAX_CHARS) -> DataFrame:
    """key, id and n_<column>: how often the patterns of each id (id, pattern; an id may have several) occur in the text
    columns, for ids that occur in one of them at least."""
    passes = [_pass(texts, key, columns, own, ignore_case) for own in slices(patterns, chars)]
    if not passes:
        return _pass(texts.limit(0), key, columns, [(0, "x")], ignore_case)
    if len(passes) == 1:
        return passes[0]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out.groupBy(*key, "id").agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in columns])  # an id may have patterns in several slices


def covered(texts: DataFrame, column: str, patterns: DataFrame, few: int = FEW) -> DataFrame:
    """The patterns' rows (id, pattern and others) with `hit`: whether any text holds one of the id's. Up to `few` patterns
    are looked for by an aggregate each."""
    own = patterns.where(F.length("pattern") > 0).where("id IS NOT NULL").select("id", "pattern").limit(few + 1).collect()
    if own and len(own) <= few:
        hits = texts.agg(*[F.coalesce(F.max(F.contains(column, F.lit(r.pattern))), F.lit(False)).alias(f"h{i}") for i, r in enumerate(own)])
        each = F.array(*[F.struct(F.lit(r.id).cast("long").alias("id"), F.col(f"h{i}").alias("hit")) for i, r in enumerate(own)])
        found = hits.select(F.inline(each)).where("hit").select("id").distinct()
    else:
        found = pattern_counts(texts, [], [column], patterns).select("id").distinct()
    return patterns.join(found.withColumn("hit", F.lit(True)), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def best_texts(texts: DataFrame, key: str, order: str, weights: dict[str, int], words: Column, topics: DataFrame) -> DataFrame:
    """id, key, score of the best text for each topic (id, pattern): occurrences of its patterns by the columns' weights,
    for a thousand words, whatever the case; the earlier one of equals, the first text where nothing occurs."""
    own = texts.withColumn("_words", F.greatest(words, F.lit(1)))
    found = pattern_counts(own, [key, order, "_words"], list(weights), topics, ignore_case=True)
    hits = sum((F.col(f"n_{c}") * w for c, w in weights.items()), F.lit(0))
    best = found.groupBy("id").agg(F.max(F.struct((hits * 1000 / F.col("_words")).alias("score"), (-F.col(order)).alias("o"), F.col(key).alias("k"))).alias("b"))
    first = texts.agg(F.min_by(key, order)).first()[0]
    out = topics.select("id").distinct().join(best, "id", "left")
    return out.select("id", F.coalesce("b.k", F.lit(first)).alias(key), F.coalesce("b.score", F.lit(0.0)).alias("score"))
