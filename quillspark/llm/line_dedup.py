"""Line deduplication behind two Bloom filters.

A line's key is the line without white space at its ends, A-Z in lower case. Keys of MIN_CHARS code points or more that
MIN_DOCS documents or more hold lose all their lines, except in the document of the largest doc_id that holds them.

One pass puts the hash of each long key, once a document, into two Bloom filters: one of keys seen once, one of keys seen
again. A key whose bits the first filter has already goes into the second. Filters of different tasks merge by their bits:
a bit that is set in two first filters is set in the second one, so no repeated key is ever missed; a merge is a union of
blocks of BLOCK bits, which travel as lists of places where they are sparse. A second pass lets only those lines through
that the second filter suspects, as 128-bit digests of their keys with the number of documents and the largest doc_id;
they are added up in the task before the shuffle. Digests of too few documents were false suspicions. What is left names
the lines to drop, and a third pass drops them where they stand: texts don't leave their tasks, unless there are more than
BROADCAST_KEYS such keys; then the documents' own digests are joined with them, and the lists with the documents.

The filters have BITS_PER_KEY bits for each line, MAX_BITS at most: beyond that more lines are suspected and shuffled, and
the result is the same. At most FOLDS tasks fill filters, so that what they send doesn't grow with the number of splits.

Each row is a document. Null and empty texts are one empty line. A null doc_id is smaller than all others; rows that share
the largest doc_id of a key all keep its lines. Other columns stay in drop_lines(). An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, keyed, prepare, shared_ids, small_enough, stored, table, texts, word_hashes

MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of a filter for each line, and at most; bits of a block.
BITS_PER_KEY, MAX_BITS, LEAST_BITS, BLOCK = 8, 1 << 30, 1 << 20, 1 << 16
#: Blocks in an Arrow batch.
ROWS = 256
#: Tasks that fill filters at most; keys that are broadcast at most.
FOLDS, BROADCAST_KEYS = 4096, 2_000_000

_BYTES = BLOCK // 8
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Lines:
    """Lines of a chunk of texts: where they begin and end, and where their keys do."""

    def __init__(self, offs: np.ndarray, data: np.ndarray, least: int):
        breaks = np.flatnonzero(data == 10)
        n = len(offs) - 1
        counts = np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]) + 1  # lines of each text
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.own = np.repeat(np.arange(n), counts)
        self.starts, self.ends = np.empty(len(self.own), np.int64), np.empty(len(self.own), np.int64)
        leads, lasts = np.zeros(len(self.own), bool), np.zeros(len(self.own), bool)
        leads[self.first[:-1]] = lasts[self.first[1:] - 1] = True
        self.starts[leads], self.ends[lasts] = offs[:-1], offs[1:]
        self.starts[~leads], self.ends[~lasts] = breaks + 1, breaks
        self.data = _LOWER[data]
        shown = np.flatnonzero(~_BLANK[data])
        a, b = np.searchsorted(shown, self.starts), np.searchsorted(shown, self.ends)
        some = a < b
        self.key_starts, self.key_ends = self.starts.copy(), self.starts.copy()
        self.key_starts[some], self.key_ends[some] = shown[a[some]], shown[b[some] - 1] + 1
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.long = np.flatnonzero(chars[self.key_ends] - chars[self.key_starts] >= least)
        self.hashes = word_hashes(self.data, self.key_starts[self.long], self.key_ends[self.long])

    def digest(self, line: int) -> bytes:
        return hashlib.blake2b(self.data[self.key_starts[line] : self.key_ends[line]], digest_size=16).digest()


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(bits - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


class Bloom:
    """Keys seen once and keys seen again, two bits a key."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def has(plane: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in _places(hashes, bits):
            out &= (plane[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def _put(self, plane: np.ndarray, hashes: np.ndarray) -> None:
        for at in _places(hashes, self.bits):
            np.bitwise_or.at(plane, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def add(self, hashes: np.ndarray, own: np.ndarray) -> None:
        """Hashes of lines and the numbers of their documents: each document counts once."""
        order = np.lexsort((own, hashes))
        h, o = hashes[order], own[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        other = np.flatnonzero(~new & (o != np.roll(o, 1)))  # in another document of this chunk
        seen = h[new]
        self._put(self.again, np.concatenate((h[other], seen[self.has(self.once, seen, self.bits)])))
        self._put(self.once, seen)

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        once, again = self.once.reshape(-1, _BYTES), self.again.reshape(-1, _BYTES)
        for i in np.flatnonzero(once.any(axis=1)):
            yield int(i), packed(once[i]), packed(again[i])


def packed(block: np.ndarray) -> bytes:
    """A block's bits, or where fewer bytes tell them the places of those that are set."""
    places = np.flatnonzero(np.unpackbits(block, bitorder="little")).astype("<u2") if np.count_nonzero(block) < _BYTES // 2 else None
    return block.tobytes() if places is None or 2 * len(places) >= _BYTES else places.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == _BYTES:
        return np.frombuffer(raw, np.uint8)
    bits = np.zeros(BLOCK, np.uint8)
    bits[np.frombuffer(raw, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


_FILTER = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])


def partial_filters(docs: DataFrame, bits: int, least: int = MIN_CHARS) -> DataFrame:
    """block, once, again: the filters of each task."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            for _, offs, data in texts(b.column(0)):
                lines = _Lines(offs, data, least)
                own = own or Bloom(bits)
                own.add(lines.hashes, lines.own[lines.long])
        if own is not None:
            rows = own.blocks()
            while some := list(islice(rows, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), _FILTER.types, strict=True)], schema=_FILTER)

    rows = docs.select("text").coalesce(FOLDS)
    return rows.mapInArrow(run, "block int, once binary, again binary")


def merged_filter(parts: DataFrame) -> DataFrame:
    """block, again: the filter of keys seen again in all tasks. A task merges its blocks one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block, once, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o, a = unpacked(once), unpacked(again)
                if block in held:
                    before, twice = held[block]
                    held[block] = (before | o, twice | a | (before & o))
                else:
                    held[block] = (o, a)
        for block, (_, twice) in held.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed(twice)], pa.binary())], names=["block", "again"])

    return parts.repartition("block").mapInArrow(run, "block int, again binary")


def filter_bits(docs: DataFrame, least: int = MIN_CHARS) -> int:
    """A power of two: BITS_PER_KEY bits for each line that can be long enough, within the bounds."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    lines = size - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    n = docs.agg(F.coalesce(F.sum(F.least(lines, F.floor(size / least)).cast("long")), F.lit(0))).first()[0]
    return min(MAX_BITS, max(LEAST_BITS, 1 << max(0, BITS_PER_KEY * n - 1).bit_length()))


def repeat_filter(docs: DataFrame, least: int = MIN_CHARS, bits: int | None = None) -> np.ndarray:
    """The bits of the keys that two documents or more may hold."""
    bits = bits or filter_bits(docs, least)
    plane = np.zeros((bits // BLOCK, _BYTES), np.uint8)
    found = merged_filter(partial_filters(docs, bits, least)).toArrow()  # bits // 8 bytes at most
    for block, again in zip(found.column("block").to_pylist(), found.column("again").to_pylist(), strict=True):
        plane[block] = unpacked(again)
    return plane.reshape(-1)


def _suspects(lines: _Lines, plane: np.ndarray) -> np.ndarray:
    return lines.long[Bloom.has(plane, lines.hashes, 8 * len(plane))]


def suspected(docs: DataFrame, held, least: int, key: str | None = None) -> DataFrame:
    """digest, n, last: for each batch, how many documents hold a suspected key and the largest doc_id of them; with the name
    of a key column one row for each document and digest: digest, doc, doc_id."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts, last = b.column(0).cast(pa.int64()).to_pylist(), {}, {}
            rows: list[tuple[bytes, int, int | None]] = []
            for lo, offs, data in texts(b.column(1)):
                lines = _Lines(offs, data, least)
                own = {(int(lo + lines.own[i]), lines.digest(i)) for i in _suspects(lines, held.value)}
                for row, d in own:
                    if key is not None:
                        rows.append((d, b.column(2)[row].as_py(), ids[row]))
                        continue
                    counts[d] = counts.get(d, 0) + 1
                    best = last.get(d)
                    last[d] = ids[row] if best is None or (ids[row] is not None and ids[row] > best) else best
            if key is None:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array(list(last.values()), pa.int64())], names=["digest", "n", "last"])
            else:
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["digest", "doc", "doc_id"])

    own = docs.select(F.col("doc_id").cast("long"), "text", *([key] if key else []))
    return own.mapInArrow(run, "digest binary, doc long, doc_id long" if key else "digest binary, n long, last long")


def repeated_keys(docs: DataFrame, held, least: int = MIN_CHARS, most: int = MIN_DOCS) -> DataFrame:
    """digest, last: keys that `most` documents or more hold, and the largest doc_id that does."""
    found = suspected(docs, held, least).groupBy("digest").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return stored(found.where(F.col("n") >= most).select("digest", "last"), "repeated-lines")


def _kept(docs: DataFrame, gone, least: int, spare: str) -> DataFrame:
    """The rows with n_lines, n_dropped and the text of the lines that stay. gone() gives for a batch a function that tells
    of (row, lines) which lines go."""
    prepare(docs.sparkSession)
    names = [spare, "text", "doc_id", *[c for c in docs.columns if c not in (spare, "text", "doc_id")]]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    out_lines, out_gone = fresh(docs, "n_lines"), fresh(docs, "n_dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n_lines, n_gone = [], [], []
            drops = gone(b)
            for lo, offs, data in texts(b.column(1)):
                lines, raw = _Lines(offs, data, least), data.tobytes()
                out = drops(lo, lines)
                for i in range(len(offs) - 1):
                    at, end = lines.first[i], lines.first[i + 1]
                    stay = np.flatnonzero(~out[at:end]) + at
                    n_lines.append(end - at)
                    n_gone.append(end - at - len(stay))
                    if len(stay) == end - at:
                        found.append(raw[offs[i] : offs[i + 1]])
                    else:
                        found.append(b"\n".join(raw[s:e] for s, e in zip(lines.starts[stay].tolist(), lines.ends[stay].tolist(), strict=True)))
            text = pa.array(found, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text, *b.columns[2:], pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names=[*names, out_lines, out_gone])

    kind = T.StructType([*rows.schema.fields]).add(out_lines, "long").add(out_gone, "long")
    return rows.mapInArrow(run, kind).drop(spare)


def drop_lines(docs: DataFrame, least: int = MIN_CHARS, most: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS, bits: int | None = None) -> DataFrame:
    """The documents with the text of the lines that stay, n_lines (before) and n_dropped; null texts become empty."""
    spark = docs.sparkSession
    spare = fresh(docs, "own")
    plane = spark.sparkContext.broadcast(repeat_filter(docs, least, bits))
    keys = repeated_keys(docs, plane, least, most)
    if small_enough(keys, broadcast_keys):
        got = keys.toArrow()
        digests = np.array(got.column("digest").to_pylist() or [b""], "S16")
        order = np.argsort(digests)
        known = spark.sparkContext.broadcast((digests[order], got.column("last").fill_null(-(1 << 63)).to_numpy()[order] if got.num_rows else np.zeros(1, np.int64)))

        def gone(b: pa.RecordBatch):
            digests, last = known.value
            ids = b.column(2).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)

            def drops(lo: int, lines: _Lines) -> np.ndarray:
                out = np.zeros(len(lines.own), bool)
                at = _suspects(lines, plane.value)
                if len(at):
                    own = np.array([lines.digest(i) for i in at], "S16")
                    place = np.minimum(np.searchsorted(digests, own), len(digests) - 1)
                    out[at] = (digests[place] == own) & (last[place] != ids[lo + lines.own[at]])
                return out

            return drops

        return _kept(docs.withColumn(spare, F.lit(None).cast("binary")), gone, least, spare)
    key = fresh(docs, "doc_key")
    rows = keyed(docs, key, shared_ids(docs))
    hits = suspected(rows, plane, least, key).join(keys, "digest").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    lists = hits.groupBy("doc").agg(F.collect_set("digest").alias(spare))  # a document's own digests
    lists = lists.select(F.col("doc").alias(key), F.array_join(F.transform(spare, F.hex), "").alias(spare))
    both = rows.join(lists, key, "left").drop(key)

    def gone_own(b: pa.RecordBatch):
        def drops(lo: int, lines: _Lines) -> np.ndarray:
            out = np.zeros(len(lines.own), bool)
            sets: dict[int, set[str]] = {}
            for i in lines.long:
                row = lo + int(lines.own[i])
                if row not in sets:
                    text = b.column(0)[row].as_py() or ""
                    sets[row] = {text[k : k + 32] for k in range(0, len(text), 32)}
                out[i] = bool(sets[row]) and lines.digest(i).hex().upper() in sets[row]
            return out

        return drops

    return _kept(both, gone_own, least, spare)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = rf"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM t),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= {MIN_CHARS}) GROUP BY key HAVING count(*) >= {MIN_DOCS}),
d AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""
