"""Byte-level BPE encoding and decoding.

Pre-tokens are looked up in two tiers. A minimal perfect hash over the vocabulary (hash, displace; one slot a token)
resolves those that are tokens as a whole with one comparison of bytes. The others are encoded by merging the pair of
lowest rank first, from a heap over a linked list of bytes.

Nulls and empty texts have no ids. Null keys, repeated rows and other columns are kept as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table

#: Pre-tokens whose ids a worker keeps, and the longest of them in characters.
KEPT, KEPT_LENGTH = 400_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash of distinct keys: bucket by one hash, then the least displacement that fills free slots.
    A bucket of one key stores its slot itself, as a negative number."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n, self.buckets = max(1, len(keys)), max(1, len(keys) // per_bucket)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        at = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(keys) else []
        free, self.shift, self.slots = np.ones(self.n, bool), [0] * self.buckets, [-1] * self.n
        groups.sort(key=len, reverse=True)
        many = [g for g in groups if len(g) > 1]
        for g in many:
            d, own = 0, [int(x) for x in h[g]]
            while True:
                places = [self._slot(x, d) for x in own]
                if len(set(places)) == len(places) and all(free[p] for p in places):
                    break
                d += 1
            free[places] = False
            self.shift[int(at[g[0]])] = d
            for p, key in zip(places, g, strict=True):
                self.slots[p] = int(key)
        for g, p in zip(groups[len(many) :], np.flatnonzero(free).tolist(), strict=False):
            self.shift[int(at[g[0]])] = -p - 1
            self.slots[p] = int(g[0])

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else self._slot(h, d)


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = list(self.ranks)
        self.table = PerfectHash(self.tokens)
        #: The token and the id in each slot of the perfect hash.
        self.by_slot = [(self.tokens[k], self.ranks[self.tokens[k]]) if k >= 0 else (b"", -1) for k in self.table.slots]
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}

    def whole(self, piece: bytes) -> int | None:
        """Tier one: the id of a pre-token that is a token."""
        token, i = self.by_slot[self.table.slot(piece)]
        return i if token == piece and i >= 0 else None

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: merge the pair of lowest rank, leftmost first, until no pair is a token."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a = parts[i]
            j = nxt[i] if a is not None else -1
            if j < 0 or len(a) + len(parts[j]) != size:
                continue
            parts[i], parts[j], nxt[i] = a + parts[j], None, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for left in (prev[i], i):
                if left >= 0 and nxt[left] >= 0 and (r := ranks.get(q := parts[left] + parts[nxt[left]])) is not None:
                    heapq.heappush(heap, (r, left, len(q)))
        return [ranks[p] for p in parts if p is not None]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        one = self.whole(raw)
        ids = [one] if one is not None else self.merged(raw)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[piece] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get, piece = self.kept.get, self._piece
        return b"".join([get(p) or piece(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """The rows with a binary column `out` of ids (little-endian unsigned 32-bit) after their own columns; a column of that
    name that they have is replaced."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = pa.array([c.encode(t) for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, out])

    return docs.drop(out).mapInArrow(run, docs.drop(out).schema.add(out, "binary"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes that they decode to."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
