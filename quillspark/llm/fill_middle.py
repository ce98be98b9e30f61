"""Fill-in-the-middle transformation over an index of distinct texts.

A text is cut at two code points into prefix, middle and suffix, which are put into the order prefix, suffix, middle or
suffix, prefix, middle behind marks. Where it is cut, in which form, and whether at all, is a function of doc_id and seed.

Cutting needs the byte at which a code point begins. That list of boundaries is kept in Elias-Fano form, a little over two
bits a code point: low bits as they are, high bits in unary; selecting the i-th boundary finds the i-th set bit. Texts are
the same if their length and SHA-256 are. The index has one list for every text that several documents share, made from one
of them; documents are joined with it by digest and pick their own cuts from the list. A text of one document alone is the
only user of its list, which is made where the text is read. The index is broadcast up to BROADCAST_BYTES; beyond that the
join is by shuffle, where Spark splits the digests that many documents have.

A null text is an empty one; a null doc_id counts as an empty one for the cuts. Rows of equal doc_id have equal draws.
Empty texts and texts that contain a mark stay plain. Other columns stay in fill_middle(). An empty table gives an empty one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, prepare, stored, table

#: Marks of the parts, and per cent of texts that are transformed; of those, per cent with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SUFFIX_FIRST, SEED = 90, 20, 1
#: Bounds of a broadcast index; representatives that are broadcast at most.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 2_000_000

_HEAD = struct.Struct("<QQB")
_ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)


def boundaries(raw: bytes) -> np.ndarray:
    """The byte at which each code point ends."""
    data = np.frombuffer(raw, np.uint8)
    return np.concatenate((np.flatnonzero((data & 0xC0) != 0x80)[1:], [len(data)])) if len(data) else np.zeros(0, np.int64)


class EliasFano:
    """A rising list of n values below a bound of u + 1."""

    def __init__(self, n: int, u: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.u, self.low_bits, self.low, self.high = n, u, low_bits, low, high
        self._ranks: np.ndarray | None = None

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        n = len(values)
        u = int(values[-1]) if n else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 7) // 8 * 8, np.uint8)
        for b in range(bits):
            low[np.arange(n) * bits + b] = (values >> b) & 1
        high = np.zeros((n + (u >> bits) + 8) // 8 * 8, np.uint8)
        high[(values >> bits) + np.arange(n)] = 1
        return EliasFano(n, u, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if self._ranks is None:
            self._ranks = np.cumsum(_ONES[self.high])
        at = int(np.searchsorted(self._ranks, i, "right"))
        left = i - (int(self._ranks[at - 1]) if at else 0)
        set_ = np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little"))
        low = sum(int(self.low[(k := i * self.low_bits + b) >> 3] >> (k & 7) & 1) << b for b in range(self.low_bits))
        return (8 * at + int(set_[left]) - i) << self.low_bits | low

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.u, self.low_bits) + self.low.tobytes() + self.high.tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> EliasFano:
        n, u, bits = _HEAD.unpack_from(raw)
        body = np.frombuffer(raw, np.uint8, offset=_HEAD.size)
        low = (n * bits + 7) // 8
        return EliasFano(n, u, bits, body[:low], body[low:])


def cuts(doc_id: Column, n: Column, text: Column, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Column:
    """form, first and last: the form of a document, and the code points after which prefix and middle end."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = lambda i: F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (n == 0) | marked | (h(2) % 100 >= rate)
    form = F.when(plain, "plain").when(h(3) % 100 < suffix_first, "spm").otherwise("psm")
    a, b = h(0) % (n + 1), h(1) % (n + 1)
    return F.struct(form.alias("form"), F.when(~plain, F.least(a, b)).alias("first"), F.when(~plain, F.greatest(a, b)).alias("last"))


def _digest(text: Column) -> Column:
    return F.unhex(F.concat(F.sha2(text, 256), F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def shared_boundaries(docs: DataFrame) -> DataFrame:
    """digest, ends: Elias-Fano lists of the texts that several documents share, each made from the one of the least
    doc_id."""
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").alias("_id"), _digest(text).alias("digest"), (F.octet_length(text) > 0).alias("_some"))
    many = stored(slim.where("_some").groupBy("digest").agg(F.min("_id").alias("_id"), F.count("*").alias("n")).where("n > 1").select("digest", "_id"), "shared-texts")
    few = many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id"), F.col("text"), _digest(text).alias("_digest"))
    own = rows.join(F.broadcast(many) if few else many, (F.col("_digest") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [EliasFano.of(boundaries(x.as_buffer().to_pybytes())).to_bytes() for x in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.binary())], names=["digest", "ends"])

    made = own.select("digest", "text").mapInArrow(run, "digest binary, ends binary")
    return stored(made.groupBy("digest").agg(F.min("ends").alias("ends")), "boundaries")  # repeated rows made equal lists


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with n (code points), form, prefix_chars, middle_chars and output."""
    index = shared_boundaries(docs)
    held = index.agg(F.coalesce(F.sum(F.octet_length("ends") + 64), F.lit(0))).first()[0]
    names = {x: fresh(docs, x) for x in ("n", "form", "prefix_chars", "middle_chars", "output", "_cut", "_digest", "_ends", "_key")}
    text = F.coalesce(F.col("text"), F.lit(""))
    index = index.select(F.col("digest").alias(names["_key"]), F.col("ends").alias(names["_ends"]))
    rows = docs.withColumns({names["n"]: F.char_length(text).cast("long"), names["_digest"]: _digest(text)})
    rows = rows.withColumn(names["_cut"], cuts(F.col("doc_id"), F.col(names["n"]), text, seed, rate, suffix_first))
    both = rows.join(F.broadcast(index) if held <= broadcast_bytes else index, F.col(names["_digest"]) == F.col(names["_key"]), "left")
    cut = F.col(names["_cut"])
    kept = [c for c in docs.columns if c != "text"]
    plan = both.select(
        text.alias("text"), F.when(cut["form"] != "plain", F.col(names["_ends"])).alias(names["_ends"]), cut["form"].alias(names["form"]), cut["first"].alias(names["prefix_chars"]),
        (cut["last"] - cut["first"]).alias(names["middle_chars"]), F.col(names["n"]), *[F.col(f"`{c}`") for c in kept],
    )
    out_names = [names["form"], names["prefix_chars"], names["middle_chars"], names["n"], *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        for b in batches:
            out = []
            raws = b.column(0).cast(pa.large_binary())
            for x, ends, form, first, middle in zip(raws, b.column(1).to_pylist(), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                raw = x.as_buffer().to_pybytes()
                if form == "plain":
                    out.append(raw)
                    continue
                have = EliasFano.from_bytes(ends) if ends is not None else EliasFano.of(boundaries(raw))
                i, j = (have.select(k - 1) if k else 0 for k in (first, first + middle))
                out.append(p + raw[:i] + s + raw[j:] + m + raw[i:j] if form == "psm" else s + raw[j:] + p + raw[:i] + m + raw[i:j])
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.binary()).cast(pa.string())], names=[*out_names, names["output"]])

    kind = T.StructType([f for f in plan.schema.fields[2:]]).add(names["output"], "string")
    done = plan.mapInArrow(run, kind)
    order = [*kept, names["n"], names["form"], names["prefix_chars"], names["middle_chars"], names["output"]]
    return done.select(*[F.col(f"`{c}`") for c in order])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


SQL = f"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
d AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j FROM d),
p AS (SELECT *, substr(t, 1, i) AS a, substr(t, i + 1, j - i) AS m, substr(t, j + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || z || '{MIDDLE}' || m ELSE '{SUFFIX}' || z || '{PREFIX}' || a || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
