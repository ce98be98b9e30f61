"""Substring deduplication against a log-structured fingerprint index.

Windows of WINDOW words are fingerprinted by the least hash of the SHINGLE-word shingles in them, so that equal windows
have equal fingerprints and neighbouring windows mostly share one: the index holds one entry for every sixth word or so.
A batch's fingerprints become a sorted, immutable run, partitioned and sorted by fingerprint. It is merge-joined with the
runs of earlier batches; fingerprints that occur before, or twice in the batch, name the documents whose windows must be
compared. Those windows are verified by 96-bit digests of their words, and every word that a window covers whose words
start earlier too is removed. After FANOUT runs, the runs are compacted into one.

Hot passages: each chunk of texts puts an entry for a fingerprint, or for a window, into the shuffle once, however many
of its documents share it; of equal windows in a chunk all but the first are decided on the spot. Windows whose fingerprint
is in more than HOT chunks find their first place by an aggregate, which combines before the shuffle, and a join.

Nulls and empty texts have no words. Every row is a document with a place of its own: by doc_id, nulls last; rows that share
a doc_id, or have none, by a hash of doc_id and text. Rows equal in both share a place, so none is earlier than the other.
Other columns are ignored. An empty table gives an empty result. Batches are ranges of doc_id, so earlier batches have
smaller ids; rows without a doc_id are in the last one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_long, keyed, prepare, remove, scope, shared_dir, shared_ids, small_enough, stored, table, texts, window_hashes, word_hashes, words

WINDOW, SHINGLE = 20, 10
#: Runs that are compacted; batches of the query; bytes of text that are handled together.
FANOUT, BATCHES, CHUNK = 2, 3, 1 << 18
#: Chunks with a fingerprint from which its windows are hot.
HOT = 100_000
#: Ids that are broadcast at most.
BROADCAST_ROWS = 2_000_000
#: The id in place of null.
LAST = (1 << 63) - 1


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values."""
    n, have = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= k:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return x[:n] if have == k else np.minimum(x[:n], x[k - have : k - have + n])


class _Chunk:
    """Windows of a chunk of texts: their fingerprints, and which lie within one text."""

    def __init__(self, offs: np.ndarray, data: np.ndarray, window: int, shingle: int):
        self.starts, self.ends, self.first = words(offs, data)
        n = len(self.starts)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.own = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.shingles = window_hashes(self.hashes, shingle)
        self.prints = _least(self.shingles, window - shingle + 1)
        self.valid = self.own[: len(self.prints)] == self.own[window - 1 :] if n >= window else np.zeros(0, bool)

    def selected(self, span: int) -> np.ndarray:
        """Places of the shingles that are the least of some window."""
        if not len(self.prints):
            return np.zeros(0, np.int64)
        padded = np.zeros(len(self.shingles) + span - 1, np.uint64)
        padded[span - 1 : span - 1 + len(self.prints)] = np.where(self.valid, self.prints, 0)
        most = ~_least(~padded, span)
        return np.flatnonzero((most == self.shingles) & (most > 0))


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offs = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values), mask=pa.array(sizes == 0))


def fingerprints(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """fp, doc, rest: for each chunk of texts its fingerprints, with the documents that have them (again for each place)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _ids(b.column(0))
            for lo, offs, data in texts(b.column(1), CHUNK):
                c = _Chunk(offs, data, window, shingle)
                at = c.selected(window - shingle + 1)
                fp, doc = c.shingles[at], ids[lo + c.own[at]]
                order = np.argsort(fp, kind="stable")
                fp, doc = fp[order], doc[order]
                new = np.concatenate(([True], fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, bool)
                lead = np.flatnonzero(new)
                rest = np.diff(np.concatenate((lead, [len(fp)]))) - 1
                yield pa.RecordBatch.from_arrays([pa.array(as_long(fp[lead])), pa.array(doc[lead]), _lists(doc[~new], rest)], names=["fp", "doc", "rest"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "fp long, doc long, rest array<bigint>")


class FingerprintIndex:
    """Runs of (fp, doc, rest), each a table bucketed and sorted by fp in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.name = spark, f"fingerprints_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.written = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.written}"
        self.written += 1
        dealt = rows.repartition(self.buckets, "fp")
        dealt.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{shared_dir(self.spark)}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def add(self, rows: DataFrame) -> str:
        self.runs.append(self._write(rows))
        return self.runs[-1]

    def _counts(self, run: str) -> DataFrame:
        return self.spark.table(run).groupBy("fp").agg(F.sum(1 + F.greatest(F.coalesce(F.size("rest"), F.lit(0)), F.lit(0))).alias("n"), F.count("*").alias("chunks"))

    def shared(self, run: str) -> DataFrame:
        """doc_id, fp, hot: documents of the run and of earlier ones, with the fingerprints of the run that occur twice or
        more, and whether very many chunks have them."""
        both = self._counts(run)
        older = self.runs[: self.runs.index(run)]
        more = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
        for old in older:
            both = both.join(self._counts(old).withColumnsRenamed({"n": "m", "chunks": "c"}), "fp", "left").select("fp", more("n", "m").alias("n"), more("chunks", "c").alias("chunks"))
        keys = both.where("n > 1").select("fp", (F.col("chunks") > HOT).alias("hot"))
        out = None
        for name in [*older, run]:
            own = self.spark.table(name).join(keys, "fp").select("fp", "hot", F.explode(F.concat(F.array("doc"), F.coalesce("rest", F.array().cast("array<bigint>")))).alias("doc_id"))
            out = own if out is None else out.union(own)
        return out

    def compact(self, fanout: int = FANOUT) -> None:
        if len(self.runs) < fanout:
            return
        rows = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            rows = rows.unionByName(self.spark.table(name))
        old, self.runs = self.runs, [self._write(rows)]
        self._drop(old)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{shared_dir(self.spark)}/{name}")

    def drop(self) -> None:
        self._drop(self.runs)
        self.runs = []


def windows(asked: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """h1, h2, doc_id, sub, start, done of the windows that have a fingerprint in `fps`: each chunk's first ones, and as
    lists those that repeat an earlier one of the chunk. Lists have start -1 and a key of their own."""
    prepare(asked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subs, fps = _ids(b.column(0)), _ids(b.column(1)), b.column(3)
            size = fps.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            asked_of, asked_fp = np.repeat(np.arange(len(ids)), size), fps.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, offs, data in texts(b.column(2), CHUNK):
                c = _Chunk(offs, data, window, shingle)
                if not c.valid.any():
                    continue
                here = (asked_of >= lo) & (asked_of < lo + len(offs) - 1)
                tag = lambda row, fp: fp ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                own = c.own[: len(c.prints)]
                at = np.flatnonzero(c.valid & np.isin(tag(own, c.prints), tag(asked_of[here] - lo, asked_fp[here])))
                h1 = as_long(window_hashes(c.hashes, window))[at]
                h2 = as_long(window_hashes(c.hashes, window, 1))[at].astype(np.int32)
                doc, sub, start = ids[lo + own[at]], subs[lo + own[at]], (at - c.first[own[at]]).astype(np.int32)
                order = np.lexsort((start, sub, doc, h2, h1))
                h1, h2, doc, sub, start = h1[order], h2[order], doc[order], sub[order], start[order]
                lead = np.ones(len(h1), bool)
                lead[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                first = np.maximum.accumulate(np.where(lead, np.arange(len(h1)), 0))
                later = (doc != doc[first]) | (sub != sub[first]) | (start != start[first])
                ld, lb, ls = doc[later], sub[later], start[later]
                order = np.lexsort((ls, lb, ld))
                ld, lb, ls = ld[order], lb[order], ls[order]
                edge = np.flatnonzero(np.concatenate(([True], (ld[1:] != ld[:-1]) | (lb[1:] != lb[:-1])))) if len(ld) else np.zeros(0, np.int64)
                n = int(lead.sum())
                lists = np.concatenate((np.zeros(n, np.int64), np.diff(np.concatenate((edge, [len(ld)])))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((h1[lead], (ld[edge] ^ lb[edge]) * np.int64(0x5851F42D4C957F2D)))),
                        pa.array(np.concatenate((h2[lead], ls[edge]))),
                        pa.array(np.concatenate((doc[lead], ld[edge]))),
                        pa.array(np.concatenate((sub[lead], lb[edge]))),
                        pa.array(np.concatenate((start[lead], np.full(len(edge), -1, np.int32)))),
                        _lists(ls, lists),
                    ],
                    names=["h1", "h2", "doc_id", "sub", "start", "done"],
                )

    return asked.select("doc_id", "sub", "text", "fps").mapInArrow(run, "h1 long, h2 int, doc_id long, sub long, start int, done array<int>")


def _among(docs: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """Documents with an id among the others, or not, without a shuffle of texts if the ids are few enough to broadcast."""
    return docs.join(F.broadcast(ids) if small_enough(ids, BROADCAST_ROWS) else ids, on, how)


def verify(docs: DataFrame, shared: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, sub, starts: windows of documents that start earlier too, among those with shared fingerprints."""
    sets = [F.collect_set(F.when(F.col("hot") == hot, F.col("fp"))).alias(name) for name, hot in (("fps", False), ("hot", True))]
    by_doc = stored(shared.groupBy("doc_id").agg(*sets), "shared-fingerprints")
    asked = _among(docs, by_doc.select("doc_id"), ["doc_id"], "left_semi").join(by_doc, "doc_id")
    at = F.struct("doc_id", "sub", "start")
    first = F.min(F.when(F.col("start") >= 0, at))
    w = windows(asked, window, shingle).withColumn("_first", first.over(Window.partitionBy("h1", "h2")))
    if by_doc.where(F.size("hot") > 0).limit(1).count():
        hot = stored(windows(asked.where(F.size("hot") > 0).withColumn("fps", F.col("hot")), window, shingle), "hot-windows")
        firsts = stored(hot.where("start >= 0").groupBy("h1", "h2").agg(first.alias("_first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-windows")
        met = hot.where("start >= 0").join(F.broadcast(firsts) if small_enough(firsts, BROADCAST_ROWS) else firsts, ["h1", "h2"])
        w = w.unionByName(met).unionByName(hot.where("start < 0").withColumn("_first", F.lit(None).cast(firsts.schema["_first"].dataType)))
    found = w.where((F.col("start") < 0) | (at > F.col("_first")))
    starts = F.when(F.col("start") < 0, F.col("done")).otherwise(F.array("start"))
    return found.groupBy("doc_id", "sub").agg(F.flatten(F.collect_list(starts)).alias("starts"))


def _kept(text: bytes, starts: list[int] | None, window: int) -> tuple[int, int, bytes]:
    own = text.split()  # bytes split at U+0020 and U+0009 to U+000D
    if not starts:
        return len(own), 0, b" ".join(own)
    gone = np.zeros(len(own) + 1, np.int32)
    for s in set(starts):
        if s + window <= len(own):
            gone[s] += 1
            gone[s + window] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    return len(own), int(covered.sum()), b" ".join([x for x, c in zip(own, covered.tolist(), strict=True) if not c])


def _placed(docs: DataFrame) -> DataFrame:
    """own_id, doc_id, sub, text: the place of every row; sub is 0 where the doc_id is the row's own."""
    shared = shared_ids(docs)
    slim = keyed(docs.select("doc_id", "text"), "sub", shared)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id")
    sub = F.lit(0) if shared is None else F.when(F.col("sub").eqNullSafe(F.col("doc_id").cast("long")), 0).otherwise(F.col("sub"))
    return slim.select(F.col("doc_id").alias("own_id"), own, sub.cast("long").alias("sub"), "text")


def removed_starts(placed: DataFrame, batches: int = BATCHES, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, sub, starts: the windows whose words start earlier too; all documents, in batches by doc_id."""
    spark = placed.sparkSession
    docs, known = placed.select("doc_id", "sub", "text"), placed.where("own_id IS NOT NULL")
    cuts = [min(int(x), LAST - 1) for x in known.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)] if batches > 1 else []
    index, found, low = FingerprintIndex(spark), [], None
    for high in [*sorted(set(cuts)), None]:
        own = docs if low is None else docs.where(F.col("doc_id") > low)
        own = own if high is None else own.where(F.col("doc_id") <= high)
        seen = docs if high is None else docs.where(F.col("doc_id") <= high)
        run = index.add(fingerprints(own, window, shingle))
        with scope(spark) as made:
            hits = verify(seen, index.shared(run), window, shingle)
            found.append(stored(hits if low is None else hits.where(F.col("doc_id") > low), "repeated-windows"))
            made.drop(found[-1])
        if high is not None:
            index.compact()
        low = high
    index.drop()
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def dedup_words(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words' text of every document."""
    prepare(docs.sparkSession)
    placed = _placed(docs)
    starts = removed_starts(placed, batches, window, shingle)
    ids = starts.select("doc_id", "sub")
    hit = _among(placed, ids, ["doc_id", "sub"], "left_semi").join(starts, ["doc_id", "sub"]).select("own_id", "text", "starts")
    rest = _among(placed, ids, ["doc_id", "sub"], "left_anti").select("own_id", "text", F.lit(None).cast("array<int>").alias("starts"))
    joined = hit.union(rest)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            got = [_kept(t or b"", s, window) for t, s in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2].decode() for g in got], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, (SELECT unnest(range(0, 20)) AS j)),
kept AS (SELECT w.doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w) w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY ALL)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY ALL) USING (doc_id)
"""
