"""Quality selection by importance resampling.

Two generative models of hashed n-grams (words and pairs of words, BUCKETS buckets) are counted: one over the target
texts (documents labelled good and not toxic), one over all documents. A document's log weight is the sum over its
n-grams of the log ratio of the two models; adding Gumbel noise, a function of doc_id and seed, and keeping the k largest
keys draws k documents without replacement in proportion to their weights. k is the share of good documents among the
labelled ones, times all documents. The k-th largest key is found by radix selection over counts of key prefixes, so no
task sorts the corpus.

Counts cover all documents. A batch of rows adds up its counts before the shuffle; a model has BUCKETS counts however
large the corpus is. Null and empty texts have no n-grams and weight 0. Documents of equal key at the bound are all kept.
Without target documents, or without any, all weights are 0. Repeated rows get equal keys. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, prepare, small_enough, stored, table, texts, window_hashes, word_hashes, words

#: Hash buckets of a model; pseudo-counts of each bucket; seed of the noise.
BUCKETS, PRIOR, SEED = 1 << 18, 3.0, 20
#: Key bits told apart in one pass of the selection.
DIGIT = 13
#: Labels that are broadcast at most.
BROADCAST_ROWS = 500_000


def grams(offs: np.ndarray, data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word (in the lower half of the buckets) and every pair of neighbouring words."""
    starts, ends, first = words(offs, data)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = word_hashes(data, starts, ends)
    pairs = window_hashes(h, 2)
    same = own[:-1] == own[1:] if len(own) else np.zeros(0, bool)
    half = np.uint64(buckets // 2)
    return np.concatenate((own, own[:-1][same])), np.concatenate((h % half, pairs[same] % half + half)).astype(np.int64)


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """target, bucket, n: n-grams of the texts by bucket, for target texts and the others."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            target = np.array(b.column(1).to_pylist(), dtype=np.int64)
            for lo, offs, data in texts(b.column(0)):
                row, bucket = grams(offs, data, buckets)
                total += np.bincount(target[lo + row] * buckets + bucket, minlength=2 * buckets).reshape(2, buckets)
        kind, bucket = np.nonzero(total)
        for lo in range(0, len(kind), 1 << 16):
            k, at = kind[lo : lo + (1 << 16)], bucket[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(total[k, at], pa.int64())], names=["target", "bucket", "n"])

    return docs.select("text", F.col("target").cast("int")).mapInArrow(run, "target int, bucket int, n long").groupBy("target", "bucket").agg(F.sum("n").alias("n"))


def log_ratios(counts: list[tuple[int, int, int]], buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """log(target model / raw model) of every bucket; the raw model has all texts."""
    n = np.zeros((2, buckets))
    for kind, bucket, c in counts:
        n[kind, bucket] += c
    target, raw = n[1], n.sum(0)
    if not target.sum():
        return np.zeros(buckets)
    # pseudo-counts at the scale of the target: buckets that are rare there weigh little
    return np.log((target + prior) / (raw * (target.sum() / raw.sum()) + prior))


def gumbel(doc_id: np.ndarray, seed: int) -> np.ndarray:
    u = (mix(doc_id.astype(np.int64).view(np.uint64) + np.uint64(mix(np.array([seed], np.uint64))[0])) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and key of every document."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, offs, data in texts(b.column(1)):
                row, bucket = grams(offs, data, len(r))
                out[lo : lo + len(offs) - 1] = np.bincount(row, weights=r[bucket], minlength=len(offs) - 1)
            ids = np.array([-1 if x is None else x for x in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array(out + gumbel(ids, seed), pa.float64())], names=["doc_id", "log_weight", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, log_weight double, key double")


def kth_largest(keys: DataFrame, k: int, digit: int = DIGIT) -> float:
    """The k-th largest value of the column key: counts by leading bits, one digit after the other."""
    if k <= 0:
        return float("inf")
    # keys as whole multiples of 2**-20
    fixed = keys.select(F.round(F.col("key") * (1 << 20)).cast("long").alias("v"))
    lo_hi = fixed.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if lo_hi[2] == 0 or k >= lo_hi[2]:
        return -float("inf")
    low, high, left = int(lo_hi[0]), int(lo_hi[1]), k
    while low < high:
        shift = max(0, (high - low).bit_length() - digit)
        step = fixed.where(F.col("v").between(low, high)).groupBy(F.call_function("shiftright", F.col("v") - F.lit(low), F.lit(shift)).alias("d")).count()
        for d, n in sorted(((r[0], r[1]) for r in step.collect()), reverse=True):  # 2**digit rows at most
            if left <= n:
                low, high = low + (d << shift), min(high, low + ((d + 1) << shift) - 1)
                break
            left -= n
    return (low - 0.5) / (1 << 20)


def select(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key and kept of every document."""
    good = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")).alias("target"))
    good = good.where(F.col("doc_id").isNotNull() & F.col("target").isNotNull())
    share = good.agg(F.avg("target")).first()[0]
    ids = good.where("target = 1").select("doc_id").withColumn("target", F.lit(1))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if small_enough(ids, BROADCAST_ROWS) else ids, "doc_id", "left")
    counts = gram_counts(marked.select("text", F.coalesce("target", F.lit(0)).alias("target"))).toPandas()
    ratios = log_ratios(list(counts.itertuples(index=False, name=None)))
    keys = stored(weigh(docs, ratios, seed), "importance-keys")
    n = keys.count()
    bound = kth_largest(keys, round(n * (1.0 if share is None else share)))
    return keys.withColumn("kept", F.col("key") >= F.lit(bound))


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
