"""Minimax contiguous sharding.

Documents with equal texts form one atomic group. Groups are put into a fixed order by a 64-bit hash of their text and
gathered into CELLS consecutive cells of that order, so that the driver holds bounded lists of sizes however large the
corpus is; a group never straddles cells. A binary search finds the smallest capacity that lets the ordered sizes be cut
into the wanted number of contiguous shards; each probe packs greedily. Cells in which the best solution may have a cut
are then split anew, CELLS parts at a time, until every such cell holds one group or no better capacity is possible: the
capacity is the smallest one for the groups themselves. The cuts are placed within it, as evenly as the remaining shards
allow.

Nulls: a null text has no bytes and counts as an empty one; a null doc_id is kept. Repeated rows get slots of their own.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Cells of the order of groups: the bound of what the driver and a broadcast hold.
CELLS = 1 << 16
#: Cells with more than this share of all rows are numbered in parts.
PART_SHARE = 1 / 512


def fits(sizes: np.ndarray, shards: int, capacity: int) -> bool:
    """Whether greedy packing of the ordered sizes needs no more than `shards` shards of `capacity`."""
    ends, at = np.cumsum(sizes), 0
    for _ in range(shards):
        if at == len(sizes):
            return True
        at = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + capacity, "right"))
    return at == len(sizes)


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    if not len(sizes):
        return 0
    lo, hi = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(sizes, shards, mid) else (mid + 1, hi)
    return lo


def cut(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each ordered size: contiguous, no shard over the smallest feasible capacity, as even as that allows."""
    n, capacity = len(sizes), smallest_capacity(sizes, shards)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    least = [n] * (shards + 1)  # least[k]: where shard k may begin at the earliest, for k.. to hold the rest
    for k in range(shards - 1, -1, -1):
        least[k] = int(np.searchsorted(ends, ends[least[k + 1]] - capacity, "left"))
    out, at = np.empty(n, np.int64), 0
    for k in range(shards):
        most = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        target = ends[at] + (ends[n] - ends[at]) / (shards - k)
        near = min(n, int(np.searchsorted(ends, target, "left")))
        if near > at and target - ends[near - 1] < ends[near] - target:
            near -= 1
        end = n if k == shards - 1 else min(max(near, least[k + 1], at), most)
        out[at:end] = k
        at = end
    return out


def _doubtful(cells: pd.DataFrame, shards: int) -> np.ndarray:
    """Which of the ordered cells have several groups and may hold a cut of a solution better than the best one by cells.

    A greedy packing of groups gets at least as far as one of cells, so with any capacity from `least` on, shard k ends
    no earlier than it does for cells at `least`, nor than the rest allows, and no later than at k times the best."""
    sizes, many = cells["size"].to_numpy(np.int64), (cells["low"] != cells["high"]).to_numpy()
    total = int(sizes.sum())
    best = smallest_capacity(sizes, shards)
    least = max(-(-total // shards), int(sizes[~many].max(initial=0)))
    out = np.zeros(len(sizes), bool)
    if least >= best:
        return out
    ends, at = np.cumsum(sizes), 0
    for k in range(1, shards):
        at = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + least, "right"))
        first = max(ends[at - 1] if at else 0, total - (shards - k) * best)
        out |= (ends > first) & (ends - sizes < k * best)
    return out & many


def _cells(slim: DataFrame, bits: int) -> pd.DataFrame:
    """size, n, least and greatest hash of each cell, a stretch of 2**bits hashes, in their order."""
    found = slim.groupBy(F.shiftright("h", bits).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    return found.toPandas().assign(bits=bits).sort_values("cell")


def group_cells(slim: DataFrame, shards: int, cells: int = CELLS) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The cells of the first level, and cells as fine as the smallest capacity of the groups needs; in order."""
    bits = 64 - (cells - 1).bit_length()
    coarse = fine = _cells(slim, bits)
    while len(fine):
        doubtful = _doubtful(fine, shards)
        if not doubtful.any():
            break
        split, finer = max(1, (cells // int(doubtful.sum())).bit_length() - 1), [fine[~doubtful]]
        for level, own in fine[doubtful].groupby("bits"):
            asked = slim.sparkSession.createDataFrame([(int(x),) for x in own["cell"]], "_cell long")
            rows = slim.join(F.broadcast(asked), F.shiftright("h", int(level)) == F.col("_cell"))
            finer.append(_cells(rows, max(0, int(level) - split)))
        fine = pd.concat(finer).sort_values("low")
    return coarse, fine


def assign_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every document in a shard, equal texts in the same one."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    slim = stored(slim, "shard-sizes")
    coarse, fine = group_cells(slim, shards, cells)
    shard_of = cut(fine["size"].to_numpy(np.int64), shards)
    shard = F.lit(int(shard_of[0]) if len(fine) else 0)
    for i in np.flatnonzero(np.diff(shard_of)) + 1:  # fewer than `shards` places
        shard = shard + F.when(F.col("h") >= int(fine["low"].iloc[i]), int(shard_of[i] - shard_of[i - 1])).otherwise(0)
    total = int(coarse["n"].sum())
    parts = np.minimum(np.maximum(1, np.ceil(coarse["n"].to_numpy() / max(1, total * PART_SHARE))), 1 / PART_SHARE).astype(np.int64)
    known = spark.createDataFrame(list(zip(coarse["cell"].tolist(), parts.tolist(), strict=True)), "cell long, parts int")
    bits = 64 - (cells - 1).bit_length()
    own = slim.withColumn("cell", F.shiftright("h", bits)).withColumn("shard", shard.cast("int"))
    placed = own.join(F.broadcast(known), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    by_part = placed.groupBy("shard", "cell", "part").agg(F.count("*").alias("n")).toPandas().sort_values(["shard", "cell", "part"])
    by_part["base"] = by_part.groupby("shard")["n"].cumsum() - by_part["n"]
    base = spark.createDataFrame(
        list(by_part[["shard", "cell", "part", "base"]].itertuples(index=False, name=None)),
        "shard int, cell long, part int, base long",
    )
    within = Window.partitionBy("shard", "cell", "part").orderBy("doc_id")
    return placed.join(F.broadcast(base), ["shard", "cell", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("slot")
    )


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
