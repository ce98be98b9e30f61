"""MinHash near-duplicate classes with DartMinHash signatures.

A document is a weighted set of five-word shingles, each weighted by how often the text has it. Every element throws hashed
darts into its region of a plane of weights and ranks: a Poisson process on each of the weight intervals [0, 1), [1, 2),
[2, 4), [4, 8) ..., of which a dart counts if it lands below the element's weight. The earliest dart at each of the
signature's coordinates is kept. Two documents agree at a coordinate with the probability of their weighted Jaccard
similarity (sum of the lesser weights by sum of the greater ones), and the work for a document is its elements, times the
logarithm of their weights, plus a few hundred darts; not elements times coordinates, nor the sum of weights. Ranks beyond
a bound that fills all coordinates with near certainty are never looked at; the few documents with a gap take twice the
bound.

Documents with equal sets are one node. Nodes that agree in a whole band share a bucket. Candidates are every node with the
least one of its buckets, and then, between classes that these do not link, pairs that agree in AGREE bands: all pairs in
buckets of up to PAIRS nodes; in larger ones every node with leaders, which links a crowd of similar nodes without its pairs.
Candidates are verified by the exact similarity of their sets: pairs that the sizes rule out go before any set is built,
and a set moves to the hub of its pairs, a hub's set once for every PART of its pairs. The verified links' connected
components are the classes. Nodes of larger buckets that hold several classes then take an exact join by prefixes of
their sets (rarest elements first, with the bounds of sizes and positions) for the links between classes that no leader
showed, nor AGREE small buckets. Before it, where it could make more pairs than it reads rows, nodes meet leaders of each
element, in turns that join their classes, so that it makes no pair within a crowd. Classes are named after their least
doc_id.

Texts of fewer than five words have one shingle, all their words; texts without words are all equal. Every row has a class
of its own text's: rows of a null doc_id or of a doc_id that others have too are told apart by their texts, and a class of
null doc_ids alone has a null name. one_of_each() keeps one row of each class, that of the least doc_id, nulls last; of
rows equal in doc_id and text, any one. Other columns, whatever their names, are ignored or kept. Empty tables give empty
results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, fresh, keyed, mix, prepare, scope, shared_ids, small_enough, stored, table, texts, window_hashes, word_hashes, words

SHINGLE, THRESHOLD = 5, 0.8
#: Bands, coordinates in a band; bands in which a pair must agree. At a similarity of 0.8 a pair agrees in fewer with
#: probability 8e-5.
BANDS, ROWS, AGREE = 21, 3, 3
#: Nodes of a bucket whose pairs are all candidates; leaders of a larger bucket; keys of over 1/HOT of all rows of a
#: join, of which there are HOT at most, are joined by broadcast.
PAIRS, LEADERS, HOT = 32, 6, 2000
#: Pairs of one hub that are verified together.
PART = 512
CHUNK = 1 << 18
#: Turns of leaders before an exact join at most; links for a node that one must find for another one to follow.
TURNS, USEFUL = 8, 0.25
#: Counters of elements by hash that order them by rarity. Any order is right; this one makes few candidates.
SLOTS = 1 << 22
#: Runs of slots whose counters are added up together.
BLOCKS = 64
#: Ids that are broadcast at most; beyond that texts are joined with them by shuffle.
BROADCAST_ROWS = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def elements(offs: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the texts' distinct shingles, sorted."""
    starts, ends, first = words(offs, data)
    size = np.diff(first)
    own = np.repeat(np.arange(len(size)), size)
    h = word_hashes(data, starts, ends)
    whole = window_hashes(h, k)
    ok = own[: len(whole)] == own[k - 1 :] if len(h) >= k else np.zeros(0, bool)
    row, cell = own[: len(whole)][ok], whole[ok]
    for n in range(1, k):  # texts of under k words
        short = np.flatnonzero(size == n)
        if len(short):
            row = np.concatenate((row, short))
            cell = np.concatenate((cell, window_hashes(h, n, k)[first[short]]))
    order = np.lexsort((cell, row))
    row, cell = row[order], cell[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(new)
    return row[at], cell[at], np.diff(np.concatenate((at, [len(row)])))


def unit_cells(row: np.ndarray, cell: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every unit of weight, sorted: multisets become sets whose intersections have the lesser weights."""
    if len(weight) == 0 or weight.max() == 1:
        return row, cell
    at = np.repeat(np.arange(len(row)), weight)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
    row, cell = row[at], np.where(copy == 0, cell[at], mix(cell[at] + copy.astype(np.uint64) * _GOLD))
    order = np.lexsort((cell, row))
    return row[order], cell[order]


def dart_signatures(row: np.ndarray, cell: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """The k earliest darts (32 bits of their hashes) of each text; zeros for texts without elements."""
    out = np.zeros((n_rows, k), np.uint32)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    bound = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1), 0.0)
    # the regions of an element: weights from 0 to 1, and from each power of two below its weight to the next
    regions = [(row, cell, weight, 0, 1)]
    level = 0
    while len(over := np.flatnonzero(weight > (1 << level))):
        regions.append((row[over], mix(cell[over] ^ np.uint64(level + 1)), weight[over], 1 << level, 1 << level))
        level += 1
    row, cell, weight = (np.concatenate([x[i] for x in regions]) for i in range(3))
    low, width = (np.concatenate([np.full(len(x[0]), x[i], np.float64) for x in regions]) for i in (3, 4))
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[row])
        r, seed, rank, base, span, top = row[live], cell[live], np.zeros(len(live)), low[live], width[live], weight[live]
        rs, ranks, marks, coords = [], [], [], []
        step = 0
        while len(r):
            step += 1
            dart = mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span
            near = rank < bound[r]
            r, seed, rank, base, span, top = r[near], seed[near], rank[near], base[near], span[near], top[near]
            dart = mix(dart[near] ^ np.uint64(0xA0761D6478BD642F))
            hit = slice(None)
            if level:
                place = (mix(dart ^ _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                hit = base + place * span < top
            rs.append(r[hit])
            ranks.append(rank[hit])
            coords.append((dart[hit] >> np.uint64(32)) * np.uint64(k) >> np.uint64(32))
            marks.append(dart[hit].astype(np.uint32))
        at = np.concatenate(rs) * k + np.concatenate(coords).astype(np.int64)
        rank, mark = np.concatenate(ranks), np.concatenate(marks)
        order = np.lexsort((rank, at))
        at, mark = at[order], mark[order]
        lead = np.ones(len(at), bool)
        lead[1:] = at[1:] != at[:-1]
        filled = np.bincount(at[lead] // k, minlength=n_rows)
        full = todo & (filled == k)
        use = lead & full[at // k]
        out.reshape(-1)[at[use]] = mark[use]
        todo &= ~full
        bound = bound * 2
    return out


def signatures(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, s1, s2 (a 128-bit sum of the set), keys (one for each band), size (sum of weights) of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, offs, data in texts(b.column(1), CHUNK):
                n = len(offs) - 1
                row, cell, weight = elements(offs, data, k)
                sig = dart_signatures(row, cell, weight, n, bands * rows).reshape(n, bands, rows)
                key = np.full((n, bands), 0, np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))
                for i in range(rows):
                    key = mix(key ^ sig[:, :, i].astype(np.uint64))
                sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                for j, s in enumerate(sums):
                    np.add.at(s, row, mix(cell ^ np.uint64(0x1234567 * (j + 1))) * weight.astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(as_long(key).reshape(-1)))
                size = np.bincount(row, weights=weight, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(as_long(sums[0])), pa.array(as_long(sums[1])), lists, pa.array(size)], names=["id", "s1", "s2", "keys", "size"])

    return docs.select("id", "text").mapInArrow(run, "id long, s1 long, s2 long, keys array<bigint>, size long")


def _shared_entries(nodes: DataFrame) -> DataFrame:
    """node, key, n, least: the entries of buckets of two and more nodes, with the number of nodes and the least one."""
    entries = stored(nodes.select("node", F.explode("keys").alias("key")), "band-entries")
    buckets = stored(entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "buckets")
    hot = max(PAIRS, entries.count() // HOT)
    very = F.broadcast(buckets.where(F.col("n") > hot))
    rest = entries.join(very.select("key"), "key", "left_anti").join(buckets.where(F.col("n") <= hot), "key")
    return stored(entries.join(very, "key").unionByName(rest), "shared-entries")


def first_candidates(shared: DataFrame) -> DataFrame:
    """a, b: every node with the least node of all its buckets."""
    return shared.groupBy("node").agg(F.min("least").alias("a")).where("a < node").select("a", F.col("node").alias("b"))


def all_candidates(shared: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: pairs of small buckets, and nodes of the others with the bucket's leaders (the least nodes in LEADERS random
    orders), that meet at least AGREE times, are of different classes so far, and whose sizes allow the similarity. Pairs
    within a class are left out before any is made, so a crowd that is linked already makes none."""
    own = stored(shared.select("node", "key", "n").join(known, "node"), "known-entries")
    lists = own.where(F.col("n") <= PAIRS).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "label", "size"))).alias("m"))

    def later(x: Column, i: Column) -> Column:
        others = F.filter(F.slice("m", i + 2, F.size("m")), lambda y: (y["label"] != x["label"]) & _fit(x["size"], y["size"], threshold))
        return F.transform(others, lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))

    pairs = lists.select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.a", "p.b")
    large = own.where(F.col("n") > PAIRS).drop("n")
    lead = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("o"), F.struct("node", "label", "size").alias("x")))["x"].alias(f"l{i}") for i in range(LEADERS)]
    leaders = stored(large.groupBy("key").agg(*lead).select("key", F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("os")), "leaders")
    with_leaders = large.join(F.broadcast(leaders) if small_enough(leaders, BROADCAST_ROWS) else leaders, "key")
    apart = F.filter("os", lambda o: (o["label"] != F.col("label")) & _fit(o["size"], F.col("size"), threshold))
    led = with_leaders.select("node", F.explode(F.transform(apart, lambda o: o["node"])).alias("o"))
    met = pairs.union(led.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")))
    return met.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= AGREE).select("a", "b")


def _fit(a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of the two sizes can have the similarity."""
    return F.least(a, b) + 1e-9 >= F.lit(threshold) * F.greatest(a, b)


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """The distinct pairs a, b whose sets have at least the similarity.

    The set of b goes to its hub a, in parts of about PART pairs, and that of a to each part; within a part sorted by hub,
    the hub's set comes first and is held while the others pass."""
    prepare(docs.sparkSession)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    moves = pairs.join(parts.where("parts > 1"), "a", "left").select(F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    hubs = parts.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.expr("-parts").cast("int").alias("part"))
    to = F.collect_list(F.struct("hub", "part")).alias("to")
    asked = stored(moves.union(hubs).groupBy(F.col("node").alias("id")).agg(to), "asked")
    few = F.broadcast(asked) if small_enough(asked, BROADCAST_ROWS) else asked

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # repeated rows, which are those of negative ids, have equal texts
        for b in batches:
            for lo, offs, data in texts(b.column(1), CHUNK):
                n = len(offs) - 1
                row, cell = unit_cells(*elements(offs, data, k))
                at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
                ids, new = b.column(0).slice(lo, n), []
                for i, x in enumerate(ids.to_pylist()):
                    if x >= 0 or x not in done:
                        new.append(i)
                    if x < 0:
                        done.add(x)
                out = pa.RecordBatch.from_arrays([ids, b.column(2).slice(lo, n), pa.ListArray.from_arrays(pa.array(at), pa.array(as_long(cell)))], names=["node", "to", "cells"])
                yield out if len(new) == n else out.take(pa.array(new, pa.int32()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, size, held = None, 0, np.zeros(0, np.uint64)
        for b in batches:
            node, at = b.column(0).to_pylist(), b.column(1).to_pylist()
            lists = b.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            found = []
            for i, (x, h) in enumerate(zip(node, at, strict=True)):
                own = flat[ends[i] : ends[i + 1]]
                if x == h:
                    hub, size, held = h, len(own), own.copy()
                elif h == hub and (size == len(own) == 0 or min(size, len(own)) + 1e-9 >= threshold * max(size, len(own))):
                    place = np.minimum(np.searchsorted(held, own), max(0, size - 1))
                    same = int((held[place] == own).sum()) if size else 0
                    if same * (1 + threshold) + 1e-9 >= threshold * (size + len(own)):
                        found.append(i)
            taken = pa.array(found, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1).take(taken), b.column(0).take(taken)], names=["a", "b"])

    with_sets = docs.join(few, "id").select("id", "text", "to").mapInArrow(sets, "node long, to array<struct<hub:bigint,part:int>>, cells array<bigint>")
    copies = F.when(F.col("t.part") < 0, F.sequence(F.lit(0), -F.col("t.part") - 1)).otherwise(F.array("t.part"))
    places = with_sets.select("node", "cells", F.explode("to").alias("t")).select("node", "cells", "t.hub", F.explode(copies).alias("part"))
    ordered = places.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node") != F.col("hub"))
    return ordered.select("node", "hub", "cells").mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that links lead to. Labels spread over links, and jump to their labels' labels.
    Nodes of very many links take their label to them by broadcast."""
    with scope(links.sparkSession) as own:
        ends = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
        degree = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("o"), F.count("*").alias("n"))
        labels = stored(degree.select("node", F.least("node", "o").alias("label"), "n"), "labels")
        hot = max(PART, ends.count() // HOT)
        stars = [r[0] for r in labels.where(F.col("n") > hot).select("node").collect()]  # HOT at most
        star = F.col("a").isin(stars) if stars else F.lit(False)
        while True:
            of = labels.select(F.col("node").alias("a"), "label")
            met = ends.where(~star).join(of.where(~star), "a").select("b", "label")
            if stars:
                met = met.union(ends.where(star).join(F.broadcast(of.where(star)), "a").select("b", "label"))
            spread = met.groupBy(F.col("b").alias("node")).agg(F.min("label").alias("o"))
            least = labels.join(spread, "node").select("node", "label", F.least("label", "o").alias("new"))
            up = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
            now = stored(least.join(up, "new", "left").select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") != F.col("label")).alias("moved")), "labels")
            own.drop(ends, now)
            labels = now.select("node", "label")
            if now.where("moved").limit(1).count() == 0:
                own.drop(now)
                return labels


def mixed_nodes(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """node, label: the nodes of at least AGREE buckets that hold more than one class, one of over PAIRS nodes among them.
    Others agree in too few bands with the nodes of other classes, or had all those pairs as candidates."""
    labelled = stored(shared.select("node", "key", "n").join(classes, "node", "left").select("node", "key", "n", F.coalesce("label", "node").alias("label")), "labelled-entries")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    mixed = F.broadcast(mixed) if small_enough(mixed, BROADCAST_ROWS) else mixed
    own = labelled.join(mixed, "key", "left_semi").groupBy("node").agg(F.first("label").alias("label"), F.count("*").alias("keys"), F.max("n").alias("n"))
    return own.where((F.col("keys") >= AGREE) & (F.col("n") > PAIRS)).select("node", "label")


def _rarity(docs: DataFrame, k: int) -> np.ndarray:
    """How many elements of the documents' sets fall into each of SLOTS.

    A task's counters travel as one row for each of BLOCKS runs of slots, and those of a block are added up as they come:
    rows grow with tasks, not with elements, and a task holds SLOTS counters at most."""
    width = SLOTS // BLOCKS

    def rows(block: np.ndarray, slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate((np.flatnonzero(np.diff(block, prepend=-1)), [len(block)])).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in (slot, n)]
        return pa.RecordBatch.from_arrays([pa.array(block[first[:-1]]), *lists], names=["block", "slot", "n"])

    def packed(n: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(n).astype(np.int32)
        return rows(at // np.int32(width), at, n[at])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for _, offs, data in texts(b.column(1), CHUNK):
                np.add.at(n, (unit_cells(*elements(offs, data, k))[1] % np.uint64(SLOTS)).astype(np.int64), 1)
        yield packed(n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            np.add.at(n, b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy())
        yield packed(n)

    kind = "block int, slot array<int>, n array<bigint>"
    found = docs.mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toArrow()
    out = np.zeros(SLOTS, np.int64)
    slots, counts = found["slot"].combine_chunks().flatten(), found["n"].combine_chunks().flatten()
    out[slots.to_numpy()] = counts.to_numpy()
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def prefixes(docs: DataFrame, rarity: np.ndarray, threshold: float, k: int) -> DataFrame:
    """cell, node, label, size, at: of every set the first elements, rarest first, one of which a similar set must share;
    without those that no other set has, as their counter tells."""
    held = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, offs, data in texts(b.column(1), CHUNK):
                n = len(offs) - 1
                row, cell = unit_cells(*elements(offs, data, k))
                order = np.lexsort((cell, held.value[(cell % np.uint64(SLOTS)).astype(np.int64)], row))
                row, cell = row[order], cell[order]
                size = np.bincount(row, minlength=n)
                at = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                keep = at <= (size - np.ceil(threshold * size - 1e-9).astype(np.int64))[row]
                keep &= held.value[(cell % np.uint64(SLOTS)).astype(np.int64)] > 1
                own = pa.array(row[keep])
                cols = [pa.array(as_long(cell[keep])), b.column(0).slice(lo, n).take(own), b.column(2).slice(lo, n).take(own), pa.array(size[row[keep]]), pa.array(at[keep])]
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "node", "label", "size", "at"])

    return docs.mapInArrow(run, "cell long, node long, label long, size long, at long")


def _left(size_x: Column, at_x: Column, size: Column, at: Column, threshold: float) -> Column:
    """Whether sets that share an element at these places can have the similarity: at one of t they share t / (1 + t) of
    their sizes' sum, and from their first common element on neither has less left."""
    return F.least(size_x - at_x, size - at) * (1 + threshold) + 1e-9 >= F.lit(threshold) * (size_x + size)


def mixed_cells(entries: DataFrame) -> DataFrame:
    """cell, n, most, main: the elements that nodes of several classes have in their prefixes, the number of these nodes, and
    that of the largest class and its name."""
    own = entries.groupBy("cell", "label").agg(F.count("*").alias("n")).groupBy("cell")
    found = own.agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
    return found.where("labels > 1").select("cell", "n", F.col("top.n").alias("most"), F.col("top.label").alias("main"))


def led_pairs(entries: DataFrame, cells: DataFrame, threshold: float, turn: int) -> DataFrame:
    """a, b: leaders and the nodes of other classes that can be similar to them. An element has a leader for each range of
    sizes, one that comes to it early, and so can be similar to most, by chances that differ with the turn."""
    band = F.floor(F.log("size") / math.log(max(1 / threshold, 1.05)))
    early = (F.col("at") + 1) / F.col("size") * (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1000)) + 200)
    lead = F.min(F.struct(early.alias("o"), "node", "label", "size", "at")).alias("lead")
    found = entries.groupBy("cell", band.alias("band")).agg(lead).groupBy("cell").agg(F.collect_list("lead").alias("leads"))
    leaders = stored(found.join(cells, "cell", "left_semi"), "leaders")
    met = entries.join(F.broadcast(leaders) if small_enough(leaders, BROADCAST_ROWS) else leaders, "cell")
    near = lambda x: (x["label"] != F.col("label")) & _left(x["size"], x["at"], F.col("size"), F.col("at"), threshold)
    return met.select(F.explode(F.transform(F.filter("leads", near), lambda x: x["node"])).alias("a"), F.col("node").alias("b")).distinct()


def prefix_pairs(entries: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """a, b: all pairs of different classes that can be similar. On each element the nodes outside its largest class meet
    all."""
    shared = stored(entries.join(cells.select("cell", "main"), "cell"), "shared-prefixes")
    x = shared.where("label <> main").select("cell", *[F.col(c).alias(f"{c}_x") for c in ("node", "label", "size", "at")])
    near = _left(F.col("size_x"), F.col("at_x"), F.col("size"), F.col("at"), threshold)
    met = x.join(shared, (x["cell"] == shared["cell"]) & (F.col("label_x") != F.col("label")) & near)
    return met.select(F.least("node_x", "node").alias("a"), F.greatest("node_x", "node").alias("b")).distinct()


def crowd_links(nodes: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """a, b: links that join all classes of the nodes between which there is any link.

    The first common element of similar sets, in any order, is in both prefixes, so all pairs that share one are candidates.
    Where these could be more than the rows, nodes meet their elements' leaders alone, and the classes so found are joined:
    a crowd of similar nodes becomes one class by a few pairs a node, and pairs within a class are never made. Turns of
    leaders end when one finds little; then all pairs that are left between classes are made."""
    few = F.broadcast(nodes) if small_enough(nodes, BROADCAST_ROWS) else nodes
    own = docs.select(F.col("id").alias("node"), "text").join(few, "node").select("node", "text", "label")
    entries = held = stored(prefixes(own, _rarity(own, k), threshold, k).distinct(), "prefixes")
    labels, links, useful, asked = nodes, [], True, nodes.count()
    while True:
        cells = stored(mixed_cells(held), "mixed-cells")
        rows, pairs = cells.agg(F.sum("n"), F.sum((F.col("n") - F.col("most")) * F.col("n").cast("double"))).first()
        last = not useful or len(links) == TURNS or (pairs or 0) <= (rows or 0)
        met = stored(prefix_pairs(held, cells, threshold) if last else led_pairs(held, cells, threshold, len(links)), "candidates")
        links.append(stored(verified(met, docs, threshold, k), "links"))
        if last:
            return reduce(DataFrame.union, links)
        useful = links[-1].count() >= USEFUL * asked
        labels = joined_classes(labels, links[-1])
        known = F.broadcast(labels) if small_enough(labels, BROADCAST_ROWS) else labels
        held = stored(entries.drop("label").join(known, "node"), "labelled-prefixes")


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the classes after further links between their nodes, or nodes of none."""
    label = lambda x: classes.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    ends = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
    up = components(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    moved = classes.join(up.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return stored(moved.union(up.join(classes, "node", "left_anti").select("node", "label")), "labels")


def _row_nodes(rows: DataFrame, nodes: DataFrame, hot: int) -> DataFrame:
    """id, node of every row; sets of very many rows (HOT at most) are joined by broadcast."""
    very = F.broadcast(nodes.where(F.col("n") > hot).drop("n"))
    rest = rows.join(very.select("s1", "s2"), ["s1", "s2"], "left_anti").join(nodes.where(F.col("n") <= hot).drop("n"), ["s1", "s2"])
    return rows.join(very, ["s1", "s2"]).select("id", "node").union(rest.select("id", "node"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, exact: bool = True) -> DataFrame:
    """id, label of rows with a long id, which repeated rows alone share: the least id of the class, the ids of rows
    without a doc_id of their own being negative. Without `exact` the join of crowded buckets by prefixes is left out."""
    spark = docs.sparkSession
    with scope(spark) as own:
        sig = stored(signatures(docs, k, bands, rows), "signatures")
        nodes = stored(sig.groupBy("s1", "s2").agg(F.min("id").alias("node"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.count("*").alias("n")), "nodes")
        lean = stored(nodes.select("node", "size"), "sizes")
        ids = stored(_row_nodes(sig.select("id", "s1", "s2"), nodes.select("s1", "s2", "node", "n"), max(PART, sig.count() // HOT)), "row-nodes")
        shared = _shared_entries(nodes.select("node", "keys"))
        own.drop(shared, lean, ids)
        of = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns]).withColumnRenamed(f"node_{x}", x)
        # the least nodes of buckets link most of each class; other pairs are verified only between classes so far
        with scope(spark) as first:
            pairs = first_candidates(shared).join(of(lean, "a"), "a").join(of(lean, "b"), "b")
            links = stored(verified(stored(pairs.where(_fit(F.col("size_a"), F.col("size_b"), threshold)).select("a", "b"), "candidates"), docs, threshold, k), "links")
            first.drop(links)
        with scope(spark) as second:
            so_far = components(links)
            known = stored(lean.join(so_far, "node", "left").select("node", "size", F.coalesce("label", "node").alias("label")), "known")
            apart = all_candidates(shared, known, threshold)
            found = joined_classes(so_far, stored(verified(stored(apart, "candidates"), docs, threshold, k), "links"))
            second.drop(found)
        if exact:
            with scope(spark) as third:
                apart = stored(mixed_nodes(shared, found), "mixed-nodes")
                if apart.limit(1).count():
                    found = joined_classes(found, crowd_links(apart, docs, threshold, k))
                third.drop(found)
        out = stored(ids.join(found, "node", "left").select("id", F.coalesce("label", "node").alias("label")), "classes")
        own.drop(out)
    return out


def _names(rows: DataFrame, label: DataFrame) -> DataFrame:
    """id, class_id, first: of every id the least doc_id of its class, nulls last, and the id of a row that has it."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("m")
    of = label.distinct()
    named = stored(rows.select("id", "doc_id").distinct().join(of, "id").groupBy("label").agg(least), "class-names")
    return of.join(named, "label").select("id", F.col("m.doc_id").alias("class_id"), F.col("m.id").alias("first"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, exact: bool = True) -> DataFrame:
    """doc_id, class_id: the class of every row, named after its least doc_id; null if all of its are."""
    shared, kind = shared_ids(docs), docs.schema["doc_id"].dataType
    slim = keyed(docs.select("doc_id", "text"), "id", shared)
    label = classes(slim, threshold, k, bands, rows, exact)
    if shared is None:
        return label.select(F.col("id").cast(kind).alias("doc_id"), F.col("label").cast(kind).alias("class_id"))
    return slim.select("id", "doc_id").join(stored(_names(slim, label).select("id", "class_id"), "class-ids"), "id").select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class with its own columns: that of the least doc_id, nulls last."""
    key, columns = fresh(docs, "_key"), [F.col(f"`{c}`") for c in docs.columns]
    with scope(docs.sparkSession) as own:
        shared = shared_ids(docs)
        rows = keyed(docs, key, shared)
        slim = rows.select(F.col(key).alias("id"), "doc_id", "text")
        label = classes(slim)
        later = label.where("id != label") if shared is None else _names(slim, label).where("id != first")
        others = stored(later.select(F.col("id").alias(key)), "later-copies")
        left = rows.join(F.broadcast(others) if small_enough(others, BROADCAST_ROWS) else others, key, "left_anti")
        if shared is None:
            own.drop(others)
            return left.select(*columns)
        many = stored(label.groupBy(F.col("id").alias(key)).count().where("count > 1").select(key), "repeated-rows")
        own.drop(others, many)
    few = F.broadcast(many) if small_enough(many, BROADCAST_ROWS) else many
    return left.join(few, key, "left_anti").select(*columns).union(left.join(few, key, "left_semi").dropDuplicates([key]).select(*columns))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s, count(*) AS c FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0) GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM sh GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 9 >= 4 * (x.n + y.n)
    UNION ALL SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON len(x.ws) = 0 AND len(y.ws) = 0 AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
SELECT w.doc_id, coalesce(least(min(r.c), w.doc_id), w.doc_id) AS class_id FROM w LEFT JOIN r USING (doc_id) GROUP BY w.doc_id
"""
