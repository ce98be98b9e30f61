"""Benchmark decontamination by containment search, in DataFrame functions alone.

A test item is found in a document if at least THRESHOLD of its distinct five-word shingles are in it. Documents are
long and items short, so signatures of documents would hardly ever agree with those of items (at a Jaccard similarity of
a few thousandths no banding has useful recall). The search is therefore asymmetric: items are partitioned by size, and
the MinHash sketch of an item keeps as many least shingle hashes as its partition needs so that a document holding the
threshold can't miss all of them: an item of n shingles may lack floor((1 - t) n) of them, so one more than that of the
partition's largest size is enough. All shingles of all documents probe these sketches, which makes recall whole; each
candidate pair is then verified by exact containment of the shingles as text.

Items with under SHINGLE words have one shingle, all their words. Null and empty texts contain nothing and, as items, are
left out. Repeated documents give one row for each doc_id and item_id (the largest containment). Null ids are kept out of
the pairs (clean_documents() judges their rows too). Other columns, whatever their names, are ignored (pairs) or kept (clean documents). Empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, fresh, keyed, let, scope, shared_ids, small_enough, stored, table, word_array

SHINGLE, THRESHOLD = 5, 0.8
#: Sketch rows that are broadcast together; there is a pass over the documents for each such slice.
SLICE_ROWS = 1_000_000
#: Candidate pairs, and bytes of item texts with them, that are broadcast at most; beyond that the joins are by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 1 << 26


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of the k-word shingles of a text."""
    return let(
        word_array(text),
        lambda w: F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k))))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )


def shingle_texts(text: Column, k: int = SHINGLE) -> Column:
    """Distinct k-word shingles of a text, words parted by one space; all words if there are fewer."""
    return let(
        word_array(text),
        lambda w: F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))))
        .when(F.size(w) > 0, F.array(F.array_join(w, " ")))
        .otherwise(F.array().cast("array<string>")),
    )


def item_sketches(items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """item_id, words and the least hashes of each item: a power-of-two partition's largest size sets how many.

    The hash of an item of under k words is that of all its words, with their number in `words` (else k)."""
    shaped = items.where(F.col("item_id").isNotNull()).select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = F.size("w") < k
    hashes = F.when(short, F.array(F.xxhash64(F.slice("w", 1, k)))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("w"), i, k))))
    )
    sized = shaped.select("item_id", F.least(F.size("w"), F.lit(k)).alias("words"), hashes.alias("h"))
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.size("h"))))
    keep = (F.floor((1 - threshold) * largest + 1e-9) + 1).cast("int")
    return sized.select("item_id", "words", F.explode(F.slice(F.array_sort("h"), F.lit(1), keep)).alias("h"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found: all pairs with n_found >= threshold * n_shingles."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    sketch = stored(item_sketches(items, threshold, k), "item-sketches")
    counts = dict(map(tuple, sketch.groupBy("words").count().collect()))  # at most k values
    sizes, found = sorted(counts), None
    for n in sizes:
        probes = docs.select("doc_id", F.explode(shingle_hashes(F.col("text"), n)).alias("h"))
        slices = -(-counts[n] // SLICE_ROWS)
        for i in range(slices):
            own = sketch.where((F.col("words") == n) & (F.pmod(F.xxhash64("h"), F.lit(slices)) == i)).select("item_id", "h")
            hits = probes.join(F.broadcast(own), "h").select("doc_id", "item_id")
            found = hits if found is None else found.union(hits)
    if found is None:  # no items
        kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
        return docs.sparkSession.createDataFrame([], f"{kinds}, n_shingles long, n_found long")
    pairs = stored(found.distinct(), "containment-candidates")
    asked = pairs.join(items.select("item_id", F.col("text").alias("item_text")).where(F.col("item_id").isNotNull()).distinct(), "item_id")
    few = small_enough(asked, BROADCAST_ROWS) and (asked.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) <= BROADCAST_BYTES
    both = docs.join(F.broadcast(asked) if few else asked, "doc_id")
    n_words = F.size(word_array(F.col("item_text")))
    item, cut = shingle_texts(F.col("item_text"), k), F.least(n_words, F.lit(k))
    doc = F.coalesce(F.concat(*[F.when(cut == n, shingle_texts(F.col("text"), n)).otherwise(F.array().cast("array<string>")) for n in sizes]), F.array().cast("array<string>"))
    verified = both.select("doc_id", "item_id", let(item, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_intersect(x, doc)).cast("long").alias("hit"))).alias("m"))
    return (
        verified.where((F.col("m.hit") > 0) & (F.col("m.hit") + 1e-9 >= F.lit(threshold) * F.col("m.n")))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct(F.col("m.hit") / F.col("m.n"), F.col("m.n").alias("n"), F.col("m.hit").alias("hit"))).alias("m"))
        .select("doc_id", "item_id", F.col("m.n").alias("n_shingles"), F.col("m.hit").alias("n_found"))
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, each row judged by its own text, whatever its doc_id."""
    key, columns = fresh(docs, "_key"), [F.col(f"`{c}`") for c in docs.columns]
    with scope(docs.sparkSession) as own:
        rows = keyed(docs, key, shared_ids(docs))
        found = contained(rows.select(F.col(key).alias("doc_id"), "text"), items)
        bad = stored(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
        own.drop(bad)
    return rows.join(F.broadcast(bad) if small_enough(bad, BROADCAST_IDS) else bad, key, "left_anti").select(*columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql_ctes(docs: str = "documents") -> str:
    return rf"""
cw AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {docs} WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
ish AS (SELECT DISTINCT item_id, least(len(ws), 5) AS k, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS sh FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM iw WHERE len(ws) > 0)),
dsh AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS sh FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM cw, (SELECT DISTINCT k FROM ish) WHERE len(ws) >= k)),
hold AS (SELECT doc_id, item_id, n AS n_shingles, count(*)::BIGINT AS n_found FROM dsh JOIN ish USING (k, sh) JOIN (SELECT item_id, count(*)::BIGINT AS n FROM ish GROUP BY ALL) USING (item_id) GROUP BY ALL HAVING n_found >= 0.8 * n_shingles)
"""


SQL = f"WITH {sql_ctes()} SELECT doc_id, item_id, n_shingles, n_found FROM hold"
