"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Every document gets counts (words, word characters, symbols, repeated lines, words in repeated windows). Two fixed base
rules reject it outright. The others are adaptive: for each language and source, quantile sketches of four rates give
Tukey fences, beyond which a document is rejected. A sketch is a histogram of log-linear buckets (values under 64
exactly, others to one part in 32): merging two is adding counts, so partial aggregation builds it before the shuffle,
and the order of rows has no influence. Groups of under MIN_GROUP documents use the merged sketches of their language.

Nulls: a null text has no words and fails the base rules; null languages and sources form groups of their own. Empty
tables give empty results. Repeated rows are judged each. Other columns, whatever their names, are kept by
quality_filter() and ignored by quality_verdicts().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, fresh, keyed, let, scope, shared_ids, small_enough, stored, table, word_array

#: Words of a document at least; percent of words in repeated windows at most; words in a window.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Interquartile ranges beyond the quartiles that a rate may lie, and what is added, per 10,000 (word length: per 100).
FENCE, MARGIN = 3, {"symbols": 100, "dup_lines": 500, "repeats": 2500, "word_length": 100}
#: Documents that a group needs for thresholds of its own.
MIN_GROUP = 50
#: Thresholds that are broadcast at most; beyond that the join is by shuffle, with salted keys.
BROADCAST_ROWS, SALTS = 100_000, 32


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the text. Windows are compared by 64-bit hashes."""
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(sorted_: Column) -> Column:
        m = F.size(sorted_)
        twice = F.filter(
            sorted_,
            lambda x, j: ((j > 0) & (F.get(sorted_, j - 1)["h"] == x["h"])) | ((j < m - 1) & (F.get(sorted_, j + 1)["h"] == x["h"])),
        )
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end"))
        return F.aggregate(at, none, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        ),
    )


def measures(text: Column) -> Column:
    """A struct of the counts of one text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        word_array(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def _rates(m: Column) -> list[tuple[str, Column]]:
    words, chars = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["word_chars"], F.lit(1))
    whole = lambda a, b: F.floor(a / b).cast("long")
    return [
        ("symbols", whole(m["n_symbols"] * 10000, chars)),
        ("dup_lines", whole(m["n_dup_lines"] * 10000, words)),
        ("repeats", whole(m["n_repeat_words"] * 10000, words)),
        ("word_length", whole(m["word_chars"] * 100, words)),
    ]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def bucket(v: Column) -> Column:
    """The lower end of the log-linear bucket of a whole number from 0."""
    cut = (F.length(F.bin(v)) - 6).cast("int")
    return F.when(v < 64, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, cut), cut))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the quantile sketches of documents that pass the base rules."""
    rates = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), bucket(v).alias("bucket")) for k, v in _rates(F.col("_m"))]))
    return (
        measured.where(~base_failed(F.col("_m")))
        .select("_lang", "_source", rates.alias("r"))
        .groupBy("_lang", "_source", F.col("r.rule").alias("rule"), F.col("r.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: n, and struct columns of the low and high fence of each rule."""
    w = Window.partitionBy(*keys, "rule")
    cum = F.sum("n").over(w.orderBy("bucket"))
    ranked = sketch.withColumn("cum", cum).withColumn("all", F.sum("n").over(w))
    quart = ranked.groupBy(*keys, "rule").agg(
        F.max("all").alias("n"),
        F.min(F.when(F.col("cum") * 4 >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("cum") * 4 >= F.col("all") * 3, F.col("bucket"))).alias("q3"),
    )
    return quart.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("rule") == k, F.col("q3") + (F.col("q3") - F.col("q1")) * FENCE + m)).alias(f"hi_{k}") for k, m in MARGIN.items()],
        F.max(F.when(F.col("rule") == "word_length", F.col("q1") - (F.col("q3") - F.col("q1")) * FENCE - MARGIN["word_length"])).alias("lo_word_length"),
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """The fences of each language and source; small groups have those of their language."""
    sketch = stored(sketches(measured), "quality-sketches")
    own = _fences(sketch, ["_lang", "_source"])
    merged = sketch.groupBy("_lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    whole = _fences(merged, ["_lang"])
    cols = [c for c in own.columns if c not in ("_lang", "_source", "n")]
    whole = whole.select(F.col("_lang").alias("_l"), *[F.col(c).alias(f"all_{c}") for c in cols])
    pick = [F.when(F.col("n") >= MIN_GROUP, F.col(c)).otherwise(F.col(f"all_{c}")).alias(c) for c in cols]
    return own.join(whole, F.col("_lang") == F.col("_l")).select("_lang", "_source", *pick)


def _measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(f"_{c}")
    return docs.select(*keep, group("lang"), group("source"), measures(docs["text"]).alias("_m"))


def _judged(measured: DataFrame, limits: DataFrame, key: Column) -> DataFrame:
    """The rows with _failed and _kept."""
    if small_enough(limits, BROADCAST_ROWS):
        joined = measured.join(F.broadcast(limits), ["_lang", "_source"], "left")
    else:
        many = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(many, ["_lang", "_source", "_salt"], "left")
    m = F.col("_m")
    out = F.lit(False)
    for k, v in _rates(m):
        out = out | F.coalesce(v > F.col(f"hi_{k}"), F.lit(False))
        if k == "word_length":
            out = out | F.coalesce(v < F.col(f"lo_{k}"), F.lit(False))
    failed = base_failed(m)
    return joined.withColumn("_failed", failed).withColumn("_kept", ~failed & ~out)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    with scope(docs.sparkSession) as own:
        measured = stored(_measured(docs, [F.col("doc_id")]), "quality-measures")
        limits = stored(thresholds(measured), "quality-thresholds")
        own.drop(measured, limits)
    return _judged(measured, limits, F.col("doc_id")).select("doc_id", "_m.*", F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. Counts are held by row, not texts."""
    key, columns = fresh(docs, "_key"), [F.col(f"`{c}`") for c in docs.columns]
    with scope(docs.sparkSession) as own:
        rows = keyed(docs, key, shared_ids(docs), "lang", "source")
        measured = stored(_measured(rows, [F.col(key)]), "quality-measures")
        limits = stored(thresholds(measured), "quality-thresholds")
        out = stored(_judged(measured, limits, F.col(key)).where(~F.col("_kept")).select(key).distinct(), "rejected")
        own.drop(out)
    return rows.join(F.broadcast(out) if small_enough(out, BROADCAST_IDS) else out, key, "left_anti").select(*columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: A common table expression that gives judged(doc_id, n_words, ..., base_failed, kept) from documents.
SQL_CTES = r"""
w AS (SELECT doc_id, coalesce('=' || lang, '') AS g_lang, coalesce('=' || source, '') AS g_source,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, coalesce(text, '') AS t,
    row_number() OVER () AS rid FROM documents),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, sum(least(8, coalesce(i - p, 8)))::BIGINT AS n_repeat_words FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, g_lang, g_source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    n_symbols * 10000 // greatest(word_chars, 1) AS r_symbols, n_dup_lines * 10000 // greatest(n_words, 1) AS r_dup_lines,
    n_repeat_words * 10000 // greatest(n_words, 1) AS r_repeats, word_chars * 100 // greatest(n_words, 1) AS r_word_length FROM m),
v AS (UNPIVOT (SELECT g_lang, g_source, r_symbols, r_dup_lines, r_repeats, r_word_length FROM b WHERE NOT base_failed)
    ON r_symbols, r_dup_lines, r_repeats, r_word_length INTO NAME rule VALUE x),
s AS (SELECT g_lang, g_source, rule, CASE WHEN x < 64 THEN x ELSE (x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6) END AS bucket, count(*)::BIGINT AS n FROM v GROUP BY ALL),
s2 AS (SELECT g_lang, g_source, rule, bucket, n FROM s UNION ALL SELECT g_lang, NULL, rule, bucket, sum(n)::BIGINT FROM s GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY g_lang, g_source, rule ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY g_lang, g_source, rule) AS total FROM s2),
q AS (SELECT g_lang, g_source, rule, max(total) AS n, min(bucket) FILTER (cum * 4 >= total) AS q1, min(bucket) FILTER (cum * 4 >= total * 3) AS q3 FROM c GROUP BY ALL),
f AS (SELECT own.g_lang, own.g_source, own.rule, CASE WHEN own.n >= 50 THEN own.q1 ELSE al.q1 END AS q1, CASE WHEN own.n >= 50 THEN own.q3 ELSE al.q3 END AS q3
    FROM q own JOIN q al ON own.g_lang = al.g_lang AND own.rule = al.rule WHERE own.g_source IS NOT NULL AND al.g_source IS NULL),
lim AS (SELECT g_lang, g_source, max(q3 + (q3 - q1) * 3 + 100) FILTER (rule = 'r_symbols') AS hi_s, max(q3 + (q3 - q1) * 3 + 500) FILTER (rule = 'r_dup_lines') AS hi_d,
    max(q3 + (q3 - q1) * 3 + 2500) FILTER (rule = 'r_repeats') AS hi_r, max(q3 + (q3 - q1) * 3 + 100) FILTER (rule = 'r_word_length') AS hi_w,
    max(q1 - (q3 - q1) * 3 - 100) FILTER (rule = 'r_word_length') AS lo_w FROM f GROUP BY ALL),
judged AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (coalesce(r_symbols > hi_s, false) OR coalesce(r_dup_lines > hi_d, false) OR coalesce(r_repeats > hi_r, false)
        OR coalesce(r_word_length > hi_w, false) OR coalesce(r_word_length < lo_w, false)) AS kept
    FROM b LEFT JOIN lim USING (g_lang, g_source))
"""
SQL = f"WITH {SQL_CTES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
