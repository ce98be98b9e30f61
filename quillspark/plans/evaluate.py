"""Queries of the evaluation dataflow: citations, coverage, sizes, corpora, topics, question scores, comparisons, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import CITED_EXTENSIONS, NEVER_CITED_DIRS, NEVER_CITED_FILES, cited_paths
from ..functions.values import percent
from ..operators import evaluation as ev
from ..operators.patterns import pattern_counts as pattern_table
from ..operators.relational import zero_filled
from ..sources.tables import table
from .ingest import FILES_SQL, _literal, files, scanned

CORE = ["the", "tion and", "ciónmente", "no/such/file.ts", "thing. The", "queau"]
TOPICS = {"one": ["the", "and"], "two": ["tion", "ing."], "three": ["de la", "que"], "four": ["der", "und"], "none": ["zzzz+", "(x)"]}
CORPUS_LIMIT = 400


def cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that cite files by name, by suffix, by link and wrongly."""
    p, path = F.col("part_id"), F.col("path")
    tail = F.element_at(F.split("path", "/"), -1)
    content = F.concat(
        F.lit("See `"), path, F.lit(":"), (p % 90 + 1).cast("string"), F.lit("` and [code](./"), F.concat_ws("/", F.element_at(F.split("path", "/"), -2), tail), F.lit("#L3-L9), `"), tail,
        F.lit("`, `no code`, [site](https://example.org/a.ts), [blob](https://github.com/o/r/blob/main/"), path, F.lit("#L1), `gone/"), p.cast("string"), F.lit(".ts`."),
    )
    return files(spark, sf_dir).select("part_id", content.alias("content"))


_SPAN = r"list_transform(regexp_extract_all(content, '`([^`\n]+)`', 1), lambda x: trim(x))"
_HREF = r"regexp_extract_all(content, '\[[^\]]*\]\(([^)\s]+)\)', 1)"
_BLOB = r"github\.com/[^/\s]+/[^/\s]+/blob/[^/\s]+/([^)\s#]+)"
_CITED = rf"""{FILES_SQL},
pages_ AS (SELECT part_id, 'See `' || path || ':' || (part_id % 90 + 1) || '` and [code](./' || parts[-2] || '/' || parts[-1] || '#L3-L9), `' || parts[-1]
    || '`, `no code`, [site](https://example.org/a.ts), [blob](https://github.com/o/r/blob/main/' || path || '#L1), `gone/' || part_id || '.ts`.' AS content FROM shaped),
raw AS (SELECT part_id, unnest(list_concat({_SPAN}, list_transform(list_filter({_HREF}, lambda h: regexp_matches(h, '{_BLOB}') OR NOT (regexp_matches(h, '^(?i)[a-z]+://') OR starts_with(h, '#'))),
    lambda h: CASE WHEN regexp_matches(h, '{_BLOB}') THEN regexp_extract(h, '{_BLOB}', 1) ELSE h END))) AS x FROM pages_),
norm AS (SELECT part_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\./', ''), '^/+', ''), '#L\d+(-L?\d+)?$', ''), ':\d+(-\d+)?$', '') AS path FROM raw),
cand AS (SELECT DISTINCT part_id, path FROM norm WHERE length(path) BETWEEN 1 AND 200 AND regexp_full_match(path, '[\w@./-]+') AND NOT contains(path, '//') AND NOT contains(path, '..') AND NOT starts_with(path, '.')
    AND NOT list_contains({_literal(NEVER_CITED_DIRS)}, string_split(path, '/')[1]) AND NOT list_contains({_literal(NEVER_CITED_FILES)}, string_split(path, '/')[-1])
    AND list_contains({_literal(CITED_EXTENSIONS)}, lower(regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]*)$', 1)))),
repo AS (SELECT path FROM scanned)"""


def citation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited_pages(spark, sf_dir).select("part_id", F.explode(cited_paths(F.col("content"))).alias("path"))


def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of all pages held against the files that a scan keeps."""
    out = ev.citations(cited_pages(spark, sf_dir), scanned(spark, sf_dir).select("path"))
    return out.select("candidate_count", "valid_count", F.round("validity", 4).alias("validity"), F.col("invalid_count").alias("n_invalid"), "first_invalid")


def core_file_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = spark.createDataFrame(list(enumerate(CORE)), "place int, pattern string")
    out = ev.coverage(table(spark, sf_dir, "documents").select(F.col("text").alias("content")), core)
    return out.select(F.array_join("covered", "|").alias("covered"), F.array_join("missing", "|").alias("missing"), F.round("coverage", 4).alias("coverage"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return d.select("doc_id", F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("source") != "src3", F.col("source")).alias("section"), status.alias("status"), F.col("text").alias("content"))


def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sizes(_pages(spark, sf_dir))


def corpus_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every conversation as one corpus, cut at a limit."""
    c = table(spark, sf_dir, "conversations")
    pages = c.select("conv_id", "turn", F.col("role").alias("title"), F.lit(None).cast("string").alias("section"), F.lit("completed").alias("status"), F.col("text").alias("content"))
    return ev.corpus(pages, ["conv_id"], "turn", CORPUS_LIMIT).select("conv_id", F.sha2("corpus", 256).alias("corpus_hash"), "truncated")


def best_page_for_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("Page of "), F.col("lang")).alias("title"), F.col("text").alias("content"))
    topics = spark.createDataFrame([(t, w) for t, words in TOPICS.items() for w in words], "topic string, keyword string")
    return ev.best_pages(pages, topics).select("topic", "page_id", F.round("score", 4).alias("score"))


def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each longer word of the conversations: documents that hold it, within words too, and how often."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("pattern")).where(F.length("pattern") >= 5).distinct()
    named = words.select(F.xxhash64("pattern").alias("id"), "pattern")
    found = pattern_table(table(spark, sf_dir, "documents"), ["doc_id"], ["text"], named)
    return found.groupBy("id").agg(F.count("*").alias("documents"), F.sum("n_text").alias("occurrences")).join(named, "id").select("pattern", "documents", "occurrences")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(0).alias("pos"), (F.col("doc_id") % 5 > 0).alias("answerable"))
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "partial")
    g = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(0).alias("pos"), verdict.alias("verdict"), F.lit(None).cast("string").alias("reason"))
    return ev.answered(q, a, g)


_ANSWERED = """ans AS (SELECT d.doc_id AS id, source, CASE WHEN NOT coalesce(l.doc_id % 5 > 0, false) THEN 'unanswerable' WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' ELSE 'incorrect' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)),
pts AS (SELECT *, CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE AS p, id % 3 = 0 AS deep FROM ans)"""


def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.scores(_answered(spark, sf_dir), F.col("id") % 3 == 0)
    return out.select(*ev.VERDICTS, *[F.round(c, 4).alias(c) for c in ("score", "floor", "depth")], percent(F.col("score")).alias("score_text"))


def qa_scores_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.scores(_answered(spark, sf_dir), F.col("id") % 3 == 0, ["source"]).select("source", *ev.VERDICTS, *[F.round(c, 4).alias(c) for c in ("score", "floor", "depth")])


def pairwise_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins of two runs and ties over order-swapped judgements."""
    side = lambda c: F.when(c == 1, "A").otherwise("B")
    judged = table(spark, sf_dir, "labels").select(ev.winner(side(F.col("quality")), F.when(F.col("doc_id") % 7 > 0, side(F.col("toxic"))), "base", "next").alias("winner"))
    return zero_filled(judged, "winner", ["base", "next", "tie"])


def run_report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the runs side by side."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label"), "o_totalprice", "o_orderkey", "o_custkey")
    metrics = {"pages": F.count("*"), "mean": F.round(F.avg("o_totalprice"), 2), "most": F.round(F.max("o_totalprice"), 2), "repos": F.count_distinct("o_custkey")}
    return ev.report(o, "label", ["F", "O", "P"], metrics)


def verdict_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the first run's questions in three runs (roles), ? where a run lacks one."""
    c = table(spark, sf_dir, "conversations")
    runs = c.groupBy("conv_id", "role").agg(F.when(F.max(F.length("text")) > 150, "ok").otherwise("no").alias("v"))
    ids = runs.where("role = 'user'").select("conv_id")
    wide = ids.join(runs, "conv_id", "left").groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.first("v"))
    return wide.select("conv_id", *[F.coalesce(r, F.lit("?")).alias(r) for r in ("user", "assistant", "system")])


QUERIES = {
    "citation_candidates": citation_candidates,
    "citation_validity": citation_validity,
    "core_file_coverage": core_file_coverage,
    "size_stats": size_stats,
    "corpus_truncation": corpus_truncation,
    "best_page_for_topic": best_page_for_topic,
    "pattern_counts": pattern_counts,
    "qa_scores": qa_scores,
    "qa_scores_by_source": qa_scores_by_source,
    "pairwise_tally": pairwise_tally,
    "run_report_pivot": run_report_pivot,
    "verdict_grid": verdict_grid,
}


def _topic_sql(topic: str, words: list[str]) -> str:
    count = lambda c, k: f"len(regexp_extract_all(lower({c}), '{__import__('re').escape(k.lower())}'))"
    hits = " + ".join(f"{count('text', k)} + 5 * {count(chr(39) + 'Page of ' + chr(39) + ' || lang', k)}" for k in words)
    return f"(SELECT '{topic}' AS topic, doc_id AS page_id, round(({hits}) * 1000.0::DOUBLE / len(string_split_regex(text, '\\s+')), 4) AS score FROM documents ORDER BY ({hits}) * 1000.0::DOUBLE / len(string_split_regex(text, '\\s+')) DESC, doc_id LIMIT 1)"


_SCORES = "count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'unanswerable') AS unanswerable, round(avg(p), 4) AS score, round(avg(p) FILTER (NOT deep), 4) AS floor, round(avg(p) FILTER (deep), 4) AS depth"
_COVER = ", ".join(f"bool_or(contains(text, '{c}')) AS h{i}" for i, c in enumerate(CORE))
_COVER_LIST = "[" + ", ".join(f"{{'c': '{c}', 'h': h{i}}}" for i, c in enumerate(CORE)) + "]"
SQL = {
    "citation_candidates": f"WITH {_CITED} SELECT part_id, path FROM cand",
    "citation_validity": f"""WITH {_CITED}, suf AS (SELECT DISTINCT array_to_string(p[i:], '/') AS path FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM repo)),
        c AS (SELECT path, path IN (SELECT path FROM suf) AS ok FROM (SELECT DISTINCT path FROM cand))
        SELECT count(*) AS candidate_count, count(*) FILTER (ok) AS valid_count, round(count(*) FILTER (ok) / count(*), 4) AS validity, count(*) FILTER (NOT ok) AS n_invalid, min(path) FILTER (NOT ok) AS first_invalid FROM c""",
    "core_file_coverage": f"WITH h AS (SELECT {_COVER} FROM documents), l AS (SELECT {_COVER_LIST} AS x FROM h) SELECT array_to_string(list_transform(list_filter(x, lambda e: e.h), lambda e: e.c), '|') AS covered, array_to_string(list_transform(list_filter(x, lambda e: NOT e.h), lambda e: e.c), '|') AS missing, round(len(list_filter(x, lambda e: e.h)) / {len(CORE)}, 4) AS coverage FROM l",
    "size_stats": """WITH p AS (SELECT CASE WHEN source <> 'src3' THEN source END AS section, CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' ELSE 'pending' END AS status, text FROM documents LEFT JOIN labels USING (doc_id))
        SELECT count(DISTINCT section) AS sections, count(*) AS pages, count(*) FILTER (status = 'completed') AS completed_pages, count(*) FILTER (status = 'failed') AS failed_pages,
        CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) FILTER (status = 'completed') AS BIGINT) AS total_words,
        CAST(floor(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) FILTER (status = 'completed') / count(*) FILTER (status = 'completed') + 0.5) AS BIGINT) AS avg_words_per_page FROM p""",
    "corpus_truncation": f"""WITH f AS (SELECT conv_id, string_agg('# ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, text) AS t FROM conversations WHERE text <> '' GROUP BY ALL)
        SELECT conv_id, sha256(CASE WHEN length(t) > {CORPUS_LIMIT} THEN left(t, {CORPUS_LIMIT}) || chr(10) || chr(10) || '[wiki content truncated for evaluation]' ELSE t END) AS corpus_hash, length(t) > {CORPUS_LIMIT} AS truncated FROM f""",
    "best_page_for_topic": " UNION ALL ".join(_topic_sql(t, w) for t, w in TOPICS.items()),
    "pattern_counts": r"""WITH w AS (SELECT DISTINCT p FROM (SELECT unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) AS p FROM conversations) WHERE length(p) >= 5)
        SELECT p AS pattern, count(*) AS documents, sum((strlen(text) - strlen(replace(text, p, ''))) // strlen(p))::BIGINT AS occurrences FROM w JOIN documents ON contains(text, p) GROUP BY p""",
    "qa_scores": f"WITH {_ANSWERED} SELECT {_SCORES}, printf('%.0f%%', avg(p) * 100) AS score_text FROM pts",
    "qa_scores_by_source": f"WITH {_ANSWERED} SELECT source, {_SCORES} FROM pts GROUP BY source",
    "pairwise_tally": """WITH j AS (SELECT CASE quality WHEN 1 THEN 'base' ELSE 'next' END AS one, CASE WHEN doc_id % 7 = 0 THEN 'tie' WHEN toxic = 1 THEN 'next' ELSE 'base' END AS two FROM labels), w AS (SELECT CASE WHEN one = two THEN one ELSE 'tie' END AS winner FROM j)
        SELECT v AS winner, (SELECT count(*) FROM w WHERE winner = v) AS n FROM (VALUES ('base'), ('next'), ('tie')) t(v)""",
    "run_report_pivot": " UNION ALL ".join(
        f"SELECT {i} AS metric_order, '{m}' AS metric, {', '.join(f'(SELECT CAST({e} AS DOUBLE) FROM orders WHERE o_orderstatus = {chr(39)}{s}{chr(39)}) AS {chr(34)}{s}{chr(34)}' for s in 'FOP')}"
        for i, (m, e) in enumerate({"pages": "count(*)", "mean": "round(avg(o_totalprice), 2)", "most": "round(max(o_totalprice), 2)", "repos": "count(DISTINCT o_custkey)"}.items())
    ),
    "verdict_grid": "WITH r AS (SELECT conv_id, role, CASE WHEN max(length(text)) > 150 THEN 'ok' ELSE 'no' END AS v FROM conversations GROUP BY ALL) SELECT conv_id, "
    + ", ".join(f"coalesce(max(v) FILTER (role = '{r}'), '?') AS {chr(34)}{r}{chr(34)}" for r in ("user", "assistant", "system"))
    + " FROM r WHERE conv_id IN (SELECT conv_id FROM r WHERE role = 'user') GROUP BY conv_id",
}
