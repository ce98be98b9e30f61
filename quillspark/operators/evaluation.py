"""Evaluation of documentation: citations, coverage, diagrams, sizes, question scores, pairwise comparison, reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import cited_paths
from ..functions.text import clipped, word_count
from ..functions.values import cost
from ..streaming.calls import called
from .patterns import best_texts, covered
from .relational import valid_citations

VERDICTS = ("correct", "partial", "incorrect", "unanswerable")


def judged_citations(pages: DataFrame, files: DataFrame) -> DataFrame:
    """path, valid: the distinct citations of all pages."""
    found = pages.where(F.col("content").isNotNull()).select(F.explode(cited_paths(F.col("content"))).alias("path")).distinct()
    return valid_citations(found, files)


def invalid_citations(pages: DataFrame, files: DataFrame) -> DataFrame:
    """path: the citations that name no file, sorted."""
    return judged_citations(pages, files).where(~F.col("valid")).select("path").orderBy("path")


def citations(pages: DataFrame, files: DataFrame) -> DataFrame:
    """One row: distinct citations of all pages, valid ones, their share (null if there are none), the number of the others
    and the first of them."""
    return judged_citations(pages, files).agg(
        F.count("*").alias("candidate_count"),
        F.count_if("valid").alias("valid_count"),
        F.try_divide(F.count_if("valid"), F.count("*")).alias("validity"),
        F.count_if(~F.col("valid")).alias("invalid_count"),
        F.min(F.when(~F.col("valid"), F.col("path"))).alias("first_invalid"),
    )


def coverage(pages: DataFrame, core: DataFrame) -> DataFrame:
    """One row: which names of a list (place, pattern) occur in any page, in the list's order, and their share. One pass over
    the pages, whatever the length of the list."""
    hits = covered(pages, "content", core.select(F.col("place").cast("long").alias("id"), "pattern"))
    pick = lambda want: F.transform(F.sort_array(F.collect_list(F.when(F.col("hit") == want, F.struct("id", "pattern")))), lambda x: x["pattern"])
    return hits.agg(pick(True).alias("covered"), pick(False).alias("missing"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(1.0)).alias("coverage"))


def sizes(pages: DataFrame) -> DataFrame:
    """One row: sections, pages by status, words of completed pages and their rounded mean."""
    done = F.col("status") == "completed"
    words = F.coalesce(F.sum(F.when(done, word_count(F.coalesce("content", F.lit("")))).cast("long")), F.lit(0))
    return pages.agg(
        F.count_distinct("section").alias("sections"),
        F.count("*").alias("pages"),
        F.count_if(done).alias("completed_pages"),
        F.count_if(F.col("status") == "failed").alias("failed_pages"),
        words.alias("total_words"),
        F.coalesce(F.floor(F.try_divide(words, F.count_if(done)) + 0.5), F.lit(0)).alias("avg_words_per_page"),
    )


def corpus(pages: DataFrame, key: Sequence[str], order: str, limit: int) -> DataFrame:
    """Completed pages of each key as one text in order, cut at a limit, with a note if it was. A text holds so few pages
    below the limit that the first of each key are enough: tasks keep no more of them before the shuffle."""
    rule = "\n\n---\n\n"
    own = pages.where((F.col("status") == "completed") & (F.coalesce("content", F.lit("")) != ""))
    part = F.concat(F.lit("# "), "title", F.coalesce(F.concat(F.lit("\n_Section: "), F.nullif("section", F.lit("")), F.lit("_")), F.lit("")), F.lit("\n\n"), "content")
    within = Window.partitionBy(*key).orderBy(order, "t")
    first = own.select(*key, order, part.alias("t")).withColumn("_k", F.row_number().over(within)).where(F.col("_k") <= limit // len(rule) + 2)
    before = F.coalesce(F.sum(F.length("t") + len(rule)).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = first.withColumn("_at", before).where(F.col("_at") <= limit + len(rule))  # the text before it, without the rule, is not over the limit
    full = near.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "t"))), lambda x: x["t"]), rule).alias("full"), F.max(F.col("_at") + F.length("t")).alias("_n"))
    over = F.col("_n") > limit
    return full.select(*key, F.when(over, F.concat(F.left("full", F.lit(limit)), F.lit("\n\n[wiki content truncated for evaluation]"))).otherwise(F.col("full")).alias("corpus"), over.alias("truncated"))


#: Characters of a page that a judge of two pages sees.
PAGE_CLIP = 40_000


def pair_prompts(pairs: DataFrame) -> DataFrame:
    """id, prompt: for each pair of pages (topic, first, second) a prompt in both orders, `<topic>/1` and `<topic>/2`; long
    pages are cut, with a note."""
    note = "\n\n[page truncated]"
    page = lambda c: clipped(F.coalesce(c, F.lit("")), PAGE_CLIP, note)
    one = lambda n, a, b: F.struct(F.concat("topic", F.lit(f"/{n}")).alias("id"), F.concat(F.lit("Which page explains the topic better?\n\nTopic: "), "topic", F.lit("\n\n## Page A\n\n"), page(a), F.lit("\n\n## Page B\n\n"), page(b), F.lit("\n\nAnswer A, B or tie.")).alias("prompt"))
    return pairs.select(F.inline(F.array(one(1, F.col("first"), F.col("second")), one(2, F.col("second"), F.col("first")))))


def run_record(pages: DataFrame, keys: Mapping[str, Column], started: Column, ended: Column) -> DataFrame:
    """One row, the record of a run in the form of RUN: its labels, how long it took, tokens and cost of its pages, and how
    many pages there are, are finished, have failed."""
    sums = pages.agg(
        F.count("*").cast("int").alias("total"),
        F.count_if(F.col("status") == "completed").cast("int").alias("completed"),
        F.count_if(F.col("status") == "failed").cast("int").alias("failed"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("p"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("c"),
        F.coalesce(F.sum(cost(F.col("model"), F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0)))), F.lit(0.0)).alias("usd"),
    )
    return sums.select(
        *[keys.get(k, F.lit(None)).cast("string").alias(k) for k in ("label", "repo", "sha", "model", "contextMode")],
        (F.unix_millis(ended) - F.unix_millis(started)).alias("durationMs"),
        F.struct(F.col("p").alias("promptTokens"), F.col("c").alias("completionTokens"), F.col("usd").alias("costUsd")).alias("totals"),
        F.struct("total", "completed", "failed").alias("pageStats"),
    )


def score_record(label: str, pages: DataFrame, files: DataFrame, core: DataFrame, qa: DataFrame | None = None) -> DataFrame:
    """One row with all scores of a run: citations, coverage of core files, sizes, and those of the questions if there are
    any (scores(), without groups)."""
    as_one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    parts = [as_one(citations(pages, files), "citation"), as_one(coverage(pages, core), "coverage"), as_one(sizes(pages), "size")]
    parts.append(as_one(qa, "qa") if qa is not None else pages.sparkSession.range(1).select(F.lit(None).cast("string").alias("qa")))
    out = pages.sparkSession.range(1).select(F.lit(label).alias("label"))
    for part in parts:  # one row each
        out = out.join(part)
    return out


def answered(questions: DataFrame, answers: DataFrame, grades: DataFrame) -> DataFrame:
    """Questions with answer, verdict and reason; of several answers or grades of a question the last one counts."""
    last = lambda df: df.groupBy("id").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("id", "pos")]), "pos").alias("r")).select("id", "r.*")
    out = questions.join(last(answers), "id", "left").join(last(grades), "id", "left")
    able = F.coalesce("answerable", F.lit(False))
    return out.withColumn("verdict", F.when(~able, "unanswerable").otherwise(F.coalesce("verdict", F.lit("incorrect")))).withColumn("reason", F.coalesce("reason", F.lit("")))


def points(verdict: Column) -> Column:
    return F.when(verdict == "correct", 1.0).when(verdict == "partial", 0.5).otherwise(0.0)


def scores(rows: DataFrame, depth: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts by verdict and the scores of all questions, of floor and of depth questions (null where there are none)."""
    p = points(F.col("verdict"))
    return rows.groupBy(*by).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.avg(p).alias("score"), F.avg(F.when(~depth, p)).alias("floor"), F.avg(F.when(depth, p)).alias("depth"))


def best_pages(pages: DataFrame, topics: DataFrame, order: str = "pos") -> DataFrame:
    """topic, page_id, score: the best page of each topic (topic, keyword: a row each; one given twice counts twice), the earlier one of equals. One pass
    over the pages, whatever the number of keywords."""
    ids = topics.select(F.xxhash64("topic").alias("id"), "topic", F.col("keyword").alias("pattern"))
    words = F.size(F.split(F.coalesce("content", F.lit("")), r"(?U)\s+"))
    best = best_texts(pages.select("page_id", order, "title", "content"), "page_id", order, {"title": 5, "content": 1}, words, ids)
    return best.join(ids.select("id", "topic").distinct(), "id").select("topic", "page_id", "score")


def winner(first: Column, second: Column, a: str, b: str) -> Column:
    """Of two judgements with the order swapped: the label both name, else a tie. The second saw b in place A."""
    one = F.when(first == "A", a).when(first == "B", b).otherwise("tie")
    two = F.when(second == "A", b).when(second == "B", a).otherwise("tie")
    return F.when(one == two, one).otherwise("tie")


def report(runs: DataFrame, label: str, labels: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """metric_order, metric and a column for each run."""
    wide = runs.groupBy(label).agg(*[c.cast("double").alias(m) for m, c in metrics.items()])
    tall = wide.select(label, F.inline(F.array(*[F.struct(F.lit(i).alias("metric_order"), F.lit(m).alias("metric"), F.col(m).alias("value")) for i, m in enumerate(metrics)])))
    return tall.groupBy("metric_order", "metric").pivot(label, list(labels)).agg(F.first("value"))


def padded(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Lines of a report of a few rows, columns padded to their widest value."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.select(*columns).collect()]
    width = [max(len(x[i]) for x in [list(columns), *rows]) for i in range(len(columns))]
    return ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in [list(columns), *rows]]


def judged(prompts: DataFrame, ask: Callable[[str], str], folder: str, attempts: int = 3, at_once: int = 4) -> DataFrame:
    """id, answer of an injected judge for prompts (id, prompt), null where it failed each time; the executors call it, and
    the answers are written to the folder."""
    done = called(prompts.select("id", "prompt"), lambda item: {"text": ask(str(item["prompt"]))}, folder, at_once, retries=attempts - 1, wait=lambda n: 0.0, retry=lambda m: True)
    return done.select("id", F.col("text").alias("answer"))
