"""Queries over outlines: flattening, slugs, validation, summaries, normalisation, affected and unfinished pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outline as ol
from ..operators.generation import rescanned, stored_pages, to_resume
from ..operators.relational import overlapping
from ..sources.json_files import OUTLINE
from ..sources.tables import table
from .ingest import FILES_SQL, files


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outline from regions (sections) and nations (pages), through JSON text as a model would give it."""
    page = F.struct(
        F.lower("n_name").alias("id"), F.initcap("n_name").alias("title"), F.concat(F.lit("About "), "n_name").alias("description"),
        F.transform(F.sequence(F.lit(1), F.col("n_nationkey") % 5 + 1), lambda i: F.concat(F.lit("src/"), F.lower("n_name"), F.lit("_"), i.cast("string"), F.when(i % 2 == 0, F.lit(".md")).otherwise(F.lit(".ts")))).alias("filePaths"),
        F.when(F.col("n_nationkey") % 3 > 0, F.array(F.lit("flow"), F.lit("class"), F.lit("sequence"))).alias("diagrams"),
    )
    pages = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", page.alias("p")))).alias("l"))
    section = F.struct("r_regionkey", F.struct(F.lower("r_name").alias("id"), F.initcap("r_name").alias("title"), F.lit("x").alias("description"), F.transform("l", lambda x: x["p"]).alias("pages")).alias("s"))
    whole = table(spark, sf_dir, "region").join(pages, "r_regionkey").agg(F.sort_array(F.collect_list(section)).alias("l"))
    text = F.to_json(F.struct(F.lit("World").alias("title"), F.lit("d").alias("description"), F.transform("l", lambda x: x["s"]).alias("sections")))
    return whole.select(F.lit(1).alias("wiki_id"), F.from_json(text, OUTLINE).alias("outline"))


_PAGES = """np AS (SELECT r_regionkey AS section_pos, lower(r_name) AS section_id, array_to_string(list_transform(string_split(r_name, ' '), lambda x: upper(left(x, 1)) || lower(x[2:])), ' ') AS section_title, n_nationkey, n_name, lower(n_name) AS page_id,
    array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(left(x, 1)) || lower(x[2:])), ' ') AS title, 'About ' || n_name AS description,
    list_transform(range(1, n_nationkey % 5 + 2), lambda i: 'src/' || lower(n_name) || '_' || i || CASE WHEN i % 2 = 0 THEN '.md' ELSE '.ts' END) AS paths, n_nationkey % 3 > 0 AS has_diagrams,
    row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS page_pos, row_number() OVER (ORDER BY r_regionkey, n_nationkey) - 1 AS sort_order FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def outline_pages_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ol.flat_pages(outlines(spark, sf_dir), "wiki_id")
    return out.select("wiki_id", "section_pos", "section_id", "page_pos", "sort_order", F.col("id").alias("page_id"), "title", F.size("filePaths").alias("n_paths"))


def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ol.flat_pages(outlines(spark, sf_dir), "wiki_id")
    return out.select(F.col("id").alias("page_id"), ol.slug_entry(F.col("section_pos"), F.col("page_pos"), ol.plain_slug(F.col("title"))).alias("slug"))


def resolved_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by full slug and by page id, and one that leads nowhere."""
    flat = ol.flat_pages(outlines(spark, sf_dir), "wiki_id")
    entries = flat.select("wiki_id", F.col("id").alias("page_id"), "sort_order", ol.slug_entry(F.col("section_pos"), F.col("page_pos"), ol.plain_slug(F.col("title"))).alias("slug"))
    asked = entries.select("wiki_id", F.explode(F.array(F.upper("slug"), F.concat(F.lit("%20"), ol.plain_slug(F.col("page_id"))), F.concat(F.lit("no-"), F.col("slug")))).alias("slug"))
    return ol.resolve_slug(entries, asked, "wiki_id").select("slug", "page_id")


def outline_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each nation's own small outline: parts are missing by its number."""
    k = F.col("n_nationkey")
    page = F.struct(F.when(k % 5 != 1, F.lower("n_name")).alias("id"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("filePaths"), F.lit(None).cast("array<string>").alias("diagrams"))
    section = F.struct(F.when(k % 5 != 2, F.lit("s")).alias("id"), F.lit("S").alias("title"), F.lit(None).cast("string").alias("description"), F.when(k % 5 != 3, F.array(page)).alias("pages"))
    one = F.struct(F.when(k % 5 != 4, F.lit("T")).otherwise("").alias("title"), F.lit(None).cast("string").alias("description"), F.when(k % 7 != 6, F.array(section)).alias("sections"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.regexp_extract(F.coalesce(ol.problem(one), F.lit("none")), "^[^:]*", 0).alias("problem"))


def outline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outlines(spark, sf_dir)
    return out.select("wiki_id", ol.summary(F.col("outline")).alias("summary"), ol.page_total(F.col("outline")).cast("long").alias("n_pages"))


def outline_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline held against a repository that lacks some of its files and has entry points."""
    pages = ol.flat_pages(outlines(spark, sf_dir), "wiki_id")
    paths = pages.select("wiki_id", F.explode("filePaths").alias("path")).where(~F.col("path").rlike("_5")).distinct()
    entries = spark.createDataFrame([(1, "src/index.ts"), (1, "package.json"), (1, "cmd/a/main.go"), (1, "README.md")], "wiki_id int, path string")
    files = paths.union(entries).withColumn("pos", F.xxhash64("path"))
    out = ol.normalised(pages, files, "wiki_id")
    return out.select(F.col("id").alias("page_id"), F.array_join("file_paths", "|").alias("file_paths"), F.coalesce(F.size("diagrams"), F.lit(-1)).alias("n_diagrams"))


def affected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that list a changed file; the files of large parts have changed."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    pages = li.groupBy(F.col("l_orderkey").alias("wiki_id"), F.col("l_suppkey").alias("page_id")).agg(F.collect_set("l_partkey").alias("parts"))
    changed = part.where("p_size >= 49").select(F.col("p_partkey").alias("part_id"))
    return overlapping(pages, "parts", ["wiki_id", "page_id"], changed, "part_id").select("wiki_id", "page_id", F.size("parts").cast("long").alias("n_files"))


def resume_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages left to do of wikis that are not finished."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    status = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "R", "pending").otherwise("completed")
    todo = to_resume(li.select(F.col("l_orderkey").alias("wiki_id"), F.col("l_linenumber").alias("sort_order"), F.col("l_returnflag").alias("flag"), status.alias("status"))).drop("status")
    return todo.join(o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("wiki_id")), "wiki_id", "left_semi")


def rescanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a new scan that a change set names; some of it is gone."""
    f = files(spark, sf_dir)
    changed = f.where("part_id % 7 = 0").select(F.when(F.col("part_id") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit(".gone"))).alias("file_path"))
    return rescanned(f.select("part_id", F.col("path").alias("file_path")), changed).select("part_id", "file_path")


def outline_to_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that each order's outline lists, with those that are stored: the ones that were returned never were."""
    li = table(spark, sf_dir, "lineitem")
    listed = li.select(F.col("l_orderkey").alias("wiki_id"), F.col("l_linenumber").alias("page_id")).distinct()
    stored = li.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("wiki_id"), F.col("l_linenumber").alias("page_id")).agg(F.max("l_partkey").alias("id"))
    return stored_pages(listed, stored, ["wiki_id", "page_id"])


def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the title of their section, its id where the outline lacks it, none where they have none."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("s"), (F.col("c_nationkey") + F.col("c_custkey") % 3 * 10).cast("string"))).alias("parent_id"))
    sections = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"))
    return ol.with_section_titles(c, sections).select("c_custkey", "section")


def root_readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The README at the root of each customer's repository, from files in the order of a scan."""
    names = F.array(*map(F.lit, ["README.md", "docs/README.md", "ReadMe", "src/a.ts", "readme.MD", "README.txt"]))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("pos"), F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("path"))
    return ol.root_readme(o, "repo_id")


QUERIES = {f.__name__: f for f in (rescanned_files, outline_to_stored, section_titles, root_readmes, outline_pages_flat, page_slugs, resolved_slugs, outline_validate, outline_summary, outline_normalize, affected_pages, resume_pages)}

_SLUG = "(section_pos + 1) || '.' || (page_pos + 1) || '-' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g')"
SQL = {
    "rescanned_files": f"WITH {FILES_SQL}, c AS (SELECT CASE WHEN part_id % 2 = 0 THEN path ELSE path || '.gone' END AS p FROM files WHERE part_id % 7 = 0) SELECT part_id, path AS file_path FROM files WHERE path IN (SELECT p FROM c)",
    "outline_to_stored": "SELECT l_orderkey AS wiki_id, l_linenumber AS page_id, max(l_partkey) FILTER (l_returnflag <> 'R') AS id FROM lineitem GROUP BY ALL HAVING id IS NOT NULL",
    "section_titles": "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN coalesce(n_name, 's' || (c_nationkey + c_custkey % 3 * 10)) END AS section FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + c_custkey % 3 * 10",
    "root_readmes": "WITH f AS (SELECT o_custkey AS repo_id, o_orderkey AS pos, (['README.md', 'docs/README.md', 'ReadMe', 'src/a.ts', 'readme.MD', 'README.txt'])[o_orderkey % 6 + 1] AS path FROM orders) SELECT repo_id, arg_min(path, pos) AS path FROM f WHERE regexp_full_match(path, '(?i)readme(.md)?') AND NOT contains(path, 'txt') GROUP BY ALL",
    "outline_pages_flat": f"WITH {_PAGES} SELECT 1 AS wiki_id, section_pos, section_id, page_pos::INTEGER AS page_pos, sort_order::INTEGER AS sort_order, page_id, title, len(paths)::INTEGER AS n_paths FROM np",
    "page_slugs": f"WITH {_PAGES} SELECT page_id, {_SLUG} AS slug FROM np",
    "resolved_slugs": f"WITH {_PAGES} SELECT upper({_SLUG}) AS slug, page_id FROM np UNION ALL SELECT '%20' || regexp_replace(page_id, '[^a-z0-9]+', '-', 'g'), page_id FROM np UNION ALL SELECT 'no-' || {_SLUG}, NULL FROM np",
    "outline_validate": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN 'Outline missing title' WHEN n_nationkey % 7 = 6 THEN 'Outline missing sections array' WHEN n_nationkey % 5 = 2 THEN 'Invalid section' WHEN n_nationkey % 5 = 3 THEN 'Section s missing pages array' WHEN n_nationkey % 5 = 1 THEN 'Invalid page in section s' ELSE 'none' END AS problem FROM nation",
    "outline_summary": f"WITH {_PAGES} SELECT 1 AS wiki_id, (SELECT string_agg(s, chr(10) ORDER BY section_pos) FROM (SELECT section_pos, '- **' || any_value(section_title) || '**' || chr(10) || string_agg('  - ' || title || ': ' || description, chr(10) ORDER BY page_pos) AS s FROM np GROUP BY section_pos)) AS summary, count(*) AS n_pages FROM np",
    "outline_normalize": f"""WITH {_PAGES}, k AS (SELECT *, list_filter(paths, lambda x: NOT contains(x, '_5')) AS p FROM np),
        c AS (SELECT *, len(list_filter(p, lambda x: x LIKE '%.ts')) AS code FROM k),
        e AS (SELECT *, CASE WHEN section_pos = 0 AND code < 2 THEN list_concat(p, ['package.json', 'src/index.ts'][1:2 - code]) ELSE p END AS q FROM c),
        d AS (SELECT *, list_filter(q, lambda x: x LIKE '%.md') AS docs, len(list_filter(q, lambda x: NOT x LIKE '%.md')) AS rest FROM e),
        f AS (SELECT *, CASE WHEN section_pos = 0 AND len(docs) > 0.5 * len(q) THEN list_filter(q, lambda x: NOT x LIKE '%.md' OR list_contains(docs[1:least(len(docs), rest)], x)) ELSE q END AS r FROM d)
        SELECT page_id, array_to_string(r, '|') AS file_paths, (CASE WHEN NOT has_diagrams THEN -1 WHEN len(r) <= 2 THEN 0 ELSE 2 END)::INTEGER AS n_diagrams FROM f""",
    "affected_pages": "SELECT l_orderkey AS wiki_id, l_suppkey AS page_id, count(DISTINCT l_partkey) AS n_files FROM lineitem GROUP BY ALL HAVING bool_or(l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 49))",
    "resume_pages": "SELECT l_orderkey AS wiki_id, l_linenumber AS sort_order, l_returnflag AS flag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')",
}
