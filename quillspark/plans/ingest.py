"""Queries over a scanned tree: filters, languages, hashes, duplicates, change sets, the rendered tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LANGUAGES, MAX_FILE_BYTES, PRIORITY_DIRS, SKIP_DIRS, SKIP_EXTENSIONS, SKIP_FILES, extension, is_doc, is_readme, language, priority, scannable
from ..functions.text import content_hash, is_generated, is_minified
from ..operators.outline import tree_lines
from ..sources.tables import table

#: Folders, names and extensions of the files that stand for a tree, chosen by the part's number.
DIRS = ["src", "lib/core", "docs", "node_modules/x", "app/build", "tests", "cmd/run", "pkg/tmp/a"]
NAMES = ["index", "main", "readme", "part", ".hidden", "package-lock", "handler"]
EXTENSIONS = [".ts", ".py", ".md", ".png", ".min.js", ".json", ".go", ".lock", ".txt", "", ".JS"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and size of a tree of one file a part."""
    p = F.col("p_partkey")
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (p % len(items) + 1).cast("int"))
    path = F.concat(pick(DIRS), F.lit("/"), (p % 13).cast("string"), F.lit("/"), pick(NAMES), F.when(p % 3 == 0, F.lit("")).otherwise(p.cast("string")), pick(EXTENSIONS))
    return table(spark, sf_dir, "part").select(p.alias("part_id"), path.alias("path"), (F.col("p_size") * 40_000 - 40_000).cast("long").alias("size"))


def _literal(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


FILES_SQL = f"""files AS (SELECT p_partkey AS part_id, ({_literal(DIRS)})[p_partkey % {len(DIRS)} + 1] || '/' || (p_partkey % 13)::VARCHAR || '/' || ({_literal(NAMES)})[p_partkey % {len(NAMES)} + 1]
    || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_partkey::VARCHAR END || ({_literal(EXTENSIONS)})[p_partkey % {len(EXTENSIONS)} + 1] AS path, CAST(p_size * 40000 - 40000 AS BIGINT) AS size FROM part),
shaped AS (SELECT *, string_split(path, '/') AS parts, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1)) AS ext FROM files),
scanned AS (SELECT * FROM shaped WHERE NOT list_has_any(parts[1:len(parts) - 1], {_literal(SKIP_DIRS)}) AND NOT list_contains({_literal(SKIP_FILES)}, base) AND NOT list_contains({_literal(SKIP_EXTENSIONS)}, ext) AND size BETWEEN 1 AND {MAX_FILE_BYTES})"""
_LANGUAGE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LANGUAGES.items()) + "}"


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(scannable(F.col("path"), F.col("size")))


def ingest_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).select("part_id", "path", "size", extension(F.col("path")).alias("ext"), language(F.col("path")).alias("language"), is_doc(F.col("path")).alias("is_doc"), is_readme(F.col("path")).alias("is_readme"))


def priority_scan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred files of the scan's order, source folders first."""
    ordered = scanned(spark, sf_dir).orderBy(F.desc(priority(F.col("path"))), F.collate("path", "UNICODE"), "part_id").limit(100)
    return ordered.select("part_id", "path", priority(F.col("path")).alias("is_priority"))


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with their files and the first file that has them."""
    own = scanned(spark, sf_dir).select("part_id", language(F.col("path")).alias("language")).where("language IS NOT NULL")
    return own.groupBy("language").agg(F.count("*").alias("n"), F.min("part_id").alias("first_seen"))


def path_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder and file of the tree with its depth and the files below."""
    parts = F.split("path", "/")
    every = scanned(spark, sf_dir).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix"), n.alias("depth"), (n < F.size(parts)).alias("folder")))).alias("x"))
    return every.select("x.*").groupBy("prefix", "depth", "folder").agg(F.count("*").alias("n_files"))


def rendered_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the rendered tree, in order."""
    return tree_lines(scanned(spark, sf_dir)).orderBy("place").select("line")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("text").alias("content"))


_DOCS = "docs AS (SELECT doc_id, source, lang, 'src/' || source || '/' || doc_id || '.md' AS file_path, text AS content FROM documents)"


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).select("doc_id", "file_path", "content_hash")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).withColumn("content_hash", content_hash(F.col("content"))).drop("content")


def _older_hash():
    """Hashes of an older state, in which German documents were others."""
    return F.when(F.col("lang") == "de", F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))


def new_or_changed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose path and hash an index lacks: it is older, and one source is new since."""
    now = _indexed(spark, sf_dir)
    old = now.where("source <> 'src3'").select("file_path", _older_hash().alias("content_hash"))
    return now.join(old, ["file_path", "content_hash"], "left_anti").select("doc_id", "file_path", "content_hash")


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change set between two snapshots, of which each has a source that the other lacks: paths added, deleted or modified."""
    now = _indexed(spark, sf_dir)
    old = now.where("source <> 'src3'").select("file_path", _older_hash().alias("old_hash"))
    new = now.where("source <> 'src4'").select("file_path", "content_hash")
    both = old.join(new, "file_path", "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("content_hash")))
    return both.select("file_path", F.when(F.col("old_hash").isNull(), "added").when(F.col("content_hash").isNull(), "deleted").otherwise("modified").alias("change"))


def exact_duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = document_index(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return by.where("n > 1")


def minified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(is_minified(F.col("content"))).select("doc_id", F.length("content").cast("long").alias("n_chars"), F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


def generated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _documents(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("// Code generated by a tool; do not edit\n"), "content")).otherwise(F.col("content")))
    return marked.where(is_generated(F.col("content"))).select("doc_id", content_hash(F.col("content")).alias("content_hash"))


QUERIES = {
    "ingest_filter_chain": ingest_filter_chain,
    "priority_scan_topk": priority_scan_topk,
    "language_counts": language_counts,
    "path_prefix_tree": path_prefix_tree,
    "rendered_tree": rendered_tree,
    "document_index": document_index,
    "new_or_changed_docs": new_or_changed_docs,
    "changed_files": changed_files,
    "exact_duplicate_hashes": exact_duplicate_hashes,
    "minified_documents": minified_documents,
    "generated_documents": generated_documents,
}

_MARKS = "CODE GENERATED|DO NOT EDIT|GENERATED FILE|THIS FILE IS AUTOGENERATED|THIS FILE WAS GENERATED|AUTO-GENERATED|AUTO GENERATED|AUTOMATICALLY GENERATED|GENERATED BY|@GENERATED|DO NOT MODIFY"
SQL = {
    "ingest_filter_chain": f"WITH {FILES_SQL} SELECT part_id, path, size, ext, ({_LANGUAGE})[ext] AS language, regexp_matches(path, '(?i)\\.(md|mdx|markdown|rst|txt)$') AS is_doc, regexp_matches(base, '(?i)^readme(\\.\\w+)?$') AS is_readme FROM scanned",
    "priority_scan_topk": f"WITH {FILES_SQL} SELECT part_id, path, list_contains({_literal(PRIORITY_DIRS)}, parts[1]) AS is_priority FROM scanned ORDER BY is_priority DESC, lower(path), path DESC, part_id LIMIT 100",
    "language_counts": f"WITH {FILES_SQL} SELECT ({_LANGUAGE})[ext] AS language, count(*) AS n, min(part_id) AS first_seen FROM scanned WHERE ({_LANGUAGE})[ext] IS NOT NULL GROUP BY ALL",
    "path_prefix_tree": f"WITH {FILES_SQL} SELECT array_to_string(parts[1:d], '/') AS prefix, d::INTEGER AS depth, d < len(parts) AS folder, count(*) AS n_files FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS d FROM scanned) GROUP BY ALL",
    "rendered_tree": f"WITH {FILES_SQL}, n AS (SELECT parts[1:d] AS p, bool_and(d = len(parts)) AS file FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS d FROM scanned) GROUP BY ALL) SELECT repeat('  ', len(p) - 1) || p[len(p)] || CASE WHEN file THEN '' ELSE '/' END AS line FROM n",
    "document_index": f"WITH {_DOCS} SELECT doc_id, file_path, sha256(content) AS content_hash FROM docs",
    "new_or_changed_docs": f"WITH {_DOCS} SELECT doc_id, file_path, sha256(content) AS content_hash FROM docs WHERE lang = 'de' OR source = 'src3'",
    "changed_files": f"WITH {_DOCS} SELECT file_path, CASE source WHEN 'src3' THEN 'added' WHEN 'src4' THEN 'deleted' ELSE 'modified' END AS change FROM docs WHERE source IN ('src3', 'src4') OR lang = 'de'",
    "exact_duplicate_hashes": f"WITH {_DOCS} SELECT sha256(content) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM docs GROUP BY ALL HAVING n > 1",
    "minified_documents": f"WITH {_DOCS} SELECT doc_id, length(content) AS n_chars, len(string_split(content, chr(10))) AS n_lines FROM docs WHERE length(content) / len(string_split(content, chr(10))) > 500",
    "generated_documents": f"WITH {_DOCS}, m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '// Code generated by a tool; do not edit' || chr(10) || content ELSE content END AS content FROM docs) SELECT doc_id, sha256(content) AS content_hash FROM m WHERE regexp_matches(upper(left(content, 1000)), '{_MARKS}')",
}
