"""Outlines: nested sections and pages as rows, validation, slugs, summaries, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.markdown import headings_column
from ..functions.paths import is_doc, is_readme
from ..functions.text import heading_id, heading_text

# Likely entry points in order, exact paths first, then patterns; limits of a page.
ENTRY_PATHS = [
    "package.json", "src/index.ts", "src/index.tsx", "src/index.js", "src/index.mjs", "src/index.svelte", "src/main.ts", "src/main.js", "src/main.py", "src/main.go", "src/main.rs", "src/app.ts", "src/app.js", "src/app.svelte", "src/server.ts", "src/server.js", "index.ts", "index.js", "index.py", "index.go", "index.rs", "index.mjs",
    "main.ts", "main.js", "main.py", "main.go", "main.rs", "server.ts", "server.js", "server.py", "app.py", "app.rb",
]
ENTRY_PATTERNS = [r"\Acmd/[^/]+/main\.go\z", r"\Asrc/routes/(?:.+/)?\+page\.svelte\z", r"\Asrc/routes/(?:.+/)?\+layout\.svelte\z"]
MAX_PATHS, MIN_CODE, MAX_DOC_SHARE, FEW_PATHS, MAX_DIAGRAMS, INJECTED = 25, 2, 0.5, 2, 2, 2


def flat_pages(outlines: DataFrame, key: str, outline: str = "outline") -> DataFrame:
    """key, section_pos, page_pos, sort_order and the fields of every page; positions from 0."""
    sections = outlines.select(key, F.posexplode(f"{outline}.sections").alias("section_pos", "s"))
    pages = sections.select(key, "section_pos", F.col("s.id").alias("section_id"), F.col("s.title").alias("section_title"), F.posexplode("s.pages").alias("page_pos", "p"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("section_pos", "page_pos")) - 1
    return pages.select(key, "section_pos", "section_id", "section_title", "page_pos", order.alias("sort_order"), "p.*")


def slug_entry(section_pos: Column, page_pos: Column, slug: Column) -> Column:
    return F.concat((section_pos + 1).cast("string"), F.lit("."), (page_pos + 1).cast("string"), F.lit("-"), slug)


def plain_slug(title: Column) -> Column:
    """The slug of an ASCII title; titles with other characters take markdown.slug_column()."""
    s = F.regexp_replace(F.replace(F.lower(title), F.lit("&"), F.lit(" and ")), "['’]", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("page"))


def resolve_slug(entries: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """asked(key, slug) with the page_id of that slug, else of the page whose id has that slug; null if none has."""
    want = asked.withColumn("_slug", F.lower(F.trim(F.url_decode(F.replace("slug", F.lit("+"), F.lit("%2B"))))))
    named = entries.select(key, F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("slug").alias("s")), F.struct(F.lit(1).alias("rank"), plain_slug(F.col("page_id")).alias("s")))).alias("c"), "page_id", "sort_order")
    hit = want.join(named.select(key, F.col("c.s").alias("_slug"), "c.rank", "page_id", "sort_order"), [key, "_slug"], "left")
    return hit.groupBy(key, "slug").agg(F.min_by("page_id", F.struct("rank", "sort_order")).alias("page_id"))


def problem(outline: Column) -> Column:
    """What is wrong with an outline; null if nothing is."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    first = lambda found: F.try_element_at(found, F.lit(1))
    bad_section = lambda s: empty(s["id"]) | empty(s["title"])
    bad_page = lambda p: empty(p["id"]) | empty(p["title"])
    # the sections are judged in order, so the first that is wrong in any way names the problem
    said = F.transform(
        outline["sections"],
        lambda s: F.when(bad_section(s), F.concat(F.lit("Invalid section: "), F.to_json(s)))
        .when(s["pages"].isNull(), F.concat(F.lit("Section "), s["id"], F.lit(" missing pages array")))
        .when(F.exists(s["pages"], bad_page), F.concat(F.lit("Invalid page in section "), s["id"], F.lit(": "), F.to_json(first(F.filter(s["pages"], bad_page))))),
    )
    return F.when(empty(outline["title"]), "Outline missing title").when(outline["sections"].isNull(), "Outline missing sections array").otherwise(first(F.filter(said, lambda x: x.isNotNull())))


def page_total(outline: Column) -> Column:
    return F.aggregate(outline["sections"], F.lit(0), lambda a, s: a + F.size(s["pages"]))


def summary(outline: Column) -> Column:
    """A bullet for each section, with its pages indented below."""
    known = lambda c: F.coalesce(c, F.lit("undefined"))
    page = lambda p: F.concat(F.lit("  - "), known(p["title"]), F.lit(": "), known(p["description"]))
    return F.array_join(F.transform(outline["sections"], lambda s: F.concat(F.lit("- **"), known(s["title"]), F.lit("**\n"), F.array_join(F.transform(s["pages"], page), "\n"))), "\n")


def entry_points(files: DataFrame, key: str) -> DataFrame:
    """key, entries, has_code: likely entry points of each repository in order; none where all files are documents."""
    path = F.col("path")
    rank = None
    for i, p in enumerate(ENTRY_PATHS):
        rank = F.when(path == p, i) if rank is None else rank.when(path == p, i)
    for i, p in enumerate(ENTRY_PATTERNS):
        rank = rank.when(path.rlike(p), len(ENTRY_PATHS) + i)
    ranked = files.select(key, "pos", "path", rank.alias("rank"), (~is_doc(path)).alias("code"))
    out = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "pos", "path")))).alias("e"), F.max("code").alias("has_code"))
    return out.select(key, F.when(F.col("has_code"), F.array_distinct(F.transform("e", lambda x: x["path"]))).otherwise(F.array().cast("array<string>")).alias("entries"), "has_code")


def normalised(pages: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Pages (key, section_pos, section_id, section_title, page_pos, filePaths, diagrams) with file_paths and diagrams
    put right: known files once each, MAX_PATHS at most; on overview pages entry points added and documents held to half;
    diagrams none on pages of few files, else two. A null list of diagrams stays null."""
    ids = [key, "section_pos", "page_pos"]
    one = pages.select(*ids, F.posexplode("filePaths").alias("pos", "path")).join(files.select(key, "path").distinct(), [key, "path"], "left_semi")
    known = one.groupBy(*ids).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"])).alias("_known"))
    out = pages.join(known, ids, "left").join(entry_points(files, key), key, "left")
    out = out.withColumn("_p", F.slice(F.coalesce("_known", F.array().cast("array<string>")), 1, MAX_PATHS))
    overview = (F.col("section_id") == "overview") | (F.lower(F.trim("section_title")) == "overview") | (F.col("section_pos") == 0)
    fix = F.coalesce(overview & F.col("has_code"), F.lit(False))
    code = F.size(F.filter("_p", lambda x: ~is_doc(x)))
    # entry points are never documents, so each one added is one code file more
    room = F.greatest(F.least(F.lit(MIN_CODE) - code, F.lit(INJECTED), F.lit(MAX_PATHS) - F.size("_p")), F.lit(0))
    out = out.withColumn("_p", F.when(fix, F.concat("_p", F.slice(F.array_except("entries", "_p"), F.lit(1), room))).otherwise(F.col("_p")))
    docs, rest = F.filter("_p", is_doc), F.size(F.filter("_p", lambda x: ~is_doc(x)))
    sorted_docs = F.concat(F.filter(docs, is_readme), F.filter(docs, lambda x: ~is_readme(x)))
    kept = F.slice(sorted_docs, F.lit(1), F.least(F.size(docs), rest))
    out = out.withColumn("_kept", F.when(fix & (F.size(docs) > F.lit(MAX_DOC_SHARE) * F.size("_p")), kept))
    out = out.withColumn("file_paths", F.when(F.col("_kept").isNull(), F.col("_p")).otherwise(F.filter("_p", lambda x: ~is_doc(x) | F.array_contains("_kept", x))))
    few = F.size("file_paths") <= FEW_PATHS
    right = F.when(F.col("diagrams").isNull(), F.col("diagrams")).when(few, F.array().cast("array<string>")).otherwise(F.slice("diagrams", 1, MAX_DIAGRAMS))
    return out.select(*[c for c in pages.columns if c not in ("filePaths", "diagrams")], "file_paths", right.alias("diagrams"))


def tree_lines(files: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """key, place, line: the rendered tree of each key, folders before files, each in the order of a dictionary, two spaces a level."""
    parts = F.split("path", "/")
    prefixes = files.select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.slice(parts, F.lit(1), n).alias("p"), (n == F.size(parts)).alias("file")))).alias("x"))
    nodes = prefixes.groupBy(*key, F.col("x.p").alias("p")).agg(F.min("x.file").alias("file"))
    depth = F.size("p")
    place = F.transform("p", lambda name, i: F.struct(((i == depth - 1) & F.col("file")).alias("f"), F.collate(name, "UNICODE").alias("c"), name.alias("n")))
    line = F.concat(F.repeat(F.lit("  "), depth - 1), F.element_at("p", -1), F.when(F.col("file"), "").otherwise("/"))
    return nodes.select(*key, place.alias("place"), line.alias("line"))


def toc(pages: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, pos, level, id, plain: headings of the second and third level outside fenced blocks. The nth repeat of an id
    on a page, among headings of all levels, gets -n."""
    found = pages.select(key, F.explode(headings_column(F.col(content))).alias("h")).select(key, "h.*")
    based = found.withColumn("base", heading_id(F.col("heading")))
    nth = F.row_number().over(Window.partitionBy(key, "base").orderBy("pos")) - 1
    own = F.when(nth > 0, F.concat("base", F.lit("-"), nth.cast("string"))).otherwise(F.col("base"))
    return based.withColumn("id", own).where(F.col("level").isin(2, 3)).select(key, F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), "id", heading_text(F.col("heading")).alias("plain"))


def with_section_titles(pages: DataFrame, sections: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Pages with the title of their section (parent_id): the id itself where no section has it, null for none."""
    titles = sections.select(*key, F.col("id").alias("parent_id"), F.col("title").alias("_title"))
    return pages.join(titles, [*key, "parent_id"], "left").withColumn("section", F.coalesce("_title", "parent_id")).drop("_title")


def root_readme(files: DataFrame, key: str) -> DataFrame:
    """key, path: the first file by `pos` that is a README at the root, whatever the case."""
    return files.where(F.lower("path").isin("readme.md", "readme")).groupBy(key).agg(F.min_by("path", "pos").alias("path"))
