"""Queries of the text functions: addresses, names, headings, links, diagrams, embedded JSON, times, costs, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import paths, prompts, text, values
from ..operators.generation import outline_prompts as outlines_asked
from ..operators.links import relink_stored, shown
from ..operators.outline import toc
from ..operators.relational import longest_suffix
from ..sources.tables import table
from .ingest import FILES_SQL, files


#: Addresses of a repository (owner @o, name @n) as people write them, right and wrong; what a name can't have is in @n too.
ADDRESSES = [
    "  https://github.com/@o/@n.git ", "https://github.com/@o/@n/tree/main", "@o/@n/", "@o/@n", "@n", "./local/@n", "git@github.com/@o/@n", "http://www.github.com/@o/@n?tab=readme", "github.com/@o/@n.git/", "@o/@n.git", "https://example.org/@o/@n", "/srv/@o/@n", "~/@n", "../@o", "@o/@n/x", "https://github.com/@o", " @o/@n\t", "",
]


def parse_repo_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of many forms, made from customers: whole, short, with .git, with what a name can't have."""
    k, n = F.col("c_custkey"), len(ADDRESSES)
    form = F.element_at(F.array(*map(F.lit, ADDRESSES)), (k % n + 1).cast("int"))
    name = F.when(k % 5 == 0, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#", "-"))
    address = F.replace(F.replace(form, F.lit("@o"), F.concat(F.lit("own"), F.when(k % 3 == 0, "-er").when(k % 11 == 1, " er").otherwise("."))), F.lit("@n"), name)
    r = paths.repo_address(F.col("address"))
    return table(spark, sf_dir, "customer").select("c_custkey", address.alias("address")).select("c_custkey", r["owner"].alias("owner"), r["name"].alias("name"), r["url"].alias("url"), paths.is_local(F.col("address")).alias("is_local"))


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and commit ids: those of customers, and hashes of them, whole or cut."""
    sha = F.when(F.col("c_custkey") % 2 == 0, F.sha1("c_name")).otherwise(F.concat(F.sha1("c_name"), F.lit("\n")))
    return table(spark, sf_dir, "customer").select("c_custkey", paths.valid_name(F.col("c_name")).alias("name_ok"), paths.valid_name(F.col("c_mktsegment")).alias("segment_ok"), paths.valid_sha(sha).alias("sha_ok"))


def format_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, F.lit(" ")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.display_name(owner, F.col("c_name")).alias("shown"), text.display_name(owner, F.col("c_name"), False).alias("bare"), text.display_full_name(F.concat_ws("/", owner, F.col("c_name")), False).alias("tail"))


def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", paths.page_path(F.col("c_mktsegment"), F.concat(F.col("c_name"), F.lit(" (x)~é+")), F.when(F.col("c_custkey") % 2 == 0, F.lit("1.2-a b")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey"))).alias("path"))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with headings, made of a document's first words."""
    w = F.filter(F.split("text", r"[ \n]+"), lambda x: x != "")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("x"))
    title = F.concat_ws(" ", at(0), at(1))
    content = F.concat(
        F.lit("#  "), F.replace(title, F.lit(" "), F.lit("  ")), F.lit(" \n\nIntro\n## Source of *Truth*\n\n## "), at(0), F.lit(" & <b>"), at(1), F.lit("</b>\ntext\n### `"), at(2), F.lit("`\n```\n## not a heading\n```\n## "), at(0), F.lit(" & "), at(1), F.lit("\n#### deep\n## Trust hierarchy\nlast"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), content.alias("content"))


_TITLED = """w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, coalesce(ws[1], 'x') AS a, coalesce(ws[2], 'x') AS b, coalesce(ws[3], 'x') AS c FROM w)"""


def title_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the heading that repeats their title, and pages whose title is another, as they were."""
    p = _titled(spark, sf_dir)
    out = text.without_title(F.col("content"), F.col("title"))
    return p.select("doc_id", F.sha2(out, 256).alias("content_hash"), F.length(text.without_title(F.col("content"), F.lit("Other"))).cast("long").alias("n_other"))


def leaky_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without headings of policy wording and with code headings unwrapped."""
    return _titled(spark, sf_dir).select("doc_id", F.sha2(md.without_policy_headings_column(F.col("content")), 256).alias("content_hash"))


def toc_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and third level headings outside fences, with ids made distinct within a page."""
    return toc(_titled(spark, sf_dir), "doc_id")


def app_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of events, from texts with and without a zone, and from what isn't a time."""
    e = table(spark, sf_dir, "events")
    text_ = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("+02:00"))).otherwise(F.col("event_type"))
    return e.select("event_id", values.app_date(text_).alias("day"))


def source_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "local").when(F.col("o_orderstatus") == "O", "github")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.source_badge(kind).alias("b")).select("o_orderkey", "b.*")


def link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links of pages, led to the longest suffix that is a file of the repository."""
    f = files(spark, sf_dir)
    links = f.select("part_id", F.concat(F.lit("/home/work/repo/"), F.when(F.col("part_id") % 4 == 0, F.lit("gone/x.ts")).otherwise(F.col("path"))).alias("href"))
    out = longest_suffix(links, f.select("path"), ["part_id"], "href", "target")
    url = F.concat(F.lit("https://github.com/o/r/blob/main/"), "target")
    return out.select("part_id", F.coalesce(F.concat(F.lit("[x]("), url, F.lit(")")), F.concat(F.lit("[x]("), "href", F.lit(")"))).alias("link"))


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of many repositories (a customer each, a page an order's line) of a file of their own and another."""
    f = files(spark, sf_dir).select("part_id", "path")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")  # groups and orders meet without a further move
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    li = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("repo_id")), "l_orderkey")
    both = li.join(f.select(F.col("part_id").alias("l_partkey"), F.col("path").alias("own")), "l_partkey").join(f.select(F.col("part_id").alias("l_suppkey"), F.col("path").alias("other")), "l_suppkey")
    return both.select(F.col("l_orderkey").alias("wiki_id"), F.col("l_linenumber").alias("page_no"), "repo_id", "own", "other")


def _linked_content() -> Column:
    """Links to files, images and other addresses; some files are the repository's, some those of others."""
    a, b, n = F.col("own"), F.col("other"), F.col("page_no")
    content = F.concat(
        F.lit("See ["), a, F.lit("](/home/app/"), a, F.lit("), ![plan]("), F.when(n % 3 == 0, "/").otherwise("/x/y/"), b, F.lit(") and [gone](/etc/"), a, F.lit(".old) [n]"), F.when(n % 2 == 0, F.concat(F.lit("(/"), _tail(a), F.lit(")"))).otherwise(""),
        F.lit(" [cdn](//host/"), a, F.lit(") [rel](./"), a, F.lit(")"), F.when(n % 4 == 0, F.concat(F.lit("[again](/"), a, F.lit(")"))).otherwise(""),
    )
    return F.when(n % 7 < 6, content)


def _tail(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with the links to files of their repositories put right."""
    pages, c, n = _linked_pages(spark, sf_dir), F.col("c_custkey"), F.col("page_no")
    named = F.array_compact(F.array(F.when(n % 2 == 1, F.col("own")), F.when(n % 5 == 0, _tail(F.col("own")))))
    known = pages.where("page_no % 2 = 1 OR page_no % 5 = 0").select("repo_id", F.explode(named).alias("path"))
    url = F.when(c % 5 == 0, F.concat(F.lit("https://github.com/o"), c.cast("string"), F.lit("/r"))).when(c % 5 == 1, F.lit("http://github.com/o/r.git/")).when(c % 5 == 2, F.lit("local:///tmp/r")).when(c % 5 == 3, F.lit(" https://github.com/o/r/ "))
    repos = table(spark, sf_dir, "customer").select(c.alias("repo_id"), url.alias("url"), F.when(c % 3 == 0, "dev").when(c % 3 == 1, "").alias("default_branch"))
    out = relink_stored(pages, known, repos, "repo_id", ["wiki_id", "page_no"], _linked_content())
    return out.select("wiki_id", "page_no", F.sha2("content", 256).alias("content_hash"))


def shown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a reader sees them, with the links to the files that they name themselves."""
    pages = _linked_pages(spark, sf_dir).withColumn("file_paths", F.when(F.col("page_no") % 3 > 0, F.array("own", _tail(F.col("own")))))
    base = F.when(F.col("repo_id") % 2 == 0, F.concat(F.lit("https://github.com/o/"), F.col("repo_id").cast("string"), F.lit("/blob/main/")))
    return shown(pages.withColumn("content", _linked_content()), base).select("wiki_id", "page_no", F.sha2("content", 256).alias("content_hash"))


def _diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four diagrams: two alike, one invalid for some, one quoted in a longer fence."""
    d = F.col("doc_id")
    first = F.concat(F.lit('```mermaid\ngraph TD\n  A["Start"] --> B'), (d % 10).cast("string"), F.lit("\n```\n"))
    again = F.concat(F.lit('``` mermaid\nGRAPH td\n%% note\n   A[ "start" ]   --> b'), (d % 10).cast("string"), F.lit("\n```\n"))
    quoted = F.lit("````md\n```mermaid\npie\n```\n````\n")
    third = F.concat(F.lit("~~~mermaid\n"), F.when(d % 3 == 0, F.lit("nothing")).otherwise(F.lit("sequenceDiagram")), F.lit("\nA->>B: hi\n~~~\n"))
    last = F.lit("```mermaid\npie title x\n```\nend")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Intro\n"), first, again, quoted, third, last).alias("content"))


def diagram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagrams of all pages, and how many are valid."""
    codes = F.transform(md.fences_column(F.col("content")), lambda x: x["code"])
    own = _diagrams(spark, sf_dir).select(codes.alias("c"))
    return own.agg(F.sum(F.size("c")).alias("total"), F.sum(F.size(F.filter("c", text.is_diagram))).alias("valid"))


def diagram_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two distinct diagrams at most."""
    out = _diagrams(spark, sf_dir).select("doc_id", md.limit_diagrams_column(F.col("content")).alias("r"))
    return out.select("doc_id", F.sha2("r.content", 256).alias("content_hash"), F.size("r.diagrams").cast("long").alias("n_diagrams"))


def tidy_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_name")
    code = F.concat(F.lit("A->>>>B\nx"), F.col("n_nationkey").cast("string"), F.lit('{ "'), n, F.lit('" }\nq( "'), n, F.lit('" ]\ny['), n, F.lit(": (z)]\nz["), n, F.lit("]"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.tidy_diagram(code).alias("code"))


def json_extract_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that a model wrapped in prose and fences."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Sure:\n```json\n{\"conv\": "), F.col("conv_id").cast("string"), F.lit(", \"role\": \""), "role", F.lit("\"}\n```\nDone.")).alias("said"))
    body = text.embedded_json(F.col("said"))
    return c.select("conv_id", "turn", F.get_json_object(body, "$.role").alias("role"), F.length(body).cast("long").alias("n_chars"))


def final_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message of each conversation that isn't blank, parsed where it is JSON."""
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("} "))).otherwise(F.lit("  "))
    one = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]).alias("m"))
    return one.select("conv_id", F.try_variant_get(text.parsed_message(F.col("m")), "$.turn", "bigint").alias("turn"), text.final_message(F.col("m")).alias("message"))


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of calls by model: reported where it was, else computed."""
    li = table(spark, sf_dir, "lineitem")
    model = F.element_at(F.array(*map(F.lit, [*values.PRICES, "unknown"])), (F.col("l_linenumber") % 5 + 1).cast("int"))
    prompt, done = (F.col("l_quantity") * 1000).cast("long"), F.col("l_extendedprice").cast("long")
    cached = (F.col("l_discount") * 200_000).cast("long")
    call = li.select(model.alias("model"), prompt.alias("p"), done.alias("c"), cached.alias("k"), F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("reported"))
    own = F.coalesce("reported", values.cost(F.col("model"), F.col("p"), F.col("c"), F.col("k")))
    return call.groupBy("model").agg(F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.round(F.sum(own), 2).alias("cost"))


def settings_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as they take effect."""
    c = table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).when(F.col("c_custkey") % 4 == 1, F.lit("many")).otherwise((F.col("c_custkey") % 9).cast("string"))
    shown = F.when(F.col("c_custkey") % 3 == 0, F.lit(" FALSE ")).when(F.col("c_custkey") % 3 == 1, F.lit("no")).otherwise(F.lit(None))
    k, models = F.col("c_custkey"), list(values.PRICES)
    model = F.when(k % 7 < len(models), F.element_at(F.array(*map(F.lit, models)), (k % 7 % len(models) + 1).cast("int"))).when(k % 7 == 5, F.col("c_mktsegment")).otherwise(F.concat(F.lit(models[0]), F.lit(" ")))
    return c.select("c_custkey", values.parallel_limit(raw).cast("long").alias("pages_at_once"), values.flag(shown, True).alias("show_owner"), values.resolved_model(model).alias("model"))


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age, length and volume of events in the words of the pages."""
    e = table(spark, sf_dir, "events")
    now = F.unix_millis(F.lit("2024-02-01 00:00:00").cast("timestamp"))
    then = values.app_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    ms = (F.col("event_id") * 977 % 400_000).cast("long")
    n = (F.col("event_id") * F.col("event_id") * 13 % 3_000_000).cast("long")
    return e.select("event_id", values.relative_time(then, now).alias("age"), values.duration_floor(ms).alias("d_floor"), values.duration_rounded(ms).alias("d_round"), values.duration_short(ms).alias("d_short"), values.token_text(n).alias("tokens"))


def progress_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of jobs by pages done, in the three phases."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("d"))
    return li.select("l_orderkey", *[values.progress(F.col("d"), F.col("n"), a, b).alias(k) for k, a, b in (("full", 15, 80), ("sync", 65, 30), ("resume", 5, 90))])


def page_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for new pages and for updates, whole, of pages with no, one or several files and diagrams."""
    p, k = files(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_name", "p_brand", "p_type", "p_size"), "part_id"), F.col("part_id")
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part_id")  # short rows, a file or two of them, that long texts are made of
    some = lambda *items: F.filter(F.array(*items), lambda x: x.isNotNull())
    seeds = some(F.when(k % 2 == 0, F.col("path")), F.when(k % 3 == 0, F.concat("path", F.lit(".old"))))
    kinds = some(F.when(k % 5 == 0, F.lit("flowchart")), F.when(k % 7 == 0, F.lit("sequenceDiagram")))
    outline = F.concat(F.lit("- **"), "p_type", F.lit("**\n  - "), "p_name")
    about = F.when(k % 4 > 0, F.concat(F.lit("all of "), "p_name")).otherwise("")
    forms = [prompts.page_prompt(F.col("p_brand"), F.col("p_type"), F.col("p_name"), about, seeds, kinds, outline, final) for final in (False, True)]
    diff = F.repeat(F.concat(F.lit("+"), "p_name", F.lit("\n")), F.col("p_size") * 97)
    forms += [prompts.update_prompt(F.col("p_brand"), F.concat(F.lit("to "), k.cast("string")), about, diff, F.col("p_name"), F.concat(F.lit("old "), "p_name"), seeds, outline, final) for final in (False, True)]
    return p.select("part_id", *[F.sha2(x, 256).alias(c) for x, c in zip(forms, ("page", "page_last", "update", "update_last"), strict=True)])


def outline_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for the outlines of repositories, one a source of documents; every third has no README, sizes differ."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, [".ts", ".py", ".md", ".txt"])), (n % 4 + 1).cast("int"))
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    few = d.where((number > 3) | (n % 97 < number * 20)).select("source", F.concat(F.when(n % 5 == 0, "").otherwise(F.concat("lang", F.lit("/"))), n.cast("string"), ext).alias("path"), n.alias("pos"))
    repos = d.groupBy("source").agg(F.min(F.struct("doc_id", "text"))["text"].alias("text")).select("source", F.concat(F.lit("o/"), "source").alias("name"), F.when(number % 3 > 0, F.left("text", F.lit(80))).alias("readme"))
    return outlines_asked(few, repos, "source").select("source", F.sha2("prompt", 256).alias("prompt_hash"), F.length("prompt").cast("long").alias("n_chars"))


def escaped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2(text.html_escaped(F.col("html")), 256).alias("html_hash"))


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether failed calls are tried again, and when."""
    said = F.when(F.col("event_type") == "error", "process left with exit code 1").when(F.col("event_type") == "click", "HTTP 429").when(F.col("event_type") == "view", "Rate Limit").otherwise("bad input")
    n = (F.col("user_id") % 5).cast("int")
    return table(spark, sf_dir, "events").select("event_id", values.retryable(said).alias("again"), values.retryable(said, True).alias("again_wide"), values.retry_delay_ms(n).alias("delay_ms"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_repo_url, validators, format_display_name, page_addresses, title_headings, leaky_headings, toc_headings, app_dates, source_badges, link_rewrite, stored_links, shown_links, diagram_stats, diagram_policy, tidy_diagrams, json_extract_outline, final_messages, usage_cost, settings_effective, time_texts,
        progress_values, page_prompts, outline_prompts, escaped_html, retry_plan,
    )
}

def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_CONTENT = "'#  ' || a || '  ' || b || ' ' || chr(10) || chr(10) || rest"
_REST = "'Intro' || chr(10) || {policy} || '## ' || a || ' & <b>' || b || '</b>' || chr(10) || 'text' || chr(10) || '### ' || {tick} || c || {tick} || chr(10) || '```' || chr(10) || '## not a heading' || chr(10) || '```' || chr(10) || '## ' || a || ' & ' || b || chr(10) || '#### deep' || chr(10) || {trust} || 'last'"
_AS_WRITTEN = _REST.format(policy="'## Source of *Truth*' || chr(10) || chr(10)", tick="chr(96)", trust="'## Trust hierarchy' || chr(10)")
_WITHOUT = _REST.format(policy="''", tick="''", trust="''")
_HEADING_ID = "regexp_replace(regexp_replace(lower(regexp_replace(h, '<[^>]+>', '', 'g')), '[^A-Za-z0-9_]+', '-', 'g'), '^-|-$', '', 'g')"
_MS = "(event_id * 977 % 400000)"
_TOK = "(event_id * event_id * 13 % 3000000)"
_MIN = "{m} || 'm ' || CAST(floor(({ms} % 60000) / 1000 + 0.5) AS BIGINT) || 's'"
_SEC = f"CAST(floor({_MS} / 1000 + 0.5) AS BIGINT) || 's'"
_FLOORED = _MIN.format(m=f"({_MS} // 60000)", ms=_MS)
_ROUNDED = _MIN.format(m=f"CAST(floor({_MS} / 60000 + 0.5) AS BIGINT)", ms=_MS)
_GRAPH = "'```mermaid' || chr(10) || 'graph TD' || chr(10) || '  A[\"Start\"] --> B' || (doc_id % 10) || chr(10) || '```' || chr(10)"
_QUOTED = "'````md' || chr(10) || '```mermaid' || chr(10) || 'pie' || chr(10) || '```' || chr(10) || '````' || chr(10)"
_THIRD = "'~~~mermaid' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'nothing' ELSE 'sequenceDiagram' END || chr(10) || 'A->>B: hi' || chr(10) || '~~~' || chr(10)"
_LINK = r"(!?)\[([^\]]*)\]\((/[^)\s/][^)\s]*)\)"
_LINKED = f"""WITH {FILES_SQL}, pg AS (SELECT l_orderkey AS wiki_id, l_linenumber AS page_no, o_custkey AS repo_id, a.path AS own, CASE WHEN l_linenumber % 7 < 6 THEN
        'See [' || a.path || '](/home/app/' || a.path || '), ![plan](' || (CASE WHEN l_linenumber % 3 = 0 THEN '/' ELSE '/x/y/' END) || b.path || ') and [gone](/etc/' || a.path || '.old) [n]' || (CASE WHEN l_linenumber % 2 = 0 THEN '(/' || a.parts[-1] || ')' ELSE '' END)
        || ' [cdn](//host/' || a.path || ') [rel](./' || a.path || ')' || (CASE WHEN l_linenumber % 4 = 0 THEN '[again](/' || a.path || ')' ELSE '' END) END AS content, a.parts[-1] AS tail
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey JOIN shaped a ON a.part_id = l_partkey JOIN shaped b ON b.part_id = l_suppkey),
lk AS (SELECT wiki_id, page_no, repo_id, unnest(range(1, len(regexp_extract_all(content, '{_LINK}', 0)) + 1)) AS i, unnest(regexp_extract_all(content, '{_LINK}', 1)) AS image, unnest(regexp_extract_all(content, '{_LINK}', 2)) AS label, unnest(regexp_extract_all(content, '{_LINK}', 3)) AS href FROM pg),
tl AS (SELECT wiki_id, page_no, repo_id, i, unnest(range(2, len(string_split(href, '/')) + 1)) AS k, string_split(href, '/') AS p FROM lk)"""
_PUT_BACK = f"""SELECT pg.wiki_id, pg.page_no, sha256((SELECT string_agg(piece || coalesce(new, ''), '' ORDER BY x.i) FROM (SELECT unnest(string_split_regex(pg.content, '{_LINK}')) AS piece, unnest(range(1, len(string_split_regex(pg.content, '{_LINK}')) + 1)) AS i) x
    LEFT JOIN nw ON nw.wiki_id = pg.wiki_id AND nw.page_no = pg.page_no AND nw.i = x.i)) AS content_hash FROM pg"""
SQL = {
    "stored_links": f"""{_LINKED}, known AS (SELECT DISTINCT repo_id, own AS path FROM pg WHERE page_no % 2 = 1 UNION SELECT repo_id, tail FROM pg WHERE page_no % 5 = 0),
        hit AS (SELECT wiki_id, page_no, i, min(k) AS k FROM tl JOIN known ON known.repo_id = tl.repo_id AND known.path = array_to_string(p[k:], '/') GROUP BY ALL),
        base AS (SELECT c_custkey AS repo_id, 'https://github.com/' || (CASE c_custkey % 5 WHEN 0 THEN 'o' || c_custkey || '/r' WHEN 1 THEN 'o/r' WHEN 3 THEN 'o/r' END) || '/blob/' || (CASE WHEN c_custkey % 3 = 0 THEN 'dev' ELSE 'main' END) || '/' AS b FROM customer),
        nw AS (SELECT wiki_id, page_no, lk.i, CASE WHEN k IS NULL THEN image || '[' || label || '](' || href || ')' WHEN b IS NULL THEN chr(96) || array_to_string(string_split(href, '/')[k:], '/') || chr(96) ELSE image || '[' || label || '](' || b || array_to_string(string_split(href, '/')[k:], '/') || ')' END AS new
            FROM lk LEFT JOIN hit USING (wiki_id, page_no, i) LEFT JOIN base USING (repo_id)) {_PUT_BACK}""",
    "shown_links": f"""{_LINKED}, known AS (SELECT DISTINCT wiki_id, page_no, unnest([own, tail]) AS path FROM pg WHERE page_no % 3 > 0),
        hit AS (SELECT tl.wiki_id, tl.page_no, i, min(k) AS k FROM tl JOIN known ON known.wiki_id = tl.wiki_id AND known.page_no = tl.page_no AND known.path = array_to_string(p[k:], '/') GROUP BY ALL),
        nw AS (SELECT wiki_id, page_no, lk.i, CASE WHEN k IS NULL THEN image || '[' || label || '](' || href || ')' WHEN repo_id % 2 = 1 OR image = '!' THEN '<code>' || array_to_string(string_split(href, '/')[k:], '/') || '</code>' ELSE '[' || label || '](https://github.com/o/' || repo_id || '/blob/main/' || array_to_string(string_split(href, '/')[k:], '/') || ')' END AS new
            FROM lk LEFT JOIN hit USING (wiki_id, page_no, i)) {_PUT_BACK}""",
    "parse_repo_url": rf"""WITH a AS (SELECT c_custkey, trim(replace(replace(({_list(ADDRESSES)})[c_custkey % {len(ADDRESSES)} + 1], '@o', 'own' || (CASE WHEN c_custkey % 3 = 0 THEN '-er' WHEN c_custkey % 11 = 1 THEN ' er' ELSE '.' END)), '@n', CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE replace(c_name, '#', '-') END), ' ' || chr(9)) AS t FROM customer),
        b AS (SELECT *, regexp_replace(regexp_replace(t, '\.git$', ''), '/$', '') AS c FROM a), h AS (SELECT *, regexp_matches(c, 'github\.com/([^/]+)/([^/]+)') AS hosted, regexp_full_match(c, '([^/]+)/([^/]+)') AS short FROM b),
        p AS (SELECT *, CASE WHEN hosted THEN regexp_extract(c, 'github\.com/([^/]+)/([^/]+)', 1) WHEN short THEN split_part(c, '/', 1) END AS o, CASE WHEN hosted THEN regexp_extract(c, 'github\.com/([^/]+)/([^/]+)', 2) WHEN short THEN split_part(c, '/', 2) END AS n FROM h),
        q AS (SELECT *, coalesce(regexp_full_match(o, '[a-zA-Z0-9._-]+') AND regexp_full_match(n, '[a-zA-Z0-9._-]+'), false) AS ok FROM p)
        SELECT c_custkey, CASE WHEN ok THEN o END AS owner, CASE WHEN ok THEN n END AS name, CASE WHEN ok THEN 'https://github.com/' || o || '/' || n END AS url, regexp_matches(t, '^(/|~|\./|\.\./)') AS is_local FROM q""",
    "validators": "SELECT c_custkey, regexp_full_match(c_name, '[a-zA-Z0-9._-]+') AS name_ok, regexp_full_match(c_mktsegment, '[a-zA-Z0-9._-]+') AS segment_ok, c_custkey % 2 = 0 AS sha_ok FROM customer",
    "format_display_name": "WITH o AS (SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 2 THEN c_mktsegment ELSE 'unknown' END AS shown_owner FROM customer) SELECT c_custkey, shown_owner || '/' || c_name AS shown, c_name AS bare, c_name AS tail FROM o",
    "page_addresses": "SELECT c_custkey, '/' || c_mktsegment || '/' || replace(c_name, '#', '%23') || '%20(x)~%C3%A9%2B' || CASE WHEN c_custkey % 2 = 0 THEN '/1.2-a%20b' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '?v=' || c_nationkey ELSE '' END AS path FROM customer",
    "title_headings": f"WITH {_TITLED}, r AS (SELECT *, {_AS_WRITTEN} AS rest FROM t) SELECT doc_id, sha256(rest) AS content_hash, length({_CONTENT}) AS n_other FROM r",
    "leaky_headings": f"WITH {_TITLED}, r AS (SELECT *, {_WITHOUT} AS rest FROM t) SELECT doc_id, sha256({_CONTENT}) AS content_hash FROM r",
    "toc_headings": rf"""WITH {_TITLED}, h AS (SELECT doc_id, unnest([{{'pos': 0, 'level': 1, 'h': a || '  ' || b}}, {{'pos': 12, 'level': 4, 'h': 'deep'}}, {{'pos': 3, 'level': 2, 'h': 'Source of *Truth*'}}, {{'pos': 5, 'level': 2, 'h': a || ' & <b>' || b || '</b>'}}, {{'pos': 7, 'level': 3, 'h': chr(96) || c || chr(96)}}, {{'pos': 11, 'level': 2, 'h': a || ' & ' || b}}, {{'pos': 13, 'level': 2, 'h': 'Trust hierarchy'}}], recursive := true) FROM t),
        i AS (SELECT doc_id, pos, level, h, {_HEADING_ID} AS base FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) - 1 AS k FROM i)
        SELECT doc_id, pos::BIGINT AS pos, level::BIGINT AS level, base || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS id, lower(trim(regexp_replace(regexp_replace(regexp_replace(h, '[`*_~]+', '', 'g'), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS plain FROM n WHERE level IN (2, 3)""",
    "app_dates": "WITH d AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR END AS t FROM events) SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' ELSE month(t) || '/' || day(t) || '/' || year(t) END AS day FROM d",
    "source_badges": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Local' ELSE 'GitHub' END AS label, CASE WHEN o_orderstatus = 'F' THEN 'local' ELSE 'github' END AS cls FROM orders",
    "link_rewrite": f"WITH {FILES_SQL} SELECT part_id, CASE WHEN part_id % 4 = 0 THEN '[x](/home/work/repo/gone/x.ts)' ELSE '[x](https://github.com/o/r/blob/main/' || path || ')' END AS link FROM files",
    "diagram_stats": "SELECT (count(*) * 4)::BIGINT AS total, (count(*) * 4 - count(*) FILTER (doc_id % 3 = 0))::BIGINT AS valid FROM documents",
    "diagram_policy": f"SELECT doc_id, sha256('Intro' || chr(10) || {_GRAPH} || {_QUOTED} || {_THIRD} || 'end') AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n_diagrams FROM documents",
    "tidy_diagrams": "SELECT n_nationkey, 'A->>B' || chr(10) || 'x' || n_nationkey || '{\"' || n_name || '\"}' || chr(10) || 'q( \"' || n_name || '\" ]' || chr(10) || 'y[\"' || n_name || ': (z)\"]' || chr(10) || 'z[' || n_name || ']' AS code FROM nation",
    "json_extract_outline": "SELECT conv_id, turn, role, length('{\"conv\": ' || conv_id || ', \"role\": \"' || role || '\"}') AS n_chars FROM conversations",
    "final_messages": "SELECT conv_id, max(turn) FILTER (turn % 2 = 0) AS turn, coalesce('{\"turn\": ' || max(turn) FILTER (turn % 2 = 0) || '}', '') AS message FROM conversations GROUP BY conv_id",
    "usage_cost": """WITH c AS (SELECT (['claude-sonnet-4-6', 'claude-opus-4-6', 'gpt-5.5', 'gpt-5.5-xhigh', 'unknown'])[l_linenumber % 5 + 1] AS model, ([3.0, 5.0, 1.75, 1.75, 0.0])[l_linenumber % 5 + 1]::DOUBLE AS a, ([15.0, 25.0, 14.0, 14.0, 0.0])[l_linenumber % 5 + 1]::DOUBLE AS b,
        trunc(l_quantity * 1000)::BIGINT AS p, trunc(l_extendedprice)::BIGINT AS c, trunc(l_discount * 200000)::BIGINT AS k, CASE WHEN l_returnflag = 'R' THEN l_tax END AS reported FROM lineitem)
        SELECT model, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, round(sum(coalesce(reported, ((p - least(k, p)) * a + least(k, p) * a * 0.1 + c * b) / 1e6)), 2) AS cost FROM c GROUP BY model""",
    "settings_effective": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE greatest(1, least(5, c_custkey % 9)) END::BIGINT AS pages_at_once, c_custkey % 3 <> 0 AS show_owner, CASE c_custkey % 7 WHEN 1 THEN 'claude-opus-4-6' WHEN 2 THEN 'gpt-5.5' WHEN 3 THEN 'gpt-5.5-xhigh' ELSE 'claude-sonnet-4-6' END AS model FROM customer",
    "time_texts": f"""WITH d AS (SELECT *, epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(date_trunc('second', ts)) AS diff FROM events)
        SELECT event_id, CASE WHEN diff < 60000 THEN 'just now' WHEN diff < 3600000 THEN (diff // 60000) || 'm ago' WHEN diff < 86400000 THEN (diff // 3600000) || 'h ago' ELSE (diff // 86400000) || 'd ago' END AS age,
        CASE WHEN {_MS} = 0 THEN '' WHEN {_MS} < 60000 THEN {_SEC} ELSE {_FLOORED} END AS d_floor, CASE WHEN {_MS} = 0 THEN '' WHEN {_MS} < 60000 THEN {_SEC} ELSE {_ROUNDED} END AS d_round,
        CASE WHEN {_MS} = 0 THEN '' WHEN {_MS} < 1000 THEN {_MS} || 'ms' WHEN {_MS} < 60000 THEN (({_MS} + 50) // 100 // 10) || '.' || (({_MS} + 50) // 100 % 10) || 's' ELSE {_ROUNDED} END AS d_short,
        CASE WHEN {_TOK} = 0 THEN '' WHEN {_TOK} >= 1000000 THEN (({_TOK} + 50000) // 100000 // 10) || '.' || (({_TOK} + 50000) // 100000 % 10) || 'M' WHEN {_TOK} >= 1000 THEN (({_TOK} + 50) // 100 // 10) || '.' || (({_TOK} + 50) // 100 % 10) || 'K' ELSE {_TOK}::VARCHAR END AS tokens FROM d""",
    "progress_values": "WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS d FROM lineitem GROUP BY ALL) SELECT l_orderkey, (15 + floor(d / n * 80))::INTEGER AS full, (65 + floor(d / n * 30))::INTEGER AS sync, (5 + floor(d / n * 90))::INTEGER AS resume FROM c".replace("AS full", 'AS "full"'),
    "page_prompts": f"""WITH {FILES_SQL}, d AS (SELECT part_id, p_name, p_brand, p_type, list_filter([CASE WHEN part_id % 2 = 0 THEN path END, CASE WHEN part_id % 3 = 0 THEN path || '.old' END], lambda x: x IS NOT NULL) AS seeds,
            list_filter([CASE WHEN part_id % 5 = 0 THEN 'flowchart' END, CASE WHEN part_id % 7 = 0 THEN 'sequenceDiagram' END], lambda x: x IS NOT NULL) AS kinds, CASE WHEN part_id % 4 > 0 THEN 'all of ' || p_name ELSE '' END AS about,
            '- **' || p_type || '**' || chr(10) || '  - ' || p_name AS outline, left(repeat('+' || p_name || chr(10), p_size * 97), {prompts.MAX_DIFF}) AS diff FROM files JOIN part ON p_partkey = part_id),
        e AS (SELECT *, chr(10) || chr(10) AS nn, list_transform(seeds, lambda x: '- ' || x) AS items FROM d),
        f AS (SELECT *, 'Write a documentation page for the repository ' || p_brand || '.' || nn || '## Wiki structure' || chr(10) || outline || nn || '## Page' || chr(10) || '- Section: ' || p_type || chr(10) || '- Page: ' || p_name || chr(10) || '- About: ' || about || nn || '## Files to start from' || chr(10)
                || (CASE WHEN len(items) > 0 THEN array_to_string(items, chr(10)) ELSE '- (none: find the relevant files)' END) || nn
                || (CASE WHEN len(kinds) > 0 THEN '## Diagrams' || nn || 'Optional; one at most, two on pages of several components. Suggested: ' || array_to_string(kinds, ', ') || '.' || chr(10) || 'Use fenced mermaid blocks with quoted labels.' || nn ELSE '' END)
                || '## Form' || chr(10) || 'Markdown from second level headings on; headings are about the code; the title is added elsewhere.' AS made,
            'Bring a page of the wiki of ' || p_brand || ' up to date.' || nn || '## Wiki structure' || chr(10) || outline || nn || '## Change' || chr(10) || '- to ' || part_id || chr(10) || '- ' || about || nn || '```diff' || chr(10) || diff || chr(10) || '```' || nn || '## Page: ' || p_name || nn || 'old ' || p_name || nn || '## Its files' || chr(10)
                || (CASE WHEN len(items) > 0 THEN array_to_string(items, chr(10)) ELSE '- (none recorded: see the difference)' END) AS changed, nn || '## Output' || chr(10) AS ends FROM e)
        SELECT part_id, sha256(made) AS page, sha256(made || ends || 'The last message is the page''s Markdown alone.') AS page_last, sha256(changed || ends || 'Set "noChangesNeeded", or "content" to the whole page.') AS update,
            sha256(changed || ends || 'The last message is the page''s Markdown alone, or {prompts.NO_CHANGES} if nothing changes.') AS update_last FROM f""",
    "outline_prompts": """WITH d AS (SELECT *, regexp_extract(source, '(\\d+)$', 1)::INTEGER AS k FROM documents),
        f AS (SELECT source, doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS folder, doc_id || (['.ts', '.py', '.md', '.txt'])[doc_id % 4 + 1] AS name, (['typescript', 'python', 'markdown', NULL])[doc_id % 4 + 1] AS l FROM d WHERE k > 3 OR doc_id % 97 < k * 20),
        t AS (SELECT source, 0 AS top, folder, '' AS name, folder || '/' AS line FROM f WHERE folder IS NOT NULL GROUP BY ALL UNION ALL SELECT source, CASE WHEN folder IS NULL THEN 1 ELSE 0 END, coalesce(folder, ''), name, CASE WHEN folder IS NULL THEN name ELSE '  ' || name END FROM f),
        tree AS (SELECT source, string_agg(line, chr(10) ORDER BY top, folder, name) AS tree FROM t GROUP BY source), cnt AS (SELECT source, count(*) AS n FROM f GROUP BY source),
        lang_ AS (SELECT source, string_agg(l, ', ' ORDER BY first) AS langs FROM (SELECT source, l, min(doc_id) AS first FROM f WHERE l IS NOT NULL GROUP BY ALL) GROUP BY source),
        r AS (SELECT source, CASE WHEN any_value(k) % 3 > 0 THEN left(arg_min(text, doc_id), 80) END AS readme FROM d GROUP BY source),
        p AS (SELECT source, 'Plan a documentation wiki for a repository.' || chr(10) || chr(10) || '## Repository: o/' || source || chr(10) || chr(10) || '### Files (' || coalesce(n, 0) || ')' || chr(10) || '```' || chr(10) || coalesce(tree, '') || chr(10) || '```' || chr(10) || chr(10)
            || (CASE WHEN coalesce(readme, '') <> '' THEN '### README (intent, not truth)' || chr(10) || readme || chr(10) || chr(10) ELSE '' END) || '### Languages' || chr(10) || coalesce(langs, '') || chr(10) || chr(10) || '## Rules' || chr(10)
            || (CASE WHEN coalesce(n, 0) <= 5 THEN '- Very small repository: one Overview section of 1-2 pages, no more sections.' WHEN n <= 20 THEN '- Small repository: 1-3 sections of 1-2 pages each.' WHEN n <= 50 THEN '- 2-5 sections of 1-3 pages each.' ELSE '- 3-7 sections of 1-4 pages each.' END)
            || chr(10) || '- The first section is Overview; its pages name entry points, not only documents.' || chr(10) || '- Answer with the JSON object of title, description and sections alone.' AS prompt
            FROM r LEFT JOIN tree USING (source) LEFT JOIN cnt USING (source) LEFT JOIN lang_ USING (source))
        SELECT source, sha256(prompt) AS prompt_hash, length(prompt) AS n_chars FROM p""",
    "escaped_html": "SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS html_hash FROM pages",
    "retry_plan": "SELECT event_id, event_type = 'error' AS again, event_type IN ('error', 'click', 'view') AS again_wide, CASE WHEN user_id % 5 < 3 THEN (2 ** (user_id % 5) * 2000)::BIGINT END AS delay_ms FROM events",
}
