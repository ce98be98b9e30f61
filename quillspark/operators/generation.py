"""The dataflows around text generation: full runs, incremental syncs and resumed runs.

Generation itself is an injected function (prompt, options) -> text, or text and cost; a registry names it by model. What to generate, what
to keep of it and how it is stored are DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.paths import language
from ..functions.prompts import NO_CHANGES, outline_prompt
from ..functions.text import without_title
from ..functions.values import DEFAULT_MODEL, PRICES, RETRY_TEXTS
from ..streaming.calls import called
from ..streaming.transitions import PAGE_SECONDS
from .links import relink_stored
from .outline import tree_lines
from .relational import overlapping
from .snapshots import Store, delete_paths, update_by_id

Generator = Callable[[str, Mapping[str, object]], str | Mapping[str, object]]
_generators: dict[str, Generator] = {}
UNFINISHED = ("failed", "pending", "generating")


def register(model: str, generate: Generator) -> None:
    if model not in PRICES:
        raise ValueError(f"unknown model: {model}")
    _generators[model] = generate


def generator(model: str | None) -> Generator:
    """The function of a model, or that of the default one."""
    name = model if model in PRICES else DEFAULT_MODEL
    if name not in _generators:
        raise LookupError(f"no generator is registered for {name}")
    return _generators[name]


def outline_prompts(files: DataFrame, repos: DataFrame, key: str = "repo_id") -> DataFrame:
    """key, prompt: what a generator is asked for the outline of each repository, from its scanned files (key, path, pos: the
    scan's order) and the repositories (key, name, readme: null if there is none). Those without files have an empty tree."""
    tree = tree_lines(files, [key]).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("tree"))
    spoken = files.select(key, language(F.col("path")).alias("l"), "pos").where("l IS NOT NULL").groupBy(key, "l").agg(F.min("pos").alias("first"))
    languages = spoken.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "l"))), lambda x: x["l"]).alias("languages"))
    counts = files.groupBy(key).agg(F.count("*").alias("n"))
    own = repos.select(key, "name", "readme").join(tree, key, "left").join(languages, key, "left").join(counts, key, "left")
    none = F.array().cast("array<string>")
    return own.select(key, outline_prompt(F.col("name"), F.coalesce("tree", F.lit("")), F.col("readme"), F.coalesce("n", F.lit(0)), F.coalesce("languages", none)).alias("prompt"))


def cleaned(pages: DataFrame, files: DataFrame, repos: DataFrame, repo: str = "repo_id", key: Sequence[str] = ("page_id",)) -> DataFrame:
    """Generated content put right: title heading out, policy headings out, two diagrams at most, links to files."""
    out = pages.withColumn("content", md.without_policy_headings_column(without_title(F.col("content"), F.col("title"))))
    out = out.withColumn("_d", md.limit_diagrams_column(F.col("content"))).withColumn("diagrams", F.col("_d.diagrams"))
    return relink_stored(out.withColumn("content", F.col("_d.content")).drop("_d"), files, repos, repo, key)


def generate_pages(pages: DataFrame, model: str | None, folder: str, at_once: int = 2, spend: float | None = None) -> DataFrame:
    """page_id, content, status, error_message of pages with prompts, written to the folder. The executors call the
    generator; pages that a spend limit leaves out are pending still."""
    run = generator(model)

    def call(item: Mapping[str, object]) -> Mapping[str, object]:
        got = run(str(item["prompt"]), {"page_id": item["page_id"]})
        return {"text": got} if isinstance(got, str) else got

    again = lambda message: any(t in message for t in RETRY_TEXTS)
    done = called(pages.select("page_id", "prompt"), call, folder, at_once, spend, PAGE_SECONDS, retry=again)
    return done.select("page_id", F.col("text").alias("content"), F.when(F.col("status") == "skipped", "pending").otherwise(F.col("status")).alias("status"), F.col("error").alias("error_message"))


def to_resume(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status").isin(*UNFINISHED))


def rescanned(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Scanned files that a change set names."""
    return files.join(changed.select("file_path").distinct(), "file_path", "left_semi")


def stored_pages(outline_pages: DataFrame, pages: DataFrame, key: Sequence[str] = ("page_id",)) -> DataFrame:
    """Pages of an outline with the stored ones of their ids; those that aren't stored are left out."""
    return outline_pages.join(pages, list(key))


def sync(store: Store, repo_id: int, pull: Callable[[], tuple[str, str]], changes: Callable[[str, str], DataFrame], scan: Callable[[str], DataFrame], update: Callable[[DataFrame], DataFrame]) -> str:
    """Bring a repository's newest wiki up to date with its newest commit; says what was done.

    pull() gives a folder and a commit, changes(folder, since) the changed files (file_path), scan(folder) all files
    (file_path, content_hash), update(pages) new contents (page_id, content, status). The commit moves last, so that a
    run that fails is done again."""
    repo = store.read("repos").where(F.col("id") == repo_id).first()
    wiki = store.read("wikis").where(F.col("repo_id") == repo_id).orderBy(F.desc("created_at"), F.desc("id")).first()
    if repo is None or wiki is None:
        raise LookupError("no such wiki")
    if not repo.last_commit_sha:
        raise ValueError("the repository was never scanned; generate the wiki anew")
    folder, sha = pull()
    if sha == repo.last_commit_sha:
        return "up to date"
    changed = changes(folder, repo.last_commit_sha).select("file_path").distinct()
    advance = lambda: store.change("repos", lambda r: update_by_id(r, repo_id, {"clone_path": folder, "last_commit_sha": sha}, F.current_timestamp()))
    if changed.limit(1).count() == 0:
        advance()
        return "no files changed"
    store.change("documents", lambda d: delete_paths(d, repo_id, changed))
    store.upsert("documents", rescanned(scan(folder), changed).select(F.lit(repo_id).cast("bigint").alias("repo_id"), "file_path", "content_hash"))
    own = store.read("wiki_pages").where(F.col("wiki_id") == wiki.id).withColumn("file_paths", F.from_json("file_paths", "array<string>"))
    todo = to_sync(own, changed, repo.last_commit_sha, sha)
    n = todo.count()
    if n:
        new = synced(todo, update(todo)).select("wiki_id", "page_id", "title", "parent_id", "sort_order", "content", F.to_json("file_paths").alias("file_paths"), "status")
        store.upsert("wiki_pages", new)
    advance()
    return f"{n} pages updated"


def to_sync(pages: DataFrame, changed: DataFrame, last_sha: str | None, sha: str | None) -> DataFrame:
    """Pages that a change set touches; none when the commit is the same."""
    if last_sha is not None and last_sha == sha:
        return pages.limit(0)
    return overlapping(pages, "file_paths", ["page_id"], changed.select(F.col("file_path").alias("path")), "path")


def synced(pages: DataFrame, updates: DataFrame) -> DataFrame:
    """Pages with updated content; an answer that says nothing changes keeps it."""
    new = updates.select("page_id", F.when(F.trim("content") != NO_CHANGES, F.col("content")).alias("_new"), F.col("status").alias("_status"))
    out = pages.join(new, "page_id", "left")
    ok = F.coalesce(F.col("_status") == "completed", F.lit(False))
    return out.withColumn("content", F.when(ok, F.coalesce("_new", "content")).otherwise(F.col("content"))).drop("_new", "_status")
