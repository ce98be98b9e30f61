"""The service's requests as functions on a store: each returns a status code with a result, or frames."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import repo_address
from ..functions.values import DEFAULT_MODEL, PARALLEL_DEFAULT, PRICES, parallel_limit, resolved_model
from ..sources.json_files import OUTLINE
from .generation import UNFINISHED
from .outline import flat_pages, plain_slug, resolve_slug, slug_entry
from .relational import latest, with_count
from .snapshots import ACTIVE, Store, cancel, with_ids

Answer = tuple[int, dict]


def _one(df: DataFrame) -> dict | None:
    rows = df.limit(1).collect()
    return rows[0].asDict() if rows else None


def _active(store: Store, repo_id: int) -> dict | None:
    return _one(store.read("jobs").where(F.col("status").isin(*ACTIVE) & (F.col("repo_id") == repo_id)).orderBy(F.desc("created_at"), F.desc("id")))


def _create_job(store: Store, kind: str, repo_id: int | None, wiki_id: int | None, params: dict) -> int:
    row = store.spark.createDataFrame([(kind, repo_id, wiki_id, json.dumps(params))], "type string, repo_id long, wiki_id long, params string")
    made: list[int] = []

    def with_job(jobs: DataFrame) -> DataFrame:
        new = with_ids(row, jobs, ["type"], after=store.largest_id("jobs")).withColumn("created_at", F.current_timestamp())
        made.append(_one(new.select("id"))["id"])
        return jobs.unionByName(new.withColumn("id", F.lit(made[-1])), allowMissingColumns=True)

    store.change("jobs", with_job)
    return made[-1]


def _latest_wiki(store: Store, repo_id: int, status: str | None = None) -> dict | None:
    own = store.read("wikis").where(F.col("repo_id") == repo_id)
    return _one((own if status is None else own.where(F.col("status") == status)).orderBy(F.desc("created_at"), F.desc("id")))


def _repo(store: Store, full_name: str) -> dict | None:
    return _one(store.read("repos").where(F.col("full_name") == full_name))


def request_generation(store: Store, address: str | None, model: str | None = None, force: bool = False) -> Answer:
    """A job for a repository: the active one if there is one, the finished wiki unless forced, else a new job."""
    if not address:
        return 400, {"error": "no repository given"}
    parsed = _one(store.spark.createDataFrame([(address,)], "a string").select(repo_address(F.col("a")).alias("r")).where("r IS NOT NULL").select("r.*"))
    if parsed is None:
        return 400, {"error": "not a repository address"}
    repo = _repo(store, f"{parsed['owner']}/{parsed['name']}")
    if repo:
        if job := _active(store, repo["id"]):
            return 200, {"job_id": job["id"], "existing": True}
        if not force and (wiki := _latest_wiki(store, repo["id"], "completed")):
            return 200, {"wiki_id": wiki["id"], "exists": True}
    return 200, {"job_id": _create_job(store, "full_generation", repo and repo["id"], None, {**parsed, "model": model})}


def request_update(store: Store, owner: str, name: str) -> Answer:
    repo = _repo(store, f"{owner}/{name}")
    wiki = repo and _latest_wiki(store, repo["id"])
    if not wiki:
        return 404, {"error": "no such wiki"}
    if job := _active(store, repo["id"]):
        return 200, {"job_id": job["id"], "existing": True}
    return 200, {"job_id": _create_job(store, "sync", repo["id"], wiki["id"], {})}


def request_resume(store: Store, wiki_id: int) -> Answer:
    """A job for the pages that are left, whether or not another one runs."""
    wiki = _one(store.read("wikis").where(F.col("id") == wiki_id))
    if not wiki:
        return 404, {"error": "no such wiki"}
    left = store.read("wiki_pages").where((F.col("wiki_id") == wiki_id) & F.col("status").isin(*UNFINISHED)).count()
    if not left:
        return 400, {"error": "nothing to resume"}
    return 200, {"job_id": _create_job(store, "resume", wiki["repo_id"], wiki_id, {}), "pages": left}


def cancel_job(store: Store, job_id: int | str) -> Answer:
    if not str(job_id).isdigit():
        return 400, {"error": "bad job id"}
    job = _one(store.read("jobs").where(F.col("id") == int(job_id)))
    if job is None:
        return 404, {"error": "no such job"}
    if job["status"] not in ACTIVE:
        return 409, {"error": f"job is {job['status']}"}
    store.change("jobs", lambda j: cancel(j, int(job_id), F.current_timestamp()))
    return 200, {"success": True}


def delete_wiki(store: Store, wiki_id: int, clones: str | None = None) -> Answer:
    if _one(store.read("wikis").where(F.col("id") == wiki_id)) is None:
        return 404, {"error": "no such wiki"}
    store.delete_wiki(wiki_id, clones)
    return 200, {"success": True}


def put_settings(store: Store, values: dict[str, object]) -> Answer:
    """Valid settings are stored, others are left out; either way it succeeds."""
    checks = {
        "generationModel": lambda v: v in PRICES,
        "parallelPageLimit": lambda v: bool(re.fullmatch(r"\d+", str(v))) and 1 <= int(str(v)) <= 10,
        "showRepoOwner": lambda v: isinstance(v, bool) or str(v) in ("true", "false"),
    }
    kept = [(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in values.items() if k in checks and checks[k](v)]
    if kept:
        store.upsert("settings", store.spark.createDataFrame(kept, "key string, value string"))
    return 200, {"success": True}


def settings(store: Store) -> dict[str, object]:
    """The settings that take effect."""
    raw = {r.key: r.value for r in store.read("settings").collect()}
    one = store.spark.createDataFrame([(raw.get("generationModel"), raw.get("parallelPageLimit"))], "m string, p string")
    got = one.select(resolved_model(F.col("m")).alias("m"), parallel_limit(F.col("p")).cast("int").alias("p")).first()
    return {"generationModel": got.m, "parallelPageLimit": got.p, "showRepoOwner": raw.get("showRepoOwner", "true").strip().lower() != "false"}


def settings_view(store: Store) -> dict[str, object]:
    """What the settings page shows: values in effect, defaults, and the models with their prices."""
    models = [{"id": k, "input": a, "output": b} for k, (a, b) in PRICES.items()]
    return {"current": settings(store), "defaults": {"generationModel": DEFAULT_MODEL, "parallelPageLimit": PARALLEL_DEFAULT, "showRepoOwner": True}, "generationModels": models}


def active_jobs(store: Store) -> DataFrame:
    repos = store.read("repos").select(F.col("id").alias("repo_id"), F.concat("owner", F.lit("/"), "name").alias("repo_full_name"))
    return store.read("jobs").where(F.col("status").isin(*ACTIVE)).join(repos, "repo_id", "left").orderBy("created_at", "id")


def wikis(store: Store) -> DataFrame:
    """All wikis with repository, page count and the numbers of their last completed job, newest first."""
    done = store.read("jobs").where("status = 'completed' AND wiki_id IS NOT NULL").select("wiki_id", "completed_at", F.col("id").alias("job_id"), (F.col("total_prompt_tokens") + F.col("total_completion_tokens")).alias("total_tokens"), "total_cost")
    last = latest(done, ["wiki_id"], ["completed_at", "job_id"]).withColumnRenamed("wiki_id", "id")
    pages = store.read("wiki_pages").select(F.col("wiki_id").alias("id"))
    listed = with_count(store.read("wikis"), pages, "id", "page_count")
    repos = store.read("repos").select(F.col("id").alias("repo_id"), "owner", F.col("name").alias("repo_name"))
    return listed.join(repos, "repo_id", "left").join(last, "id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def home(store: Store) -> dict[str, object]:
    """What the first page shows: active jobs, all wikis, whether owners are shown."""
    return {"jobs": active_jobs(store), "wikis": wikis(store), "show_owner": settings(store)["showRepoOwner"]}


def page_view(store: Store, owner: str, name: str, slug: str, version: int | None = None) -> Answer:
    """A page of a wiki by its slug; other forms of the address lead to the slug."""
    code, shown = view(store, owner, name, version)
    if code != 200:
        return code, shown
    outline = store.spark.createDataFrame([(1, shown["wiki"]["structure"])], "wiki int, s string").select("wiki", F.from_json("s", OUTLINE).alias("outline"))
    entries = flat_pages(outline, "wiki").select("wiki", F.col("id").alias("page_id"), "sort_order", slug_entry(F.col("section_pos"), F.col("page_pos"), plain_slug(F.col("title"))).alias("slug"))
    found = resolve_slug(entries, store.spark.createDataFrame([(1, slug)], "wiki int, slug string"), "wiki").select("page_id")
    hit = _one(entries.select("page_id", "slug").join(found, "page_id"))
    page = hit and _one(shown["pages"].where(F.col("page_id") == hit["page_id"]))
    if not page:
        return 404, {"error": "no such page"}
    if hit["slug"] != slug:
        return 302, {"location": f"/{owner}/{name}/{hit['slug']}" + (f"?v={version}" if version is not None else "")}
    return 200, {**shown, "page": page}


def view(store: Store, owner: str, name: str, version: int | None = None) -> Answer:
    """A wiki's page: the latest wiki or the asked version, its pages in order, versions, active job and last numbers."""
    repo = _repo(store, f"{owner}/{name}")
    newest = repo and _latest_wiki(store, repo["id"])
    if not newest:
        return 404, {"error": "no such wiki"}
    own = store.read("wikis").where(F.col("repo_id") == repo["id"])
    wiki = newest if version is None else _one(own.where(F.col("version") == version))
    if not wiki:
        return 404, {"error": "no such version"}
    if version is not None and wiki["id"] == newest["id"]:
        return 302, {"location": f"/{owner}/{name}"}
    pages = store.read("wiki_pages").where(F.col("wiki_id") == wiki["id"]).orderBy("sort_order")
    counts = with_count(own, store.read("wiki_pages").select(F.col("wiki_id").alias("id")), "id", "page_count").select("id", "version", "page_count").orderBy(F.desc("version"))
    stats = _one(store.read("jobs").where((F.col("wiki_id") == wiki["id"]) & (F.col("status") == "completed")).orderBy(F.desc("completed_at"), F.desc("id")))
    return 200, {"wiki": wiki, "pages": pages, "versions": counts, "active_job": _active(store, repo["id"]), "stats": stats}
