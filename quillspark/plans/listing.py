"""Queries over the catalogue: listings, versions, lookups, active jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import last_of_group, latest, next_version, numbered, with_count
from ..operators.snapshots import claim
from ..sources.tables import ACTIVE, SQL_CTES, jobs, pages, repos, time_text, wikis


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wiki with its repository, page count and latest completed job, newest first."""
    done = jobs(spark, sf_dir).where("status = 'completed'").select(F.col("repo_id").alias("wiki_id"), F.col("created_at").alias("completed_at"), "job_id", "value")
    last = latest(done, ["wiki_id"], ["completed_at", "job_id"]).select("wiki_id", "job_id", (F.round(F.col("value") * 100)).cast("long").alias("prompt_tokens"), F.lit(10).cast("long").alias("completion_tokens"))
    listed = with_count(wikis(spark, sf_dir), pages(spark, sf_dir), "wiki_id", "page_count")
    out = listed.join(repos(spark, sf_dir), "repo_id", "left").join(last, "wiki_id", "left")
    return out.select("wiki_id", "repo_id", "owner", "name", time_text("created_at").alias("created_at"), "page_count", "job_id", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens")).orderBy(F.desc("created_at"), F.desc("wiki_id"))


_LISTING = f"""WITH {SQL_CTES}
SELECT w.wiki_id, w.repo_id, r.owner, r.name, strftime(w.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
    (SELECT count(*) FROM pages_ p WHERE p.wiki_id = w.wiki_id) AS page_count, j.job_id, CAST(round(j.value * 100) AS BIGINT) + 10 AS total_tokens
FROM wikis w LEFT JOIN repos r ON r.repo_id = w.repo_id
LEFT JOIN (SELECT * FROM jobs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) = 1) j ON j.repo_id = w.wiki_id"""


def latest_wiki_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest(wikis(spark, sf_dir), ["repo_id"], ["created_at", "wiki_id"])
    return last.join(repos(spark, sf_dir), "repo_id").select("repo_id", "owner", "name", "wiki_id", time_text("created_at").alias("created_at"))


_LATEST = f"""WITH {SQL_CTES} SELECT repo_id, owner, name, wiki_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM wikis JOIN repos USING (repo_id)
QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, wiki_id DESC) = 1"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(wikis(spark, sf_dir), ["repo_id"], ["created_at", "wiki_id"], "version")


_VERSIONS = "versions AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at, wiki_id) AS version FROM wikis)"


def wiki_version_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("wiki_id", "repo_id", "version")


def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = repos(spark, sf_dir).select("repo_id").join(_versions(spark, sf_dir).select("repo_id", "version"), "repo_id", "left")
    return next_version(every, "repo_id")


def versions_with_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_count(_versions(spark, sf_dir), pages(spark, sf_dir), "wiki_id", "page_count")
    return counted.join(repos(spark, sf_dir), "repo_id").select("repo_id", "name", "version", "wiki_id", "page_count").orderBy("repo_id", F.desc("version"))


def wiki_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository's second version: lookup by unique name and version, with bound parameters."""
    v = _versions(spark, sf_dir).join(repos(spark, sf_dir), "repo_id")
    return spark.sql("SELECT wiki_id, repo_id, owner, name, version FROM {v} WHERE name = :name AND version = :version", args={"name": "Customer#000000007", "version": 2}, v=v)


def wiki_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wikis(spark, sf_dir).where(F.col("wiki_id") == 7).select("wiki_id", "repo_id", "status", time_text("created_at").alias("created_at"))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one wiki in order."""
    return pages(spark, sf_dir).where("wiki_id = 7").select("wiki_id", "sort_order", "part_id").orderBy("sort_order")


def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending and running jobs, oldest first, with the repository's full name (null if the repository is gone)."""
    out = jobs(spark, sf_dir).where(F.col("status").isin(*ACTIVE)).join(repos(spark, sf_dir), "repo_id", "left")
    return out.select("job_id", "type", "status", "repo_id", F.concat("owner", F.lit("/"), "name").alias("full_name"), time_text("created_at").alias("created_at")).orderBy("created_at", "job_id")


def active_job_for_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = jobs(spark, sf_dir).where(F.col("status").isin(*ACTIVE)).select("repo_id", "job_id", "status", "created_at")
    return latest(own, ["repo_id"], ["created_at", "job_id"]).select("repo_id", "job_id", "status")


def claim_next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest pending job, as it is once claimed."""
    j = jobs(spark, sf_dir).select(F.col("job_id").alias("id"), "type", "repo_id", "status", "created_at", F.lit(None).cast("timestamp").alias("started_at"))
    return claim(j, F.current_timestamp()).where("started_at IS NOT NULL").select(F.col("id").alias("job_id"), "type", "repo_id", "status")


def dedupe_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest wiki of each repository with the number of its versions; wikis without one stand for themselves."""
    listed = wikis(spark, sf_dir).join(repos(spark, sf_dir), "repo_id", "left")
    key = F.coalesce(F.concat(F.lit("id:"), F.col("repo_id").cast("string")), F.concat(F.lit("nm:"), F.col("wiki_id").cast("string")))
    return last_of_group(listed, key, ["created_at", "wiki_id"], "version_count").select("repo_id", "wiki_id", "owner", "name", "version_count")


def search_repositories(spark: SparkSession, sf_dir: str, query: str = " building/customer#00000001 ") -> DataFrame:
    """Repositories whose owner/name has the query in it, whatever the case; an empty query finds all."""
    full = F.concat(F.coalesce("owner", F.lit("")), F.lit("/"), F.coalesce("name", F.lit("")))
    return repos(spark, sf_dir).where(F.lower(full).contains(query.strip().lower())).select("repo_id", full.alias("full_name"))


def wiki_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wiki's page shows of its jobs: latest completed job of each repository that has a wiki."""
    done = jobs(spark, sf_dir).where("status = 'completed'").select("repo_id", "job_id", "created_at", "value")
    last = latest(done, ["repo_id"], ["created_at", "job_id"])
    newest = latest(wikis(spark, sf_dir), ["repo_id"], ["created_at", "wiki_id"]).select("repo_id", "wiki_id")
    return newest.join(last, "repo_id", "left").select("repo_id", "wiki_id", "job_id", F.round("value", 2).alias("cost"))


QUERIES = {
    "catalog_listing": catalog_listing,
    "latest_wiki_per_repo": latest_wiki_per_repo,
    "wiki_version_number": wiki_version_number,
    "next_version": next_versions,
    "versions_with_page_count": versions_with_page_count,
    "wiki_by_version": wiki_by_version,
    "wiki_by_id": wiki_by_id,
    "wiki_pages": wiki_pages,
    "active_jobs": active_jobs,
    "active_job_for_repo": active_job_for_repo,
    "claim_next_job": claim_next_job,
    "dedupe_by_repo": dedupe_by_repo,
    "search_repositories": search_repositories,
    "wiki_view": wiki_view,
}

SQL = {
    "catalog_listing": _LISTING,
    "latest_wiki_per_repo": _LATEST,
    "wiki_version_number": f"WITH {SQL_CTES}, {_VERSIONS} SELECT wiki_id, repo_id, version FROM versions",
    "next_version": f"WITH {SQL_CTES}, {_VERSIONS} SELECT repo_id, coalesce(max(version), 0) + 1 AS next_version FROM repos LEFT JOIN versions USING (repo_id) GROUP BY ALL",
    "versions_with_page_count": f"WITH {SQL_CTES}, {_VERSIONS} SELECT repo_id, name, version, wiki_id, (SELECT count(*) FROM pages_ p WHERE p.wiki_id = v.wiki_id) AS page_count FROM versions v JOIN repos USING (repo_id)",
    "wiki_by_version": f"WITH {SQL_CTES}, {_VERSIONS} SELECT wiki_id, repo_id, owner, name, version FROM versions JOIN repos USING (repo_id) WHERE name = 'Customer#000000007' AND version = 2",
    "wiki_by_id": f"WITH {SQL_CTES} SELECT wiki_id, repo_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM wikis WHERE wiki_id = 7",
    "wiki_pages": f"WITH {SQL_CTES} SELECT wiki_id, sort_order, part_id FROM pages_ WHERE wiki_id = 7",
    "active_jobs": f"WITH {SQL_CTES} SELECT job_id, type, j.status, j.repo_id, owner || '/' || name AS full_name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM jobs j LEFT JOIN repos USING (repo_id) WHERE status IN ('pending', 'processing')",
    "active_job_for_repo": f"WITH {SQL_CTES} SELECT repo_id, job_id, status FROM jobs WHERE status IN ('pending', 'processing') QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) = 1",
    "claim_next_job": f"WITH {SQL_CTES} SELECT job_id, type, repo_id, 'processing' AS status FROM jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 1",
    "dedupe_by_repo": f"WITH {SQL_CTES} SELECT repo_id, wiki_id, owner, name, count(*) OVER (PARTITION BY repo_id) AS version_count FROM wikis LEFT JOIN repos USING (repo_id) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, wiki_id DESC) = 1",
    "search_repositories": f"WITH {SQL_CTES} SELECT repo_id, owner || '/' || name AS full_name FROM repos WHERE contains(lower(owner || '/' || name), 'building/customer#00000001')",
    "wiki_view": f"""WITH {SQL_CTES}, n AS (SELECT repo_id, wiki_id FROM wikis QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, wiki_id DESC) = 1),
        j AS (SELECT repo_id, job_id, value FROM jobs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) = 1)
        SELECT repo_id, wiki_id, job_id, round(value, 2) AS cost FROM n LEFT JOIN j USING (repo_id)""",
}
