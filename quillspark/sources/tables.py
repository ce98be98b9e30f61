"""Relations of the catalogue, over Parquet tables.

The engine's relations are repos, wikis (versions of a repository's documentation), pages, jobs and documents. A store
holds them as Parquet snapshots; the functions here derive them from the benchmark tables, so that queries run anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Status of a job by the type of the event that stands for it.
STATUS = {"purchase": "completed", "signup": "pending", "click": "processing", "error": "failed", "view": "cancelled"}
ACTIVE = ("pending", "processing")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def time_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def status_of(kind: Column) -> Column:
    out = None
    for k, v in STATUS.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("name"))


def wikis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("wiki_id"), F.col("o_custkey").alias("repo_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status")
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("wiki_id"), F.col("l_linenumber").alias("sort_order"), F.col("l_partkey").alias("part_id"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("repo_id"), F.col("event_type").alias("type"), F.col("ts").alias("created_at"), F.col("value"), status_of(F.col("event_type")).alias("status")
    )


#: The same relations for DuckDB, as common table expressions.
SQL_CTES = """
repos AS (SELECT c_custkey AS repo_id, c_mktsegment AS owner, c_name AS name FROM customer),
wikis AS (SELECT o_orderkey AS wiki_id, o_custkey AS repo_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders),
pages_ AS (SELECT l_orderkey AS wiki_id, l_linenumber AS sort_order, l_partkey AS part_id, l_returnflag AS flag, l_quantity AS quantity FROM lineitem),
jobs AS (SELECT event_id AS job_id, user_id AS repo_id, event_type AS type, ts AS created_at, value,
    CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'cancelled' END AS status FROM events)
"""
