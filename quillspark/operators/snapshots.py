"""A catalogue of tables kept as Parquet snapshots: upserts, updates, cascading deletes, versions and job transitions.

Parquet has no MERGE, keys or identity columns. Every change is a function from frames to frames; Store writes the results
as new snapshots and then one manifest that names them, so readers see the old state or the new one, and of writers at the
same time each change counts.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .relational import next_version


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # type: ignore[return-value]


SCHEMAS = {
    "repos": "id bigint, owner string, name string, full_name string, url string, default_branch string, last_commit_sha string, clone_path string, created_at timestamp, updated_at timestamp",
    "documents": "id bigint, repo_id bigint, file_path string, content_hash string, created_at timestamp",
    "settings": "id bigint, key string, value string, updated_at timestamp",
    "wikis": "id bigint, repo_id bigint, version int, title string, description string, structure string, model string, source_type string, generation_duration_ms bigint, status string, created_at timestamp, updated_at timestamp",
    "wiki_pages": "id bigint, wiki_id bigint, page_id string, title string, parent_id string, sort_order int, content string, diagrams string, file_paths string, prompt_tokens bigint, completion_tokens bigint, model string, generation_time_ms bigint, status string, error_message string, created_at timestamp, updated_at timestamp",
    "jobs": "id bigint, type string, repo_id bigint, wiki_id bigint, params string, status string, progress int, progress_message string, total_prompt_tokens bigint, total_completion_tokens bigint, total_cost double, error_message string, started_at timestamp, completed_at timestamp, created_at timestamp",
}
KEYS = {"repos": ["full_name"], "documents": ["repo_id", "file_path"], "settings": ["key"], "wikis": ["id"], "wiki_pages": ["wiki_id", "page_id"], "jobs": ["id"]}
DEFAULTS = {
    "repos": {"default_branch": "main"},
    "wikis": {"source_type": "github", "status": "generating"},
    "wiki_pages": {"sort_order": 0, "status": "pending"},
    "jobs": {"status": "pending", "progress": 0},
}
#: How an upsert of a page treats a column: the new value, or the new one unless it is null. A page that comes without a
#: status is pending again.
PAGE_KEEPS = ("content", "diagrams", "prompt_tokens", "completion_tokens", "model", "generation_time_ms", "error_message")
ACTIVE = ("pending", "processing")


#: New rows that one task numbers at most.
ONE_TASK = 100_000


def with_ids(new: DataFrame, old: DataFrame, order: Sequence[str], key: str = "id", after: int = 0) -> DataFrame:
    """Ids in order after the largest one, and after `after`. Many rows are dealt into ranges of the order, which are
    numbered each after the rows before it."""
    top = max(after, old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0])
    if new.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return new.withColumn(key, F.lit(top).cast("long") + F.row_number().over(Window.orderBy(*order)))
    dealt = new.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    base, starts = top, []
    for part, n in sorted(map(tuple, dealt.groupBy("_range").count().collect())):  # one for each partition
        starts.append((part, base))
        base += n
    known = new.sparkSession.createDataFrame(starts, "_range int, _base long")
    numbered = dealt.join(F.broadcast(known), "_range").withColumn(key, F.col("_base") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.drop("_range", "_base")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Mapping[str, Column] | None = None) -> DataFrame:
    """Old rows with those of equal keys changed, and the new ones. `update` gives changed columns from _o (old) and _n
    (new); without it all columns that the new rows have are replaced. New rows must have distinct keys."""
    cols = old.columns
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in cols])
    o, n = old.alias("_o"), new.withColumn("_new", F.lit(True)).alias("_n")
    both = o.join(n, [F.col(f"_o.{k}").eqNullSafe(F.col(f"_n.{k}")) for k in keys], "full_outer")
    fresh, same = F.col("_n._new").isNotNull(), F.coalesce(*[F.col(f"_o.{k}").isNotNull() for k in keys])
    rules = {c: F.col(f"_n.{c}") for c in cols if c not in keys} if update is None else dict(update)
    out = []
    for c in cols:
        kept = F.col(f"_o.{c}") if c not in rules else F.when(fresh, rules[c]).otherwise(F.col(f"_o.{c}"))
        out.append(F.when(same, kept).otherwise(F.col(f"_n.{c}")).alias(c))
    return both.select(*out)


def coalescing(columns: Sequence[str]) -> dict[str, Column]:
    return {c: F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")) for c in columns}


def page_rules(columns: Sequence[str]) -> dict[str, Column]:
    rules = {c: F.col(f"_n.{c}") for c in columns if c not in ("id", "wiki_id", "page_id", "created_at")}
    rules |= coalescing([c for c in PAGE_KEEPS if c in columns])
    if "status" in columns:
        rules["status"] = F.coalesce(F.col("_n.status"), F.lit("pending"))
    return rules


def insert_version(wikis: DataFrame, row: DataFrame) -> DataFrame:
    """New wikis, each with the next version of its repository."""
    versions = row.select("repo_id").distinct().join(wikis.select("repo_id", "version"), "repo_id", "left")
    numbered = row.drop("version").join(next_version(versions, "repo_id").withColumnRenamed("next_version", "version"), "repo_id")
    return wikis.unionByName(numbered.withColumn("version", F.col("version").cast("int")), allowMissingColumns=True)


def update_by_id(df: DataFrame, ids: int | Sequence[int], values: Mapping[str, object], touch: Column | None = None) -> DataFrame:
    """Rows of the ids with new values; nothing changes, not even the time, without values."""
    if not values:
        return df
    hit = F.col("id").isin([ids] if isinstance(ids, int) else list(ids))
    made = {c: v if isinstance(v, Column) else F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()}
    if touch is not None and "updated_at" in df.columns:
        made["updated_at"] = touch
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in made.items()})


def delete_wikis(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the wikis and their pages; jobs of theirs point nowhere."""
    gone = ids.select(F.col("id").alias("wiki_id")).distinct()
    out = dict(tables)
    out["wikis"] = tables["wikis"].join(gone.withColumnRenamed("wiki_id", "id"), "id", "left_anti").select(*tables["wikis"].columns)
    out["wiki_pages"] = tables["wiki_pages"].join(gone, "wiki_id", "left_anti").select(*tables["wiki_pages"].columns)
    marked = tables["jobs"].join(gone.withColumn("_gone", F.lit(True)), "wiki_id", "left")
    out["jobs"] = marked.withColumn("wiki_id", F.when(F.col("_gone").isNull(), F.col("wiki_id"))).select(*tables["jobs"].columns)
    return out


def delete_repos(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the repositories, their documents, wikis, pages and jobs."""
    gone = ids.select(F.col("id").alias("repo_id")).distinct()
    out = delete_wikis(tables, tables["wikis"].join(gone, "repo_id", "left_semi"))
    for name in ("documents", "jobs"):
        out[name] = out[name].join(gone, "repo_id", "left_anti").select(*tables[name].columns)
    out["repos"] = tables["repos"].join(gone.withColumnRenamed("repo_id", "id"), "id", "left_anti").select(*tables["repos"].columns)
    return out


def delete_paths(documents: DataFrame, repo_id: int, paths: Sequence[str] | DataFrame) -> DataFrame:
    """Documents of a repository without the paths; no path, no change."""
    if isinstance(paths, DataFrame):
        gone = paths.select(F.lit(repo_id).cast("bigint").alias("repo_id"), F.col("file_path")).distinct()
        return documents.join(gone, ["repo_id", "file_path"], "left_anti").select(*documents.columns)
    return documents.where(~((F.col("repo_id") == repo_id) & F.col("file_path").isin(list(paths)))) if paths else documents


def last_of_repo(wikis: DataFrame, wiki_id: int) -> DataFrame:
    """Repositories whose only wiki is this one: deleting it takes them too."""
    return wikis.groupBy("repo_id").agg(F.count("*").alias("n"), F.max("id").alias("last")).where((F.col("n") == 1) & (F.col("last") == wiki_id)).select(F.col("repo_id").alias("id"))


# ---- jobs ----


def oldest_pending(jobs: DataFrame) -> int | None:
    return jobs.where("status = 'pending'").agg(F.min(F.struct("created_at", "id"))["id"]).first()[0]


def claim(jobs: DataFrame, now: Column, job_id: int | None = None) -> DataFrame:
    """Jobs with one pending job started: that of the id, or the oldest; a job that isn't pending is left as it is."""
    one = oldest_pending(jobs) if job_id is None else job_id
    hit = F.coalesce((F.col("id") == F.lit(one).cast("long")) & (F.col("status") == "pending"), F.lit(False))
    return jobs.withColumns({"status": F.when(hit, "processing").otherwise(F.col("status")), "started_at": F.when(hit, now).otherwise(F.col("started_at"))})


def finish(jobs: DataFrame, job_id: int, now: Column, error: str | None = None, prompt: int | None = None, completion: int | None = None, cost: float | None = None) -> DataFrame:
    """The job completed, or failed with an error; a cancelled job stays so."""
    hit = (F.col("id") == job_id) & (F.col("status") != "cancelled")
    values: dict[str, Column] = {"status": F.lit("failed" if error else "completed"), "completed_at": now}
    values |= {"error_message": F.lit(error)} if error else {"progress": F.lit(100)}
    for c, v in (("total_prompt_tokens", prompt), ("total_completion_tokens", completion), ("total_cost", cost)):
        if v is not None:
            values[c] = F.lit(v)
    return jobs.withColumns({c: F.when(hit, v.cast(jobs.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def report(jobs: DataFrame, job_id: int, progress: int, message: str | None = None) -> DataFrame:
    hit = (F.col("id") == job_id) & (F.col("status") == "processing")
    return jobs.withColumns({"progress": F.when(hit, F.lit(progress)).otherwise(F.col("progress")), "progress_message": F.when(hit, F.lit(message)).otherwise(F.col("progress_message"))})


def cancel(jobs: DataFrame, job_id: int | None, now: Column) -> DataFrame:
    """The job cancelled if it is active; all active ones for None, which is the sweep at start-up."""
    hit = F.col("status").isin(*ACTIVE) & (F.lit(True) if job_id is None else F.col("id") == job_id)
    return jobs.withColumns({"completed_at": F.when(hit, now).otherwise(F.col("completed_at")), "status": F.when(hit, "cancelled").otherwise(F.col("status"))})


def safe_to_delete(path: str | None, root: str) -> bool:
    """Whether a folder lies below the root, dots and links resolved."""
    return bool(path) and os.path.realpath(path).startswith(os.path.realpath(root) + "/")


def migrated(name: str, found: DataFrame) -> DataFrame:
    """A table of an older form in today's: columns that went are dropped, new ones have their defaults, and the version of a
    wiki is its place among those of its repository by time."""
    schema = _schema(SCHEMAS[name])
    missing = {f.name: F.lit(DEFAULTS.get(name, {}).get(f.name)).cast(f.dataType) for f in schema if f.name not in found.columns}
    out = found.withColumns(missing) if missing else found
    if name == "wikis" and "version" in missing:
        out = out.withColumn("version", F.row_number().over(Window.partitionBy("repo_id").orderBy("created_at", "id")).cast("int"))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


class Conflict(Exception):
    """Another writer has changed the tables meanwhile."""


#: Times that a change is made anew after another writer's.
TRIES = 20


class Store:
    """Snapshots of the tables under a folder, and manifests that name the snapshot of each table that counts, with the
    largest id that it ever had. A change of several tables writes their snapshots and then one manifest, so readers see
    all of it or nothing. Manifests are numbered; of two writers of the same number the second one makes its change anew
    from what the first has left, so no change is lost."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop

    def _path(self, text: str):
        path = self._hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """The number and content of the newest manifest."""
        path, fs = self._path(f"{self.folder}/manifests")
        found = sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []
        if not found:
            return 0, {}
        stream = fs.open(self._hadoop.fs.Path(path, str(found[-1])))
        try:
            return found[-1], json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def largest_id(self, name: str) -> int:
        return self._manifest()[1].get(name, {}).get("id", 0)

    def read(self, name: str) -> DataFrame:
        """The newest snapshot, with columns that it lacks as nulls or defaults: older snapshots need no migration."""
        schema, own = _schema(SCHEMAS[name]), self._manifest()[1].get(name)
        if own is None:
            return self.spark.createDataFrame([], schema)
        return migrated(name, self.spark.read.parquet(f"{self.folder}/{name}/{own['at']}"))

    def _publish(self, number: int, content: bytes) -> None:
        """The manifest of the number, whole at once, by one writer alone; Conflict for all others. Hadoop's local files are
        looked for and then made or replaced, so of two writers both could succeed: there a hard link is made, which fails
        if the name exists, as renaming does elsewhere."""
        path, fs = self._path(f"{self.folder}/manifests/{number}")
        made, _ = self._path(f"{self.folder}/manifests/.{number}-{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(content))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(made.toUri().getPath(), path.toUri().getPath())
            elif not fs.rename(made, path):
                raise FileExistsError(path.toString())
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, Py4JJavaError) and "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise Conflict(f"a manifest after {number - 1} exists") from e
        finally:
            fs.delete(made, False)

    def commit(self, tables: Mapping[str, DataFrame], number: int | None = None) -> None:
        """New snapshots of the tables, all at once; the ones before stay for readers, older ones go. With the number of the
        manifest that the tables were made from, it raises Conflict if that isn't the newest."""
        newest, manifest = self._manifest()
        number = newest if number is None else number
        if number != newest:
            raise Conflict(f"a manifest after {number} exists")
        after = {k: dict(v) for k, v in manifest.items()}
        for name, df in tables.items():
            at = f"v{number + 1}-{uuid.uuid4().hex[:8]}"
            defaults = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.get(name, {}).items() if c in df.columns}
            df.withColumns(defaults).select(*_schema(SCHEMAS[name]).names).write.parquet(f"{self.folder}/{name}/{at}")
            top = self.spark.read.parquet(f"{self.folder}/{name}/{at}").agg(F.max("id")).first()[0] or 0
            old = manifest.get(name, {})
            after[name] = {"at": at, "before": old.get("at"), "id": max(top, old.get("id", 0))}
        self._publish(number + 1, json.dumps(after).encode())
        for name in tables:
            if gone := manifest.get(name, {}).get("before"):
                path, fs = self._path(f"{self.folder}/{name}/{gone}")
                fs.delete(path, True)

    def write(self, name: str, df: DataFrame) -> None:
        self.commit({name: df})

    def _again(self, make: Callable[[], Mapping[str, DataFrame]]) -> None:
        """Commit what `make` makes of the tables as they are, made anew after another writer's change."""
        for left in range(TRIES - 1, -1, -1):
            number = self._manifest()[0]
            try:
                self.commit(make(), number)
                return
            except Conflict:
                if not left:
                    raise

    def change(self, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        self._again(lambda: {name: f(self.read(name))})

    def upsert(self, name: str, rows: DataFrame, now: Column | None = None) -> None:
        """Rows by the table's key; new ones get ids, defaults and times."""
        self._again(lambda: {name: self._upserted(name, rows, F.current_timestamp() if now is None else now)})

    def _upserted(self, name: str, rows: DataFrame, now: Column) -> DataFrame:
        old, keys = self.read(name), KEYS[name]
        given = [c for c in rows.columns if c not in keys and c != "id"]
        fresh = with_ids(rows.drop("id").join(old.select(*keys), keys, "left_anti"), old, keys, after=self.largest_id(name))
        known = rows.drop("id").join(old.select("id", *keys), keys)
        both = known.unionByName(fresh.select(*known.columns))
        times = {c: now for c in ("created_at", "updated_at") if c in old.columns and c not in rows.columns}
        rules = page_rules(old.columns) if name == "wiki_pages" else {c: F.col(f"_n.{c}") for c in given}
        if "updated_at" in old.columns:
            rules["updated_at"] = F.coalesce(F.col("_n.updated_at"), now)
        return upsert(old, both.withColumns(times), keys, rules)

    def delete_wiki(self, wiki_id: int, clones: str | None = None) -> None:
        """The wiki with its pages, at once with its repository and documents if that has no other. The repository's clone
        goes too if it lies below `clones` and the wiki isn't that of a local folder."""
        ids, paths, local = self.spark.createDataFrame([(wiki_id,)], "id bigint"), [], False

        def without() -> dict[str, DataFrame]:
            nonlocal paths, local
            tables = {n: self.read(n) for n in SCHEMAS}
            alone = last_of_repo(tables["wikis"], wiki_id)
            local = tables["wikis"].where((F.col("id") == wiki_id) & (F.col("source_type") == "local")).count() > 0
            paths = [r[0] for r in tables["repos"].join(alone, "id", "left_semi").select("clone_path").collect()]  # one at most
            after = delete_repos(delete_wikis(tables, ids), alone)
            return {name: after[name] for name in ("repos", "documents", "wikis", "wiki_pages", "jobs")}

        self._again(without)
        for path in paths:
            if clones and not local and safe_to_delete(path, clones):
                shutil.rmtree(path, ignore_errors=True)
