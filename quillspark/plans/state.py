"""Queries of changing state: upserts, cascades, job transitions, progress streams, event folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import snapshots as snap
from ..operators.relational import numbered
from ..sources.json_files import events as parsed_events
from ..sources.tables import SQL_CTES, jobs, table
from ..streaming import transitions as tr
from ..streaming.jobs import folded_calls, folded_jobs, progress_reports


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documents after a scan: it lacked a source, had old hashes of a language and keeps what a scan left out."""
    d = table(spark, sf_dir, "documents").select(F.lit(1).cast("long").alias("repo_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.sha2("text", 256).alias("content_hash"), "source", "lang")
    old = d.where("source <> 'src3'").select("repo_id", "file_path", F.when(F.col("lang") == "de", F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    new = d.where("source <> 'src4'").select("repo_id", "file_path", "content_hash")
    return snap.upsert(old, new, ["repo_id", "file_path"]).select("file_path", "content_hash")


def upsert_pages_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages after an upsert: content stays where none is given, a status that isn't given is pending again."""
    li = table(spark, sf_dir, "lineitem")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("line"), F.min("l_partkey").alias("part"))
    key = [F.col("l_orderkey").alias("wiki_id"), F.col("l_linenumber").cast("string").alias("page_id")]
    old = one.where("flag <> 'R'").select(*key, F.concat(F.lit("t"), F.col("part").cast("string")).alias("title"), F.concat(F.lit("c"), F.col("part").cast("string")).alias("content"), F.lit("completed").alias("status"))
    new = one.where("line = 'O' OR flag = 'R'").select(*key, F.concat(F.lit("n"), F.col("part").cast("string")).alias("title"), F.when(F.col("flag") == "A", F.lit("fresh")).alias("content"), F.when(F.col("flag") == "R", F.lit("failed")).alias("status"))
    rules = snap.page_rules(old.columns)
    out = snap.upsert(old, new, ["wiki_id", "page_id"], rules)
    return out.withColumn("status", F.coalesce("status", F.lit("pending")))


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and jobs left after the finished wikis are deleted: pages go, jobs point nowhere."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tables = {
        "wikis": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id")),
        "wiki_pages": li.select(F.col("l_orderkey").alias("wiki_id"), F.col("l_linenumber").alias("sort_order")),
        "jobs": jobs(spark, sf_dir).select(F.col("job_id").alias("id"), F.col("repo_id").alias("wiki_id")),
    }
    out = snap.delete_wikis(tables, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))
    pages = out["wiki_pages"].groupBy("wiki_id").agg(F.count("*").alias("n")).select(F.lit("page").alias("kind"), "wiki_id", "n")
    return pages.union(out["jobs"].groupBy("wiki_id").agg(F.count("*").alias("n")).select(F.lit("job"), "wiki_id", "n"))


def delete_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a repository without the changed paths."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", 1).otherwise(2).cast("long").alias("repo_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), "source")
    gone = d.where("source = 'src3'").select("file_path")
    return snap.delete_paths(d.drop("source"), 1, gone)


def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows numbered after the largest id."""
    new = table(spark, sf_dir, "supplier").select("s_name")
    return snap.with_ids(new, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), ["s_name"])


def cancel_stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).select("job_id", "status", F.lit(None).cast("timestamp").alias("completed_at"))
    out = snap.cancel(j.withColumnRenamed("job_id", "id"), None, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return out.select(F.col("id").alias("job_id"), "status", F.col("completed_at").isNotNull().alias("ended"))


def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the jobs after their transitions; a user's events stand for those of one job."""
    j = numbered(jobs(spark, sf_dir), ["repo_id"], ["created_at", "job_id"], "seq")
    return folded_jobs(j.select(F.col("repo_id").alias("job_id"), "seq", "status", F.floor(F.col("value")).cast("long").alias("progress")))


#: Limits of the query's steps: its events are hours apart.
STEP_LIMITS = {"outline": 90_000, "page": 180_000}


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions and time-outs of jobs. A user's events of three days ask for those of one job, many of them in vain."""
    e = table(spark, sf_dir, "events")
    kind, value, n = F.col("event_type"), F.col("value"), F.col("event_id")
    asked = (
        F.when(kind == "signup", "create").when(kind == "click", "claim").when((kind == "purchase") & (value > 80), "complete")
        .when((kind == "error") & (value > 100), "fail").when((kind == "error") & (n % 7 == 0), "cancel").when(kind != "error", "progress").otherwise("other")
    )
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")  # whatever the session's zone
    day = F.floor(ms / 259_200_000)
    events = e.select(
        (F.col("user_id") * 100_000 + day).cast("long").alias("job_id"), n.alias("seq"), F.timestamp_millis(ms).alias("at"), asked.alias("kind"),
        F.when(n % 5 == 0, None).when(n % 2 == 0, "page").otherwise("outline").alias("step"), F.when(n % 3 > 0, F.floor(value % 100)).cast("int").alias("progress"), F.when(n % 4 > 0, kind).alias("message"),
    )
    out = tr.job_transitions(events, limits=STEP_LIMITS)
    return out.select("job_id", "seq", F.unix_millis("at").alias("at_ms"), "status", "progress", "message")


def progress_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener hears of the jobs."""
    j = numbered(jobs(spark, sf_dir).where("status <> 'cancelled'"), ["repo_id"], ["created_at", "job_id"], "seq")
    polls = j.select(F.col("repo_id").alias("job_id"), "seq", F.when(F.col("status") == "completed", F.lit("processing")).otherwise(F.col("status")).alias("status"), F.floor(F.col("value") / 50).cast("long").alias("progress"), F.lit("m").alias("message"))
    return progress_reports(polls).select("job_id", "seq", "status", "progress")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of calls, a conversation each: both shapes of events, and lines that don't parse."""
    c = table(spark, sf_dir, "conversations")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    n = F.length("text")
    item = F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("agent_message").alias("type"), F.col("text")).alias("item")))
    turn = F.to_json(F.struct(F.lit("turn.completed").alias("type"), F.struct(n.alias("input_tokens"), (n * 2).alias("output_tokens"), (n - 1).alias("cached_input_tokens")).alias("usage")))
    message = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("message")))
    lines = F.array(F.lit("not json"), F.when(F.col("role") == "assistant", message).otherwise(item), F.lit(""), turn)
    one = c.select(F.col("conv_id").alias("request"), seq.alias("s"), F.posexplode(lines).alias("i", "value"))
    return one.select("request", (F.col("s") * 10 + F.col("i")).alias("seq"), "value")


def jsonl_stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of calls from their event lines."""
    out = folded_calls(parsed_events(_lines(spark, sf_dir)))
    return out.select("request", F.sha2("text", 256).alias("text_hash"), "input_tokens", "output_tokens", "cached_tokens", "is_error")


QUERIES = {f.__name__: f for f in (upsert_documents, upsert_pages_coalesce, delete_cascade, delete_paths, next_ids, cancel_stale_jobs, job_state_fold, job_transitions, progress_change_events, jsonl_stream_fold)}

SQL = {
    "upsert_documents": "SELECT source || '/' || doc_id AS file_path, CASE WHEN source = 'src4' AND lang = 'de' THEN 'old' ELSE sha256(text) END AS content_hash FROM documents",
    "upsert_pages_coalesce": """WITH o AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, max(l_linestatus) AS line, min(l_partkey) AS part FROM lineitem GROUP BY ALL)
        SELECT l_orderkey AS wiki_id, l_linenumber::VARCHAR AS page_id, CASE WHEN line = 'O' OR flag = 'R' THEN 'n' ELSE 't' END || part AS title, CASE WHEN flag = 'R' THEN NULL WHEN flag = 'A' AND line = 'O' THEN 'fresh' ELSE 'c' || part END AS content,
        CASE WHEN flag = 'R' THEN 'failed' WHEN line = 'O' THEN 'pending' ELSE 'completed' END AS status FROM o""",
    "delete_cascade": f"""WITH {SQL_CTES}, gone AS (SELECT wiki_id FROM wikis WHERE status = 'F')
        SELECT 'page' AS kind, wiki_id, count(*) AS n FROM pages_ WHERE wiki_id NOT IN (SELECT wiki_id FROM gone) GROUP BY ALL UNION ALL SELECT 'job', w, count(*) FROM (SELECT CASE WHEN repo_id NOT IN (SELECT wiki_id FROM gone) THEN repo_id END AS w FROM jobs) GROUP BY w""",
    "delete_paths": "SELECT CASE lang WHEN 'en' THEN 1 ELSE 2 END::BIGINT AS repo_id, source || '/' || doc_id AS file_path FROM documents WHERE NOT (lang = 'en' AND source = 'src3')",
    "next_ids": "SELECT s_name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name) AS id FROM supplier",
    "cancel_stale_jobs": f"WITH {SQL_CTES} SELECT job_id, CASE WHEN status IN ('pending', 'processing') THEN 'cancelled' ELSE status END AS status, status IN ('pending', 'processing') AS ended FROM jobs",
    "job_state_fold": f"""WITH {SQL_CTES}, j AS (SELECT repo_id, status, floor(value)::BIGINT AS progress, row_number() OVER (PARTITION BY repo_id ORDER BY created_at, job_id) AS seq FROM jobs)
        SELECT repo_id AS job_id, coalesce(arg_min(status, seq) FILTER (status IN ('completed', 'failed', 'cancelled')), arg_max(status, seq)) AS status, max(CASE WHEN status = 'completed' THEN 100 ELSE progress END)::BIGINT AS progress, count(*) AS n_events FROM j GROUP BY repo_id""",
    # one event of each job at a time: first its time-out, then the transition if its status admits it
    "job_transitions": """WITH RECURSIVE e AS (SELECT user_id * 100000 + (epoch_us(ts) // 1000) // 259200000 AS job_id, event_id AS seq, (epoch_us(ts) // 1000) AS tms,
            CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'click' THEN 'claim' WHEN event_type = 'purchase' AND value > 80 THEN 'complete' WHEN event_type = 'error' AND value > 100 THEN 'fail'
                WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'cancel' WHEN event_type <> 'error' THEN 'progress' END AS kind,
            CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'page' ELSE 'outline' END AS step, CASE WHEN event_id % 3 > 0 THEN floor(value % 100)::INTEGER END AS p, CASE WHEN event_id % 4 > 0 THEN event_type END AS m FROM events),
        o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY tms, seq) AS k FROM e), horizon AS (SELECT max(tms) AS t FROM e),
        r AS (SELECT DISTINCT job_id, 0::BIGINT AS k, NULL::VARCHAR AS status, 0::INTEGER AS progress, NULL::VARCHAR AS message, NULL::VARCHAR AS step, NULL::BIGINT AS due, NULL::BIGINT AS late, NULL::BIGINT AS seq, NULL::BIGINT AS tms FROM e
            UNION ALL SELECT job_id, k, coalesce(made, held), CASE WHEN made = 'completed' THEN 100 WHEN made IS NOT NULL THEN coalesce(p, progress) ELSE progress END,
                CASE WHEN made IS NOT NULL THEN m WHEN late IS NOT NULL THEN step || ': nothing heard for ' || (CASE step WHEN 'page' THEN 180000 ELSE 90000 END) || ' s' ELSE message END,
                CASE WHEN made = 'processing' THEN next_step WHEN made IS NULL AND late IS NULL THEN step END,
                CASE WHEN made = 'processing' THEN tms + (CASE next_step WHEN 'page' THEN 180000000 WHEN 'outline' THEN 90000000 END) WHEN made IS NULL AND late IS NULL THEN due END,
                late, CASE WHEN made IS NOT NULL THEN seq END, tms
            FROM (SELECT *, CASE WHEN kind = 'create' AND held IS NULL THEN 'pending' WHEN kind = 'claim' AND held = 'pending' THEN 'processing' WHEN kind = 'progress' AND held = 'processing' THEN 'processing' WHEN kind = 'complete' AND held = 'processing' THEN 'completed'
                    WHEN kind = 'fail' AND held IN ('pending', 'processing') THEN 'failed' WHEN kind = 'cancel' AND held IN ('pending', 'processing') THEN 'cancelled' END AS made
                FROM (SELECT r.job_id, o.k, r.progress, r.message, r.step, r.due, o.seq, o.tms, o.kind, o.step AS next_step, o.p, o.m, CASE WHEN r.due <= o.tms THEN r.due END AS late, CASE WHEN r.due <= o.tms THEN 'failed' ELSE r.status END AS held
                    FROM r JOIN o ON r.job_id = o.job_id AND o.k = r.k + 1) x) y),
        ended AS (SELECT *, lead(k) OVER (PARTITION BY job_id ORDER BY k) AS after, lag(progress) OVER (PARTITION BY job_id ORDER BY k) AS before, lag(step) OVER (PARTITION BY job_id ORDER BY k) AS waited FROM r),
        out_ AS (SELECT job_id, seq, tms AS at_ms, status, progress, message FROM ended WHERE seq IS NOT NULL
            UNION ALL SELECT job_id, NULL, late, 'failed', before, waited || ': nothing heard for ' || (CASE waited WHEN 'page' THEN 180000 ELSE 90000 END) || ' s' FROM ended WHERE late IS NOT NULL
            UNION ALL SELECT job_id, NULL, due, 'failed', progress, step || ': nothing heard for ' || (CASE step WHEN 'page' THEN 180000 ELSE 90000 END) || ' s' FROM ended WHERE after IS NULL AND due <= (SELECT t FROM horizon))
        SELECT * FROM out_""",
    "progress_change_events": f"""WITH {SQL_CTES}, j AS (SELECT repo_id, CASE status WHEN 'completed' THEN 'processing' ELSE status END AS status, floor(value / 50)::BIGINT AS progress, row_number() OVER (PARTITION BY repo_id ORDER BY created_at, job_id) AS seq FROM jobs WHERE status <> 'cancelled'),
        e AS (SELECT *, min(seq) FILTER (status = 'failed') OVER (PARTITION BY repo_id) AS stop, lag(status || progress) OVER (PARTITION BY repo_id ORDER BY seq) AS before FROM j)
        SELECT repo_id AS job_id, seq, status, progress FROM e WHERE (stop IS NULL OR seq <= stop) AND before IS DISTINCT FROM status || progress""",
    "jsonl_stream_fold": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations)
        SELECT conv_id AS request, sha256(text) AS text_hash, length(text) AS input_tokens, length(text) * 2 AS output_tokens, length(text) - 1 AS cached_tokens, false AS is_error FROM c WHERE k = 1""",
}
