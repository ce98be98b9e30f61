"""Job and event streams: folds, change-only progress, a claiming worker; each has a batch form that replays equally."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import changes_only
from ..operators.snapshots import Store, cancel, claim, finish, oldest_pending, report
from ..sources.json_files import message_text
from .cancel import Cancelled, run_job
from .transitions import TERMINAL

#: Progress reports of the change-only stream.
REPORT = "job_id long, seq long, status string, progress long, message string"


def folded_jobs(transitions: DataFrame) -> DataFrame:
    """State of each job after its transitions (job_id, seq, status, progress). A cancelled job stays cancelled, and no
    transition follows a terminal one. An aggregate: works in batch and, in update mode, on streams."""
    seq, status = F.col("seq"), F.col("status")
    ended = F.min(F.when(status.isin(*TERMINAL), F.struct(seq, status)))
    last = F.max_by(status, seq)
    progress = F.max(F.when(status == "completed", F.lit(100)).otherwise(F.col("progress")))
    return transitions.groupBy("job_id").agg(F.coalesce(ended["status"], last).alias("status"), progress.cast("long").alias("progress"), F.count("*").alias("n_events"))


def progress_reports(polls: DataFrame, order: str = "seq") -> DataFrame:
    """What a listener hears of polled jobs: reports that differ from the one before, until a terminal one."""
    shown = polls.withColumn("progress", F.when(F.col("status") == "completed", F.lit(100)).otherwise(F.col("progress")))
    ended = F.min(F.when(F.col("status").isin(*TERMINAL), F.col(order)))
    until = shown.groupBy("job_id").agg(ended.alias("_end"))
    open_ = shown.join(until, "job_id").where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")
    return changes_only(open_, "job_id", [order], ["status", "progress", "message"])


def stream_progress_reports(polls: DataFrame) -> DataFrame:
    """progress_reports() of a stream: the last report of each job is its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            if last and last[0] in TERMINAL:
                break
            now = (r.status, 100 if r.status == "completed" else int(r.progress), r.message)
            if now != last:
                out.append((key[0], r.seq, *now))
                last = now
        if last:
            state.update(last)
        yield pd.DataFrame(out, columns=["job_id", "seq", "status", "progress", "message"])

    return polls.groupBy("job_id").applyInPandasWithState(run, REPORT, "status string, progress long, message string", "append", GroupStateTimeout.NoTimeout)


def folded_calls(events: DataFrame, key: str = "request", order: str = "seq") -> DataFrame:
    """Result of each call from its events (column e): the last text or result, the last usage, cost, time, errors.
    Messages with their own usage and items with the usage of a turn are read alike."""
    e, at = F.col("e"), F.col(order)
    kind = e["type"]
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when & value.isNotNull(), at))
    item = (kind == "item.completed") & (e["item"]["type"] == "agent_message") & (F.coalesce(e["item"]["text"], F.lit("")) != "")
    own = F.when(kind == "assistant", F.nullif(message_text(e), F.lit(""))).when(kind == "result", e["result"]).when(item, e["item"]["text"])
    usage = e["usage"]
    tokens = lambda *names: sum((F.coalesce(usage[n], F.lit(0)) for n in names), F.lit(0).cast("long"))
    used = kind.isin("result", "turn.completed") & usage.isNotNull()
    failed = (kind == "error") | (kind == "turn.failed") | F.coalesce(e["is_error"], F.lit(False))
    why = F.coalesce(e["error"]["message"], e["message"])
    return events.groupBy(key).agg(
        last(own, own.isNotNull()).alias("text"),
        last(tokens("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"), used).alias("input_tokens"),
        last(tokens("output_tokens"), used).alias("output_tokens"),
        last(tokens("cached_input_tokens"), used).alias("cached_tokens"),
        last(e["total_cost_usd"], kind == "result").alias("cost_usd"),
        last(e["duration_api_ms"], kind == "result").alias("duration_ms"),
        F.max(failed).alias("is_error"),
        last(why, failed).alias("error"),
    )


class Worker:
    """Takes pending jobs of a store one at a time, oldest first, and hands them to a function; polls every second. A job
    that is cancelled while it runs is stopped within about `watch` seconds, Spark actions included."""

    def __init__(self, store: Store, handle: Callable[[dict], dict], now: Callable[[], Column] = F.current_timestamp, watch: float = 0.5):
        self.store, self.handle, self.now, self.watch = store, handle, now, watch
        store.change("jobs", lambda j: cancel(j, None, now()))  # what an earlier run left behind

    def step(self) -> bool:
        """Run one job; False if none was pending."""
        own = oldest_pending(self.store.read("jobs"))
        if own is None:
            return False
        self.store.change("jobs", lambda j: claim(j, self.now(), own))
        one = self.store.read("jobs").where((F.col("id") == own) & (F.col("status") == "processing")).collect()
        if not one:  # no longer pending when it was claimed
            return True
        try:
            tell = lambda done, message=None: self.store.change("jobs", lambda j: report(j, own, done, message))
            row = {**one[0].asDict(), "cancelled": lambda: self.cancelled(own), "report": tell}
            done = run_job(self.store.spark, own, lambda: self.handle(row), lambda: self.cancelled(own), self.watch)
            self.store.change("jobs", lambda j: finish(j, own, self.now(), None, done.get("prompt"), done.get("completion"), done.get("cost")))
        except Cancelled:  # its row says so
            pass
        except Exception as e:
            self.store.change("jobs", lambda j: finish(j, own, self.now(), str(e) or type(e).__name__))
        return True

    def cancelled(self, job_id: int) -> bool:
        """Whether the job was cancelled meanwhile: work asks between its parts, and stops."""
        return self.store.read("jobs").where((F.col("id") == job_id) & (F.col("status") == "cancelled")).count() > 0

    def run(self, polls: int, wait: float = 1.0) -> int:
        n = 0
        for _ in range(polls):
            if self.step():
                n += 1
            else:
                time.sleep(wait)
        return n


def file_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
