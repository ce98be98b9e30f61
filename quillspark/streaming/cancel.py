"""Work of a job that a cancellation stops: its Spark actions carry the job's tag and are interrupted by it."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

R = TypeVar("R")


class Cancelled(Exception):
    """The job was cancelled while it ran."""


def tag_of(job_id: int) -> str:
    return f"job-{job_id}"


@contextmanager
def tagged(spark: SparkSession, job_id: int) -> Iterator[None]:
    """What this thread runs within it, and threads that inherit its properties, belongs to the job."""
    spark.sparkContext.addJobTag(tag_of(job_id))
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag_of(job_id))


def interrupt(spark: SparkSession, job_id: int) -> None:
    """Stop the job's running Spark actions, and no others."""
    spark.sparkContext.cancelJobsWithTag(tag_of(job_id))


def run_job(spark: SparkSession, job_id: int, work: Callable[[], R], cancelled: Callable[[], bool], every: float = 0.2) -> R:
    """The result of `work`, which runs in a thread of its own under the job's tag. Once the job is cancelled, its actions
    are interrupted, again as long as new ones start, and Cancelled is raised when the work has ended."""
    out: list[R] = []
    failed: list[BaseException] = []

    def run() -> None:
        try:
            with tagged(spark, job_id):
                out.append(work())
        except BaseException as e:  # handed to the caller's thread
            failed.append(e)

    thread = threading.Thread(target=inheritable_thread_target(spark)(run), name=tag_of(job_id), daemon=True)
    thread.start()
    stopped = False
    while thread.is_alive():
        thread.join(every)
        if thread.is_alive() and (stopped or cancelled()):
            stopped = True
            interrupt(spark, job_id)
    if stopped:
        raise Cancelled(f"job {job_id} was cancelled") from (failed[0] if failed else None)
    if failed:
        raise failed[0]
    return out[0]
