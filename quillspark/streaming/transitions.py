"""Jobs as a stateful stream: guarded transitions and time-outs, with a batch form by the same operator.

An event asks for a transition of a job: create, claim, progress, complete, fail or cancel. A job is created once, claimed
while it is pending, reports while it is processing, and nothing follows its end; a cancelled job stays cancelled. Events of
a job count in the order of (at, seq), each once. While a job is processing, its last event's step names what it waits for;
a job that is silent for the step's limit is failed, once, at the moment the limit ends.

By event time, events wait in the state until the watermark has passed them, so their order of arrival has no influence:
the stream emits what a replay of all events in order does. By arrival, events take effect at once, late ones (not after
the job's last one) say nothing, and limits run by the clock. A batch comes sorted, so nothing waits: a task replays its
jobs one after the other by the same rules, and holds the job at hand alone.

State is one value for a job, and its waiting events; an ended job's state goes RETAIN_MS after its end.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds that calls to a model may take, by step.
OUTLINE_SECONDS, PAGE_SECONDS = 600, 1200
LIMITS = {"outline": OUTLINE_SECONDS, "page": PAGE_SECONDS}
TERMINAL = ("completed", "failed", "cancelled")
#: Milliseconds that an ended job's state stays, to know its repeated events.
RETAIN_MS = 86_400_000

#: The status after an event, and those (None: no such job) in which it counts.
NEXT = {
    "create": ("pending", (None,)),
    "claim": ("processing", ("pending",)),
    "progress": ("processing", ("processing",)),
    "complete": ("completed", ("processing",)),
    "fail": ("failed", ("pending", "processing")),
    "cancel": ("cancelled", ("pending", "processing")),
}
EVENT = "job_id long, seq long, at timestamp, kind string, step string, progress int, message string"
TRANSITION = "job_id long, seq long, at_ms long, status string, progress int, message string"
_TRANSITION = pa.schema([("job_id", pa.int64()), ("seq", pa.int64()), ("at_ms", pa.int64()), ("status", pa.string()), ("progress", pa.int32()), ("message", pa.string())])


class Event(NamedTuple):
    at: int
    seq: int
    kind: str | None
    step: str | None
    progress: int | None
    message: str | None


class Job(NamedTuple):
    status: str
    progress: int
    message: str | None
    at: int
    seq: int
    step: str | None
    due: int | None


STATE = "status string, progress int, message string, at long, seq long, step string, due long"


def timed_out(job: Job | None, until: int, limits: Mapping[str, int]) -> Job | None:
    """The job failed, if its limit ended by then."""
    if job is None or job.due is None or job.due > until:
        return None
    return job._replace(status="failed", message=f"{job.step}: nothing heard for {limits[job.step or '']} s", at=job.due, step=None, due=None)


def advanced(job: Job | None, e: Event, limits: Mapping[str, int], now: int | None = None) -> Job | None:
    """The job after an event, or None if the event doesn't count. `now` is the clock that limits run by, else the event's."""
    status, sources = NEXT.get(e.kind or "", ("", ()))
    if (None if job is None else job.status) not in sources or (job is not None and (e.at, e.seq) <= (job.at, job.seq)):
        return None
    before = job.progress if job else 0
    progress = 100 if status == "completed" else before if e.progress is None else e.progress
    waits = status == "processing" and e.step in limits
    return Job(status, progress, e.message, e.at, e.seq, e.step if waits else None, (e.at if now is None else now) + 1000 * limits[e.step] if waits else None)


def replayed(batches: Iterator[pa.RecordBatch], limits: Mapping[str, int], horizon: int) -> Iterator[pa.RecordBatch]:
    """TRANSITION rows of events that come sorted by job_id, at_ms and seq; jobs that are silent at `horizon` are failed."""
    key, job, last = None, None, None
    out: list[tuple] = []

    def note(seq: int | None, new: Job) -> None:
        out.append((key, seq, new.at, new.status, new.progress, new.message))

    def packed() -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else [()] * len(_TRANSITION)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _TRANSITION, strict=True)], schema=_TRANSITION)
        out.clear()
        return batch

    for b in batches:
        for own, *rest in zip(*(b.column(c).to_pylist() for c in ("job_id", "at_ms", *Event._fields[1:])), strict=True):
            e = Event(*rest)
            if own != key:
                if late := timed_out(job, horizon, limits):
                    note(None, late)
                key, job, last = own, None, None
            if last is not None and e[:2] < last:
                raise RuntimeError("a batch's events must come in order")
            last = e[:2]
            if late := timed_out(job, e.at, limits):
                job = late
                note(None, job)
            if new := advanced(job, e, limits):
                job = new
                note(e.seq, job)
        yield packed()
    if late := timed_out(job, horizon, limits):
        note(None, late)
    yield packed()


class JobTransitions(StatefulProcessor):
    """`clock`: "event" (events wait for the watermark) or "arrival" (they count at once)."""

    def __init__(self, clock: str, limits: Mapping[str, int], retain: int = RETAIN_MS):
        self.clock, self.limits, self.retain = clock, dict(limits), retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        if self.clock == "event":
            self.waiting = handle.getMapState("waiting", "at long, seq long", "kind string, step string, progress int, message string")

    def _read(self) -> Job | None:
        return Job(*self.job.get()) if self.job.exists() else None

    def _write(self, job: Job | None) -> None:
        if job is None:
            return
        self.job.update(tuple(job))
        until = job.at + self.retain if job.status in TERMINAL else job.due
        if until is not None:
            self.handle.registerTimer(until)

    @staticmethod
    def _rows(key: tuple, out: list[tuple[int | None, Job]]) -> pd.DataFrame:
        cols = {"job_id": [key[0]] * len(out), "seq": pd.array([s for s, _ in out], "Int64"), "at_ms": [j.at for _, j in out], "status": [j.status for _, j in out]}
        return pd.DataFrame(cols | {"progress": [j.progress for _, j in out], "message": [j.message for _, j in out]})

    def _apply(self, job: Job | None, events: list[Event], until: int | None, now: int | None = None) -> tuple[Job | None, list[tuple[int | None, Job]]]:
        """The job after the events and time-outs, and the transitions with the numbers of their events."""
        out: list[tuple[int | None, Job]] = []
        for e in events:
            if late := timed_out(job, e.at if now is None else now, self.limits):
                job = late
                out.append((None, job))
            if new := advanced(job, e, self.limits, now):
                job = new
                out.append((e.seq, job))
        if until is not None and (late := timed_out(job, until, self.limits)):
            job = late
            out.append((None, job))
        return job, out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.clock == "event":
            for part in rows:
                for e in _events(part):
                    if not self.waiting.containsKey((e.at, e.seq)):
                        self.waiting.updateValue((e.at, e.seq), (e.kind, e.step, e.progress, e.message))
                        self.handle.registerTimer(e.at)
            return
        now, job = timerValues.getCurrentProcessingTimeInMs(), self._read()
        for part in rows:
            job, out = self._apply(job, sorted(_events(part), key=lambda e: (e.at, e.seq)), now, now)
            if out:
                yield self._rows(key, out)
        self._write(job)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() if self.clock == "event" else expiredTimerInfo.getExpiryTimeInMs()
        job, events = self._read(), []
        if self.clock == "event":
            ready = sorted(k for k in self.waiting.keys() if k[0] <= until)
            events = [Event(at, seq, *self.waiting.getValue((at, seq))) for at, seq in ready]
            for k in ready:
                self.waiting.removeKey(k)
        elif job is not None and job.due is not None:
            until = max(until, min(timerValues.getCurrentProcessingTimeInMs(), job.due))
        job, out = self._apply(job, events, until)
        if job is not None and job.status in TERMINAL and not out and job.at + self.retain <= until:
            self.job.clear()
        elif out:
            self._write(job)
            yield self._rows(key, out)

    def close(self) -> None:
        pass


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _events(part: pd.DataFrame) -> list[Event]:
    text = lambda x: None if pd.isna(x) else x
    return [Event(int(r.at_ms), int(r.seq), text(r.kind), text(r.step), _whole(r.progress), text(r.message)) for r in part.itertuples(index=False)]


def _timed(transitions: DataFrame) -> DataFrame:
    return transitions.select("job_id", "seq", F.timestamp_millis("at_ms").alias("at"), "status", "progress", "message")


def _keyed(events: DataFrame) -> DataFrame:
    """Events that name a job, a time and a place in its order; the others say nothing."""
    return events.where("job_id IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL").select("job_id", "seq", "at", "kind", "step", "progress", "message", F.unix_millis("at").alias("at_ms"))


def job_transitions(events: DataFrame, clock: str = "event", delay: str = "10 minutes", limits: Mapping[str, int] = LIMITS, retain: int = RETAIN_MS) -> DataFrame:
    """job_id, seq (null: a time-out), at, status, progress and message of the transitions that count. A stream of EVENT
    gives a stream, by the watermark or by arrival. A batch is replayed in order, up to the time of its last event. The
    stream needs the RocksDB state store."""
    if events.isStreaming:
        own = _keyed(events.withWatermark("at", delay) if clock == "event" else events)
        mode = "eventTime" if clock == "event" else "processingTime"
        return _timed(own.groupBy("job_id").transformWithStateInPandas(JobTransitions(clock, limits, retain=retain), TRANSITION, "append", mode))
    own = _keyed(events)
    horizon = own.agg(F.max("at_ms")).first()[0]
    ordered = own.drop("at").repartition("job_id").sortWithinPartitions("job_id", "at_ms", "seq")
    return _timed(ordered.mapInArrow(lambda batches: replayed(batches, limits, horizon), TRANSITION))


def current_jobs(transitions: DataFrame) -> DataFrame:
    """The state of each job after its transitions (a batch of them, with a column `place` that orders those of a job)."""
    last = F.max_by(F.struct("status", "progress", "message", "at"), "place")
    return transitions.groupBy("job_id").agg(last.alias("j"), F.count("*").alias("n_transitions")).select("job_id", "j.*", "n_transitions")
