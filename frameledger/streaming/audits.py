"""Audits as a stream's state: leases that are extended or end, deadlines that fail what is pending, retention that drops an audit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DEADLINE, EXHAUSTED, UNREADABLE = "job_deadline_exceeded", "attempts_exhausted", "unreadable"
PENDING, COMPLETE = "pending", "complete"
ACTIVE = ("queued", "running")


@dataclass(frozen=True)
class Limits:
    """Milliseconds of a lease, of a claim's work and of a result's retention; claims an audit may have; its images."""

    lease: int
    deadline: int
    retention: int
    attempts: int
    images: int


@dataclass
class Audit:
    """An audit between two events; times are milliseconds, -1 for none. ``images`` says of each place pending, complete or its error."""

    status: str = "queued"
    attempts: int = 0
    owner: str | None = None
    until: int = -1
    deadline: int = -1
    completed: int = -1
    error: str | None = None
    deleted: int = 0
    images: dict[int, str] = field(default_factory=dict)

    def close(self, at: int, error: str | None = None) -> None:
        """Ends the audit; with an error what is pending gets it."""
        if error:
            self.images = {k: error if v == PENDING else v for k, v in self.images.items()}
        done = [v == COMPLETE for v in self.images.values()]
        self.status = "complete" if all(done) else "partial" if any(done) else "failed"
        self.error, self.completed, self.owner, self.until, self.deadline = error, at, None, -1, -1

    def pass_time(self, now: int, limits: Limits) -> None:
        """What has happened before ``now`` without an event: a deadline or the end of a lease, whichever is first, and the end of retention."""
        if self.status == "running" and self.deadline <= self.until and self.deadline < now:
            self.close(self.deadline, DEADLINE)
        elif self.status == "running" and self.until < now:
            self.status, self.owner, self.until, self.deadline = "queued", None, -1, -1
        if self.status not in ACTIVE and self.completed + limits.retention < now:
            self.__init__(deleted=self.deleted + 1, images=dict.fromkeys(range(limits.images), PENDING))

    def event(self, kind: str, worker: str, position: int, at: int, limits: Limits) -> None:
        """An event, once :meth:`pass_time` is up to it. Only a lease's owner extends it, reports images and finishes."""
        if kind == "claim":
            if self.status == "queued" and self.attempts >= limits.attempts:
                self.close(at, EXHAUSTED)
            elif self.status == "queued":
                self.status, self.attempts, self.owner, self.until, self.deadline = "running", self.attempts + 1, worker, at + limits.lease, at + limits.deadline
        elif self.status == "running" and self.owner == worker:
            if kind == "extend":
                self.until = at + limits.lease
            elif kind in ("done", "failed") and self.images.get(position) == PENDING:
                self.images[position] = COMPLETE if kind == "done" else UNREADABLE
            elif kind == "finish" and PENDING not in self.images.values():
                self.close(at)

    def next_due(self, limits: Limits) -> int | None:
        """When time alone changes it next."""
        if self.status == "running":
            return min(self.deadline, self.until) + 1
        return self.completed + limits.retention + 1 if self.status not in ACTIVE else None


_SCALARS = [f.name for f in fields(Audit) if f.name != "images"]
_STATE = "status string, attempts int, owner string, until long, deadline long, completed long, error string, deleted int"


class AuditProcessor(StatefulProcessor):
    """Keeps an audit's own values and its images as two states, and one timer for what comes next."""

    def __init__(self, limits: Limits, key_type: str):
        self.limits, self.key_type = limits, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.audit = handle.getValueState("audit", _STATE)
        self.images = handle.getMapState("images", "position int", "state string")

    def _load(self) -> Audit:
        if not self.audit.exists():
            return Audit(images=dict.fromkeys(range(self.limits.images), PENDING))
        return Audit(**dict(zip(_SCALARS, self.audit.get(), strict=True)), images={k[0]: v[0] for k, v in self.images.iterator()})

    def _store(self, key: tuple, audit: Audit, before: dict[int, str] | None) -> Iterator[pd.DataFrame]:
        self.audit.update(tuple(getattr(audit, n) for n in _SCALARS))
        for position, state in audit.images.items():
            if before is None or before.get(position) != state:
                self.images.updateValue((position,), (state,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = audit.next_due(self.limits)
        if due is not None:
            self.handle.registerTimer(due)
        states = ",".join(audit.images[k] for k in sorted(audit.images))
        row = {"audit_id": [key[0]], "status": [audit.status], "attempts": [audit.attempts], "error": pd.Series([audit.error], dtype=object), "images": [states], "deleted": [audit.deleted]}
        yield pd.DataFrame(row)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        audit = self._load()
        before = dict(audit.images) if self.audit.exists() else None
        for at, _, kind, worker, position in sorted(row for part in rows for row in zip(part["ms"], part["seq"], part["kind"], part["worker"], part["position"], strict=True)):
            audit.pass_time(int(at), self.limits)
            audit.event(kind, worker, int(position), int(at), self.limits)
        yield from self._store(key, audit, before)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        audit = self._load()
        before = dict(audit.images)
        audit.pass_time(timerValues.getCurrentWatermarkInMs(), self.limits)
        yield from self._store(key, audit, before)

    def close(self) -> None:
        pass


def audit_states(events: DataFrame, limits: Limits) -> DataFrame:
    """(audit_id, status, attempts, error, images, deleted), a row whenever an audit may have changed.

    Events are (audit_id, seq, at, kind, worker, position): claim, extend, done, failed, finish. ``at`` is event time, which also
    moves the timers; ``seq`` orders what is of one time. The state is bounded by an audit's images, however many events it has, and a deleted
    audit starts anew.
    """
    kind = dict(events.dtypes)["audit_id"]
    rows = events.withWatermark("at", "0 seconds").select("audit_id", "seq", "kind", "worker", "position", "at", F.unix_millis("at").alias("ms"))
    schema = f"audit_id {kind}, status string, attempts int, error string, images string, deleted int"
    return rows.groupBy("audit_id").transformWithStateInPandas(AuditProcessor(limits, kind), schema, "Update", "EventTime")
