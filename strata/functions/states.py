"""Columns over job states and component health."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Engine job state to task status.
TASK_STATUS = {
    "RUNNING": "running",
    "CANCELED": "finished",
    "FAILED": "failed",
    "FINISHED": "finished",
    "CREATED": "submitting",
    "RESTARTING": "running",
    "SUSPENDED": "paused",
    "Failing": "failed",
}

# Task life cycle, status to the statuses that may follow; finished is terminal.
TRANSITIONS = {
    "draft": ("submitting",),
    "submitting": ("running", "failed"),
    "running": ("saving_point", "failed", "finished"),
    "saving_point": ("paused", "running", "failed"),
    "paused": ("submitting", "finished"),
    "failed": ("submitting", "finished"),
    "finished": (),
}


def map_job_state(state) -> Column:
    """Task status of an engine job state; unknown states in lower case."""
    state = F.col(state) if isinstance(state, str) else state
    known = F.create_map(*[F.lit(part) for part in chain.from_iterable(TASK_STATUS.items())])
    return F.coalesce(F.try_element_at(known, state), F.lower(state))


def transition_allowed(before, after) -> Column:
    """Whether the life cycle lets a task go from one status to the other."""
    pairs = [F.struct(F.lit(a), F.lit(b)) for a, targets in TRANSITIONS.items() for b in targets]
    return F.struct(before, after).isin(*pairs)


def overall_status(core_ok: Column, data_ok: Column) -> Column:
    """The core component decides on unhealthy, the data components on degraded."""
    return F.when(~core_ok, "unhealthy").when(~data_ok, "degraded").otherwise("healthy")
