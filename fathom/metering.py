"""What the steps of a run cost: time, tasks, memory, spill, shuffle and skew of their Spark jobs, as a table beside the results.

Jobs that start within a step carry a tag. When the step ends, the figures of their stages are read from the driver's
status store, which Spark keeps whether its web interface is on or not: a row a stage, whatever the data.

Defined results: a step without jobs has zeros, and null for the largest memory and the skew; frames are lazy, so a
frame's cost belongs to the step whose action asks for it; a stage that an earlier job has run already counts once, where it ran;
steps within steps count in both; a step that raises has its row, with ``failed``; stages that the store has already
let go (``spark.ui.retainedStages``) are counted in ``n_lost`` and missing in the sums.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
#: How long to wait for the last events of a step, in milliseconds.
PATIENCE = 30_000
SCHEMA = (
    "run int, step string, failed boolean, seconds double, n_jobs int, n_stages int, n_lost int, n_tasks long, n_failed_tasks long, task_seconds double, cpu_seconds double, gc_seconds double, "
    "input_bytes long, output_bytes long, shuffle_read_bytes long, shuffle_write_bytes long, memory_spilled_bytes long, disk_spilled_bytes long, largest_task_memory_bytes long, skew double"
)
#: Sums over stages: our name, the store's, and by what to divide.
_SUMS = {
    "n_tasks": ("numTasks", 1), "n_failed_tasks": ("numFailedTasks", 1), "task_seconds": ("executorRunTime", 1e3), "cpu_seconds": ("executorCpuTime", 1e9), "gc_seconds": ("jvmGcTime", 1e3),
    "input_bytes": ("inputBytes", 1), "output_bytes": ("outputBytes", 1), "shuffle_read_bytes": ("shuffleReadBytes", 1), "shuffle_write_bytes": ("shuffleWriteBytes", 1),
    "memory_spilled_bytes": ("memoryBytesSpilled", 1), "disk_spilled_bytes": ("diskBytesSpilled", 1),
}
#: Stages with fewer tasks, or whose slowest task is shorter, say nothing about skew.
SKEW_TASKS, SKEW_MS = 4, 100


class Meter:
    """``with meter.step("train"): ...`` adds a row; ``table()`` has one row a step that has ended, in order."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._rows: list[dict[str, Any]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        context, tag, start, failed = self.spark.sparkContext, f"fathom-{uuid.uuid4().hex}", time.time(), True
        context.addJobTag(tag)
        try:
            yield
            failed = False
        finally:
            context.removeJobTag(tag)
            row = {"run": len(self._rows) + 1, "step": name, "failed": failed, "seconds": time.time() - start} | self._read(tag, start)
            self._rows.append(row)
            log.info("%s: %.1f s, %d tasks, %d bytes shuffled, %d spilled, largest task %s bytes", name, row["seconds"], row["n_tasks"], row["shuffle_write_bytes"], row["disk_spilled_bytes"], row["largest_task_memory_bytes"])

    def table(self) -> DataFrame:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in self._rows], SCHEMA)

    def _read(self, tag: str, start: float) -> dict[str, Any]:
        context = self.spark.sparkContext
        core, jvm = context._jsc.sc(), context._jvm
        core.listenerBus().waitUntilEmpty(PATIENCE)  # the end of the last job is told to the store a moment after the action returns
        store, jobs = core.statusStore(), list(core.statusTracker().getJobIdsForTag(tag))
        quantiles = context._gateway.new_array(jvm.double, 2)
        quantiles[0], quantiles[1] = 0.5, 1.0
        known, lost = set(), 0
        for job in jobs:
            ids = store.job(job).stageIds()
            known.update(ids.apply(k) for k in range(ids.size()))
        out: dict[str, Any] = dict.fromkeys(_SUMS, 0.0)
        memory, skews, ran = [], [], 0
        for stage in sorted(known):
            attempts = store.stageData(stage, False, jvm.java.util.ArrayList(), True, quantiles)
            lost += attempts.size() == 0
            for k in range(attempts.size()):
                one = attempts.apply(k)
                at = one.submissionTime()
                if at.isEmpty() or at.get().getTime() < int(start * 1000):  # skipped, or run before
                    continue
                ran += 1
                for name, (theirs, unit) in _SUMS.items():
                    out[name] += getattr(one, theirs)() / unit
                if one.taskMetricsDistributions().isDefined():
                    spread = one.taskMetricsDistributions().get()
                    memory.append(int(spread.peakExecutionMemory().apply(1)))
                    median, most = (spread.executorRunTime().apply(q) for q in (0, 1))
                    if one.numTasks() >= SKEW_TASKS and most >= SKEW_MS:
                        skews.append(most / max(median, 1.0))
        sums = {n: v if n.endswith("seconds") else int(v) for n, v in out.items()}
        return sums | {"n_jobs": len(jobs), "n_stages": ran, "n_lost": lost, "largest_task_memory_bytes": max(memory, default=None), "skew": max(skews, default=None)}


def metered(method):
    """A method of an object with a ``meter`` as a step of its own name."""

    @wraps(method)
    def inner(self, *args, **options):
        with self.meter.step(method.__name__):
            return method(self, *args, **options)

    return inner
