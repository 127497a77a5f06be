"""Loops: a stream fed back to an earlier operator, unrolled by Spark."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LoopStream:
    """A placeholder in a program; ``connect`` closes it. An unconnected loop cannot run."""

    def __init__(self, start: DataFrame):
        self.start, self.step = start, None

    def connect(self, step: Callable[[DataFrame], DataFrame]) -> LoopStream:
        self.step = step
        return self

    def run(self, most: int) -> DataFrame:
        if self.step is None:
            raise ValueError("the loop is not connected")
        return iterate(self.start, self.step, most)


def iterate(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """All rows that come by: start, step(start), ... until a round is empty or ``most`` rounds.

    Each round is checkpointed to the session's shared folder, so the plan does not grow.
    """
    context = start.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    rounds, now = [start], start
    for _ in range(most):
        now = step(now).checkpoint(eager=True)
        if now.isEmpty():
            break
        rounds.append(now)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def counter(spark: SparkSession, last: int) -> DataFrame:
    """(ts, data): the loop that adds 1 to timestamp and data, from (0, 0), as one recursive query."""
    return spark.sql(f"WITH RECURSIVE loop(ts, data) MAX RECURSION LEVEL {int(last) + 1} AS (SELECT 0L, 0L UNION ALL SELECT ts + 1, data + 1 FROM loop WHERE ts < {int(last)}) SELECT ts, data FROM loop").select(F.col("ts"), F.col("data"))
