"""Runtime profiles: driver-side trace events, and percentiles over event tables."""

from __future__ import annotations

import csv
import functools
import json
import logging
import sys
import threading
import time
from collections import defaultdict, deque
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

KEPT = 1000


class Trace:
    """Chrome trace events and the last KEPT durations of each event."""

    def __init__(self):
        self.events, self.durations, self.lock = [], defaultdict(lambda: deque(maxlen=KEPT)), threading.Lock()

    def add(self, event: str, start_us: float, duration_us: float, **args) -> None:
        with self.lock:
            self.events.append({"name": event, "ph": "X", "ts": start_us, "dur": duration_us, "pid": 0, "tid": threading.get_ident(), "args": args})
            self.durations[event].append(duration_us)

    def runtime(self, event: str, percentile: float) -> float:
        """Percentile (0 to 100) of the kept durations, by linear interpolation; nan if there are none."""
        kept = self.durations.get(event)
        return float(np.percentile(list(kept), percentile)) if kept else float("nan")

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.events, f)

    def save_csv(self, path: str) -> None:
        with open(path, "w", newline="") as f:
            writer = csv.writer(f)
            writer.writerow(["name", "ts", "dur"])
            writer.writerows((e["name"], e["ts"], e["dur"]) for e in self.events)


class Profile:
    """Context manager that adds one event."""

    def __init__(self, trace: Trace, event: str, **args):
        self.trace, self.event, self.args = trace, event, args

    def __enter__(self):
        self.start, self.clock = time.time(), time.perf_counter()
        return self

    def __exit__(self, *_):
        self.trace.add(self.event, self.start * 1e6, (time.perf_counter() - self.clock) * 1e6, **self.args)


def profiled(trace: Trace, event: str | None = None):
    """Decorator that profiles each call."""

    def wrap(function):
        @functools.wraps(function)
        def run(*args, **kwargs):
            with Profile(trace, event or function.__qualname__):
                return function(*args, **kwargs)

        return run

    return wrap


class BatchTrace(StreamingQueryListener):
    """Adds each micro-batch's trigger time of all queries to a trace."""

    def __init__(self, trace: Trace):
        self.trace = trace

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.trace.add(p.name or str(p.id), time.time() * 1e6, float(p.durationMs.get("triggerExecution", 0)) * 1e3, batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def runtime_percentiles(df: DataFrame, event: str, order: Sequence[str], duration: str, percentile: float, kept: int = KEPT) -> DataFrame:
    """(event, runtime) over the last ``kept`` rows of each event, by linear interpolation."""
    last = Window.partitionBy(event).orderBy(*[F.desc(c) for c in order])
    rows = df.select(event, *order, duration).withColumn("__rn", F.row_number().over(last)).where(F.col("__rn") <= kept)
    return rows.groupBy(event).agg(F.percentile(duration, F.lit(percentile / 100)).alias("runtime"))


def logger(name: str, path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A console logger, or a file logger when a path is given."""
    out = logging.getLogger(name)
    handler = logging.FileHandler(path) if path else logging.StreamHandler(sys.stdout)
    handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s: %(message)s"))
    out.handlers, out.propagate = [handler], False
    out.setLevel(level)
    return out
