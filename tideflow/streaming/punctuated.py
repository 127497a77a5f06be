"""Explicit watermarks on a running query.

Spark's own watermark is the largest event time less a delay, one batch late; a program's explicit
watermark needs state of its own. Each stream key holds its watermark and the data it still has to
close; rows of a micro-batch are taken in order of seq. State is in RocksDB, a map with an
entry for each open timestamp, so a task holds the data of one timestamp, not all open data of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CloseBatches(StatefulProcessor):
    """Emits (stream, batch, ts, data) for the data that a watermark closes; late rows come out with batch -1.

    Timestamps are one-dimensional longs here; Top is the largest long.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.low = handle.getValueState("low", "ts long")
        self.open = handle.getMapState("open", "ts long", "data array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        low = self.low.get()[0] if self.low.exists() else None
        columns, late, new = ["stream", "batch", "ts", "data"], [], {}

        def kept() -> None:
            for ts, data in new.items():
                old = list(self.open.getValue((ts,))[0]) if self.open.containsKey((ts,)) else []
                self.open.updateValue((ts,), (old + data,))
            new.clear()

        for kind, ts, data in zip(batch.kind, batch.ts, batch.data):
            ts = int(ts)
            if kind == "d":
                if low is not None and ts <= low:
                    late.append((key[0], -1, ts, data))
                else:
                    new.setdefault(ts, []).append(float(data))
            elif low is None or ts > low:
                low = ts
                kept()
                for at in sorted(k[0] for k in self.open.keys() if k[0] <= ts):
                    yield pd.DataFrame([(key[0], ts, at, d) for d in self.open.getValue((at,))[0]], columns=columns)
                    self.open.removeKey((at,))
        kept()
        if low is not None:
            self.low.update((low,))
        yield pd.DataFrame(late, columns=columns)

    def close(self) -> None:
        pass


Seen = dict[str, tuple[int, bool]]


class Timers(StatefulProcessor):
    """Processing-time deadlines. A timestamp's timer is armed when ``starts`` first holds and disarmed when
    ``ends`` does; the handler's row (ts, missed) comes out when it fires first.

    Both see what has come for the timestamp so far: by stream the number of messages, and whether its
    watermark is out. By default data on one of the read streams starts a deadline, and the watermarks of
    all write streams end it. The duration may depend on the messages that start it. Resolution is the
    trigger interval; ``deadlines.audit`` is exact.
    """

    def __init__(self, milliseconds: int | Callable[[pd.DataFrame], int], reads: Sequence[str], writes: Sequence[str], starts: Callable[[Seen], bool] | None = None, ends: Callable[[Seen], bool] | None = None):
        self.milliseconds = milliseconds
        self.starts = starts or (lambda seen: any(seen.get(s, (0, False))[0] for s in reads))
        self.ends = ends or (lambda seen: all(seen.get(s, (0, False))[1] for s in writes))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "due long")
        self.seen = handle.getMapState("seen", "stream string", "messages long, watermark boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        for (stream, kind), n in batch.groupby(["stream", "kind"]).size().items():
            messages, watermark = self.seen.getValue((stream,)) if self.seen.containsKey((stream,)) else (0, False)
            self.seen.updateValue((stream,), (int(messages) + int(n) * (kind == "d"), bool(watermark or kind == "w")))
        seen = {k[0]: (int(v[0]), bool(v[1])) for k, v in self.seen.iterator()}
        due = self.armed.get()[0] if self.armed.exists() else None
        if self.ends(seen):
            if due is not None and due >= 0:
                self.handle.deleteTimer(due)
            self.armed.update((-1,))  # ended: later messages of the timestamp start nothing
        elif due is None and self.starts(seen):
            lasts = self.milliseconds(batch) if callable(self.milliseconds) else self.milliseconds
            due = timerValues.getCurrentProcessingTimeInMs() + int(lasts)
            self.handle.registerTimer(due)
            self.armed.update((due,))
        yield pd.DataFrame({"ts": [], "missed": []}).astype({"ts": "int64", "missed": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.armed.update((-1,))
        yield pd.DataFrame({"ts": [int(key[0])], "missed": [True]})

    def close(self) -> None:
        pass


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def closed_batches(df: DataFrame, stream: str = "stream") -> DataFrame:
    """df: stream, seq, kind, ts long, data double, as a streaming frame."""
    use_rocksdb(df.sparkSession)
    return df.groupBy(stream).transformWithStateInPandas(CloseBatches(), "stream string, batch long, ts long, data double", "Append", "None")


def deadline_timers(
    df: DataFrame,
    milliseconds: int | Callable[[pd.DataFrame], int],
    reads: Sequence[str] = ("in",),
    writes: Sequence[str] = ("in",),
    starts: Callable[[Seen], bool] | None = None,
    ends: Callable[[Seen], bool] | None = None,
) -> DataFrame:
    """df: ts long, kind, and stream if there are several, as a streaming frame; rows (ts, missed) when a timestamp's deadline passes.

    Without a column ``stream`` all messages are of one stream, "in", whose watermark ends a deadline.
    """
    use_rocksdb(df.sparkSession)
    rows = df if "stream" in df.columns else df.withColumn("stream", F.lit("in"))
    return rows.groupBy("ts").transformWithStateInPandas(Timers(milliseconds, reads, writes, starts, ends), "ts long, missed boolean", "Append", "ProcessingTime")
