"""Sources and sinks: replayed tables, generators, driver-side ingest and extract, and topics."""

from __future__ import annotations

import os
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tideflow.functions import timestamps
from tideflow.operators.shapes import LateMessage, StreamClosed


def replayed(spark: SparkSession, path: str, schema: T.StructType | str, files_a_batch: int = 1, form: str = "parquet") -> DataFrame:
    """A folder of files as a stream; files_a_batch is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(form).load(path)


def generated(spark: SparkSession, rows: int, ts: Column, data: Column, partitions: int | None = None) -> DataFrame:
    """A source computed where it runs: ts and data are expressions of id, 0 to rows - 1."""
    return spark.range(0, rows, 1, partitions or spark.sparkContext.defaultParallelism).select(F.col("id").alias("seq"), F.lit("d").alias("kind"), ts.alias("ts"), data.alias("data"))


class _Part(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _CounterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.parts = int(options.get("rows", 10)), int(options.get("partitions", 4))

    def partitions(self):
        step = -(-self.rows // self.parts)
        return [_Part(a, min(self.rows, a + step)) for a in range(0, self.rows, step)] if self.rows else [_Part(0, 0)]

    def read(self, partition):
        for n in range(partition.start, partition.end):
            yield (n, "d", n, n)
            yield (n, "w", n, None)


class _CounterStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.rows, self.step = int(options.get("rows", 10)), int(options.get("step", 5))

    def initialOffset(self):
        return {"at": 0}

    def read(self, start):
        end = min(self.rows, start["at"] + self.step)
        return iter(self.readBetweenOffsets(start, {"at": end})), {"at": end}

    def readBetweenOffsets(self, start, end):
        return [r for n in range(start["at"], end["at"]) for r in ((n, "d", n, n), (n, "w", n, None))]

    def commit(self, end):
        pass


class CounterSource(DataSource):
    """``spark.read`` or ``readStream`` format "counter": data n and watermark n at each timestamp n."""

    @classmethod
    def name(cls):
        return "counter"

    def schema(self):
        return "seq bigint, kind string, ts bigint, data bigint"

    def reader(self, schema):
        return _CounterReader(self.options)

    def simpleStreamReader(self, schema):
        return _CounterStream(self.options)


class IngestStream:
    """The driver pushes messages into a folder that a streaming query watches.

    Messages before ``start`` wait in the buffer. ``flush`` writes a file, which is one micro-batch's
    input; order and lateness are checked as they are sent. Timestamps are longs or, with ``coordinates``,
    Timestamp values of any number of coordinates, as in all envelope frames.
    """

    def __init__(self, spark: SparkSession, folder: str, data_type: str, coordinates: bool = False):
        self.spark, self.folder, self.low, self.seq, self.buffer = spark, folder, None, 0, []
        self.coordinates, self.top = coordinates, timestamps.TOP if coordinates else self.TOP
        self.schema = T.StructType.fromDDL(f"seq bigint, kind string, ts {timestamps.TYPE if coordinates else 'bigint'}, data {data_type}")
        os.makedirs(folder, exist_ok=True) if "://" not in folder else None

    TOP = (1 << 63) - 1

    def is_closed(self) -> bool:
        return self.low is not None and self.low == self.top

    def send(self, ts: int | timestamps.Timestamp, data: Any) -> None:
        if self.is_closed():
            raise StreamClosed(self.folder)
        if self.low is not None and ts <= self.low:
            raise LateMessage(f"data at {ts} after watermark {self.low}")
        self._add("d", ts, data)

    def send_watermark(self, ts: int | timestamps.Timestamp) -> None:
        if self.is_closed():
            raise StreamClosed(self.folder)
        if self.low is not None and ts < self.low:
            raise LateMessage(f"watermark {ts} after {self.low}")
        self.low = ts
        self._add("w", ts, None)

    def close(self) -> None:
        self.send_watermark(self.top)
        self.flush()

    def _add(self, kind: str, ts: int | timestamps.Timestamp, data: Any) -> None:
        self.buffer.append((self.seq, kind, ts.row() if self.coordinates else ts, data))
        self.seq += 1

    def flush(self) -> None:
        if self.buffer:
            self.spark.createDataFrame(self.buffer, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
            self.buffer = []

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.folder)


class ExtractStream:
    """The driver pulls what a query produces: read() blocks, try_read() does not.

    At most ``waiting`` unread rows are held; the query waits for the reader beyond that.
    """

    def __init__(self, df: DataFrame, checkpoint: str, available_now: bool = False, name: str | None = None, waiting: int = 1024):
        self.rows: queue.Queue = queue.Queue(waiting)
        self.stopped = threading.Event()

        def put(batch: DataFrame, epoch: int) -> None:
            for row in batch.toLocalIterator():
                while not self.stopped.is_set():
                    try:
                        self.rows.put(row, timeout=0.1)
                        break
                    except queue.Full:
                        continue

        writer = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).queryName(name or f"extract_{uuid.uuid4().hex}")
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()

    def stop(self) -> None:
        """Give up the rest: a query that waits for the reader goes on and ends."""
        self.stopped.set()
        self.query.stop()

    def is_closed(self) -> bool:
        return not self.query.isActive and self.rows.empty()

    def try_read(self):
        """A row or None."""
        try:
            return self.rows.get_nowait()
        except queue.Empty:
            if self.query.exception() is not None:
                raise self.query.exception()
            return None

    def read(self, seconds: float = 60.0):
        """The next row; None once the query has ended and all is read."""
        until = time.monotonic() + seconds
        while time.monotonic() < until:
            row = self.try_read()
            if row is not None or self.is_closed():
                return row
            time.sleep(0.02)
        raise TimeoutError("no message came")

    def __iter__(self) -> Iterator:
        while (row := self.read()) is not None:
            yield row


def from_topic(records: DataFrame, decode: Callable[[Column], Column]) -> DataFrame:
    """A pub/sub stream's records (column value) as envelopes: decode gives array<struct<kind, ts, data>>,
    so one record may become data and watermarks, or nothing."""
    return records.select(F.explode(decode(F.col("value"))).alias("__m")).select("__m.*")


def to_topic(envelopes: DataFrame, encode: Callable[[], Column]) -> DataFrame:
    """Records (value) of data and watermark rows: encode gives an array of values for each row."""
    return envelopes.select(F.explode(encode()).alias("value"))


def publish(df: DataFrame, folder: str, checkpoint: str):
    """Write a stream's records to a folder in micro-batches, each once."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
