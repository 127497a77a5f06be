"""User-defined operators: callbacks on data and watermarks, over Spark partitions.

Sequential shapes see one key's log in the order (ts, watermark after data of its timestamp, seq):
rows are hash-partitioned by key, sorted, and streamed through the callbacks in Arrow batches, so a
task holds one batch and the operator's own state. Parallel shapes have no order between data of
different timestamps, so they are what Spark does best: a grouped aggregate for each timestamp
(``parallel``), with map-side partial sums.

Life of a sequential operator, once a key: setup(context), run(context), the callbacks, the end of
the log as watermark Top if the log had none, destroy(). Watermarks flow on after on_watermark unless
the configuration says otherwise; then the state is committed.
"""

from __future__ import annotations

import functools
import itertools
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.functions.messages import DATA, WATERMARK
from tideflow.functions.timestamps import BOTTOM, TOP, TYPE, Timestamp
from tideflow.operators import deadlines


@dataclass(frozen=True)
class OperatorConfig:
    """name, whether watermarks flow, and a free node hint that Spark's scheduler does not need."""

    name: str = "operator"
    flow_watermarks: bool = True
    node_id: int = 0


class SendError(Exception):
    """A message that its stream cannot take."""


class StreamClosed(SendError):
    """The stream has sent Top."""


class LateMessage(SendError):
    """Data at or below the stream's watermark, or a watermark below it."""


class ReadError(Exception):
    """A stream that has nothing more to read: it has sent Top."""


class TryReadError(ReadError):
    """As ReadError, of a read that does not wait."""


class ReadStream:
    """An input port inside ``run``: the key's messages in order, taken one at a time."""

    def __init__(self, messages: Iterator):
        self.messages, self.closed = messages, False

    def is_closed(self) -> bool:
        return self.closed

    def read(self):
        """The next Message; the last one is Top, after which reading is an error."""
        if self.closed:
            raise ReadError("the stream has sent Top")
        message = next(self.messages)
        self.closed = message.is_top_watermark()
        return message

    def try_read(self):
        """read() without waiting; in a batch all messages are there."""
        if self.closed:
            raise TryReadError("the stream has sent Top")
        return self.read()


class WriteStream:
    """An output port inside an operator: checks the order of what is sent."""

    def __init__(self, port: str):
        self.port, self.low, self.rows = port, BOTTOM, []

    def is_closed(self) -> bool:
        return self.low == TOP

    def send(self, timestamp: Timestamp, data: Any) -> None:
        if self.is_closed():
            raise StreamClosed(self.port)
        if timestamp <= self.low:
            raise LateMessage(f"{self.port}: data at {timestamp.key} after watermark {self.low.key}")
        self.rows.append((self.port, DATA, timestamp.row(), data))

    def send_watermark(self, timestamp: Timestamp) -> None:
        if self.is_closed():
            raise StreamClosed(self.port)
        if timestamp < self.low:
            raise LateMessage(f"{self.port}: watermark {timestamp.key} after {self.low.key}")
        self.low = timestamp
        self.rows.append((self.port, WATERMARK, timestamp.row(), None))


class TimeVersionedState:
    """A version for each timestamp, made by ``default`` on first use."""

    def __init__(self, default: Callable[[], Any] = lambda: None):
        self.default, self.versions, self.last_committed_timestamp = default, {}, BOTTOM

    def at(self, timestamp: Timestamp) -> Any:
        if timestamp not in self.versions:
            self.versions[timestamp] = self.default()
        return self.versions[timestamp]

    def commit(self, timestamp: Timestamp) -> None:
        self.last_committed_timestamp = max(self.last_committed_timestamp, timestamp)

    def evict_until(self, timestamp: Timestamp) -> None:
        """Drop versions up to the lesser of timestamp and the last commit."""
        until = min(timestamp, self.last_committed_timestamp)
        self.versions = {t: v for t, v in self.versions.items() if t > until}


@dataclass
class Context:
    """What a callback sees."""

    config: OperatorConfig
    state: TimeVersionedState
    timestamp: Timestamp = BOTTOM
    write_stream: WriteStream | None = None
    left_write_stream: WriteStream | None = None
    right_write_stream: WriteStream | None = None
    deadlines: list = field(default_factory=list)
    read_stream: ReadStream | None = None

    def current_state(self) -> Any:
        return self.state.at(self.timestamp)

    def set_current_state(self, value: Any) -> None:
        self.state.versions[self.timestamp] = value

    def past_state(self, timestamp: Timestamp) -> Any:
        """The version at exactly ``timestamp`` if that is committed, else None."""
        return self.state.at(timestamp) if timestamp <= self.state.last_committed_timestamp else None

    def last_committed_timestamp(self) -> Timestamp:
        return self.state.last_committed_timestamp

    def add_deadline(self, deadline) -> None:
        """For setup: ``missed`` audits the deadlines that operators add there."""
        self.deadlines.append(deadline)


class Operator:
    """Base of the sequential shapes. ``state`` makes a version's default; ``retain`` is a number of
    committed versions to keep, None for all."""

    ports: tuple[str, ...] = ()
    retain: int | None = None
    #: Whether run() reads the input itself, from context.read_stream; callbacks then see what it left.
    reads: bool = False

    def state(self) -> Any:
        return None

    def setup(self, context: Context) -> None:
        pass

    def run(self, context: Context) -> None:
        pass

    def on_watermark(self, context: Context) -> None:
        pass

    def destroy(self) -> None:
        pass


class Sink(Operator):
    """on_data and on_watermark without output, for external effects: ``run_sink`` and, on streams, ``start_sink``."""

    def on_data(self, context: Context, data: Any) -> None:
        pass


class OneInOneOut(Operator):
    ports = ("out",)

    def on_data(self, context: Context, data: Any) -> None:
        pass


class TwoInOneOut(Operator):
    ports = ("out",)

    def on_left_data(self, context: Context, data: Any) -> None:
        pass

    def on_right_data(self, context: Context, data: Any) -> None:
        pass


class OneInTwoOut(Operator):
    ports = ("left", "right")

    def on_data(self, context: Context, data: Any) -> None:
        pass


class Source:
    """run yields Messages; the log ends with Top."""

    def run(self) -> Iterator:
        raise NotImplementedError

    def destroy(self) -> None:
        pass


def _plain(value: Any) -> Any:
    return value.asDict(recursive=True) if hasattr(value, "asDict") else value


class _Running:
    """One key's operator and its streams."""

    def __init__(self, make: Callable[[], Operator], config: OperatorConfig):
        self.operator, self.config = make(), config
        ports = {p: WriteStream(p) for p in self.operator.ports}
        self.streams = list(ports.values())
        self.context = Context(config, TimeVersionedState(self.operator.state), write_stream=ports.get("out"), left_write_stream=ports.get("left"), right_write_stream=ports.get("right"))
        self.lows: dict[str, Timestamp] = {}
        self.low, self.order = BOTTOM, []
        self.operator.setup(self.context)
        if not self.operator.reads:
            self.operator.run(self.context)

    def read(self, messages: Iterator) -> Iterator:
        """Let run() read; the messages that it left."""
        from tideflow.functions.messages import Message

        def ended() -> Iterator:
            top = False
            for m in messages:
                top = m.is_top_watermark()
                yield m
            if not top:
                yield Message.new_watermark(TOP)

        self.context.read_stream = ReadStream(ended())
        self.operator.run(self.context)
        while not self.context.read_stream.is_closed():
            yield self.context.read_stream.read()

    def take(self, side: str, inputs: tuple[str, ...], kind: str, ts: Timestamp, data: Any) -> None:
        if self.low == TOP:
            return
        if kind == DATA:
            self.context.timestamp = ts
            getattr(self.operator, "on_data" if len(inputs) == 1 else f"on_{side}_data")(self.context, data)
            return
        self.lows[side] = max(self.lows.get(side, BOTTOM), ts)
        low = min(self.lows.get(i, BOTTOM) for i in inputs)
        if low > self.low:
            self.low = self.context.timestamp = low
            self.operator.on_watermark(self.context)
            for stream in self.streams if self.config.flow_watermarks else ():
                if not stream.is_closed() and low >= stream.low:
                    stream.send_watermark(low)
            self.context.state.commit(low)
            if self.operator.retain is not None:
                self.order.append(low)
                if len(self.order) > self.operator.retain:
                    self.context.state.evict_until(self.order.pop(0))

    def end(self, inputs: tuple[str, ...]) -> None:
        for side in inputs:
            self.take(side, inputs, WATERMARK, TOP, None)
        self.operator.destroy()
        for stream in self.streams:
            if not stream.is_closed():
                stream.send_watermark(TOP)

    def rows(self) -> list[tuple]:
        out = [r for s in self.streams for r in s.rows]
        for s in self.streams:
            s.rows = []
        return out


def connect(make: Callable[[], Operator], *inputs: DataFrame, data_type: str, key: str | None = None, config: OperatorConfig = OperatorConfig()) -> DataFrame:
    """Rows (key, port, kind, ts, data) that a sequential operator sends.

    inputs: one envelope frame, or left and right ones. ``key`` names a column whose values have an
    operator each; without it the stream is one log on one task, as a sequential operator demands.
    Data of a timestamp that is late for the operator (at or below its watermark) must be gated before.
    """
    example = make()
    wanted = 2 if isinstance(example, TwoInOneOut) else 1
    if not isinstance(example, Operator):
        raise TypeError("an operator derives from one of the shapes")
    if len(inputs) != wanted:
        raise TypeError(f"{type(example).__name__} takes {wanted} input(s)")
    base = next(b for b in (Sink, OneInOneOut, TwoInOneOut, OneInTwoOut, Operator) if isinstance(example, b))
    names = ("on_data", "on_left_data", "on_right_data", "on_watermark", "run")
    if all(getattr(type(example), n, None) is getattr(base, n, None) for n in names):
        warnings.warn(f"{type(example).__name__} overrides no callback", stacklevel=2)
    sides = ("in",) if wanted == 1 else ("left", "right")
    own = F.col(key).cast("string") if key else F.lit("")
    frames = []
    for side, df in zip(sides, inputs):
        frames.append(df.select(own.alias("key"), F.lit(side).alias("side"), "seq", "kind", "ts", (F.struct("data") if wanted == 1 else F.struct(F.col("data").alias(side))).alias("data")))
    if wanted == 1:
        rows = frames[0].select("key", "side", "seq", "kind", "ts", "data.data")
    else:
        left, right = frames
        kinds = [f.schema["data"].dataType[s].dataType for f, s in zip(frames, sides)]
        rows = left.select("key", "side", "seq", "kind", "ts", F.col("data.left").alias("data"), F.lit(None).cast(kinds[1]).alias("data2")).unionByName(right.select("key", "side", "seq", "kind", "ts", F.lit(None).cast(kinds[0]).alias("data"), F.col("data.right").alias("data2")))
    mark = F.when(F.col("kind") == DATA, 0).otherwise(1)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width if key else 1, "key").sortWithinPartitions("key", "ts", mark, "seq", "side")
    names = ["key", "port", "kind", "ts", "data"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For operators whose run() reads: a key's rows are its messages."""
        from tideflow.functions.messages import Message

        flat = (row for batch in batches for row in batch.itertuples(index=False))
        for own, rows in itertools.groupby(flat, key=lambda row: row.key):
            now = _Running(make, config)
            messages = (Message(Timestamp.of({"k": r.ts["k"], "c": r.ts["c"]}), None if r.kind == WATERMARK else _plain(r.data), r.kind == WATERMARK) for r in rows)
            for m in now.read(messages):
                now.take(sides[0], sides, WATERMARK if m.watermark else DATA, m.timestamp, m.data)
            now.end(sides)
            yield pd.DataFrame([(own, port, kind, {"k": ts[0], "c": ts[1]}, data) for port, kind, ts, data in now.rows()], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, now = None, None

        def sent(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([(own, port, kind, {"k": ts[0], "c": ts[1]}, data) for port, kind, ts, data in rows], columns=names)

        for batch in batches:
            for row in batch.itertuples(index=False):
                if now is None or row.key != own:
                    if now is not None:
                        now.end(sides)
                        yield sent(now.rows())
                    own, now = row.key, _Running(make, config)
                ts = Timestamp.of({"k": row.ts["k"], "c": row.ts["c"]})
                now.take(row.side, sides, row.kind, ts, _plain(row.data2 if row.side == "right" else row.data))
            if now is not None:
                yield sent(now.rows())
        if now is not None:
            now.end(sides)
            yield sent(now.rows())

    if example.reads and wanted != 1:
        raise TypeError("run() reads one input")
    return dealt.mapInPandas(read if example.reads else run, f"key string, port string, kind string, ts {TYPE}, data {data_type}")


def run_sink(make: Callable[[], Sink], df: DataFrame, key: str | None = None, config: OperatorConfig = OperatorConfig()) -> None:
    """Run a sink for its effects over an envelope frame, once for each key."""
    connect(make, df, data_type="string", key=key, config=config).write.format("noop").mode("overwrite").save()


def start_sink(make: Callable[[], Sink], df: DataFrame, checkpoint: str, key: str | None = None, config: OperatorConfig = OperatorConfig(), **trigger):
    """Run a sink over a streaming envelope frame, by micro-batches; returns the query.

    Each micro-batch is a log of its own: a sink lives from setup to destroy in it, once a key. A batch
    that is repeated after a failure has its effects again, so they should be idempotent.
    """
    writer = df.writeStream.foreachBatch(lambda batch, epoch: run_sink(make, batch, key, config)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def deadlines_of(make: Callable[[], Operator], config: OperatorConfig = OperatorConfig()) -> list:
    """The deadlines that an operator adds in its setup."""
    operator = make()
    context = Context(config, TimeVersionedState(operator.state))
    operator.setup(context)
    return context.deadlines


def missed(make: Callable[[], Operator], inputs: dict[str, DataFrame], outputs: dict[str, DataFrame], keys: tuple[str, ...] = ("ts",), config: OperatorConfig = OperatorConfig()) -> DataFrame:
    """(deadline, keys, start, due, release): the misses of the deadlines that an operator adds in its setup.

    inputs: by stream the messages (keys, seq, arrival, ..); outputs: by stream the releases (keys, release).
    """
    messages = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("stream", F.lit(n)) for n, df in inputs.items()])
    releases = functools.reduce(DataFrame.unionByName, [df.select(*keys, "release", F.lit(n).alias("stream")) for n, df in outputs.items()])
    found = [deadlines.misses(d, messages, releases, keys, reads=inputs).select(F.lit(d.name).alias("deadline"), *keys, "start", "due", "release") for d in deadlines_of(make, config)]
    if not found:
        raise ValueError("the operator adds no deadline")
    return functools.reduce(DataFrame.unionByName, found)


def connect_source(spark, source: Source, data_type: str, rows: int = 50_000) -> DataFrame:
    """A driver-side source's messages, ended by Top; the driver holds ``rows`` of them at a time.

    More than that are written to the session's checkpoint folder as they come.
    """
    from tideflow.functions.messages import Message, frame

    log, last = iter(source.run()), None
    seq, folder = 0, None

    def messages() -> Iterator:
        nonlocal last
        for last in log:
            yield last
        if last is None or not last.is_top_watermark():
            yield Message.new_watermark(TOP)

    stream = messages()
    part = list(itertools.islice(stream, rows))
    rest = list(itertools.islice(stream, rows))
    if rest:
        context = spark.sparkContext
        base = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", "")
        if not base:
            raise ValueError("a source of many messages needs spark.checkpoint.dir")
        folder = f"{base}/source-{uuid.uuid4().hex}"
    while part:
        now = frame(spark, part, data_type)
        if folder is None:
            source.destroy()
            return now
        now.withColumn("seq", F.col("seq") + F.lit(seq)).coalesce(1).write.mode("append").parquet(folder)
        seq += len(part)
        part, rest = rest, list(itertools.islice(stream, rows))
    source.destroy()
    return spark.read.parquet(folder)


def port(rows: DataFrame, name: str) -> DataFrame:
    """One output of an operator's rows. Persist the rows first if both outputs are used."""
    return rows.where(F.col("port") == name).drop("port")


def parallel(df: DataFrame, *appends: Column, keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The parallel shapes: data callbacks append to their timestamp's state in any order, which is a
    commutative aggregate; the watermark callback sees the finished version, which is its row."""
    return df.where(F.col("kind") == DATA).groupBy(*keys).agg(*appends)


def parallel_two(left: DataFrame, right: DataFrame, *appends: Column, keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Parallel two-in-one-out: rows of both sides are told apart by the column side."""
    rows = left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")), allowMissingColumns=True)
    return parallel(rows, *appends, keys=keys)


def parallel_ports(df: DataFrame, ports: dict[str, Column], *appends: Column, keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Parallel one-in-two-out: a row goes to each port whose predicate holds, in one pass."""
    sides = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in ports.items()]))
    rows = df.withColumn("port", F.explode(sides))
    return parallel(rows, *appends, keys=(*keys, "port")) if appends else rows
