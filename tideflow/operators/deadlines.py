"""Timestamp deadlines, audited in batch; ``streaming.punctuated.deadline_timers`` arms them on a running query.

A deadline starts for a timestamp when its start condition first holds on a constrained input
(default: the first message), lasts a duration that may depend on the row, and is missed unless
its end condition (default: the release, the watermark for the timestamp on ALL constrained outputs)
holds in time. An operator arms a deadline only if the deadline constrains all streams it reads.
Deadlines are keyed by (deadline, timestamp), so several timestamps can be pending at once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Deadline:
    """duration: an interval Column, or seconds; it may use the start rows' columns."""

    name: str
    duration: Column | float
    read_streams: frozenset[str] = field(default_factory=frozenset)
    write_streams: frozenset[str] = field(default_factory=frozenset)
    start_condition: Column | None = None
    end_condition: Column | None = None

    def on_read_stream(self, *streams: str) -> Deadline:
        return self._with(read_streams=self.read_streams | set(streams))

    def on_write_stream(self, *streams: str) -> Deadline:
        return self._with(write_streams=self.write_streams | set(streams))

    def with_start_condition(self, condition: Column) -> Deadline:
        """condition: an aggregate over the timestamp's messages, e.g. count(*) >= 2."""
        return self._with(start_condition=condition)

    def with_end_condition(self, condition: Column) -> Deadline:
        """condition: over a row with release, ts and the start's columns; true where the work is done."""
        return self._with(end_condition=condition)

    def _with(self, **changes) -> Deadline:
        return Deadline(**{**self.__dict__, **changes})

    @property
    def interval(self) -> Column:
        return F.make_dt_interval(secs=F.lit(float(self.duration))) if isinstance(self.duration, (int, float)) else self.duration


def starts(deadline: Deadline, messages: DataFrame, keys: tuple[str, ...] = ("ts",), reads: Iterable[str] | None = None) -> DataFrame:
    """(keys, start, and the first message's columns) for each timestamp whose start condition holds.

    reads: the streams that the operator reads; unless the deadline constrains them all, nothing starts.
    A column ``stream`` of the messages tells their stream; those of other streams do not count.
    """
    if not deadline.read_streams:
        raise ValueError(f"deadline {deadline.name} constrains no read stream and could never start")
    if reads is not None and not deadline.read_streams >= set(reads):
        messages = messages.limit(0)
    if "stream" in messages.columns:
        messages = messages.where(F.col("stream").isin(*sorted(deadline.read_streams)))
    rest = [c for c in messages.columns if c not in (*keys, "seq", "arrival")]
    condition = deadline.start_condition if deadline.start_condition is not None else F.first(F.lit(True))
    first = messages.groupBy(*keys).agg(F.min_by(F.struct("arrival", *rest), F.struct("seq", "arrival")).alias("__first"), condition.alias("__starts"))
    return first.where("__starts").select(*keys, F.col("__first.arrival").alias("start"), *[F.col(f"__first.{c}").alias(c) for c in rest])


def released(deadline: Deadline, releases: DataFrame, keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(keys, release): when the last of the constrained outputs has released a timestamp; null while one has not.

    An output's first release of a timestamp counts. Without a column ``stream`` all releases are one output's.
    """
    if "stream" not in releases.columns or not deadline.write_streams:
        return releases.groupBy(*keys).agg(F.min("release").alias("release"))
    of = releases.where(F.col("stream").isin(*sorted(deadline.write_streams))).groupBy(*keys, "stream").agg(F.min("release").alias("release"))
    return of.groupBy(*keys).agg(F.when(F.count("release") == len(deadline.write_streams), F.max("release")).alias("release"))


def audit(deadline: Deadline, messages: DataFrame, releases: DataFrame, keys: tuple[str, ...] = ("ts",), reads: Iterable[str] | None = None) -> DataFrame:
    """(keys, start, due, release, missed) of each started deadline.

    messages: keys, seq, arrival, columns the duration may use, and stream if there are several.
    releases: keys, release, and stream if there are several.
    """
    begun = starts(deadline, messages, keys, reads).withColumn("due", F.col("start") + deadline.interval)
    joined = begun.join(released(deadline, releases, keys), list(keys), "left")
    ended = deadline.end_condition if deadline.end_condition is not None else F.lit(True)
    in_time = F.coalesce((F.col("release") <= F.col("due")) & ended, F.lit(False))
    return joined.select(*keys, "start", "due", "release", (~in_time).alias("missed"))


def misses(deadline: Deadline, messages: DataFrame, releases: DataFrame, keys: tuple[str, ...] = ("ts",), reads: Iterable[str] | None = None) -> DataFrame:
    """The rows for which the handler runs."""
    return audit(deadline, messages, releases, keys, reads).where("missed").drop("missed")
