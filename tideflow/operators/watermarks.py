"""Explicit watermarks over an envelope log: lateness, flow, minima and batching.

A watermark t closes t: later data with ts <= t is late, a later watermark below t is rejected and
an equal one changes nothing; Top closes the stream. ``seq`` orders a stream's log. A log is
sequential by nature, yet its running maximum is not: it is taken in buckets of ``bucket`` sequence
numbers, the buckets' maxima are accumulated (one row a bucket), and each bucket is then a window
partition of its own, so no task sees a whole stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.functions import timestamps
from tideflow.functions.messages import is_data, is_watermark

BUCKET = 100_000


def running_maxima(df: DataFrame, values: dict[str, Column], stream: Sequence[str] = (), bucket: int = BUCKET, inclusive: bool = False) -> DataFrame:
    """df with, by name, the maximum of each value over the stream's earlier rows (and the row itself if inclusive), in one pass."""
    held = {name: f"__value_{k}" for k, name in enumerate(values)}
    rows = df.withColumns({"__bucket": F.floor(F.col("seq") / F.lit(bucket)).cast("bigint")} | {held[n]: v for n, v in values.items()})
    keys = [*stream, "__bucket"]
    sums = rows.groupBy(*keys).agg(*[F.max(h).alias(f"{h}_most") for h in held.values()])
    before = Window.partitionBy(*stream).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, *[F.max(f"{h}_most").over(before).alias(f"{h}_before") for h in held.values()])
    inside = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = _null_safe(rows, sums, keys).withColumns({n: F.greatest(f"{h}_before", F.max(h).over(inside)) for n, h in held.items()})
    return joined.drop("__bucket", *held.values(), *[f"{h}_before" for h in held.values()])


def running_maximum(df: DataFrame, value: Column, name: str, stream: Sequence[str] = (), bucket: int = BUCKET, inclusive: bool = False) -> DataFrame:
    """df with the maximum of ``value`` over the stream's earlier rows (and the row itself if inclusive)."""
    return running_maxima(df, {name: value}, stream, bucket, inclusive)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, condition, "inner").drop(*[f"__r_{k}" for k in keys])


def gate(df: DataFrame, stream: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """df with ``low`` (the watermark in force) and ``accepted``."""
    marked = running_maximum(df, F.when(is_watermark(), F.col("ts")), "low", stream, bucket)
    open_ = F.col("low").isNull() | ~timestamps.is_top("low")
    ok = F.when(is_watermark(), F.col("low").isNull() | (F.col("ts") >= F.col("low"))).otherwise(F.col("low").isNull() | (F.col("ts") > F.col("low")))
    return marked.withColumn("accepted", open_ & ok)


def accepted(df: DataFrame, stream: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """The rows that a sender may send, in the input's columns."""
    return gate(df, stream, bucket).where("accepted").drop("low", "accepted")


def rejected(df: DataFrame, stream: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """The rows that raise at the sender: late data, backward watermarks, anything after Top."""
    return gate(df, stream, bucket).where(~F.col("accepted")).drop("accepted")


def flowing(df: DataFrame, stream: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """The watermark rows that advance their stream, as an operator forwards them."""
    return gate(df.where(is_watermark()), stream, bucket).where(F.col("accepted") & (F.col("low").isNull() | (F.col("ts") > F.col("low")))).drop("low", "accepted")


def minimum(df: DataFrame, inputs: Sequence[str], input_column: str = "input", stream: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """(stream.., seq, ts): the least watermark over all inputs, where it strictly increases.

    df holds the inputs' watermark rows in one order ``seq``; an input that has sent none holds
    the minimum at Bottom.
    """
    rows = df.where(is_watermark())
    names = [f"__low_{k}" for k in range(len(inputs))]
    rows = running_maxima(rows, {name: F.when(F.col(input_column) == F.lit(value), F.col("ts")) for name, value in zip(names, inputs)}, stream, bucket, inclusive=True)
    all_known = F.lit(True)
    for name in names:
        all_known = all_known & F.col(name).isNotNull()
    least = F.when(all_known, F.least(*names) if len(names) > 1 else F.col(names[0]))
    rows = rows.select(*stream, "seq", least.alias("ts")).where(F.col("ts").isNotNull())
    rows = running_maximum(rows, F.col("ts"), "__was", stream, bucket)
    return rows.where(F.col("__was").isNull() | (F.col("ts") > F.col("__was"))).drop("__was")


def batches(df: DataFrame, stream: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """Accepted data rows with ``batch``: the watermark that closes them (null while none does).

    The closing watermark is the least one at or over the row's timestamp. It comes from a sort by
    timestamp, in runs: within a run by a window, across runs by the least watermark of later runs.
    """
    rows = accepted(df, stream, bucket)
    mark = F.when(is_watermark(), F.col("ts"))
    # coarse timestamp cells: coordinate 0 divided by the bucket; sentinels have a cell of their own
    cell = F.struct(F.col("ts")["k"].alias("k"), F.floor(timestamps.coordinate("ts", 0) / F.lit(float(bucket))).alias("c"))
    rows = rows.withColumn("__cell", cell)
    keys = [*stream, "__cell"]
    later = Window.partitionBy(*stream).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys).agg(F.min(mark).alias("__least")).select(*keys, F.min("__least").over(later).alias("__later"))
    inside = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.when(is_watermark(), 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    joined = _null_safe(rows, cells, keys)
    return joined.withColumn("batch", F.coalesce(F.min(mark).over(inside), F.col("__later"))).where(is_data()).drop("__cell", "__later")
