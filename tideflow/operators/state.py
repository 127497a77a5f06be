"""Time-versioned state as grouped frames: a version for each timestamp, committed by watermarks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(df: DataFrame, *aggregates: Column, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """The state that appending each row to its timestamp's version gives: partial sums, then one shuffle."""
    return df.groupBy(*keys).agg(*aggregates)


def message_counts(df: DataFrame, stream: str = "stream") -> DataFrame:
    """(stream, ts, messages, watermark): what start and end conditions of deadlines see."""
    return df.groupBy(stream, "ts").agg(F.count_if(F.col("kind") == "d").alias("messages"), F.coalesce(F.bool_or(F.col("kind") == "w"), F.lit(False)).alias("watermark"))


def joined_sum(frames: Sequence[DataFrame], value: str, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """The sum of a value over all inputs of a timestamp; no join is needed."""
    rows = reduce(DataFrame.unionByName, [f.select(*keys, value) for f in frames])
    return rows.groupBy(*keys).agg(F.sum(value).alias("total"))


def running_sum(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), groups: Column | None = None) -> DataFrame:
    """(keys, order.., total): each version is the committed one before it plus its own rows.

    Rows are summed to versions first. ``groups`` is a coarse column that ascends with the order
    (a month of a day, say): sums of groups are accumulated first, and a window then covers one
    group instead of all versions.
    """
    own = [*keys, *order]
    extra = [groups.alias("__group")] if groups is not None else []
    sums = df.select(*own, *extra, value).groupBy(*own, *(["__group"] if extra else [])).agg(F.sum(value).alias("__own"))
    if not extra:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return sums.select(*own, F.sum("__own").over(window).alias("total"))
    before = Window.partitionBy(*keys).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.groupBy(*keys, "__group").agg(F.sum("__own").alias("__all")).select(*keys, "__group", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return sums.join(base, [*keys, "__group"]).select(*own, (F.col("__base") + F.sum("__own").over(inside)).alias("total"))


def past_state(requests: DataFrame, states: DataFrame, at: str, value: str, default: Column, committed: Column) -> DataFrame:
    """requests with ``past``: the version at exactly ``at``, the default if there is none, null if
    ``at`` lies after the last commit (no as-of lookup)."""
    known = states.select(F.col("ts").alias("__ts"), F.col(value).alias("__value"))
    joined = requests.join(known, requests[at] == known["__ts"], "left")
    return joined.withColumn("past", F.when(F.col(at) <= committed, F.coalesce("__value", default))).drop("__ts", "__value")


def evicted(states: DataFrame, low: Column, committed: Column) -> DataFrame:
    """The versions that remain after eviction up to the lesser of the watermark and the last commit."""
    return states.where(F.col("ts") > F.least(low, committed))
