"""The envelope of a stream's rows: seq bigint, kind string ('d' or 'w'), ts, data, and arrival."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.functions import timestamps
from tideflow.functions.timestamps import Timestamp

DATA, WATERMARK = "d", "w"


@dataclass(frozen=True)
class Message:
    """A data item, or a watermark if data is None and watermark is set."""

    timestamp: Timestamp
    data: Any = None
    watermark: bool = False

    @classmethod
    def new_watermark(cls, timestamp: Timestamp) -> Message:
        return cls(timestamp, None, True)

    def is_top_watermark(self) -> bool:
        return self.watermark and self.timestamp.is_top


def schema(data_type: str) -> str:
    return f"seq bigint, kind string, ts {timestamps.TYPE}, data {data_type}"


def frame(spark: SparkSession, messages: Iterable[Message], data_type: str) -> DataFrame:
    """An envelope frame of driver-side messages, numbered in order."""
    rows = [(k, WATERMARK if m.watermark else DATA, m.timestamp.row(), m.data) for k, m in enumerate(messages)]
    return spark.createDataFrame(rows, schema(data_type))


def envelope(df: DataFrame, seq: Column, ts: Column, data: Column) -> DataFrame:
    """Data rows of any table."""
    return df.select(seq.cast("bigint").alias("seq"), F.lit(DATA).alias("kind"), ts.alias("ts"), data.alias("data"))


def watermarks(df: DataFrame, seq: Column, ts: Column, like: DataFrame) -> DataFrame:
    """Watermark rows with the data type of ``like``."""
    return df.select(seq.cast("bigint").alias("seq"), F.lit(WATERMARK).alias("kind"), ts.alias("ts"), F.lit(None).cast(like.schema["data"].dataType).alias("data"))


def is_data() -> Column:
    return F.col("kind") == DATA


def is_watermark() -> Column:
    return F.col("kind") == WATERMARK


def is_top_watermark() -> Column:
    return is_watermark() & timestamps.is_top("ts")


def same(left: str, right: str) -> Column:
    """Message equality of two envelope structs: same kind, timestamp and data."""
    return F.struct(F.col(left)["kind"], F.col(left)["ts"], F.col(left)["data"]).eqNullSafe(F.struct(F.col(right)["kind"], F.col(right)["ts"], F.col(right)["data"]))
