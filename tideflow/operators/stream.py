"""The built-in stream operators as rewrites of a DataFrame's plan.

A Stream wraps a frame with the columns ts and data (other envelope columns pass through where
they can). Each operator takes a Column or a function from the data Column to one, which Catalyst
optimises; an operator over Python values is the ``*_python`` form, which runs in Arrow batches.
Every operator keeps the input's timestamps, works on batch and streaming frames alike, and has no
shuffle but the join's.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideflow.plans.graph import Graph

Expression = Column | Callable[[Column], Column]


def _value(expression: Expression) -> Column:
    return expression(F.col("data")) if callable(expression) else expression


#: Type families of a variant's schema_of_variant; a Python bool is an int, so int takes both.
FAMILIES = {
    int: ("BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN"),
    bool: ("BOOLEAN",),
    float: ("DOUBLE", "FLOAT", "DECIMAL"),
    str: ("STRING",),
    bytes: ("BINARY",),
    list: ("ARRAY",),
    dict: ("OBJECT",),
    type(None): ("VOID",),
}


class Stream:
    def __init__(self, df: DataFrame, name: str = "stream", graph: Graph | None = None, sources: tuple[Stream, ...] = (), operator: str = "source"):
        self.df, self.graph = df, graph or (sources[0].graph if sources else Graph())
        self.node = self.graph.add(name, operator, tuple(s.node for s in sources))

    @property
    def id(self) -> str:
        return self.node.id

    @property
    def name(self) -> str:
        return self.node.name

    @name.setter
    def name(self, value: str) -> None:
        self.node.name = value

    def _next(self, df: DataFrame, operator: str, *others: Stream) -> Stream:
        return Stream(df, f"{operator}_{len(self.graph.nodes)}", self.graph, (self, *others), operator)

    def map(self, expression: Expression) -> Stream:
        """data replaced by an expression of it."""
        return self._next(self.df.withColumn("data", _value(expression)), "MapOp")

    def map_python(self, function: Callable[[Any], Any], data_type: str) -> Stream:
        """map by a Python function, in Arrow batches."""

        def part(values: pd.Series) -> pd.Series:
            return values.map(function)

        return self._next(self.df.withColumn("data", F.pandas_udf(part, data_type)(F.col("data"))), "MapOp")

    def flat_map(self, expression: Expression) -> Stream:
        """A row for each element of an array expression, in order; none for an empty or null array."""
        kept = [c for c in self.df.columns if c != "data"]
        return self._next(self.df.select(*kept, F.explode(_value(expression)).alias("data")), "FlatMapOp")

    def flat_map_python(self, function: Callable[[Any], list], data_type: str) -> Stream:
        def part(values: pd.Series) -> pd.Series:
            return values.map(lambda v: list(function(v)))

        return self.flat_map(F.pandas_udf(part, f"array<{data_type}>")(F.col("data")))

    def filter(self, predicate: Expression) -> Stream:
        return self._next(self.df.where(_value(predicate)), "FilterOp")

    def filter_python(self, predicate: Callable[[Any], bool]) -> Stream:
        """filter by a Python predicate, in Arrow batches."""
        return self._next(self.df.where(_python_predicate(predicate)(F.col("data"))), "FilterOp")

    def split_python(self, predicate: Callable[[Any], bool]) -> tuple[Stream, Stream]:
        """split by a Python predicate; it runs once in each of the two streams' plans."""
        holds = _python_predicate(predicate)(F.col("data"))
        return self._next(self.df.where(holds), "SplitOp"), self._next(self.df.where(~holds), "SplitOp")

    def split(self, predicate: Expression) -> tuple[Stream, Stream]:
        """(rows where the predicate holds, the others); a null predicate goes right, so nothing is lost."""
        holds = F.coalesce(_value(predicate), F.lit(False))
        return self._next(self.df.where(holds), "SplitOp"), self._next(self.df.where(~holds), "SplitOp")

    def split_by_type(self, *types: type) -> tuple[Stream, ...]:
        """One stream for each Python type of a VARIANT payload. The first type that fits takes a row;
        rows that fit none are dropped. The payload becomes a typed column where the type has one."""
        if not types:
            raise ValueError("split_by_type needs a type at least")
        kind = F.regexp_extract(F.schema_of_variant("data"), "^[A-Z]+", 0)
        taken, out = F.lit(False), []
        for t in types:
            fits = F.coalesce(kind.isin(*FAMILIES[t]), F.lit(False))
            plain = {int: "bigint", bool: "boolean", float: "double", str: "string"}.get(t)
            rows = self.df.where(fits & ~taken)
            if plain:
                rows = rows.withColumn("data", F.try_variant_get("data", "$", plain) if t is not int else F.coalesce(F.try_variant_get("data", "$", "bigint"), F.try_variant_get("data", "$", "boolean").cast("bigint")))
            out.append(self._next(rows, "SplitByTypeOp"))
            taken = taken | fits
        return tuple(out)

    def timestamp_join(self, other: Stream, left_watermark: str | None = None) -> Stream:
        """Inner equi-join on the timestamp; data becomes struct<left, right>, the product in a timestamp.

        Streaming frames need an event-time column ``et`` of the timestamp on both sides;
        ``left_watermark`` is the delay that bounds both sides' state. Batch frames are sorted and merged:
        Catalyst does not count the rows that a flat map adds, and would collect such a side on the driver to
        broadcast it. ``F.broadcast`` on the other stream's frame, if it is known to be small, still counts.
        """
        keys = ["ts"]
        left, right = self.df, other.df
        if left.isStreaming or right.isStreaming:
            if left_watermark is None or "et" not in left.columns or "et" not in right.columns:
                raise ValueError("a streaming timestamp_join needs et columns and a watermark delay")
            left, right, keys = left.withWatermark("et", left_watermark), right.withWatermark("et", left_watermark), ["et", "ts"]
        a = left.select(*keys, F.col("data").alias("__left"))
        b = right.select(*keys, F.col("data").alias("__right"))
        if not (left.isStreaming or right.isStreaming):
            a = a.hint("merge")
        return self._next(a.join(b, keys).select(*keys, F.struct(F.col("__left").alias("left"), F.col("__right").alias("right")).alias("data")), "TimestampJoinOp", other)

    def concat(self, *others: Stream) -> Stream:
        """All rows of all streams; the watermark is the least of the inputs' (``watermarks.minimum``)."""
        if not others:
            raise ValueError("concat needs another stream")
        return self._next(functools.reduce(DataFrame.unionByName, [s.df for s in (self, *others)]), "ConcatOp", *others)

    def broadcast(self, times: int) -> tuple[Stream, ...]:
        """The same stream for several consumers; persist the frame first if its plan is expensive."""
        return tuple(self for _ in range(times))


def _python_predicate(predicate: Callable[[Any], bool]):
    def part(values: pd.Series) -> pd.Series:
        return values.map(lambda v: bool(predicate(v))).astype(bool)

    return F.pandas_udf(part, "boolean")


def to_variant(column: Column) -> Column:
    """A payload of any type as VARIANT."""
    return F.variant_get(F.to_variant_object(F.struct(column.alias("v"))), "$.v", "variant")


def join_schema(left: T.DataType, right: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("left", left), T.StructField("right", right)])
