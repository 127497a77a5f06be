"""Multi-dimensional logical timestamps as a sortable struct.

A timestamp is struct<k tinyint, c array<bigint>>: k is -1 (Bottom), 0 (Time) or 1 (Top), and c
holds the coordinates of a Time, null otherwise. Structs compare k first, then c in
lexicographic order with a prefix before its extensions, so ORDER BY, max, joins and GROUP BY need
no further rule. Coordinates are unsigned 64-bit in the data model; BIGINT holds the first half of
that range and ``check_coordinates`` raises beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import total_ordering

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<k:tinyint,c:array<bigint>>"
MOST = (1 << 63) - 1


def time(*coordinates: Column | str | int) -> Column:
    """A Time column of the given coordinates; strings name columns."""
    items = [F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c for c in coordinates]
    array = F.array(*[i.cast("bigint") for i in items]) if items else F.array().cast("array<bigint>")
    return F.struct(F.lit(0).cast("tinyint").alias("k"), array.alias("c"))


def _sentinel(k: int) -> Column:
    return F.struct(F.lit(k).cast("tinyint").alias("k"), F.lit(None).cast("array<bigint>").alias("c"))


def top() -> Column:
    return _sentinel(1)


def bottom() -> Column:
    return _sentinel(-1)


def is_top(ts: Column | str) -> Column:
    return _col(ts)["k"] == 1


def is_bottom(ts: Column | str) -> Column:
    return _col(ts)["k"] == -1


def coordinate(ts: Column | str, place: int) -> Column:
    """The coordinate at ``place`` or null."""
    return F.get(_col(ts)["c"], F.lit(place))


def event_time(ts: Column | str, unit: str = "seconds") -> Column:
    """A TIMESTAMP of coordinate 0, which Spark's own watermarks need. unit: seconds, millis or micros."""
    return {"seconds": F.timestamp_seconds, "millis": F.timestamp_millis, "micros": F.timestamp_micros}[unit](coordinate(ts, 0))


def check_coordinates(ts: Column | str) -> Column:
    """ts; raises at run time if a coordinate is negative, which is how a value over 2^63 - 1 would appear."""
    ts = _col(ts)
    bad = F.exists(F.coalesce(ts["c"], F.array().cast("array<bigint>")), lambda x: x < 0)
    return F.when(bad, F.raise_error(F.lit("timestamp coordinate outside 0 to 2^63 - 1"))).otherwise(ts)


def _col(ts: Column | str) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


@total_ordering
@dataclass(frozen=True, eq=False)
class Timestamp:
    """The driver-side value: exactly one of coordinates, is_top and is_bottom."""

    coordinates: tuple[int, ...] | None = None
    is_top: bool = False
    is_bottom: bool = False

    def __post_init__(self):
        if (self.coordinates is not None) + bool(self.is_top) + bool(self.is_bottom) != 1:
            raise ValueError("give exactly one of coordinates, is_top and is_bottom")
        if self.coordinates is not None:
            object.__setattr__(self, "coordinates", tuple(self.coordinates))
            if any(not 0 <= c <= MOST for c in self.coordinates):
                raise ValueError("coordinates are integers from 0 to 2^63 - 1")

    @property
    def key(self) -> tuple:
        return (1,) if self.is_top else (-1,) if self.is_bottom else (0, self.coordinates)

    def __eq__(self, other):
        return self.key == self._of(other)

    def __lt__(self, other):
        return self.key < self._of(other)

    def __hash__(self):
        return hash(self.key)

    @staticmethod
    def _of(other) -> tuple:
        if not isinstance(other, Timestamp):
            raise ValueError("a Timestamp compares with a Timestamp only")
        return other.key

    def row(self) -> tuple:
        """The struct's value for createDataFrame."""
        return (self.key[0], list(self.coordinates) if self.coordinates is not None else None)

    @classmethod
    def of(cls, value) -> Timestamp:
        """From a collected struct."""
        return cls(is_top=True) if value["k"] == 1 else cls(is_bottom=True) if value["k"] == -1 else cls(tuple(value["c"]))


TOP, BOTTOM = Timestamp(is_top=True), Timestamp(is_bottom=True)
