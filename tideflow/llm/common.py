"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only on a local master without spark.checkpoint.dir (tests, notebooks)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: The tables of ``written`` that are still there.
_tables: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: smaller than a checkpoint's rows, and read by column.

    The table stays, as the frame that reads it is not yet computed, unless it is made inside ``scratch``.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``written`` makes inside; what is computed from them must be written inside too."""
    before = len(_tables)
    yield
    while len(_tables) > before:
        deleted(spark, _tables.pop())


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def plainly_joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Join on a key, with plain shuffles directly below it on both sides.

    A side that is aggregated or joined by the key keeps that layout, and then adaptive execution
    cannot split a hot key. A hash of the key as a second join key asks for a layout that no side has.
    """
    a, b = F.col(left_key), F.col(right_key)
    return left.join(right, (F.xxhash64(a) == F.xxhash64(b)) & (a == b), how)


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; null ids have a null fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, target: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled documents of each class outside fold 0: (id, text, label, stands_for).

    The rows are taken in the order of a hash of the id, so the sample does not depend on
    partitioning. A document that is labelled more than once has the rounded mean of its
    labels; null labels and null ids are left out. An id with several texts has the smallest of them,
    so that each id is one row, found in Spark. ``stands_for`` is how many training rows of
    its class a row of the sample stands for, so that the classes' prior does not depend on
    ``most``. The ids of the sample (2 x ``most`` longs) are the only data that is broadcast.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull() & (fold(id_col) != 0))
        .groupBy(F.col(id_col).alias("__id"))
        .agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("label"))
    )
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("__id"), "__id").limit(most) for k in (0, 1)]
    totals = known.groupBy("label").agg(F.count("*").alias("__n")).select("label", F.greatest(F.lit(1.0), F.col("__n") / F.lit(float(most))).alias("stands_for"))
    ids = parts[0].unionByName(parts[1]).join(F.broadcast(totals), "label")
    rows = docs.select(F.col(id_col).alias("__own"), text_of("text").alias("text")).join(F.broadcast(ids), F.col("__own") == F.col("__id"))
    return rows.groupBy(F.col("__id").alias("id"), "label", "stands_for").agg(F.min("text").alias("text"))


def class_rates(rows: pd.DataFrame) -> tuple[float, float]:
    """stands_for of the classes 0 and 1; 1 for rows that are not a sample, and for a class without rows."""
    if "stands_for" not in rows:
        return 1.0, 1.0
    return tuple(float(rows.stands_for[rows.label == k].max()) if (rows.label == k).any() else 1.0 for k in (0, 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def logistic(x: np.ndarray, y: np.ndarray, positive: float = 1.0, ridge: float = 0.1, steps: int = 40):
    """Ridge logistic regression by Newton's method; returns (mean, scale, weights with bias).

    A column without spread counts for nothing, whatever its later values.
    """
    mean, spread = x.mean(0), x.std(0)
    scale = np.where(spread > 1e-6, spread, np.inf)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight = np.where(y == 1, positive, 1.0)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        gradient = z.T @ (weight * (p - y)) + penalty * w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def logistic_score(model, x: np.ndarray) -> np.ndarray:
    """Rounded, so that a row's score does not depend on the batch that it is in."""
    mean, scale, w = model
    return np.round(sigmoid(np.c_[(x - mean) / scale, np.ones(len(x))] @ w), 9)


def sliced(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``most_bytes``, one row at least, so a task's working set stays small."""
    rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def extended(df: DataFrame, added: str, make: Callable[[], Callable[[pa.RecordBatch], list]], consumed: tuple[str, ...] = ("__text",)) -> DataFrame:
    """df without ``consumed`` and with the columns of ``added`` (a DDL string), row by row.

    ``make`` runs once in a task and returns the function from an Arrow slice to the new columns
    (arrays or lists). All other columns pass through untouched, whatever their type or nulls.
    """
    new = T.StructType.fromDDL(added)
    keep = [f for f in df.schema.fields if f.name not in consumed]
    schema = T.StructType([*keep, *new.fields])
    types = [_arrow(f.dataType) for f in new.fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in sliced(batch):
                columns = [part.column(f.name) for f in keep]
                values = [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(work(part), types)]
                yield pa.RecordBatch.from_arrays(columns + values, names)

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}[type(kind)]
