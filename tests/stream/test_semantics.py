"""Semantic facts of messages, timestamps and watermarks."""

import pytest
from pyspark.sql import functions as F

from tideflow.functions import messages, timestamps
from tideflow.functions.messages import Message
from tideflow.functions.timestamps import BOTTOM, TOP, Timestamp
from tideflow.operators import deadlines, loops, state, watermarks


def d(t, x):
    return Message(Timestamp((t,)), x)


def w(t):
    return Message.new_watermark(t if isinstance(t, Timestamp) else Timestamp((t,)))


def log(spark, items, data_type="string"):
    return messages.frame(spark, items, data_type)


def test_timestamp_value():
    for bad in ({}, {"coordinates": (1,), "is_top": True}, {"is_top": True, "is_bottom": True}, {"coordinates": (-1,)}, {"coordinates": (1 << 63,)}):
        with pytest.raises(ValueError):
            Timestamp(**bad)
    order = [BOTTOM, Timestamp(()), Timestamp((0,)), Timestamp((0, 1)), Timestamp((1,)), TOP]
    assert sorted(order[::-1]) == order and len(set(order)) == 6
    with pytest.raises(ValueError):
        Timestamp((1,)) < 1
    with pytest.raises(ValueError):
        Timestamp((1,)) == 1


def test_timestamp_order_in_frames(spark):
    order = [BOTTOM, Timestamp(()), Timestamp((0,)), Timestamp((0, 1)), Timestamp((1,)), TOP]
    df = spark.createDataFrame([(k, t.row()) for k, t in enumerate(order)], f"k int, ts {timestamps.TYPE}").repartition(3)
    assert [r.k for r in df.orderBy("ts").collect()] == list(range(6))
    assert df.alias("a").join(df.alias("b"), F.col("a.ts") == F.col("b.ts")).count() == 6
    assert Timestamp.of(df.agg(F.max("ts").alias("m")).first().m) == TOP
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(timestamps.check_coordinates(timestamps.time(F.lit(-1))).alias("t")).collect()


@pytest.mark.parametrize("bucket", [1, 2, 100])
def test_late_data_and_equal_watermarks(spark, bucket):
    rows = log(spark, [d(1, "a"), w(1), d(1, "late"), d(2, "b"), w(1), w(2), d(3, "c")])
    kept = watermarks.accepted(rows, bucket=bucket)
    assert sorted(r.data for r in kept.where("kind = 'd'").collect()) == ["a", "b", "c"]
    assert kept.where("kind = 'w'").count() == 3
    assert [r.data for r in watermarks.rejected(rows, bucket=bucket).collect()] == ["late"]
    assert sorted(r.ts.c[0] for r in watermarks.flowing(rows, bucket=bucket).collect()) == [1, 2]
    closed = {r.data: r.batch and r.batch.c[0] for r in watermarks.batches(rows, bucket=bucket).collect()}
    assert closed == {"a": 1, "b": 2, "c": None}
    assert sorted(map(tuple, watermarks.accepted(kept, bucket=bucket).collect())) == sorted(map(tuple, kept.collect()))


def test_backward_watermark_and_top(spark):
    assert watermarks.accepted(log(spark, [w(5), w(4)])).count() == 1
    assert watermarks.rejected(log(spark, [w(TOP), d(9, "x"), w(TOP)])).count() == 2


def test_watermark_batches_flush_at_top(spark):
    items = []
    for n in range(8):
        items.append(d(n, str(n)))
        if n % 3 == 2:
            items.append(w(n))
    got = watermarks.batches(log(spark, [*items, w(TOP)]), bucket=2).collect()
    batches = {}
    for r in got:
        batches.setdefault(Timestamp.of(r.batch), set()).add(r.data)
    assert batches == {Timestamp((2,)): {"0", "1", "2"}, Timestamp((5,)): {"3", "4", "5"}, TOP: {"6", "7"}}


def test_minimum_watermark(spark):
    rows = [("L", 1), ("R", 2), ("L", 3), ("R", 2), ("L", 4), ("R", 5)]
    df = spark.createDataFrame([(k, i, "w", Timestamp((t,)).row()) for k, (i, t) in enumerate(rows)], f"seq long, input string, kind string, ts {timestamps.TYPE}")
    for bucket in (1, 3, 100):
        assert [r.ts.c[0] for r in watermarks.minimum(df, ["L", "R"], bucket=bucket).orderBy("seq").collect()] == [1, 2, 4]


def test_empty_log(spark):
    rows = log(spark, [])
    for f in (watermarks.accepted, watermarks.flowing, watermarks.batches):
        assert f(rows).count() == 0


def test_past_state_is_exact(spark):
    states = spark.createDataFrame([(1, 10), (3, 30)], "ts long, v long")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "at long")
    got = {r["at"]: r.past for r in state.past_state(asked, states, "at", "v", F.lit(0), F.lit(3)).collect()}
    assert got == {1: 10, 2: 0, 3: 30, 4: None}
    assert [r.ts for r in state.evicted(states, F.lit(5), F.lit(1)).collect()] == [3]


def test_running_sum_groups(spark):
    rows = spark.createDataFrame([(t, t % 7) for t in range(50)] * 2, "t long, x long")
    plain = {r.t: r.total for r in state.running_sum(rows, "x", ["t"]).collect()}
    grouped = {r.t: r.total for r in state.running_sum(rows, "x", ["t"], groups=F.floor(F.col("t") / 9)).collect()}
    assert plain == grouped and plain[49] == 2 * sum(t % 7 for t in range(50))


DEADLINE = "ts long, seq long, arrival timestamp, data long"


def seconds(x):
    return None if x is None else f"2024-01-01 00:00:{x:04.1f}"


def rows_of(spark, rows):
    starts = spark.createDataFrame([(t, k, seconds(a), t) for k, (t, a, _) in enumerate(rows)], "ts long, seq long, arrival string, data long").withColumn("arrival", F.col("arrival").cast("timestamp"))
    done = spark.createDataFrame([(t, seconds(r)) for t, _, r in rows if r is not None], "ts long, release string").withColumn("release", F.col("release").cast("timestamp"))
    return starts, done


def test_deadlines(spark):
    limit = deadlines.Deadline("d", 2.0).on_read_stream("in")
    table = [(1, 0, 1), (2, 1, 4), (3, 2, None)]
    assert sorted(r.ts for r in deadlines.misses(limit, *rows_of(spark, table)).collect()) == [2, 3]
    assert [r.ts for r in deadlines.misses(limit, *rows_of(spark, [(1, 0, 2.5), (1, 1, 2.5)])).collect()] == [1]
    dynamic = deadlines.Deadline("d", F.make_dt_interval(secs=F.when(F.col("data") == 2, 5.0).otherwise(2.0))).on_read_stream("in")
    assert [r.ts for r in deadlines.misses(dynamic, *rows_of(spark, table)).collect()] == [3]
    twice = limit.with_start_condition(F.count("*") >= 2)
    assert deadlines.audit(twice, *rows_of(spark, table)).count() == 0
    assert deadlines.misses(limit.with_end_condition(F.lit(False)), *rows_of(spark, table)).count() == 3
    with pytest.raises(ValueError):
        deadlines.misses(deadlines.Deadline("d", 2.0), *rows_of(spark, table))


def test_a_deadline_ends_when_all_outputs_have_released(spark):
    starts, _ = rows_of(spark, [(1, 0, None), (2, 0, None), (3, 0, None), (4, 0, None)])
    done = spark.createDataFrame([(1, "a", seconds(1)), (1, "b", seconds(2)), (2, "a", seconds(1)), (2, "b", seconds(3)), (3, "a", seconds(1)), (4, "a", seconds(1)), (4, "c", seconds(1)), (4, "b", seconds(2)), (4, "b", seconds(9))], "ts long, stream string, release string").withColumn("release", F.col("release").cast("timestamp"))
    limit = deadlines.Deadline("d", 2.0).on_read_stream("in").on_write_stream("a", "b")
    rows = {r.ts: r for r in deadlines.audit(limit, starts, done).collect()}
    assert {t: r.missed for t, r in rows.items()} == {1: False, 2: True, 3: True, 4: False} and rows[3].release is None
    assert deadlines.misses(deadlines.Deadline("d", 2.0).on_read_stream("in").on_write_stream("a"), starts, done).count() == 0


def test_a_deadline_is_armed_by_its_streams_only(spark):
    starts, done = rows_of(spark, [(1, 0, None), (2, 1, None)])
    starts = starts.withColumn("stream", F.when(F.col("ts") == 1, "left").otherwise("right"))
    both = deadlines.Deadline("d", 2.0).on_read_stream("left", "right")
    assert deadlines.audit(both, starts, done, reads=("left", "right")).count() == 2
    left = deadlines.Deadline("d", 2.0).on_read_stream("left")
    assert deadlines.audit(left, starts, done, reads=("left", "right")).count() == 0
    assert [r.ts for r in deadlines.audit(left, starts, done, reads=("left",)).collect()] == [1]


def test_loops(spark):
    assert loops.counter(spark, 200).agg(F.max("data"), F.count("*")).first()[:] == (200, 201)
    assert [tuple(r) for r in loops.counter(spark, 5).orderBy("ts").collect()] == [(i, i) for i in range(6)]
    start = spark.createDataFrame([(0, 0)], "ts long, data long")
    loop = loops.LoopStream(start)
    with pytest.raises(ValueError):
        loop.run(3)
    loop.connect(lambda df: df.where("ts < 4").select((F.col("ts") + 1).alias("ts"), (F.col("data") + 1).alias("data")))
    assert sorted(tuple(r) for r in loop.run(100).collect()) == [(i, i) for i in range(5)]


def test_message_equality(spark):
    df = log(spark, [d(1, "a"), d(1, "a"), w(1)]).select("seq", F.struct("kind", "ts", "data").alias("m"))
    pairs = df.alias("a").join(df.alias("b"), F.col("a.seq") < F.col("b.seq")).select(F.col("a.m").alias("x"), F.col("b.m").alias("y"))
    assert sorted(r[0] for r in pairs.select(messages.same("x", "y")).collect()) == [False, False, True]
    assert log(spark, [w(TOP), w(1), d(1, "a")]).where(messages.is_top_watermark()).count() == 1
