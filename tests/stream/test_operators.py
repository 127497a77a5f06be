"""Pipelines with known results, properties, and the user-defined shapes."""

import collections

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideflow.functions import messages, timestamps
from tideflow.functions.messages import Message
from tideflow.functions.timestamps import BOTTOM, TOP, TYPE, Timestamp
from tideflow.operators import deadlines, shapes
from tideflow.operators.stream import Stream, to_variant
from tideflow.plans.graph import Graph, run, run_async


def counter(spark, n=10):
    return Stream(spark.range(n).select(timestamps.time("id").alias("ts"), F.col("id").alias("data")), "counter")


def pairs(stream):
    return sorted((r.ts.c[0], r.data) for r in stream.df.collect())


def test_linq_golden(spark):
    source = counter(spark)
    numbers = source.flat_map(lambda x: F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x)))
    factors = source.timestamp_join(numbers).filter(lambda p: p["left"] % p["right"] == 0).map(lambda p: p["right"])
    even, odd = factors.split(lambda x: x % 2 == 0)
    assert pairs(even) == [(2, 2), (4, 2), (4, 4), (6, 2), (6, 6), (8, 2), (8, 4), (8, 8)]
    assert pairs(odd) == [(1, 1), (2, 1), (3, 1), (3, 3), (4, 1), (5, 1), (5, 5), (6, 1), (6, 3), (7, 1), (7, 7), (8, 1), (9, 1), (9, 3), (9, 9)]


def test_full_pipeline_golden(spark):
    left, right = counter(spark).map(lambda x: x * x).map(lambda x: 2 * x).filter(lambda x: x > 10).split(lambda x: x < 50)
    assert pairs(left) == [(3, 18), (4, 32)]
    assert pairs(right) == [(5, 50), (6, 72), (7, 98), (8, 128), (9, 162)]


def test_join_table(spark):
    def side(rows, kind):
        df = spark.createDataFrame(rows, f"t long, data {kind}")
        return Stream(df.select(timestamps.time("t").alias("ts"), "data"))

    left = side([(1, "a"), (1, "b"), (2, "c"), (4, "d")], "string")
    right = side([(1, 1), (1, 2), (3, 3), (4, 4)], "long")
    got = sorted((r.ts.c[0], r.data.left, r.data.right) for r in left.timestamp_join(right).df.collect())
    assert got == [(1, "a", 1), (1, "a", 2), (1, "b", 1), (1, "b", 2), (4, "d", 4)]


def test_join_with_a_flat_map_is_not_broadcast(spark):
    """Catalyst takes a flat map's output for as large as its input, and would broadcast it from the driver."""
    source = counter(spark, 50)
    numbers = source.flat_map(lambda x: F.sequence(F.lit(1).cast("long"), x * 100 + 1))
    again = Stream(numbers.concat(source).df)
    for side in (numbers, again):
        for joined in (source.timestamp_join(side), side.timestamp_join(source)):
            plan = joined.df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert source.timestamp_join(again).df.count() == sum(x * 100 + 1 for x in range(50)) + 50
    small = Stream(F.broadcast(source.df))
    assert "BroadcastHashJoin" in numbers.timestamp_join(small).df._jdf.queryExecution().executedPlan().toString()


def test_typed_fanout(spark):
    squares = counter(spark, 6).map(lambda x: x * x)
    even, odd = squares.split(lambda x: x % 2 == 0)
    both = Stream(squares.map(lambda x: to_variant(F.concat(F.lit("Number "), x.cast("string")))).df.unionByName(squares.map(lambda x: to_variant(x / 2)).df))
    texts, halves = both.split_by_type(str, float)
    out = Stream(even.map(to_variant).df).concat(*[Stream(s.map(to_variant).df) for s in (odd, texts, halves)])
    assert out.df.groupBy("ts").count().where("count <> 3").count() == 0 and out.df.count() == 18
    assert pairs(texts)[3] == (3, "Number 9") and pairs(halves)[3] == (3, 4.5)


def test_split_by_type_first_wins(spark):
    df = spark.sql("SELECT named_struct('k', 0Y, 'c', array(1L)) ts, parse_json(v) data FROM VALUES ('1'), ('true'), ('1.5'), ('\"s\"'), ('[1]'), ('null') AS t(v)")
    ints, floats, bools = Stream(df).split_by_type(int, float, bool)
    assert sorted(r.data for r in ints.df.collect()) == [1, 1] and [r.data for r in floats.df.collect()] == [1.5] and bools.df.count() == 0
    with pytest.raises(ValueError):
        Stream(df).split_by_type()


def test_python_forms(spark):
    assert pairs(counter(spark, 4).map_python(lambda x: x * 3, "long")) == [(0, 0), (1, 3), (2, 6), (3, 9)]
    assert pairs(counter(spark, 4).flat_map_python(lambda x: range(x), "long")) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(-5, 5))), max_size=30), st.lists(st.tuples(st.integers(0, 4), st.integers(-5, 5)), max_size=30))
def test_properties(spark, a, b):
    def make(rows):
        return Stream(spark.createDataFrame(rows, "t long, data long").select(timestamps.time("t").alias("ts"), "data"))

    left, right = make(a), make(b)
    yes, no = left.split(lambda x: x > 0)
    assert collections.Counter((r.ts.c[0], r.data) for r in [*yes.df.collect(), *no.df.collect()]) == collections.Counter(a)
    assert left.concat(right).df.count() == len(a) + len(b)
    count = [collections.Counter(t for t, _ in x) for x in (a, b)]
    assert left.timestamp_join(right).df.count() == sum(count[0][t] * count[1][t] for t in count[0])
    twice, once = left.map(lambda x: x + 1).map(lambda x: x * 2), left.map(lambda x: (x + 1) * 2)
    assert collections.Counter(map(str, twice.df.collect())) == collections.Counter(map(str, once.df.collect()))


def test_concat_needs_another(spark):
    with pytest.raises(ValueError):
        counter(spark).concat()


def test_filters_reach_the_scan(spark):
    from tests.conftest import SF

    df = spark.read.parquet(f"{SF}/events.parquet").select(timestamps.time("event_id").alias("ts"), F.col("value").alias("data"))
    plan = Stream(df).map(lambda x: x * 2).filter(lambda x: x > 10).df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan and "Exchange" not in plan


class RunningSum(shapes.OneInOneOut):
    def state(self):
        return 0

    def on_data(self, context, data):
        context.set_current_state(context.current_state() + data)

    def on_watermark(self, context):
        last = context.last_committed_timestamp()
        past = context.past_state(last) if last > BOTTOM else 0
        context.set_current_state(context.current_state() + past)
        if context.timestamp < TOP:
            context.write_stream.send(context.timestamp, context.current_state())


def log(spark, n, top=False):
    items = [m for t in range(n) for m in (Message(Timestamp((t,)), t), Message.new_watermark(Timestamp((t,))))]
    return messages.frame(spark, [*items, Message.new_watermark(TOP)] if top else items, "long")


def test_running_sum_operator(spark):
    out = shapes.connect(RunningSum, log(spark, 6), data_type="long")
    assert [r.data for r in out.where("kind = 'd'").orderBy("ts").collect()] == [0, 1, 3, 6, 10, 15]
    marks = [Timestamp.of(r.ts) for r in out.where("kind = 'w'").orderBy("ts").collect()]
    assert marks == [*(Timestamp((t,)) for t in range(6)), TOP]


def test_watermark_flow_can_be_off(spark):
    out = shapes.connect(RunningSum, log(spark, 3), data_type="long", config=shapes.OperatorConfig("x", flow_watermarks=False))
    assert [Timestamp.of(r.ts) for r in out.where("kind = 'w'").collect()] == [TOP]


class Batch(shapes.OneInOneOut):
    def __init__(self):
        self.got = []

    def on_data(self, context, data):
        self.got.append(data)

    def on_watermark(self, context):
        if self.got:
            context.write_stream.send(context.timestamp, self.got)
            self.got = []


def test_batch_operator_flushes_at_top(spark):
    items = [m for n in range(8) for m in ([Message(Timestamp((n,)), n)] + ([Message.new_watermark(Timestamp((n,)))] if n % 3 == 2 else []))]
    out = shapes.connect(Batch, messages.frame(spark, items, "long"), data_type="array<long>").where("kind = 'd'").orderBy("ts").collect()
    assert [(Timestamp.of(r.ts), list(r.data)) for r in out] == [(Timestamp((2,)), [0, 1, 2]), (Timestamp((5,)), [3, 4, 5]), (TOP, [6, 7])]


class Late(shapes.OneInOneOut):
    def on_watermark(self, context):
        context.write_stream.send_watermark(context.timestamp)
        context.write_stream.send(context.timestamp, 1)


def test_sending_late_data_fails(spark):
    with pytest.raises(Exception, match="LateMessage"):
        shapes.connect(Late, log(spark, 1), data_type="long").collect()


class Order(shapes.TwoInOneOut):
    def __init__(self):
        self.marks = 0

    def on_left_data(self, context, data):
        context.write_stream.send(context.timestamp, 100 * data)

    def on_right_data(self, context, data):
        context.write_stream.send(context.timestamp, data)


def test_two_inputs_wait_for_both(spark):
    out = shapes.connect(Order, log(spark, 4), log(spark, 2), data_type="long")
    assert sorted(r.data for r in out.where("kind = 'd'").collect()) == [0, 0, 1, 100, 200, 300]
    marks = [Timestamp.of(r.ts) for r in out.where("kind = 'w'").orderBy("ts").collect()]
    assert marks == [Timestamp((0,)), Timestamp((1,)), TOP]


def test_connect_checks_types(spark):
    with pytest.raises(TypeError):
        shapes.connect(Order, log(spark, 1), data_type="long")
    with pytest.raises(TypeError):
        shapes.connect(dict, log(spark, 1), data_type="long")
    with pytest.warns(UserWarning):
        shapes.connect(shapes.Sink, log(spark, 1), data_type="long")


def test_write_stream_and_state():
    stream = shapes.WriteStream("out")
    stream.send_watermark(Timestamp((2,)))
    with pytest.raises(shapes.LateMessage):
        stream.send(Timestamp((2,)), 1)
    with pytest.raises(shapes.LateMessage):
        stream.send_watermark(Timestamp((1,)))
    stream.send_watermark(TOP)
    with pytest.raises(shapes.StreamClosed):
        stream.send_watermark(TOP)
    held = shapes.TimeVersionedState(list)
    held.at(Timestamp((1,))).append(1)
    held.at(Timestamp((2,))).append(2)
    held.commit(Timestamp((1,)))
    held.evict_until(Timestamp((2,)))
    assert list(held.versions) == [Timestamp((2,))] and held.last_committed_timestamp == Timestamp((1,))


def test_source_ends_with_top(spark):
    class Two(shapes.Source):
        def run(self):
            yield Message(Timestamp((0,)), 5)

    rows = shapes.connect_source(spark, Two(), "long").orderBy("seq").collect()
    assert [r.kind for r in rows] == ["d", "w"] and rows[1].ts.k == 1


def test_a_long_source_is_written_in_parts(spark):
    class Many(shapes.Source):
        def run(self):
            for k in range(25):
                yield Message(Timestamp((k,)), k)

    for rows in (7, 25, 26, 100):
        got = shapes.connect_source(spark, Many(), "long", rows).orderBy("seq").collect()
        assert [r.seq for r in got] == list(range(26)) and [r.data for r in got[:25]] == list(range(25)) and got[25].ts.k == 1


def test_reading_inside_run(spark):
    class Pairs(shapes.OneInOneOut):
        reads = True

        def run(self, context):
            stream = context.read_stream
            while not stream.is_closed():
                one, two = stream.read(), None
                if not one.watermark and not stream.is_closed():
                    two = stream.try_read()
                if two is not None and not two.watermark:
                    context.write_stream.send(two.timestamp, one.data * 100 + two.data)
            for read, error in ((stream.read, shapes.ReadError), (stream.try_read, shapes.TryReadError)):
                try:
                    read()
                except error:
                    continue
                raise AssertionError("read after Top")

    rows = [(key, k, "d", Timestamp((k,)).row(), k) for key in ("a", "b") for k in range(6)]
    df = spark.createDataFrame(rows, f"key string, seq long, kind string, ts {TYPE}, data long")
    got = shapes.connect(Pairs, df, data_type="long", key="key").where("kind = 'd'").collect()
    assert sorted((r.key, r.data) for r in got) == [(k, v) for k in "ab" for v in (1, 203, 405)]


def test_sinks_have_their_effects(spark, tmp_path):
    folder = str(tmp_path)

    class Writer(shapes.Sink):
        def __init__(self):
            self.seen = []

        def on_data(self, context, data):
            self.seen.append(data)

        def destroy(self):
            import pathlib
            import uuid

            pathlib.Path(folder, f"{uuid.uuid4().hex}.txt").write_text(",".join(map(str, self.seen)))

    rows = [(f"k{k % 3}", k, "d", Timestamp((k,)).row(), k) for k in range(9)]
    schema = f"key string, seq long, kind string, ts {TYPE}, data long"
    shapes.run_sink(Writer, spark.createDataFrame(rows, schema), key="key")
    assert sorted(p.read_text() for p in tmp_path.glob("*.txt")) == ["0,3,6", "1,4,7", "2,5,8"]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    query = shapes.start_sink(Writer, spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/check", "key", availableNow=True)
    query.awaitTermination(60)
    assert sorted(p.read_text() for p in tmp_path.glob("*.txt")) == sorted(["0,3,6", "1,4,7", "2,5,8"] * 2)


def test_python_predicates(spark):
    rows = counter(spark, 10)
    assert sorted(r.data for r in rows.filter_python(lambda x: x % 3 == 0).df.collect()) == [0, 3, 6, 9]
    left, right = rows.split_python(lambda x: x < 4)
    assert sorted(r.data for r in left.df.collect()) == [0, 1, 2, 3] and right.df.count() == 6


def test_deadlines_of_an_operator(spark):
    class Late(shapes.OneInOneOut):
        def setup(self, context):
            context.add_deadline(deadlines.Deadline("quick", 2.0).on_read_stream("in").on_write_stream("out"))

    at = lambda c: F.timestamp_seconds(c).alias
    messages = spark.range(4).select(F.col("id").alias("ts"), F.col("id").alias("seq"), at(F.col("id"))("arrival"))
    releases = spark.range(4).select(F.col("id").alias("ts"), at(F.col("id") * 2)("release"))
    assert [(r.deadline, r.ts) for r in shapes.missed(Late, {"in": messages}, {"out": releases}).collect()] == [("quick", 3)]
    with pytest.raises(ValueError):
        shapes.missed(shapes.OneInOneOut, {"in": messages}, {"out": releases})


def test_graph_and_handles(spark):
    ids = []
    for _ in range(2):
        graph = Graph("g")
        source = Stream(counter(spark).df, "src", graph)
        joined = source.map(lambda x: x).timestamp_join(source)
        joined.name = "joined"
        ids.append([n.id for n in graph.nodes])
        dot = graph.to_dot()
        assert dot.count("->") == 3 and '"joined"' in dot
    assert ids[0] == ids[1] and len(set(ids[0])) == 3
    assert run(lambda: counter(spark, 3).df.count()) == 3
    handle = run_async(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        handle.wait()
    handle.shutdown()
