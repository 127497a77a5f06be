"""Structured Streaming: equal results to batch, punctuated state, ingest and extract, topics."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tideflow.functions import profiling, timestamps
from tideflow.operators import watermarks
from tideflow.operators.shapes import LateMessage, StreamClosed
from tideflow.operators.stream import Stream
from tideflow.sources import connectors
from tideflow.streaming import punctuated


def write_log(spark, folder, rows, files):
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], "stream string, seq long, kind string, ts long, data double").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)


def test_punctuated_batches_equal_batch(spark, tmp_path):
    rows = []
    for n in range(40):
        rows.append((f"s{n % 2}", n, "w" if n % 7 == 6 else "d", n // 2 - 2 if n % 7 == 6 else n // 2 + (n * 7) % 5 - 3, None if n % 7 == 6 else float(n)))
    folder = str(tmp_path / "log")
    write_log(spark, folder, rows, 4)
    schema = "stream string, seq long, kind string, ts long, data double"
    stream = connectors.replayed(spark, folder, schema)
    got = connectors.ExtractStream(punctuated.closed_batches(stream), str(tmp_path / "c"), available_now=True)
    streamed = sorted((r.stream, r.batch, r.ts, r.data) for r in got)
    batch = spark.createDataFrame(rows, schema).withColumn("ts", timestamps.time("ts"))
    closed = watermarks.batches(batch, ["stream"], 5).where("batch IS NOT NULL")
    late = watermarks.rejected(batch, ["stream"], 5).where("kind = 'd'")
    want = [(r.stream, r.batch.c[0], r.ts.c[0], r.data) for r in closed.collect()] + [(r.stream, -1, r.ts.c[0], r.data) for r in late.collect()]
    assert streamed == sorted(want) and late.count() > 0


def test_operators_on_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(20).select(F.col("id").alias("t"), F.timestamp_seconds(F.col("id") + 100_000).alias("et"), F.col("id").alias("data")).repartition(3).write.parquet(folder)  # a watermark starts at second 0

    def build(df):
        base = Stream(df.select(timestamps.time("t").alias("ts"), "et", "data"))
        doubled = base.map(lambda x: x * 2).filter(lambda x: x % 4 == 0)
        return base.timestamp_join(doubled, "1 hour" if df.isStreaming else None).df.select(timestamps.coordinate("ts", 0).alias("t"), "data.left", "data.right")

    schema = "t long, et timestamp, data long"
    with pytest.raises(ValueError):
        Stream(connectors.replayed(spark, folder, schema).withColumnRenamed("t", "ts")).timestamp_join(Stream(connectors.replayed(spark, folder, schema)))
    got = connectors.ExtractStream(build(connectors.replayed(spark, folder, schema)), str(tmp_path / "c"), available_now=True)
    assert sorted(map(tuple, got)) == sorted(map(tuple, build(spark.read.schema(schema).parquet(folder)).collect()))


def test_ingest_and_extract(spark, tmp_path):
    ingest = connectors.IngestStream(spark, str(tmp_path / "ingest"), "long")
    for n in range(3):
        ingest.send(n, n)
        ingest.send_watermark(n)
    with pytest.raises(LateMessage):
        ingest.send(1, 1)
    with pytest.raises(LateMessage):
        ingest.send_watermark(1)
    ingest.flush()
    squares = ingest.stream().where("kind = 'd'").select("ts", (F.col("data") * F.col("data")).alias("data"))
    out = connectors.ExtractStream(squares, str(tmp_path / "c"))
    assert sorted(tuple(out.read()) for _ in range(3)) == [(0, 0), (1, 1), (2, 4)]
    assert out.try_read() is None
    ingest.send(5, 5)
    ingest.close()
    assert tuple(out.read()) == (5, 25)
    with pytest.raises(StreamClosed):
        ingest.send(9, 9)
    out.query.stop()
    assert out.is_closed() and out.read() is None


def test_unread_rows_are_bounded(spark, tmp_path):
    spark.range(500).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = connectors.ExtractStream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "c"), available_now=True, waiting=10)
    first = out.read()
    time.sleep(0.5)
    assert first is not None and out.rows.qsize() <= 10
    assert len(list(out)) == 499
    again = connectors.ExtractStream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "c2"), waiting=10)
    again.read()
    again.stop()
    assert not again.query.isActive


def test_topics(spark, tmp_path):
    rows = [(n, "w" if n % 2 else "d", n, None if n % 2 else f"m{n}") for n in range(6)]
    log = spark.createDataFrame(rows, "seq long, kind string, ts long, data string")
    both = connectors.to_topic(log, lambda: F.array(F.to_json(F.struct("kind", "ts", "data"))))
    assert both.count() == 6
    data = connectors.to_topic(log, lambda: F.when(F.col("kind") == "d", F.array("data")))
    assert data.count() == 3
    both.write.parquet(str(tmp_path / "topic"))
    decode = lambda v: F.array(F.from_json(v, "kind string, ts long, data string"))
    got = connectors.from_topic(connectors.replayed(spark, str(tmp_path / "topic"), "value string"), decode)
    out = connectors.ExtractStream(got, str(tmp_path / "c"), available_now=True)
    assert sorted((r.ts, r.kind, r.data) for r in out) == sorted((t, k, x) for _, k, t, x in rows)
    connectors.publish(connectors.replayed(spark, str(tmp_path / "topic"), "value string"), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_counter_source(spark, tmp_path):
    spark.dataSource.register(connectors.CounterSource)
    df = spark.read.format("counter").option("rows", 7).load()
    assert df.where("kind = 'd'").count() == 7 and df.where("kind = 'w'").count() == 7
    assert connectors.generated(spark, 100, timestamps.time("id"), F.col("id") * 2).count() == 100


def test_timers(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "d"), (2, "d")], "ts long, kind string").coalesce(1).write.mode("append").parquet(folder)
    stream = connectors.replayed(spark, folder, "ts long, kind string")
    rows = []
    query = punctuated.deadline_timers(stream, 3000).writeStream.outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: rows.extend(b.collect())).start()
    try:
        until = time.time() + 60
        while not query.recentProgress and time.time() < until:
            time.sleep(0.1)
        spark.createDataFrame([(1, "w")], "ts long, kind string").coalesce(1).write.mode("append").parquet(folder)
        while not rows and time.time() < until:
            time.sleep(0.1)
        time.sleep(2)
    finally:
        query.stop()
    assert (2, True) in [tuple(r) for r in rows]


def test_timer_conditions(spark, tmp_path):
    """Two messages start a deadline, both outputs end it, and its duration comes from its messages."""
    folder, schema = str(tmp_path / "in"), "ts long, stream string, kind string, wait long"

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    send((1, "in", "d", 3000), (1, "in", "d", 3000), (2, "in", "d", 3000), (3, "in", "d", 3000), (3, "in", "d", 3000), (4, "in", "d", 600_000), (4, "in", "d", 600_000))
    rows = []
    stream = punctuated.deadline_timers(connectors.replayed(spark, folder, schema), lambda batch: int(batch.wait.max()), ["in"], ["a", "b"], starts=lambda seen: seen.get("in", (0, False))[0] >= 2)
    query = stream.writeStream.outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: rows.extend(b.collect())).start()
    try:
        until = time.time() + 60
        while not query.recentProgress and time.time() < until:
            time.sleep(0.1)
        send((1, "a", "w", 0), (3, "a", "w", 0), (3, "b", "w", 0))
        while not rows and time.time() < until:
            time.sleep(0.1)
        time.sleep(2)
    finally:
        query.stop()
    missed = {r.ts for r in rows}
    assert 1 in missed and not missed & {2, 4}


def test_ingest_of_coordinates(spark, tmp_path):
    at = timestamps.Timestamp
    ingest = connectors.IngestStream(spark, str(tmp_path / "ingest"), "long", coordinates=True)
    ingest.send(at((1, 5)), 10)
    ingest.send_watermark(at((1, 5)))
    with pytest.raises(LateMessage):
        ingest.send(at((1, 4)), 1)
    ingest.send(at((2,)), 20)
    ingest.close()
    with pytest.raises(StreamClosed):
        ingest.send(at((9,)), 1)
    got = connectors.ExtractStream(ingest.stream(), str(tmp_path / "c"), available_now=True)
    assert sorted((r.seq, r.kind, r.ts.k, r.ts.c, r.data) for r in got) == [(0, "d", 0, [1, 5], 10), (1, "w", 0, [1, 5], None), (2, "d", 0, [2], 20), (3, "w", 1, None, None)]


def test_profiles(spark, tmp_path):
    trace = profiling.Trace()

    @profiling.profiled(trace, "work")
    def work():
        time.sleep(0.001)

    for _ in range(5):
        work()
    with profiling.Profile(trace, "block", n=1):
        pass
    assert trace.runtime("work", 50) >= 1000 and trace.runtime("none", 50) != trace.runtime("none", 50)
    for k in range(1500):
        trace.add("many", 0, k)
    assert trace.runtime("many", 0) == 500 and trace.runtime("many", 100) == 1499
    trace.save(str(tmp_path / "t.json"))
    trace.save_csv(str(tmp_path / "t.csv"))
    assert {e["ph"] for e in json.load(open(tmp_path / "t.json"))} == {"X"}
    df = spark.createDataFrame([("a", k, float(k)) for k in range(1200)], "e string, t long, d double")
    assert profiling.runtime_percentiles(df, "e", ["t"], "d", 50).first().runtime == 699.5
    profiling.logger("x", str(tmp_path / "log")).info("hi")
    assert "hi" in open(tmp_path / "log").read()
