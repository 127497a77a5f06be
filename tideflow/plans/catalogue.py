"""Registered queries of the stream operators over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.functions import profiling, timestamps
from tideflow.operators import deadlines, loops, shapes, state, watermarks
from tideflow.operators.stream import Stream, to_variant

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Sequence numbers in a bucket of the running maxima, so that the tests' tables have several.
BUCKET = 4_000
HOUR = "floor(epoch(ts) / 3600)::BIGINT"
T0 = "TIMESTAMP '2024-01-01 00:00:00'"


def registered(sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour(column: str = "ts"):
    return F.floor(F.unix_timestamp(F.col(column).cast("timestamp")) / 3600).cast("bigint")


def minute(column: str = "ts"):
    return F.floor(F.unix_timestamp(F.col(column).cast("timestamp")) / 60).cast("bigint")


def events(spark: SparkSession, sf_dir: str, data=None) -> Stream:
    """events as a stream: the timestamp is the event's hour, the payload its value."""
    df = table(spark, sf_dir, "events")
    return Stream(df.select(F.col("event_id").alias("seq"), timestamps.time(hour()).alias("ts"), (data if data is not None else F.col("value")).alias("data")), "events")


def flat(stream: Stream, *more: str) -> DataFrame:
    return stream.df.select(*more, timestamps.coordinate("ts", 0).alias("t0"), "data")


@registered("SELECT event_id AS seq, " + HOUR + " AS t0, round(value * 2, 6) AS data FROM events")
def map_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(events(spark, sf_dir).map(lambda x: F.round(x * 2, 6)), "seq")


@registered("SELECT event_id AS seq, " + HOUR + " AS t0, round(value * 2, 6) AS data FROM events")
def map_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a Python function in Arrow batches."""
    return flat(events(spark, sf_dir).map_python(lambda x: x * 2, "double").map(lambda x: F.round(x, 6)), "seq")


@registered("SELECT l_orderkey AS t0, l_linenumber AS line, unnest(range(1, l_linenumber + 1))::BIGINT AS data FROM lineitem")
def flat_map_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(timestamps.time("l_orderkey").alias("ts"), F.col("l_linenumber").alias("line"), F.col("l_linenumber").cast("bigint").alias("data"))
    return flat(Stream(lines).flat_map(lambda x: F.when(x >= 1, F.sequence(F.lit(1).cast("bigint"), x))), "line")


@registered("SELECT event_id AS seq, " + HOUR + " AS t0, value AS data FROM events WHERE value > 10")
def filter_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(events(spark, sf_dir).filter(lambda x: x > 10), "seq")


@registered("SELECT event_id AS seq, " + HOUR + " AS t0, value AS data FROM events WHERE value > 50")
def split_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(events(spark, sf_dir).split(lambda x: x > 50)[0], "seq")


@registered("SELECT event_id AS seq, " + HOUR + " AS t0, value AS data FROM events WHERE NOT coalesce(value > 50, false)")
def split_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(events(spark, sf_dir).split(lambda x: x > 50)[1], "seq")


@registered("""SELECT 'int' AS kind, count(*) AS n, round(sum(event_id), 3)::DOUBLE AS total FROM events UNION ALL
    SELECT 'str', count(*), sum(length(event_type))::DOUBLE FROM events UNION ALL SELECT 'float', count(value), round(sum(value), 3) FROM events""")
def split_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    every = [df.select(timestamps.time(hour()).alias("ts"), to_variant(F.col(c)).alias("data")) for c in ("event_id", "event_type", "value")]
    mixed = Stream(every[0]).concat(Stream(every[1]), Stream(every[2]))
    ints, texts, floats = mixed.split_by_type(int, str, float)
    return (
        ints.df.select(F.lit("int").alias("kind"), F.col("data").cast("double").alias("x"))
        .unionByName(texts.df.select(F.lit("str").alias("kind"), F.length("data").cast("double").alias("x")))
        .unionByName(floats.df.select(F.lit("float").alias("kind"), F.col("data").alias("x")))
        .groupBy("kind")
        .agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("total"))
    )


@registered("SELECT floor(epoch(o_orderdate) / 86400)::BIGINT AS t0, o_totalprice AS data FROM orders UNION ALL SELECT " + HOUR + ", value FROM events")
def concat_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_orders(spark, sf_dir).concat(Stream(events(spark, sf_dir).df.drop("seq"))))


def _orders(spark: SparkSession, sf_dir: str) -> Stream:
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint")
    return Stream(table(spark, sf_dir, "orders").select(timestamps.time(day).alias("ts"), F.col("o_totalprice").alias("data")), "orders")


@registered("SELECT t0, count(*) AS n, round(sum(data), 2) AS total FROM (SELECT " + HOUR + """ % 24 AS t0, value AS data FROM events
    UNION ALL SELECT l_linenumber::BIGINT, l_quantity FROM lineitem UNION ALL SELECT o_custkey % 24, o_totalprice FROM orders) GROUP BY t0""")
def concat_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Stream(table(spark, sf_dir, "events").select(timestamps.time(hour() % 24).alias("ts"), F.col("value").alias("data")))
    b = Stream(table(spark, sf_dir, "lineitem").select(timestamps.time("l_linenumber").alias("ts"), F.col("l_quantity").alias("data")))
    c = Stream(table(spark, sf_dir, "orders").select(timestamps.time(F.col("o_custkey") % 24).alias("ts"), F.col("o_totalprice").alias("data")))
    return flat(a.concat(b, c)).groupBy("t0").agg(F.count("*").alias("n"), F.round(F.sum("data"), 2).alias("total"))


def _minutes(spark: SparkSession, sf_dir: str, kind: str) -> Stream:
    df = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return Stream(df.select(timestamps.time(minute()).alias("ts"), F.col("event_id").alias("data")), kind)


@registered("""WITH e AS (SELECT *, floor(epoch(ts) / 60)::BIGINT AS m FROM events)
    SELECT c.m AS t0, c.event_id AS l, v.event_id AS r FROM e c JOIN e v ON c.m = v.m WHERE c.event_type = 'click' AND v.event_type = 'view'""")
def timestamp_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _minutes(spark, sf_dir, "click").timestamp_join(_minutes(spark, sf_dir, "view"))
    return joined.df.select(timestamps.coordinate("ts", 0).alias("t0"), F.col("data.left").alias("l"), F.col("data.right").alias("r"))


@registered("""WITH e AS (SELECT *, floor(epoch(ts) / 86400)::BIGINT AS d FROM events)
    SELECT c.d AS t0, c.user_id AS t1, c.event_id AS l, v.event_id AS r FROM e c JOIN e v ON c.d = v.d AND c.user_id = v.user_id
    WHERE c.event_type = 'click' AND v.event_type = 'purchase'""")
def timestamp_join_multidim(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.col("ts").cast("date"))
    df = table(spark, sf_dir, "events").select(timestamps.time(day, "user_id").alias("ts"), "event_type", F.col("event_id").alias("data"))
    sides = [Stream(df.where(F.col("event_type") == k).drop("event_type")) for k in ("click", "purchase")]
    return sides[0].timestamp_join(sides[1]).df.select(timestamps.coordinate("ts", 0).alias("t0"), timestamps.coordinate("ts", 1).alias("t1"), F.col("data.left").alias("l"), F.col("data.right").alias("r"))


@registered("""WITH s AS (SELECT event_id AS t0, event_id % 50 AS x FROM events), f AS (SELECT t0, x, unnest(range(1, x + 1)) AS d FROM s)
    SELECT CASE WHEN d % 2 = 0 THEN 'even' ELSE 'odd' END AS side, t0 % 50 AS bucket, count(*) AS n, sum(d)::BIGINT AS total FROM f WHERE x % d = 0 GROUP BY ALL""")
def linq_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source -> flat_map(1..x) -> timestamp_join -> filter(x % d = 0) -> map(d) -> split -> count per timestamp bucket."""
    source = Stream(table(spark, sf_dir, "events").select(timestamps.time("event_id").alias("ts"), (F.col("event_id") % 50).alias("data")))
    numbers = source.flat_map(lambda x: F.when(x >= 1, F.sequence(F.lit(1).cast("bigint"), x)))
    factors = source.timestamp_join(numbers).filter(lambda p: p["left"] % p["right"] == 0).map(lambda p: p["right"])
    even, odd = factors.split(lambda d: d % 2 == 0)
    sides = [s.df.select(F.lit(n).alias("side"), (timestamps.coordinate("ts", 0) % 50).alias("bucket"), "data") for n, s in (("even", even), ("odd", odd))]
    return sides[0].unionByName(sides[1]).groupBy("side", "bucket").agg(F.count("*").alias("n"), F.sum("data").alias("total"))


@registered("""WITH s AS (SELECT event_id AS t0, event_id * event_id * 2 AS v FROM events)
    SELECT CASE WHEN v < 50 THEN 'left' ELSE 'right' END AS side, t0, v FROM s WHERE v > 10""")
def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The square, double, filter and split chain over all events."""
    return _square_chain(table(spark, sf_dir, "events"))


def _square_chain(rows: DataFrame) -> DataFrame:
    """counter -> square -> double -> keep over 10 -> split below 50."""
    source = Stream(rows.select(timestamps.time("event_id").alias("ts"), F.col("event_id").alias("data")))
    left, right = source.map(lambda x: x * x).map(lambda x: x * 2).filter(lambda x: x > 10).split(lambda x: x < 50)
    return left.df.withColumn("side", F.lit("left")).unionByName(right.df.withColumn("side", F.lit("right"))).select("side", timestamps.coordinate("ts", 0).alias("t0"), F.col("data").alias("v"))


@registered("""WITH s AS (SELECT event_id AS t0, event_id * event_id * 2 AS v FROM events)
    SELECT CASE WHEN v % 3 = 0 THEN 'left' ELSE 'right' END AS side, t0, v FROM s WHERE v % 5 <> 0""")
def full_pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with Python predicates: filter and split in Arrow batches."""
    source = Stream(table(spark, sf_dir, "events").select(timestamps.time("event_id").alias("ts"), F.col("event_id").alias("data")))
    left, right = source.map(lambda x: x * x * 2).filter_python(lambda v: v % 5 != 0).split_python(lambda v: v % 3 == 0)
    return left.df.withColumn("side", F.lit("left")).unionByName(right.df.withColumn("side", F.lit("right"))).select("side", timestamps.coordinate("ts", 0).alias("t0"), F.col("data").alias("v"))


@registered("""WITH e AS (SELECT user_id AS u, floor(epoch(ts) / 86400)::BIGINT AS d, event_id, floor(event_id / 1000)::BIGINT AS b FROM events)
    SELECT b AS block, event_id, row_number() OVER (PARTITION BY b ORDER BY d, u, event_id)::BIGINT AS place FROM e""")
def ts_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of two-dimensional timestamps in blocks of a thousand events."""
    from pyspark.sql import Window

    df = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("block"), timestamps.time(F.unix_date(F.col("ts").cast("date")), "user_id").alias("t"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("t", "event_id")).cast("bigint")
    return df.select("block", "event_id", place.alias("place"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in a shuffled order, every 97th row a watermark of its hour less two."""
    df = table(spark, sf_dir, "events")
    mark = F.col("event_id") % 97 == 96
    return df.select(
        (F.col("event_id") % 4).alias("stream"), F.col("event_id").alias("seq"), F.when(mark, "w").otherwise("d").alias("kind"), timestamps.time(hour() + F.when(mark, -2).otherwise(-(F.col("user_id") % 5))).alias("ts"), F.when(~mark, F.col("value")).alias("data")
    )


LOG = """log AS (SELECT event_id % 4 AS stream, event_id AS seq, event_id % 97 = 96 AS mark, floor(epoch(ts) / 3600)::BIGINT + CASE WHEN event_id % 97 = 96 THEN -2 ELSE -(user_id % 5) END AS t0, value FROM events),
    low AS (SELECT *, max(CASE WHEN mark THEN t0 END) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM log)"""


@registered(f"WITH {LOG} SELECT stream, seq, t0 FROM low WHERE NOT mark AND (low IS NULL OR t0 > low)")
def late_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermarks.accepted(_log(spark, sf_dir), ["stream"], BUCKET).where("kind = 'd'").select("stream", "seq", timestamps.coordinate("ts", 0).alias("t0"))


@registered(f"WITH {LOG} SELECT stream, mark, count(*) AS n FROM low WHERE low IS NOT NULL AND (CASE WHEN mark THEN t0 < low ELSE t0 <= low END) GROUP BY ALL")
def late_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermarks.rejected(_log(spark, sf_dir), ["stream"], BUCKET).groupBy("stream", (F.col("kind") == "w").alias("mark")).agg(F.count("*").alias("n"))


@registered(f"WITH {LOG} SELECT stream, seq, t0 FROM low WHERE mark AND (low IS NULL OR t0 > low)")
def flow_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermarks.flowing(_log(spark, sf_dir), ["stream"], BUCKET).select("stream", "seq", timestamps.coordinate("ts", 0).alias("t0"))


@registered("""WITH w AS (SELECT event_id AS seq, event_id % 2 AS input, floor(epoch(ts) / 3600)::BIGINT AS t0 FROM events),
    m AS (SELECT seq, max(CASE WHEN input = 0 THEN t0 END) OVER o AS a, max(CASE WHEN input = 1 THEN t0 END) OVER o AS b FROM w WINDOW o AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT seq, least(a, b) AS t0 FROM m WHERE a IS NOT NULL AND b IS NOT NULL),
    p AS (SELECT seq, t0, max(t0) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM l)
    SELECT seq, t0 FROM p WHERE was IS NULL OR t0 > was""")
def min_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 2).alias("input"), F.lit("w").alias("kind"), timestamps.time(hour()).alias("ts"))
    return watermarks.minimum(df, [0, 1], "input", (), BUCKET).select("seq", timestamps.coordinate("ts", 0).alias("t0"))


@registered(f"""WITH {LOG}, ok AS (SELECT * FROM low WHERE CASE WHEN mark THEN low IS NULL OR t0 >= low ELSE low IS NULL OR t0 > low END),
    b AS (SELECT d.stream, d.seq, d.value, (SELECT min(m.t0) FROM ok m WHERE m.mark AND m.stream = d.stream AND m.t0 >= d.t0) AS batch FROM ok d WHERE NOT d.mark)
    SELECT stream, coalesce(batch, -1) AS batch, count(*) AS n, round(sum(value), 3) AS total, min(seq) AS first, max(seq) AS last FROM b GROUP BY stream, coalesce(batch, -1)""")
def watermark_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data that each watermark closes; batch -1 waits for Top."""
    rows = watermarks.batches(_log(spark, sf_dir), ["stream"], 24)
    batch = F.coalesce(timestamps.coordinate("batch", 0), F.lit(-1))
    return rows.groupBy("stream", batch.alias("batch")).agg(F.count("*").alias("n"), F.round(F.sum("data"), 3).alias("total"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@registered("SELECT " + HOUR + " AS t0, count(*) AS n FROM events GROUP BY ALL")
def sink_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.versions(events(spark, sf_dir).df, F.count("*").alias("n")).select(timestamps.coordinate("ts", 0).alias("t0"), "n")


@registered("""SELECT t0, round(sum(v), 2) AS total FROM (SELECT floor(epoch(o_orderdate) / 86400)::BIGINT AS t0, o_totalprice AS v FROM orders
    UNION ALL SELECT floor(epoch(l_shipdate) / 86400)::BIGINT, l_quantity FROM lineitem) GROUP BY t0""")
def join_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(timestamps.time(F.unix_date(F.col("l_shipdate").cast("date"))).alias("ts"), F.col("l_quantity").alias("data"))
    return state.joined_sum([_orders(spark, sf_dir).df, lines], "data").select(timestamps.coordinate("ts", 0).alias("t0"), F.round("total", 2).alias("total"))


DAYS = "days AS (SELECT floor(epoch(ts) / 86400)::BIGINT AS t0, sum(event_id % 10)::BIGINT AS s FROM events GROUP BY ALL)"


@registered(f"WITH {DAYS} SELECT t0, (sum(s) OVER (ORDER BY t0))::BIGINT AS total FROM days")
def running_sum_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.unix_date(F.col("ts").cast("date")).cast("bigint").alias("t0"), (F.col("event_id") % 10).alias("x"))
    return state.running_sum(rows, "x", ["t0"], groups=F.floor(F.col("t0") / 8))


@registered(f"""WITH {DAYS}, c AS (SELECT max(t0) - 3 AS done FROM days)
    SELECT d.t0, CASE WHEN d.t0 - 2 <= c.done THEN coalesce(p.s, 0) END AS past FROM days d JOIN c ON true LEFT JOIN days p ON p.t0 = d.t0 - 2""")
def past_state_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.col("ts").cast("date")).cast("bigint")
    days = state.versions(table(spark, sf_dir, "events").select(day.alias("ts"), (F.col("event_id") % 10).alias("x")), F.sum("x").alias("s"))
    done = days.agg(F.max("ts") - 3).first()[0]
    asked = days.select(F.col("ts").alias("t0"), (F.col("ts") - 2).alias("at"))
    return state.past_state(asked, days, "at", "s", F.lit(0), F.lit(done)).select("t0", "past")


@registered("SELECT event_type AS stream, " + HOUR + " AS t0, count(*) FILTER (event_id % 97 <> 96) AS messages, bool_or(event_id % 97 = 96) AS watermark FROM events GROUP BY ALL")
def message_count_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.when(F.col("event_id") % 97 == 96, "w").otherwise("d").alias("kind"), timestamps.time(hour()).alias("ts"))
    return state.message_counts(df).select("stream", timestamps.coordinate("ts", 0).alias("t0"), "messages", "watermark")


def _deadline_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    starts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("arrival"), F.col("o_orderpriority").alias("priority"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ts"), F.col("l_shipdate").alias("release"))
    return starts, done


@registered("""SELECT o_orderkey AS ts, release IS NULL AS never FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS release FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE release IS NULL OR release > o_orderdate + INTERVAL 30 DAY""")
def deadline_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = deadlines.Deadline("ship", F.expr("INTERVAL 30 DAYS")).on_read_stream("orders").on_write_stream("lineitem")
    return deadlines.misses(limit, *_deadline_tables(spark, sf_dir)).select("ts", F.col("release").isNull().alias("never"))


@registered("""SELECT o_orderkey AS ts, release IS NULL AS never FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS release FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE release IS NULL OR release > o_orderdate + to_days(CASE WHEN o_orderpriority LIKE '1%' THEN 5 WHEN o_orderpriority LIKE '2%' THEN 20 ELSE 60 END)""")
def deadline_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.when(F.col("priority").startswith("1"), 5).when(F.col("priority").startswith("2"), 20).otherwise(60)
    limit = deadlines.Deadline("ship", F.make_dt_interval(days=days)).on_read_stream("orders")
    return deadlines.misses(limit, *_deadline_tables(spark, sf_dir)).select("ts", F.col("release").isNull().alias("never"))


class _Ship(shapes.TwoInOneOut):
    def setup(self, context):
        context.add_deadline(deadlines.Deadline("both", F.expr("INTERVAL 45 DAYS")).on_read_stream("urgent", "other").on_write_stream("even", "odd"))
        context.add_deadline(deadlines.Deadline("unarmed", F.expr("INTERVAL 1 DAYS")).on_read_stream("urgent").on_write_stream("even"))


@registered("""WITH r AS (SELECT l_orderkey, min(l_shipdate) FILTER (l_linenumber % 2 = 0) AS even, min(l_shipdate) FILTER (l_linenumber % 2 = 1) AS odd FROM lineitem GROUP BY 1)
    SELECT 'both' AS deadline, o_orderkey AS ts, even IS NULL OR odd IS NULL AS never FROM orders LEFT JOIN r ON l_orderkey = o_orderkey
    WHERE even IS NULL OR odd IS NULL OR greatest(even, odd) > o_orderdate + INTERVAL 45 DAY""")
def deadline_all_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deadlines of an operator with two inputs: one ends when both outputs have released; one constrains a single input and never starts."""
    starts, _ = _deadline_tables(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ts"), F.col("l_shipdate").alias("release"), F.col("l_linenumber").alias("n"))
    urgent = F.col("priority").startswith("1")
    inputs = {"urgent": starts.where(urgent), "other": starts.where(~urgent)}
    outputs = {"even": lines.where("n % 2 = 0"), "odd": lines.where("n % 2 = 1")}
    return shapes.missed(_Ship, inputs, outputs).select("deadline", "ts", F.col("release").isNull().alias("never"))


class _Largest(shapes.OneInOneOut):
    """run() reads its input itself and sends the largest value at the last timestamp."""

    reads = True

    def run(self, context):
        most, last = None, None
        while not context.read_stream.is_closed():
            message = context.read_stream.read()
            if not message.watermark:
                last, most = message.timestamp, message.data if most is None else max(most, message.data)
        context.write_stream.send(last, most)


@registered("SELECT user_id::VARCHAR AS key, max(" + HOUR + ") AS t0, max(event_id % 10)::BIGINT AS data FROM events GROUP BY ALL")
def read_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shapes.connect(_Largest, _user_log(spark, sf_dir), data_type="bigint", key="key")
    return out.where("kind = 'd'").select("key", timestamps.coordinate("ts", 0).alias("t0"), "data")


@registered("WITH RECURSIVE loop(ts, data) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT ts + 1, data + 1 FROM loop WHERE ts < 50) SELECT ts, data FROM loop")
def loop_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.counter(spark, 50)


@registered("SELECT 'count' AS consumer, " + HOUR + " AS t0, count(*)::DOUBLE AS x FROM events GROUP BY ALL UNION ALL SELECT 'largest', " + HOUR + ", max(value) FROM events GROUP BY ALL")
def broadcast_tee(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = events(spark, sf_dir).broadcast(2)
    n = state.versions(one.df, F.count("*").cast("double").alias("x")).withColumn("consumer", F.lit("count"))
    most = state.versions(two.df, F.max("data").alias("x")).withColumn("consumer", F.lit("largest"))
    return n.unionByName(most).select("consumer", timestamps.coordinate("ts", 0).alias("t0"), "x")


class _HourSum(shapes.OneInOneOut):
    """Adds the values of a timestamp, sends the sum when a watermark closes it."""

    retain = 1

    def __init__(self):
        self.open = {}

    def on_data(self, context, data):
        self.open[context.timestamp] = self.open.get(context.timestamp, 0) + data

    def on_watermark(self, context):
        for t in sorted(t for t in self.open if t <= context.timestamp):
            context.write_stream.send(t, self.open.pop(t))


def _user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.lit("d").alias("kind"), timestamps.time(hour()).alias("ts"), (F.col("event_id") % 10).alias("data"))


@registered("SELECT user_id::VARCHAR AS key, " + HOUR + " AS t0, sum(event_id % 10)::BIGINT AS data FROM events GROUP BY ALL")
def one_in_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shapes.connect(_HourSum, _user_log(spark, sf_dir), data_type="bigint", key="key")
    return out.where("kind = 'd'").select("key", timestamps.coordinate("ts", 0).alias("t0"), "data")


class _Both(shapes.TwoInOneOut):
    """Sends left total - right total of a timestamp."""

    def __init__(self):
        self.open = {}

    def on_left_data(self, context, data):
        self.open[context.timestamp] = self.open.get(context.timestamp, 0) + data

    def on_right_data(self, context, data):
        self.open[context.timestamp] = self.open.get(context.timestamp, 0) - data

    on_watermark = _HourSum.on_watermark


@registered("SELECT user_id::VARCHAR AS key, " + HOUR + " AS t0, sum(CASE WHEN event_type = 'click' THEN event_id % 10 ELSE -(event_id % 10) END)::BIGINT AS data FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def two_in_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    sides = [df.where(F.col("event_type") == k).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.lit("d").alias("kind"), timestamps.time(hour()).alias("ts"), (F.col("event_id") % 10).alias("data")) for k in ("click", "view")]
    return shapes.connect(_Both, *sides, data_type="bigint", key="key").where("kind = 'd'").select("key", timestamps.coordinate("ts", 0).alias("t0"), "data")


class _Parity(shapes.OneInTwoOut):
    def on_data(self, context, data):
        (context.left_write_stream if data % 2 == 0 else context.right_write_stream).send(context.timestamp, data)


@registered("SELECT CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS port, user_id::VARCHAR AS key, " + HOUR + " AS t0, event_id % 10 AS data FROM events")
def one_in_two_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shapes.connect(_Parity, _user_log(spark, sf_dir), data_type="bigint", key="key")
    return out.where("kind = 'd'").select("port", "key", timestamps.coordinate("ts", 0).alias("t0"), "data")


@registered("SELECT " + HOUR + " AS t0, count(*) AS n, sum(event_id % 10)::BIGINT AS s FROM events GROUP BY ALL")
def parallel_one_in_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.parallel(_user_log(spark, sf_dir), F.count("*").alias("n"), F.sum("data").alias("s")).select(timestamps.coordinate("ts", 0).alias("t0"), "n", "s")


@registered("SELECT " + HOUR + " AS t0, sum(event_id % 10) FILTER (event_type = 'click')::BIGINT AS l, sum(event_id % 10) FILTER (event_type = 'view')::BIGINT AS r FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def parallel_two_in_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    left, right = (df.where(F.col("event_type") == k).select(F.lit("d").alias("kind"), timestamps.time(hour()).alias("ts"), (F.col("event_id") % 10).alias("data")) for k in ("click", "view"))
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("data")))
    return shapes.parallel_two(left, right, total("left").alias("l"), total("right").alias("r")).select(timestamps.coordinate("ts", 0).alias("t0"), "l", "r")


@registered("SELECT " + HOUR + " AS t0, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS port, count(*) AS n FROM events GROUP BY ALL")
def parallel_one_in_two_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("data") % 2 == 0
    return shapes.parallel_ports(_user_log(spark, sf_dir), {"even": even, "odd": ~even}, F.count("*").alias("n")).select(timestamps.coordinate("ts", 0).alias("t0"), "port", "n")


@registered("""SELECT event_type, round(quantile_cont(value, 0.9), 4) AS runtime FROM
    (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 1000 GROUP BY event_type""")
def runtime_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiling.runtime_percentiles(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value", 90)
    return rows.select("event_type", F.round("runtime", 4).alias("runtime"))
