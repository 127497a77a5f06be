import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from tideflow.llm import mixing


def cells_of(rng, n=40):
    seen = {(f"s{rng.integers(4)}", f"l{rng.integers(3)}", f"t{rng.integers(3)}"): int(rng.integers(50, 5000)) for _ in range(n)}
    return [(*k, v) for k, v in sorted(seen.items())]


def test_marginals_are_reached():
    cells = cells_of(np.random.default_rng(0))
    settings = mixing.Settings(targets={"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}})
    mass = mixing.rake(cells, settings) * np.array([c[3] for c in cells]) / sum(c[3] for c in cells)
    for k, name in enumerate(("s0", "s1", "s2", "s3")):
        assert abs(mass[[c[0] == name for c in cells]].sum() - (0.4, 0.3, 0.2, 0.1)[k]) < 1e-8


def test_the_registered_settings_meet_their_targets(spark):
    for row in mixing.marginals(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect():
        assert abs(row.target - row.reached) < 1e-6, row


def test_a_rare_category_does_not_set_the_rate():
    """One more source of a thousandth of a percent: the largest weight stays about that of a source of one percent."""
    cells = [("a", "en", "t", 900_000), ("b", "en", "t", 90_000), ("c", "en", "t", 10_000)]
    few, more = (mixing.rake(c, mixing.Settings()).max() for c in (cells, [*cells, ("d", "en", "t", 10)]))
    assert more < 1.01 * few


def test_marginals_of_explicit_targets_and_of_nothing(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), f"s{k % 3}", None if k % 4 else "en") for k in range(300)], "doc_id long, text string, source string, lang string")
    got = {(r.dimension, r.category): r for r in mixing.marginals(docs, mixing.Settings(targets={"source": {"s0": 0.8, "s1": 0.1, "s2": 0.1}})).collect()}
    assert abs(got["source", "s0"].reached - 0.8) < 1e-6 and ("lang", "(none)") in got
    assert mixing.marginals(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0


def test_columns_with_the_operators_names_pass_through(spark):
    names = ["doc_id", "text", "source", "lang", "__text", "__tokens", "__source", "own", "__weight", "a.b"]
    rows = [(k, f"text {k}", "s", "en", f"t{k}", f"n{k}", f"x{k}", f"o{k}", f"w{k}", f"d{k}") for k in range(5)]
    docs = spark.createDataFrame(rows, names)
    out = mixing.sample(docs)
    assert out.columns == names and sorted(map(tuple, out.collect())) == rows


def test_topics(spark):
    texts = ["The patient saw a doctor; the court met.", "Le tribunal. Ein Vertrag.", "a | b", "write to a@b.example", "NO!! WAY!!", "plain", "", None, "license patient"]
    docs = spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = [r.topic for r in mixing.report(docs).orderBy("doc_id").collect()]
    assert got == ["health", "law", "table", "contact", "shout", "prose", "prose", "prose", "law"]


def test_spark_rakes_as_the_driver_does(spark):
    cells = cells_of(np.random.default_rng(1))
    for settings in (mixing.Settings(rounds=3), mixing.Settings(rounds=4, targets={"lang": {"l0": 0.5}})):
        frame = mixing.rake_frame(spark.createDataFrame(cells, "__source string, __lang string, __topic string, __tokens long"), settings)
        got = {(r[0], r[1], r[2]): r[3] for r in frame.collect()}
        want = mixing.rake(cells, settings)
        assert all(abs(got[c[:3]] - w) < 1e-9 for c, w in zip(cells, want))


def test_both_ways_draw_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = {r.doc_id for r in mixing.sample(docs).collect()}
    large = {r.doc_id for r in mixing.sample(docs, mixing.Settings(most_cells=1)).collect()}
    assert small == large and mixing.sample(docs).columns == docs.columns


def test_the_sample_has_the_raked_shares(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 10).alias("text"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"))
    settings = mixing.Settings(targets={"source": {"big": 0.5, "small": 0.5}, "lang": {"en": 0.5, "de": 0.5}})
    out = mixing.sample(rows, settings).groupBy("source", "lang").count().collect()
    total = sum(r["count"] for r in out)
    for name, values in (("source", ("big", "small")), ("lang", ("en", "de"))):
        for v in values:
            assert abs(sum(r["count"] for r in out if r[name] == v) / total - 0.5) < 0.02
