"""Held-out accuracy, defined results, and what the scores may depend on."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideflow.llm import quality, toxicity
from tideflow.llm.common import fold, training_rows

DATA = "/root/testdata/sf0.01"
OPERATORS = {"toxic": toxicity, "quality": quality}


def auc(y, s):
    rank = pd.Series(s).rank().to_numpy()
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{DATA}/{t}.parquet").cache() for t in ("documents", "labels"))


@pytest.mark.parametrize("target,least", [("toxic", 0.9), ("quality", 0.95)])
def test_held_out(spark, tables, target, least):
    docs, labels = tables
    op = OPERATORS[target]
    out = op.score(docs, op.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(out[target].to_numpy(), out.score) >= least
    assert out.score.between(0, 1).all() and ((out.score >= (0.5 if target == "toxic" else 0.3)) == (out.predicted == 1)).all()


def test_short_toxic_words_are_seen_alone():
    """Words of four and five letters save bytes as windows, and one or two of them tell in texts of any length."""
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("aeinorstlm"), 6)) for _ in range(300)]
    text = lambda n, bad=(): " ".join(rng.permutation([*rng.choice(plain, n), *bad]))
    marks = ["gulk", "drogg", "vex"]
    rows = [(i, text(rng.integers(3, 80), rng.choice(marks, 3) if i % 2 else ()), i % 2) for i in range(800)]
    model = toxicity.fit(pd.DataFrame(rows, columns=["id", "text", "label"]), toxicity.Settings())
    gains = model.gains()
    assert all(gains[toxicity.LEAD + f" {w} ".encode() + toxicity.TAIL][0] >= 2 for w in ("gulk", "drogg"))
    toxic = [text(n, ("gulk", "drogg")) for n in (3, 10, 60)]
    assert (model.score(toxic, gains) >= 0.5).all() and (model.score([text(n) for n in (3, 10, 60, 600)], gains) < 0.5).all()


def test_features_of_one_document_by_hand():
    """Every window of a text compressed here, one by one: lengths, covered windows, counts, and the mean of the windows of eight words."""
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("aeinorstlm"), 6)) for _ in range(200)]
    rows = [(i, " ".join(rng.permutation([*rng.choice(plain, 40), *(["gulker", "drogg"] if i % 2 else [])])), i % 2) for i in range(400)]
    model = toxicity.fit(pd.DataFrame(rows, columns=["id", "text", "label"]), toxicity.Settings())
    level = model.settings.level
    one, two = toxicity.compressor(model.ordinary, level), toxicity.compressor(model.ordinary + model.toxic, level)
    for text in (rows[1][1], rows[2][1], "Gulker!", "a " * 30 + "drogg"):
        words = text.lower().replace("!", "").split()
        saved, length = [], []
        for w in words:
            window = toxicity.LEAD + b" " + w.encode() + b" " + toxicity.TAIL
            saved.append(len(one(window)) - len(two(window)))
            length.append(len(two(window)))
        covered = [g if n <= model.whole else 0 for g, n in zip(saved, length)]
        of_class = [toxicity.compressor(x, level, 0) for x in model.classes]
        leaning = [len(of_class[0](w)) - len(of_class[1](w)) for w in (f" {' '.join(words[i : i + 8])} ".encode() for i in range(0, len(words), 8))]
        top = [*sorted(covered, reverse=True)[:2], 0][:2]
        want = [np.log1p(len(words)), np.mean(saved), np.mean(covered), *top]
        counts = [sum(x >= g for x in xs) for xs in (saved, covered) for g in toxicity.GAINS]
        want += [*np.log1p(counts), *[min(c / len(words), model.settings.most_share) for c in counts], np.mean(leaning)]
        assert np.allclose(model.features([text], model.gains())[0], want)


def test_repeated_windows_are_looked_up_once():
    """A text's work on single words grows with its distinct words; the features count every occurrence."""
    model = toxicity.Model(toxicity.Settings(), b"ordinary words of a text", b" gulker drogg ", whole=80)

    class Counted(toxicity.Gains):
        calls = 0

        def __getitem__(self, key):
            self.calls += 1
            return super().__getitem__(key)

    gains = model.gains()
    counted = Counted(gains.plain, gains.marked, gains.of_class)
    words = "a gulker a b drogg a gulker".split()
    row = model.features([" ".join(words * 100)], counted)[0]
    assert counted.calls == 4
    saved, length = np.array([gains[toxicity.LEAD + f" {w} ".encode() + toxicity.TAIL] for w in words * 100]).T
    covered = np.where(length <= model.whole, saved, 0)
    assert row[:5].tolist() == [np.log1p(700), saved.mean(), covered.mean(), *sorted(covered)[:-3:-1]]
    assert row[5:17].tolist() == [np.log1p((x >= g).sum()) for x in (saved, covered) for g in toxicity.GAINS]


def test_a_repeated_labelled_row_is_one_training_row(spark):
    docs = spark.createDataFrame([(1, "b")] * 500 + [(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = sorted((r.id, r.text) for r in training_rows(docs, labels, "toxic", 10).collect())
    assert got == [(i, t) for i, t in ((1, "a"), (2, ""), (3, "c")) if zlib.crc32(str(i).encode()) % 5]


def test_a_score_does_not_depend_on_its_batch(tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    texts = [r.text for r in docs.limit(60).collect()]
    buckets = quality.Buckets(model.settings.word_buckets)
    together = model.margin(*model.design(texts, buckets))
    alone = [model.margin(*model.design([t], buckets))[0] for t in texts]
    assert together.tolist() == alone


@pytest.mark.parametrize("target", list(OPERATORS))
def test_only_the_text_and_training_labels_count(spark, tables, target):
    docs, labels = tables
    op = OPERATORS[target]
    first = {r.doc_id: r.score for r in op.score(docs, op.train(docs, labels)).collect()}
    flipped = labels.withColumn(target, F.when(fold() == 0, 1 - F.col(target)).otherwise(F.col(target)))
    other = docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("zz").alias("source"), F.lit(1).alias("label"), F.lit(2).alias("score"))
    assert first == {r.doc_id: r.score for r in op.score(other, op.train(other, flipped)).collect()}
    moved = docs.limit(50).select((F.col("doc_id") + 10**12).alias("doc_id"), "text")
    again = {r.doc_id - 10**12: r.score for r in op.score(moved, op.train(docs, labels)).collect()}
    assert again == {k: first[k] for k in again}


@pytest.mark.parametrize("target", list(OPERATORS))
def test_edge_cases(spark, tables, target):
    docs, labels = tables
    op = OPERATORS[target]
    model = op.train(docs, labels)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "abc"), (5, "word " * 200_000), (6, "x"), (6, "x"), (1 << 60, "x")], "doc_id long, text string")
    got = op.score(rows, model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[2] and len(by[6]) == 1 and by[6] == by[1 << 60] and {r.held_out for r in got if r.doc_id is None} == {False}
    assert op.score(rows.limit(0), model).count() == 0
    none = op.score(rows, op.train(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.0 if target == "toxic" else 1.0}
    one = labels.where(F.col(target) == 1)
    assert {r.score for r in op.score(rows, op.train(docs, one)).collect()} == {1.0}
    dirty = labels.unionByName(labels.limit(20)).unionByName(spark.createDataFrame([(None, 1, 1), (7, None, None)], labels.schema))
    assert op.score(rows, op.train(docs, dirty)).count() == 8


def test_quality_keeps_columns(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    extra = docs.withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(7)).withColumn("__text", F.lit("t"))
    kept = quality.kept(extra, model)
    assert kept.columns == extra.columns and kept.schema == extra.schema
    want = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want and {r.score for r in kept.collect()} == {"mine"}


def test_machine_equals_all_pairs():
    """The linear-time identity against the sum over pairs."""
    rng = np.random.default_rng(0)
    settings = quality.Settings(word_buckets=50, rank=3)
    model = quality.Model(settings, np.zeros((0, 11)), 0.3, rng.normal(size=50), rng.normal(size=(50, 3)))
    index, value, start = rng.integers(0, 50, 20), rng.normal(size=20), np.array([0, 7, 7, 20])
    want = []
    for a, b in zip(start[:-1], start[1:]):
        pairs = sum(value[i] * value[j] * model.factors[index[i]] @ model.factors[index[j]] for i in range(a, b) for j in range(i + 1, b))
        want.append(0.3 + (model.linear[index[a:b]] * value[a:b]).sum() + pairs)
    assert np.allclose(model.margin(index, value, start), want)


def test_the_prior_does_not_depend_on_the_cap(spark):
    """A capped class counts as all its training rows: 30 to 270 stays so when 20 rows of each class are taken."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    want = {r.toxic: r["count"] for r in labels.where(fold() != 0).groupBy("toxic").count().collect()}
    for most in (20, 1000):
        rows = training_rows(docs, labels, "toxic", most).toPandas()
        got = rows.groupby("label").stands_for.sum()
        assert {k: round(v, 6) for k, v in got.items()} == want and rows.groupby("label").size().max() <= most


@pytest.mark.parametrize("target", list(OPERATORS))
def test_scores_are_calibrated_to_all_training_rows(target):
    """Of texts that tell nothing, a tenth is positive: a sample of as many rows of either class must score them so."""
    op = OPERATORS[target]
    rng = np.random.default_rng(5)
    text = lambda: " ".join(rng.choice([f"w{k}" for k in range(40)], 12))
    rows = pd.DataFrame([(i, text(), i % 2, (1.0, 9.0)[i % 2 == 0]) for i in range(400)], columns=["id", "text", "label", "stands_for"])
    model = op.fit(rows, op.Settings())
    aids = model.gains() if target == "toxic" else quality.Buckets(model.settings.word_buckets)
    sampled = op.fit(rows.drop(columns="stands_for"), op.Settings())
    odds = lambda m: np.log(m.score(texts, aids) / (1 - m.score(texts, aids))).mean()
    texts = [text() for _ in range(100)]
    assert abs(odds(model) - odds(sampled) + np.log(9)) < 0.3
