"""The pipeline's stages, each on what the one before it kept."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_ngram_join import brute as groups_of
from tests.llm.test_suffix_dedup import brute_kept as left_of
from tideflow.llm import common, quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_keep_columns(stages):
    for frame in stages:
        assert frame.columns == stages[0].columns and [f.dataType for f in frame.schema] == [f.dataType for f in stages[0].schema]
    counts = [f.count() for f in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0 and counts[2] == counts[3]


def test_each_stage(spark, stages):
    rows = [{r.doc_id: r.text for r in f.collect()} for f in stages]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = quality.score(stages[0], quality.train(stages[0], labels))
    assert set(rows[1]) == {r.doc_id for r in scored.where("predicted = 1").collect()}
    ids = sorted(rows[1])
    root, _ = groups_of([rows[1][i] for i in ids])
    assert set(rows[2]) == {ids[k] for k in set(root)}
    ids = sorted(rows[2])
    for i, left in zip(ids, left_of([rows[2][i] for i in ids], 200)):
        assert rows[3][i] == left.decode("utf-8", "ignore")
    assert set(rows[4]) <= set(rows[3]) and all(rows[4][i] == rows[3][i] for i in rows[4])
    assert set(rows[5]) <= set(rows[4]) and all(rows[5][i] == rows[4][i] for i in rows[5])


def test_run_equals_stages(spark, stages):
    before = list(common._tables)
    assert sorted(map(tuple, cp.run(spark, DATA).collect())) == sorted(map(tuple, stages[-1].collect()))
    assert common._tables == before and all(Path(p.removeprefix("file:")).exists() for p in before)


def test_stages_take_edge_cases(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "x " * 100_000, None, "s", 7), (3, "x " * 100_000, None, "s", 7)]
    rows += [(10 + k, " ".join(rng.choice(["a", "b", "c", "dd"], 80)), "en", "s", 1) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit("mine") for n in ("__text", "__hash", "__id", "__own_hash", "__tokens", "own", "text_hash", "spans", "score", "cls")})
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in cp.STAGES:
            now = stage(spark, now, DATA)
            assert now.columns == docs.columns and {r.own + r.cls + r["__hash"] for r in now.collect()} <= {"mine" * 3}
        assert now.count() <= frame.count()
