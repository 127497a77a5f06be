import numpy as np
import pytest
from pyspark.sql import functions as F

from tideflow.llm import decontamination as dc


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_planted_passages(spark, broadcast_rows):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(3000)]
    items = [" ".join(rng.choice(words, n)) for n in (8, 20, 55, 200)]
    docs, want = [], set()
    for k in range(40):
        text = list(rng.choice(words, 3000))
        if k % 4 == 0:
            which = k // 4 % 4
            text[1000:1000] = items[which].upper().split()
            want.add((k, which))
        if k % 4 == 1:  # half an item is no leak
            text[10:10] = items[2].split()[:27]
        docs.append((k, " ".join(text), "extra"))
    docs.append(docs[0])
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    settings = dc.Settings(broadcast_rows=broadcast_rows)
    assert sorted((r.doc_id, r.item_id) for r in dc.report(d, b, settings).collect()) == sorted(want)
    left = dc.clean(d, b, settings)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == [k for k in range(40) if k % 4]


def test_the_search_prunes_and_loses_nothing(spark):
    """Of the pairs that share a shingle only few reach verification, and all true ones do."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    settings = dc.Settings()
    table = dc.item_table(items, settings)
    pairs = {(r.doc_id, r.item_id) for r in dc.searched(docs, table, settings).collect()}
    rows = dc.numbered(dc.texts(docs)).select("doc_id", F.explode(F.array_distinct(dc.shingled("__w", 5))).alias("gram"))
    shared = {(r.doc_id, r.item_id): r.n / r.item_grams for r in rows.join(table, "gram").groupBy("doc_id", "item_id", "item_grams").agg(F.count("*").alias("n")).collect()}
    true = {k for k, v in shared.items() if v >= settings.threshold}
    assert true <= pairs <= set(shared) and table.where("sketched").count() < table.count()
    # a document that shares a third of an item does not get to verification
    words = [f"w{k}" for k in range(200)]
    part = spark.createDataFrame([(1, " ".join(words[:70] + ["x"] * 400))], "doc_id long, text string")
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert dc.searched(part, dc.item_table(item, settings), settings).count() == 0


def test_clashing_columns_and_null_ids(spark):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(None, f"a b {item} c", "h", "i"), (0, "clean text of six words here", "h2", "i2"), (None, None, "h3", "i3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __own_hash string, own string")
    items = spark.createDataFrame([(None, item), (2, None)], "item_id long, text string")
    left = dc.clean(docs, items)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == sorted(rows[1:], key=str)
    assert [(r.doc_id, r.item_id, r.containment) for r in dc.report(docs, items).collect()] == [(None, None, 1.0)]
    assert dc.report(docs.limit(0), items).count() == dc.report(docs, items.limit(0)).count() == 0


def test_plan_is_native_and_pushes_columns(spark):
    from tests.conftest import SF

    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    search = dc.searched(docs, dc.item_table(items, dc.Settings()))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in search and "BroadcastHashJoin" in search
    for plan in (search, dc.report(docs, items)._jdf.queryExecution().toString()):
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_hits_needed():
    settings = dc.Settings()
    for k in range(1, settings.sketch + 1):
        assert 1 <= dc.hits_needed(k, settings) <= k
