"""Queries with SQL against that SQL, on the given tables and on tables of edge cases."""

import os

import duckdb
import pytest

from tests.conftest import SF
from tideflow.llm import queries

TABLES = ("documents", "benchmark", "conversations")
SAID = "ka lo mi ter an su ve ri ol be do fa ge hu iv "


def edge_documents():
    base = SAID * 6
    rows = [(0, None), (1, ""), (2, "  \n "), (3, "one two"), (4, "One, two!"), (5, base), (6, base), (7, base.replace("mi", "mo", 1)), (8, "!!!"), (9, "!!!"), (10, "ü" * 30)]
    rows += [(11, "Intro here.\nReleased under the MIT License. Licensed under the Apache License, Version 2.0.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")]
    rows += [(12, "long " * 30000 + "All rights reserved."), (13, "A | B | C"), (14, "see http://x.y or a@b.c"), (15, "WOW!! NO!!"), (5, base), (None, "null id text that stands alone here"), (None, "null id text that stands alone here")]
    rows += [(20 + k, SAID * 2 + " ".join(f"w{k}x{j}" for j in range(k))) for k in range(12)]
    return [(i, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else f"s{k % 3}", "x", "y") for k, (i, t) in enumerate(rows)]


def edge_benchmark():
    return [(0, SAID), (1, SAID + "zu zu"), (1, "other text with the same id as before it"), (2, None), (3, ""), (4, "one two three"), (5, "long " * 9), (None, "null id text that stands alone here")]


def edge_conversations():
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a<|end|>b \\ [INST] \\l \\b <s></s>"), (1, 1, "assistant", "a"), (2, 0, None, "x"), (2, 0, "<|start|>", ""), (None, 0, "assistant", "é\n\U0001f600"), (None, 1, "user", "y")]
    rows += [(4, 0, "assistant", x) for x in ("a!", "a", "a\\", "a<s>", "a[INST]", "a\\l", "a\\b", "a<", "aZ", "")]  # ties: by what is said, not by its escapes
    return rows + [(3, k, ("user", "assistant")[k % 2], f"turn {k} " * 50) for k in range(300)]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(edge_documents(), "doc_id long, text string, lang string, source string, item_id string, gram string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(edge_benchmark(), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(edge_conversations(), "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="module")
def nothing(spark, edges, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    for t in TABLES:
        spark.read.parquet(f"{edges}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect())
    want = con.sql(queries.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(repr(r[k]) for k in order) for r in want.fetchall())
    return len(got)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_given_tables(spark, name):
    assert compare(spark, SF, name) > 0


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_edge_cases(spark, edges, name):
    assert compare(spark, edges, name) > 0


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_empty_tables(spark, nothing, name):
    assert compare(spark, nothing, name) == (1 if name.startswith("op2_") else 0)
