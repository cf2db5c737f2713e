"""The corpus queries that have SQL, against it: on the given tables and on awkward rows."""

import os

import duckdb
import pytest

from gradus.llm import queries

from . import fixtures

SF = "/root/testdata/sf0.01"
NAN = float("nan")
VECTORS = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, None), (3, []), (4, [NAN, 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (50, [1.0, 2.0]), (100, [1.0, 2.0, 3.0]), (101, [3.0, 2.0, 1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (8, [-0.001, 0.999]), (9, [0.5, -0.25]), (10, [0.25, 0.25])]
WORDS = " ".join(f"w{i % 61}x{i}" for i in range(80))
NEAR = [(20, WORDS, "en", "a", 1), (21, WORDS.upper() + " end", "en", "a", 1), (22, "start " + WORDS + " end", "en", "a", 1), (23, "start here " + WORDS + " end", "en", "a", 1), (24, "A b", "en", "a", 1), (25, "a\vB ", "en", "a", 1), (20, "other text of the same id", "en", "a", 1)]


def rows(frame):
    return sorted((tuple(x if x is None or isinstance(x, str) else int(x) for x in r) for r in frame), key=str)


def expected(folder, name, columns):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')" if os.path.isdir(f"{folder}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return rows(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    fixtures.documents(spark, fixtures.DOCS + NEAR).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 1), (9, 1, 1), (22, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_awkward_rows_equal_sql(spark, awkward, name):
    got = queries.queries()[name](spark, awkward)
    assert rows(got.collect()) == expected(awkward, name, got.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_tables_equal_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    assert rows(got.collect()) == expected(SF, name, got.columns)
