"""Registered queries against their SQL in DuckDB, at the smallest size; skipped where the tables are not there."""

import os

import duckdb
import pytest

from loomspark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rounded(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rounded([tuple(r) for r in df.collect()], df.columns) == rounded(found.fetchall(), names)


def test_retrieval_on_a_fixture(spark, tmp_path):
    """Nulls, empty texts and accents, against results by hand."""
    rows = [(1, "Đỏ xanh xanh", "en", "src1"), (2, "xanh la", None, None), (3, None, "fr", "src2"), (4, " ".join(["mot"] * 30), "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "xanh do"), (2, "la"), (3, "!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (50, [1.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r["term"], r["df"]) for r in run("document_frequency")} == {("do", 1), ("xanh", 2), ("la", 1), ("mot", 1), ("do_xanh", 1), ("xanh_xanh", 1), ("xanh_la", 1), ("mot_mot", 1)}
    assert {(r["query_id"], r["id"], r["score"]) for r in run("fts_token_fraction")} == {(1, 1, 1.0), (1, 2, 0.5), (2, 2, 1.0)}
    assert {(r["query_id"], r["id"], round(r["score"], 3)) for r in run("vector_topk")} == {(50, 1, 0.707), (50, 2, 0.0), (50, 50, 1.0)}
    assert [(r["query_id"], r["id"]) for r in run("bm25_topk") if r["rank"] == 1] == [(1, 1), (2, 2)]
    assert {r["doc_id"]: len((r["tokens"] or "").split()) for r in run("deaccent_tokens")} == {1: 3, 2: 2, 3: 0, 4: 30}
