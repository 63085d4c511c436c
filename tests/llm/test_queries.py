"""The registered queries themselves on written tables with awkward rows, against their SQL in DuckDB."""

import duckdb
import pytest

from docweave.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import awkward, docs, filler, prose
from tests.test_catalog import rows

ITEM = filler(9, 30)


def texts():
    base = prose(77, 60)
    long_line = filler(30, 20)
    junk = [" ".join(f"{w.upper()}!!$$$" for w in filler(99 + i, 80).split()) for i in range(3)]
    lines = [f"{filler(200 + i, 5)}\n{long_line}\n{filler(300 + i % 2, 6)}\n{filler(301 + i % 2, 6)}" for i in range(4)]
    near = [base.replace("the", f"the{i}", 1) for i in range(4)]
    return [*awkward(), *junk, *lines, base, *near, "x " + ITEM.upper() + " y", ITEM[:-3], "lonely  ITEM!", "a b c " * 60, *(prose(i, 90) for i in range(500, 520))]


def write(spark, path, texts_):
    d = docs(spark, texts_, extra=("piece", "name", "kept", "cluster"))
    langs = "case when doc_id % 11 = 3 then null when doc_id % 7 = 2 then 'xx' else 'en' end"
    from pyspark.sql import functions as F

    d.withColumn("lang", F.expr(langs)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "lonely item"), (3, None), (4, "!!"), (1, ITEM), (5, filler(7, 13))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(i, None if i == 3 else f"http://a/{i}%20x", t) for i, t in enumerate([*awkward(), "p" * 1000, "p" * 1000, "é" * 600, "é" * 600, "q" * 999, "q" * 999])]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).write.parquet(f"{path}/pages.parquet")
    turns = [(c, t, ("user", "assistant", "system")[t % 3], x) for c, x in enumerate(["hi", None, "", "</s>[INST] x", "\\[INST] <<SYS>>\n", "é😀"]) for t in range(c + 1)]
    turns += [(50 + i, t, "assistant" if t else "user", f"common {t * (i % 3)}") for i in range(6) for t in range(3)] + [(60, 0, None, "x"), (60, 1, "a\\b\nc", "y")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    write(spark, f"file://{path}", texts())
    return path


def compare(spark, path, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, f"file://{path}"), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert [x for x in a if x not in b] == [] and a == b
    return a


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(spark, tables, name):
    assert compare(spark, tables, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_of_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], docs(spark, []).schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    for t, schema in (("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, f"file://{tmp_path}").count() == (1 if name == "op3_chat_tree" else 0)
