"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docweave.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat(" ")
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["html_to_markdown", "chunk_corpus", "rewrite_query", "answer_verdicts"])
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_greedy_query_against_a_plain_loop(spark):
    import pyarrow.parquet as pq

    from docweave.operators.answer import term_set
    from docweave.operators.rank import set_containment, set_jaccard

    kept = []
    for r in sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"]):
        t = term_set(r["text"] or "")
        if t and not any(set_jaccard(t, k) >= 0.82 or (len(t) >= 4 and set_containment(t, k) >= 0.92) for _, k in kept):
            kept.append((r["doc_id"], t))
    assert sorted(r["doc_id"] for r in QUERIES["near_duplicate_greedy"](spark, SF).collect()) == [i for i, _ in kept]


def test_near_duplicate_members_name_every_document(spark, tmp_path):
    base = " ".join(f"palavra{i}" for i in range(20))
    texts = [base, base, " ".join(reversed(base.split())), base + " outra", "coisa bem diferente", "", None, base + " outra"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["near_duplicate_members"](spark, f"file://{tmp_path}").select("doc_id", "representative", "n_links").collect()}
    assert got == {(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 3, 1), (4, 4, 0), (5, None, 0), (6, None, 0), (7, 3, 1)}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert set(c.sql(SQL["near_duplicate_members"]).fetchall()) == got


@pytest.mark.parametrize("name", ["near_duplicate_greedy", "near_duplicate_members"])
def test_near_duplicate_term_tables_go_when_read(spark, name):
    from docweave.runtime import shared_root

    root = shared_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    got = QUERIES[name](spark, SF)
    left = {p.split("-")[0] for p in set(os.listdir(root)) - before}
    assert not left & {"hashed", "arranged"} and "classes" in left
    assert got.count() > 0


def test_entry_without_the_llm_folder(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def missing(name, *a, **k):
        if name.startswith("docweave.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def test_turn_neighbors_of_turns_at_one_place(spark, tmp_path):
    turns = [(0, 100000, "zeta alfa zeta beta"), (1, 0, "beta gama alfa delta"), (1, 0, "gama zeta"), (None, 1, "alfa beta zeta"), (2, None, "alfa gama"), (3, 0, None), (4, 0, "delta gama"), (5, 1, "so")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = QUERIES["turn_neighbors"](spark, f"file://{tmp_path}")
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(SQL["turn_neighbors"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
