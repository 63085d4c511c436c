import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.operators import answer as A
from docweave.operators import chunking as C
from docweave.operators import dedup as D
from docweave.operators import index as I
from docweave.operators import rank as R
from docweave.operators import search as S
from docweave.operators import termgraph as G
from docweave.operators.order import global_row_number
from docweave.operators.rewrite import rewrite_queries

MD = """intro sem título

# Relatório

Texto   da abertura.

| Indicador | Q1 2026 | Q2 2026 |
|---|:---:|---|
| NPS | 41 | - |
| **Receita** | 10 |
|  | 5 | 6 |

## Só título
## Datas
| Data | Total |
|---|---|
| 30/06/2024 | 108 |
"""


def test_sections_blocks_and_facts(spark):
    docs = spark.createDataFrame([(0, "d.md", MD, ".md", None), (1, "e.txt", "plano", ".txt", None), (2, "f.txt", "  ", ".txt", None)], "doc_pos long, source string, text string, ext string, pages int")
    got = [(r["doc_pos"], r["heading"], r["body"].split("\n")[0]) for r in C.split_sections(docs).orderBy("doc_pos", "section_pos").collect()]
    assert got == [(0, "", "intro sem título"), (0, "# Relatório", "Texto   da abertura."), (0, "## Só título", "Só título"), (0, "## Datas", "| Data | Total |"), (1, "", "plano"), (2, "", "")]
    chunks = C.chunk_documents(docs).orderBy("pos").collect()
    assert [r["pos"] for r in chunks] == list(range(len(chunks)))
    facts = [(r["metric"], r["period"], r["text"]) for r in chunks if r["kind"] == "table_fact"]
    assert facts == [
        ("NPS", "Q1 2026", "# Relatório\n\nNPS em Q1 2026: 41.\n\n| Indicador | Q1 2026 |\n| --- | --- |\n| NPS | 41 |"),
        ("Receita", "Q1 2026", "# Relatório\n\nReceita em Q1 2026: 10.\n\n| Indicador | Q1 2026 |\n| --- | --- |\n| Receita | 10 |"),
        ("30/06/2024", "30/06/2024", "## Datas\n\nData: 30/06/2024; Total: 108.\n\n| Data | Total |\n| --- | --- |\n| 30/06/2024 | 108 |"),
    ]
    assert [(r["chunk_id"], r["section"], r["text"]) for r in chunks if r["kind"] == "prose"] == [("d.md::0", "", "intro sem título"), ("d.md::1", "Relatório", "# Relatório\n\nTexto da abertura."), ("d.md::4", "Só título", "## Só título\n\nSó título"), ("e.txt::0", "", "plano")]


def chunk_rows(spark, texts, **more):
    rows = [(i, t, more.get("kind", {}).get(i, "prose"), "s", more.get("metric", {}).get(i, ""), "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pos long, text string, kind string, source_name string, metric string, period string")


def plain_dedupe(rows, threshold=0.82):
    kept, keys, sets = [], set(), []
    for pos, text, kind, source, metric, period in rows:
        t = frozenset(A.term_list(text))
        if not t or t in [k for k, _ in sets]:
            continue
        if kind == "table_fact":
            if (source, metric, period) in keys:
                continue
            keys.add((source, metric, period))
        elif any(R.set_jaccard(t, k) >= threshold or (len(t) >= 4 and R.set_containment(t, k) >= 0.92) for k, _ in sets):
            continue
        sets.append((t, pos))
        kept.append(pos)
    return kept


def test_dedupe_chunks(spark):
    base = "um dois tres quatro cinco seis sete oito nove dez onze doze"
    texts = [base, base, base + " treze", base + " treze quatorze quinze", "cinco seis sete oito", "", None, "fato alfa", "fato beta", "fato beta", "fato gama", base + " catorze dezoito vinte trinta"]
    kind, metric = {i: "table_fact" for i in (7, 8, 9, 10)}, {7: "m", 8: "m", 9: "n", 10: "n"}
    chunks = chunk_rows(spark, texts, kind=kind, metric=metric)
    kept, dropped = D.dedupe_chunks(chunks)
    want = plain_dedupe([(r["pos"], r["text"] or "", r["kind"], r["source_name"], r["metric"], r["period"]) for r in chunks.orderBy("pos").collect()])
    assert sorted(r["pos"] for r in kept.collect()) == want and dropped.count() == len(texts) - len(want)


def test_greedy_drop_chains(spark):
    pairs = [(1, 0), (2, 1), (3, 2), (4, 2), (4, 0), (6, 5)]
    got = sorted(r["pos"] for r in D.greedy_drop(spark.createDataFrame(pairs, "x long, y long")).collect())
    assert got == [1, 3, 4, 6]  # 2 stays, since 1, which it repeats, went
    assert D.greedy_drop(spark.createDataFrame([], "x long, y long")).count() == 0


def test_greedy_drop_of_long_chains_and_large_components(spark, monkeypatch):
    chain = [(i + 1, i) for i in range(300)] + [(1000 + i, 1000 + j) for i in range(12) for j in range(i) if (i * j) % 3 != 1]
    gone = set()
    for x, y in sorted(chain):
        if y not in gone:
            gone.add(x)
    rows = spark.createDataFrame(chain, "x long, y long")
    assert {r["pos"] for r in D.greedy_drop(rows).collect()} == gone
    monkeypatch.setattr(D, "COMPONENT_PAIRS", 20)  # the clique is too large for a task: rounds
    small = rows.where("x >= 1000 or x < 15")
    assert {r["pos"] for r in D.greedy_drop(small).collect()} == {p for p in gone if p >= 1000 or p < 15}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=26), min_size=2, max_size=30), st.floats(0.3, 1.0))
def test_pairs_against_all_pairs(spark, sets, t):
    df = spark.createDataFrame([(i, [f"t{x:02}" for x in sorted(s)]) for i, s in enumerate(sets)], "pos long, terms array<string>")
    jac = {(x, y) for x, a in enumerate(sets) for y, b in enumerate(sets) if a and b and len(a & b) / len(a | b) >= t}
    con = {(x, y) for x, a in enumerate(sets) for y, b in enumerate(sets) if a and b and len(a & b) / len(a) >= t}
    assert {(r["x"], r["y"]) for r in D.jaccard_pairs(df, df, t).collect()} == jac
    assert {(r["x"], r["y"]) for r in D.containment_pairs(df, df, t).collect()} == con
    near = {(x, y) for x, a in enumerate(sets) for y, b in enumerate(sets) if y < x and a and b and (len(a & b) / len(a | b) >= 0.82 or (len(a) >= 4 and len(a & b) / len(a) >= 0.92))}
    assert {(r["x"], r["y"]) for r in D.near_duplicate_pairs(df).collect()} == near


def test_near_duplicates_by_blocks_shuffle_no_candidates(spark, monkeypatch):
    from docweave.operators import setpairs

    monkeypatch.setattr(setpairs, "BLOCK_TERMS", 300)
    monkeypatch.setattr(setpairs, "EXPANDED", 50)
    sets = [{(i * j + j * j) % 61 for j in range(3 + i % 29)} for i in range(90)]
    sets += [s | {100 + i} for i, s in enumerate(sets)]
    df = spark.createDataFrame([(i, [f"t{x:03}" for x in sorted(s)]) for i, s in enumerate(sets)], "pos long, terms array<string>")
    near = {(x, y) for x, a in enumerate(sets) for y, b in enumerate(sets) if y < x and (len(a & b) / len(a | b) >= 0.82 or (len(a) >= 4 and len(a & b) / len(a) >= 0.92))}
    got = D.near_duplicate_pairs(df)
    assert len(near) > 90 and {(r["x"], r["y"]) for r in got.collect()} == near
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_block_goes_from_an_executors_disk_when_the_next_is_built(tmp_path, monkeypatch):
    import pyarrow as pa

    from docweave.operators import setpairs

    class Shared:
        def __init__(self, name):
            self._path = str(tmp_path / name)
            (tmp_path / name).write_bytes(b"block")
            rows = pa.table({"pos": pa.array([1, 2]), "n": pa.array([2, 2], pa.int32()), "ids": pa.array([[5, 6], [5, 7]], pa.list_(pa.int64()))})
            self.value = setpairs._index(rows)

    monkeypatch.setattr(setpairs, "_BUILT", {})
    a, b = Shared("a"), Shared("b")
    setpairs._built("r 0", a)
    assert setpairs._built("r 0", a)[4].tolist() == [1, 2] and (tmp_path / "a").exists()
    setpairs._built("r 5", b)
    assert not (tmp_path / "a").exists() and (tmp_path / "b").exists()


def test_components_join_a_forest_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "FOREST_PAIRS", 100)
    pairs = [(100 + x, 100 + y) for x in range(60) for y in range(x)] + [(i + 1, i) for i in range(50)] + [(91, 90), (91, 80), (92, 80)]
    rows = spark.createDataFrame(sorted(pairs, key=lambda p: (p[0] * 37 + p[1] * 11) % 101), "x long, y long").coalesce(1)
    edges = [tuple(r) for r in D._forest(rows).collect()]
    assert len(edges) == 59 + 50 + 3 and all(v < u for u, v in edges) and {v for _, v in edges} == {100, 0, 80}
    want = {**{100 + x: 100 for x in range(60)}, **{i: 0 for i in range(51)}, **{i: 80 for i in (80, 90, 91, 92)}}
    assert {r["x"]: r["c"] for r in D._components(rows.repartition(5)).collect()} == want


def test_index_values(spark):
    chunks = spark.createDataFrame([(0, "gato preto"), (1, "gato branco branco"), (2, "cachorro gato"), (3, "")], "pos long, text string")
    counts = I.term_counts(chunks)
    df, size = I.document_frequency(counts), I.corpus_size(chunks)
    idf = {r["term"]: r["idf"] for r in I.bm25_idf(df, size).collect()}
    assert math.isclose(idf["preto"], math.log(3.5 / 1.5 + 1))
    vocabulary = I.tfidf_vocabulary(df, size)
    got = {r["term"]: r["idf"] for r in vocabulary.collect()}
    assert set(got) == {"gato", "preto", "branco", "cachorro"} and math.isclose(got["preto"], math.log(5 / 2) + 1)
    assert [r["term_id"] for r in I.with_term_ids(vocabulary).orderBy("term").collect()] == [0, 1, 2, 3]
    norms = I.tfidf_weights(counts, vocabulary).groupBy("pos").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(math.isclose(r["n"], 1) for r in norms)
    everywhere = spark.createDataFrame([(i, "igual sempre") for i in range(3)], "pos long, text string")
    c = I.term_counts(everywhere)
    assert I.tfidf_vocabulary(I.document_frequency(c), I.corpus_size(everywhere)).count() == 2  # nothing is left within the limit: all


def test_neighbors_in_order_of_first_sight(spark):
    chunks = spark.createDataFrame([(0, "zeta alfa beta"), (1, "alfa gama zeta"), (2, "so")], "pos long, text string")
    near = I.neighbors(I.cooccurrence(chunks), I.graph_df(chunks))
    assert [(r["b"], r["rank"]) for r in near.where("a = 'alfa'").orderBy("rank").collect()] == [("zeta", 1), ("beta", 2), ("gama", 3)]


def test_cooccurrence_is_summed_by_hash(spark):
    chunks = spark.createDataFrame([(7, "zeta alfa beta"), (-3, "beta gama zeta"), (9, "alfa beta")], "pos long, text string")
    got = I.cooccurrence(chunks)
    seen = {(r["a"], r["b"]): (r["c"], r["seen"]["pos"], r["seen"]["at"]) for r in got.collect()}
    assert seen["zeta", "beta"] == (2, -3, 0) and seen["beta", "zeta"] == (2, -3, 2)
    assert seen["alfa", "beta"] == (2, 7, 2) and seen["beta", "alfa"] == (2, 7, 1) and len(seen) == 10
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def graph_rows(df):
    return sorted((r["a"], r["b"], round(r["weight"], 9), r["rank"], r["df_b"]) for r in df.collect())


def prose(n, words, least=0, most=30, seed=5):
    rng = random.Random(seed)
    return [(i * 7 % n - 3, " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(rng.randint(least, most)))) for i in range(n)]


def test_term_neighbors_equal_those_of_all_pairs(spark, monkeypatch):
    chunks = spark.createDataFrame([*prose(150, 120), (9000, None), (9001, ""), (9002, "so")], "pos long, text string")
    want = graph_rows(I.neighbors(I.cooccurrence(chunks), I.graph_df(chunks), 5))
    got = G.term_neighbors(chunks, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert graph_rows(got) == want and "Generate" not in plan and "Aggregate" not in plan  # no row for a pair
    monkeypatch.setattr(G, "HELD", 900)  # cells in waves, and frequent terms in cells of their own
    df, work = np.array([600, 400, 3, 2, 2]), np.array([1200, 800, 60, 40, 40])
    assert G._cells(df, work, 2)[0].tolist() == [2, 0, 1, 0, 1] and G._cells(df, work, 2)[1:] == (2, 4)
    assert graph_rows(G.term_neighbors(chunks, 5)) == want
    monkeypatch.setattr(G, "SENT", 10)
    assert graph_rows(G.term_neighbors(chunks, 5)) == want
    assert graph_rows(G.term_neighbors(chunks.where("pos > 8999"))) == []


def test_term_neighbors_are_summed_in_steps(monkeypatch):
    texts = [(p, A.term_list(t or "")) for p, t in prose(80, 60, 2)]
    lists = [(p, list(dict.fromkeys(t))) for p, t in texts]
    lists = [(p, t) for p, t in lists if len(t) >= 2]
    c, seen, df = Counter(), {}, Counter(x for _, t in lists for x in t)
    for p, t in sorted(lists):
        for x in t:
            for at, y in enumerate(t):
                if x != y:
                    c[x, y] += 1
                    seen.setdefault((x, y), (p, at))
    words = sorted(df, key=lambda w: (-df[w], w))
    idf = np.array([math.log((len(lists) + 1) / (df[w] + 1)) + 1 for w in words])
    want = set()
    for x in words:
        near = sorted((-round(c[x, y] * idf[words.index(y)], 9), seen[x, y], y) for y in words if (x, y) in c)[:4]
        want |= {(x, y, k) for k, (_, _, y) in enumerate(near, 1)}
    batches = [pa.RecordBatch.from_arrays([pa.array([p for p, _ in part]), pa.array([t for _, t in part])], ["pos", "terms"]) for part in (lists[:30], lists[30:])]
    counts = np.array([df[w] for w in words])
    for step, dense, alone in ((1 << 18, 1e-3, 3), (64, 1e-3, 3), (1 << 10, 1, 3), (64, 1e-3, 0)):
        monkeypatch.setattr(G, "STEP", step)
        monkeypatch.setattr(G, "DENSE", dense)
        cell = (np.arange(len(words)) % 3 if alone else np.arange(len(words))).astype(np.int32)
        dealt = list(G._deal(iter(batches), pa.array(words), cell, 0, int(cell.max()) + 1))
        got = [r for b in G._near(iter(dealt), pa.array(words), counts, idf, cell, alone, 4) for r in b.to_pylist()]
        assert {(r["a"], r["b"], r["rank"]) for r in got} == want and len(got) == len(want)
        assert all(r["df_b"] == df[r["b"]] and math.isclose(r["weight"], c[r["a"], r["b"]] * idf[words.index(r["b"])]) for r in got)


def test_search_and_fusion(spark):
    chunks = spark.createDataFrame([(0, "maçã verde"), (1, "maçã maçã vermelha"), (2, "pera"), (3, "nada aqui mesmo")], "pos long, text string")
    queries = spark.createDataFrame([("a", "maçã"), ("b", "xyz")], "query_id string, text string")
    counts = I.term_counts(chunks)
    df, size = I.document_frequency(counts), I.corpus_size(chunks)
    sparse = S.bm25_search(queries, I.bm25_postings(counts, I.chunk_lengths(chunks), df, size), 3)
    assert [(r["query_id"], r["pos"], r["rank"]) for r in sparse.orderBy("query_id", "rank").collect()] == [("a", 1, 1), ("a", 0, 2)]
    vocabulary = I.tfidf_vocabulary(df, size)
    dense = S.dense_search(queries, I.tfidf_weights(counts, vocabulary), vocabulary, chunks, 3)
    rows = [(r["query_id"], r["pos"], round(r["score"], 6) > 0) for r in dense.orderBy("query_id", "rank").collect()]
    assert rows == [("a", 1, True), ("a", 0, True), ("a", 2, False), ("b", 0, False), ("b", 1, False), ("b", 2, False)]
    rrf = {(r["query_id"], r["pos"]): r["rrf"] for r in S.rrf_fuse([dense, sparse]).collect()}
    assert math.isclose(rrf["a", 1], 2 / 61) and math.isclose(rrf["b", 2], 1 / 63)
    lists = [spark.createDataFrame([("q", 1, 0.5, 1), ("q", 9, 0.4, 2)], "query_id string, pos long, score double, rank int"), spark.createDataFrame([("q", 1, 6.0, 1), ("q", 2, 2.0, 2)], "query_id string, pos long, score double, rank int")]
    fused = {r["pos"]: r["rrf"] for r in S.hybrid_fuse(*lists).collect()}
    assert math.isclose(fused[9], 1 / 62 + 0.05 * (0.5 * 0.4 + 0.5 * -0.5))  # not clamped


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.sets(st.integers(0, 6), max_size=5)), max_size=8), st.floats(0, 1), st.integers(1, 6))
def test_mmr_against_a_plain_loop(items, lam, k):
    rel, sets = [r for r, _ in items], [s for _, s in items]
    chosen, left = [], list(range(len(items)))
    while left and len(chosen) < k:
        best, score = None, -1.0
        for i in left:
            value = lam * rel[i] - (1 - lam) * max((R.set_jaccard(sets[i], sets[j]) for j in chosen), default=0.0)
            if value > score:
                best, score = i, value
        if best is None:
            break
        chosen.append(best)
        left.remove(best)
    assert R.mmr(rel, lambda i, j: R.set_jaccard(sets[i], sets[j]), lam, k) == chosen
    assert R.mmr(rel, lambda i, j: R.set_jaccard(sets[i], sets[j]), 1.0, k) == sorted(range(len(rel)), key=lambda i: -rel[i])[:k]


def frame(**more):
    return {"kind": "generic", "year": None, "period_n": None, "period_token": None, "people": False, "drop": []} | more


def rewritten(spark, rows, df=None, near=None):
    """The rewriting of (question, history, hint) rows with a graph of 100 chunks."""
    queries = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_id long, question string, history string, hint string")
    gdf = spark.createDataFrame([(t, n, 100) for t, n in (df or {}).items()], "term string, df long, n long")
    edges = [(a, b, w, i + 1, (df or {}).get(b, 1)) for a, c in (near or {}).items() for i, (b, w) in enumerate(c)]
    return rewrite_queries(queries, spark.createDataFrame(edges, "a string, b string, weight double, rank int, df_b long"), gdf).orderBy("query_id").collect()


def test_rewrite(spark):
    df = {"receita": 5, "lucro": 4, "q1": 5, "2025": 9, "comum": 60, "p1": 3, "2026": 9, "incidente": 2, "ack": 2}
    near = {"receita": [("lucro", 3.0), ("comum", 2.0), ("2025", 1.0), ("2026", 0.5)], "2026": [("lucro", 1.0), ("receita", 1.0)], "q1": [("lucro", 1.0)], "p1": [("incidente", 2.0), ("ack", 1.0)]}
    plain, period = rewritten(spark, [("a receita", None, None), ("receita p1 2026", None, None)], df, near)
    assert plain["keywords"] == ["receita", "lucro"]  # comum is commoner, 2025 wasn't asked
    assert period["frame"]["kind"] == "quantity_period" and period["keywords"] == ["receita", "2026", "lucro", "q1"] and any(n.startswith("p1:") for n in period["notes"])
    steps, short, empty = rewritten(spark, [("passo a passo deploy", None, None), ("sim", "historia longa", "dica"), ("de", None, None)])
    assert steps["frame"]["kind"] == "procedure" and steps["keywords"] == ["passo", "deploy"] and steps["notes"]
    assert short["keywords"] == ["sim", "historia", "longa", "dica"]
    assert empty["search_query"] == "de" and empty["keywords"] == [] and empty["metric_want"] == []


def test_question_terms(spark):
    df = {"receita": 5, "lucro": 4, "q1": 5, "comum": 60, "p1": 3}
    (t,) = rewritten(spark, [("qual receita lucro comum q1 p1 fazer", None, None)], df, {"receita": [("lucro", 3.0), ("margem", 1.0)]})
    assert t["frame"]["drop"][0] == "fazer" and t["route_terms"] == ["receita", "lucro", "q1"] and t["metric_terms"] == ["fazer", "lucro", "q1", "receita"]
    assert t["metric_want"] == ["fazer", "lucro", "q1", "receita", "margem"] and t["quality_terms"] == ["receita", "lucro", "q1", "p1"] and t["quality_near"][0] == ["lucro", "margem"]


def test_a_term_of_another_sense_goes(spark):
    near = {"banco": [("praça", 2.0), ("jardim", 1.0)], "juros": [("taxa", 2.0), ("prazo", 1.0)], "taxa": [("juros", 2.0), ("prazo", 1.0)], "prazo": [("juros", 1.0), ("taxa", 1.0)]}
    (got,) = rewritten(spark, [("banco juros taxa prazo", None, None)], {t: 5 for t in near}, near)
    assert "banco" not in got["keywords"] and got["keywords"][:3] == ["juros", "taxa", "prazo"] and got["notes"][0].startswith("banco:")


def test_answers_and_verdicts():
    hits = [
        {"kind": "prose", "text": "A política de férias dá 30 dias por ano ao funcionário. Veja também o manual completo de benefícios.", "section": "Férias", "period": "", "source_name": "politica_ferias.md", "route": 1.0, "rerank": 0.8},
        {"kind": "prose", "text": "O gato dorme no telhado durante a tarde inteira hoje.", "section": "", "period": "", "source_name": "gatos.md", "route": 0.04, "rerank": 0.2},
    ]
    text = A.draft("Quantos dias de férias?", frame(kind="quantity", drop=[]), [], ["dias", "ferias"], hits, None)
    assert text == "A política de férias dá 30 dias por ano ao funcionário.\n\nFontes: politica_ferias.md"
    assert A.draft("x", frame(), [], [], [], None) == A.NO_HITS and A.draft("nada disso", frame(), [], ["nada"], hits[1:], None) == A.NO_SPANS
    context = " ".join(A.fold_text(h["text"]) for h in hits)
    ok = A.verify(frame(kind="quantity"), ["dias", "ferias"], [[], []], text, context)
    assert ok["ok"] and ok["grounded"]
    assert not A.verify(frame(kind="quantity", year="2020"), ["dias"], [[]], text, context)["ok"]
    assert not A.verify(frame(), ["dias"], [[]], "", context)["ok"]
    assert A.answer_redundancy("Uma frase bem comprida sobre deploy. Uma frase bem comprida sobre deploy.") == 1.0
    assert A.hit_spans("table_fact", "## KPI\n\nNPS em Q1: 41.\n\n| a | b |") == ["NPS em Q1: 41."]
    old = [("Valor de 100 reais em 2024", "p_2024.md", 0.9), ("Valor de 200 reais em 2025", "p_2025.md", 0.5)]
    assert A.best_year(old[1][1]) == 2025


def test_retrieval_quality(spark):
    queries = spark.createDataFrame([(1, ["gato", "azul"], [[], ["preto"]]), (2, ["nada"], [[]]), (3, [], [])], "query_id long, quality_terms array<string>, quality_near array<array<string>>")
    hits = spark.createDataFrame([(1, 1, "Gato preto", 0.9), (1, 2, "gato branco", 0.5), (3, 1, "x", 2.0)], "query_id long, rank int, text string, rerank double")
    got = {r["query_id"]: r for r in A.retrieval_quality(queries, hits).collect()}
    assert math.isclose(got[1]["score"], 0.5 + 0.35 * 0.9 + 0.15 * (1 - 1 / 3)) and got[1]["ok"] and got[1]["missing"] == []
    assert got[2]["score"] == 0 and not got[2]["ok"] and got[2]["missing"] == ["nada"]
    assert math.isclose(got[3]["score"], 0.35 + 0.15)


def test_global_row_number(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert [r["n"] for r in global_row_number(df, ["k"], "n").orderBy("k").collect()] == list(range(1, 1001))
