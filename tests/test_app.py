import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from docweave import agent as G
from docweave import cli
from docweave.operators import answer as A
from docweave.plans import engine as E
from docweave.settings import Settings
from docweave.sources import convert as C
from docweave.sources.files import convert_files, load_documents

CORPUS = {
    "politica_ferias.md": "# Política de férias\n\nCada funcionário tem direito a 30 dias de férias por ano, segundo a política vigente.\n\nO pedido deve ser feito com 45 dias de antecedência ao gestor direto da área.\n",
    "metricas_vendas.md": "# Métricas de vendas\n\n## Receita\n\n| Indicador | Q1 2026 | Q2 2026 |\n|---|---|---|\n| Receita líquida | R$ 12 mi | R$ 14 mi |\n| Margem | 31% | 33% |\n",
    "sub/compostagem.md": "# Compostagem\n\nA pilha de folhas secas precisa de água e de ar para virar adubo em poucos meses.\n",
    "rios.md": "# Rios\n\n" + "\n\n".join(f"## Rio {n}\n\nO rio {n} nasce na serra {n}eira e corre para o mar de {n}opolis." for n in "aran bico cural delmo ermon fubal gorim hiten ilapo jurum kolan limbe morun napel orgil pavor quimel rostan".split()) + "\n",
    "nota.txt": "Uma nota curta sobre o escritório novo em Tapira, aberto no verão.\n",
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in CORPUS.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    (root / "blank.md").write_text(" \n")
    (root / "skip.xyz").write_text("x")
    return str(root)


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return E.ingest(load_documents(spark, corpus), Settings(), str(tmp_path_factory.mktemp("index")))


def test_load_documents(spark, corpus):
    rows = load_documents(spark, corpus).orderBy("doc_pos").collect()
    assert [(r["doc_pos"], r["source"], r["ext"]) for r in rows] == [(0, "metricas_vendas.md", ".md"), (1, "nota.txt", ".txt"), (2, "politica_ferias.md", ".md"), (3, "rios.md", ".md"), (4, "sub/compostagem.md", ".md")]
    assert [r["text"] for r in rows] == [CORPUS[r["source"]] for r in rows]
    assert load_documents(spark, corpus + "/nota.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        load_documents(spark, corpus + "/none")


def test_index_saves_and_loads(spark, index):
    bundle, counts = index
    assert counts["documents"] == 5 and counts["sources"] == sorted(CORPUS) and bundle.latest.first()[0] == "2026"
    assert bundle.meta.first()["chunk_count"] == counts["chunks"] == bundle.chunks.count()
    with pytest.raises(FileNotFoundError):
        E.load_index(spark, counts["index_dir"] + "/none")


def test_ask_many(spark, index):
    q = spark.createDataFrame([(1, "Quantos dias de férias cada funcionário tem?"), (2, "Qual a receita líquida na Q2 de 2026?"), (3, "Qual a cor do submarino nuclear?"), (4, None)], "query_id long, question string")
    got = {r["query_id"]: r for r in E.ask_many(q, index[0]).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert "30 dias" in got[1]["text"] and "politica_ferias.md" in got[1]["text"] and got[1]["quality_ok"] and got[1]["answer_ok"]
    assert "Receita líquida em Q2 2026: R$ 14 mi." in got[2]["text"]
    assert got[3]["text"].startswith(E.REFUSAL) and not (got[3]["quality_ok"] and got[3]["answer_ok"]) and got[3]["attempts"] == 3
    assert got[1]["citations"][0]["rank"] == 1 and len(got[1]["citations"]) <= 6


def test_agent_post_and_tools(spark, index):
    agent = G.ChatAgent(spark, index[0])
    post = G.Post(agent)
    reply = post.deliver(G.Letter("me", "rag_chat", "Quantos dias de férias cada funcionário tem?"))
    assert reply.answer_ok and "30 dias" in reply.text and reply.citations and [line.split(":")[0] for line in reply.trace[:3]] == list(agent.ORDER)
    assert [e.sender for e in post.letters] == ["me", "rag_chat"] and post.letters[1].about == {"quality_ok": True, "answer_ok": True}
    with pytest.raises(KeyError):
        post.deliver(G.Letter("me", "other", "x"))
    listed = agent.tools.schemas()
    assert [t["name"] for t in listed] == list(agent.ORDER) and listed[1]["inputSchema"]["required"] == ["question", "hits"]
    with pytest.raises(KeyError):
        agent.tools.call("none")
    assert agent.tools.call("draft_answer", question="x", hits=[]) == A.NO_HITS
    agent.tools.put(G.Tool("rewrite_and_retrieve", "", {"question": "string"}, lambda question: 1 / 0))
    failed = agent.run("x")
    assert "rewrite_and_retrieve" in failed.text and "division by zero" in failed.text and not failed.answer_ok
    unknown = agent.tools.use("none")
    assert not unknown.ok and "none" in unknown.failure
    assert [r["role"] for r in agent.memory.rows()] == ["user", "assistant"] * 2


def test_a_script_that_never_ends(spark):
    class Loop(G.Agent):
        def script(self, said, trace):
            while True:
                yield "echo", {"x": said}

    reply = Loop([G.Tool("echo", "", {"x": "string"}, lambda x: x)]).run("a")
    assert len(reply.trace) == G.STEPS and not reply.answer_ok


def test_default_post(spark, index):
    post = G.default_post(spark, Settings(index_dir=index[1]["index_dir"]))
    assert list(post.agents) == ["rag_chat"]


def test_memory():
    m = G.Memory(2)
    for i in range(6):
        m.note("user" if i % 2 == 0 else "assistant", str(i))
    assert [x["content"] for x in m.rows()] == ["2", "3", "4", "5"] and m.asked() == ["2", "4"]


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = "".join(f'<w:style w:styleId="s{i}"><w:name w:val="{s}"/></w:style>' for i, (s, _) in enumerate(paragraphs))
    body = "".join(x if s == "raw" else f'<w:p><w:pPr><w:pStyle w:val="s{i}"/></w:pPr>{x}</w:p>' for i, (s, x) in enumerate(paragraphs))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
    return out.getvalue()


def run_(text, props=""):
    return f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"


DOCX = docx([("Heading 2", run_("Título")), ("Normal", run_("a ") + run_("b", "<w:b/>") + run_("c", "<w:b/><w:i/>")), ("List Number", run_("um")), ("Lista", run_("dois")), ("Subtitle", run_("sub")), ("raw", "<w:tbl><w:tr><w:tc><w:p>" + run_("x") + "</w:p></w:tc><w:tc><w:p>" + run_("y") + "</w:p></w:tc></w:tr><w:tr><w:tc><w:p>" + run_("1") + "</w:p></w:tc></w:tr></w:tbl>"), ("Normal", "")])


def test_converters():
    assert C.docx_markdown("d", DOCX) == "## Título\n\na **b*****c***\n\n1. um\n\n- dois\n\n## sub\n\n| x | y |\n| --- | --- |\n| 1 |  |\n"
    assert C.docx_text(DOCX).split("\n")[:2] == ["Título", "a bc"]
    assert [C.heading_level(s) for s in ("título 3", "heading 9", "title", "normal")] == [3, 6, 1, None]
    assert C.csv_markdown("a_b", b"x;y\n1;2\n\n3;4\n") == "# a b\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n"
    assert C.pipe_table([["x", "y"], ["1"]]) == "| x | y |\n| --- | --- |\n| 1 |  |"
    assert C.csv_markdown("a", b"") == "# a\n\n\n"
    html = "<title>T</title><script>no()</script><h2>A</h2><p>um <b>dois</b> <i>x</i></p><ul><li>i</li></ul><a href='u'>l</a><a>m</a><td>1</td><td>2</td>"
    assert C.html_text(html) == "T\n\n## A\n\num **dois***x*\n\n- i[l](u)[m]12"
    assert C.txt_markdown("n_o", b"a\n\n\n b\xff\r\n") == "# n o\n\na\n\nb\n"
    assert C.pdf_text(["um", " ", "dois"]) == "[pág. 1]\num\n\n[pág. 3]\ndois" and C.pdf_markdown("p_q", ["um", ""]) == "# p q\n\n## Página 1\n\num\n"
    with pytest.raises(ValueError):
        C.to_markdown("x", ".xyz", b"")


def test_convert_files(spark, tmp_path):
    os.makedirs(tmp_path / "in/sub dir")
    (tmp_path / "in/a.txt").write_text("olá")
    (tmp_path / "in/sub dir/t+1.csv").write_text("x,y\n1,2\n")
    (tmp_path / "in/e.md").write_text("")
    (tmp_path / "in/d.docx").write_bytes(DOCX)
    log = {r["target"]: (r["skipped"], r["reason"]) for r in convert_files(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert log == {"a.md": (False, ""), "sub dir/t+1.md": (False, ""), "e.md": (True, "arquivo vazio"), "d.md": (False, "")}
    assert (tmp_path / "out/a.md").read_text() == "# a\n\nolá\n"
    again = {r["target"]: r["reason"] for r in convert_files(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert again["a.md"] == "já existe (use --force)"
    os.makedirs(tmp_path / "none")
    (tmp_path / "none/x.xyz").write_text("x")
    with pytest.raises(ValueError):
        convert_files(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        convert_files(spark, str(tmp_path / "none/x.xyz"), str(tmp_path / "out"))


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("RRF_K=7\nCHUNK_SIZE='500'\n# X=1\n")
    s = Settings.from_env({"MMR_LAMBDA": "0.5", "RRF_K": "9", "DEDUP_JACCARD": ""}, str(tmp_path / ".env"))
    assert (s.rrf_k, s.chunk_size, s.mmr_lambda, s.dedup_jaccard) == (9, 500, 0.5, 0.82)


def test_command_line(spark, corpus, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setenv("INDEX_DIR", str(tmp_path / "index"))
    monkeypatch.setenv("DOCUMENTS_DIR", str(tmp_path / "docs"))
    assert cli.main(["chat"]) == 1
    assert cli.main(["add", corpus, "--no-ingest"]) == 0 and (tmp_path / "docs/nota.md").exists() and not (tmp_path / "index").exists()
    assert cli.main(["add", corpus + "/none"]) == 1
    assert cli.main(["ingest"]) == 0
    assert cli.main(["ask", "Quantos dias de férias cada funcionário tem?", "--trace"]) == 0
    assert "30 dias" in capsys.readouterr().out
    assert cli.main(["tools"]) == 0 and "draft_answer" in capsys.readouterr().out
    said = iter(["/trace", "", "/add", "/sair"])
    monkeypatch.setattr("builtins.input", lambda *_: next(said))
    assert cli.main(["chat"]) == 0


def test_inbox_stream(spark, tmp_path):
    from docweave.streaming.inbox import inbox, latest_chunks, stream_chunks

    box, out = tmp_path / "box", str(tmp_path / "out")
    os.makedirs(box)
    (box / "a.txt").write_text("primeira versão")
    (box / "b.bin").write_text("x")
    for text in (None, "segunda versão, mais nova"):
        if text:
            (box / "c.md").write_text(text)
        stream_chunks(inbox(spark, str(box)), out, str(tmp_path / "cp")).awaitTermination()
    rows = latest_chunks(spark, out).select(F.element_at(F.split("source", "/"), -1).alias("s"), "text").collect()
    assert sorted((r["s"], r["text"]) for r in rows) == [("a.txt", "primeira versão"), ("c.md", "segunda versão, mais nova")]
