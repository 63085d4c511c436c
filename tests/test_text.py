import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import lexicon as L
from docweave.functions import text as T
from docweave.functions.frames import parse_frame
from docweave.functions.sentences import split_sentences, split_windows


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, t string").select("i", expr(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_tokens_of_decomposed_text_and_signs(spark):
    import re
    import unicodedata

    texts = [unicodedata.normalize("NFD", "ação de rescisão"), "1º m² ﬁm", "10½ kg", "１２ ａｂ ㎏", "İstanbul Kelvin K", None, ""]
    words = [re.findall("[a-z0-9]{2,}", T.fold_text(t or "")) for t in texts]
    assert words[:3] == [["acao", "de", "rescisao"], ["1o", "m2", "fim"], ["101", "kg"]]
    assert column(spark, texts, lambda c: T.tokens(c, stopwords=False)) == words
    every = ["".join(chr(c) for c in range(i, i + 256) if not 0xD800 <= c < 0xE000) for i in range(0, 0x20000, 256)]
    assert column(spark, every, lambda c: T.tokens(c, stopwords=False)) == [re.findall("[a-z0-9]{2,}", T.fold_text(t)) for t in every]


def test_fold_equals_decomposition_of_letters(spark):
    texts = ["Férias ÀÇÕ ñ ß", "ŠŽ ǆ ế Ự", "abc", "İstanbul"]
    plain = ["".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)) for t in texts]
    got = column(spark, texts, T.fold)
    assert got[0] == plain[0] and got[2] == plain[2]
    assert column(spark, [*texts, "º ² ½ ﬁ"], T.fold_exact) == [*plain, T.fold_text("º ² ½ ﬁ")]


def test_tokens(spark):
    text = "Férias: 30 dias, n5 m2 — R$ 80 para os dias"
    assert column(spark, [text, None, ""], T.tokens) == [["ferias", "30", "dias", "n5", "m2", "80", "dias"], [], []]
    assert column(spark, [text], T.unique_terms) == [["ferias", "30", "dias", "n5", "m2", "80"]]
    assert column(spark, ["para os dias"], lambda c: T.tokens(c, stopwords=False)) == [["para", "os", "dias"]]


def test_set_measures(spark):
    df = spark.createDataFrame([(["ferias", "30", "dias", "corridos"], ["30", "dias", "uteis"]), ([], []), ([], ["a"])], "a array<string>, b array<string>")
    got = df.select(T.jaccard(F.col("a"), F.col("b")).alias("j"), T.containment(F.col("b"), F.col("a")).alias("c"), T.near_duplicate(F.col("a"), F.col("b"), 0.4).alias("n")).collect()
    assert [(round(r.j, 3), round(r.c, 3), r.n) for r in got] == [(0.4, 0.667, True), (1.0, 0.0, True), (0.0, 0.0, False)]


def test_years_periods_and_cells(spark):
    assert column(spark, ["de 2024 a 120256", None], T.years) == [[2024, 2025], []]
    labels = ["Δ", "delta", "FY 2024", "q1", "P4 2026", "R12 móvel", "Ago/2025", "2026", "Campo", "Q5", "12/2025", ""]
    assert column(spark, labels, T.is_period_label) == [True] * 8 + [False] * 4
    assert column(spark, ["**a**  b\tc", "x \n\n\n\n y  z "], T.clean_cell) == ["a b c", "x y z"]
    assert column(spark, ["x \n\n\n\n y  z "], T.collapse_prose) == ["x\n\ny z"]
    assert column(spark, [" | a | b", "|a", "a | b |"], T.is_table_line) == [True, False, False]


def test_content_terms(spark):
    drop = F.array(F.lit("preco"))
    assert column(spark, ["Quanto custa o preço do q1 no p1 da filial"], lambda c: T.content_terms(c, drop)) == [["custa", "q1", "filial"]]


def test_markdown_titles(spark):
    assert column(spark, ["# t\nx ", " corpo"], lambda c: T.title_block(F.lit("meu_doc"), c)) == ["# t\nx\n", "# meu doc\n\ncorpo\n"]
    assert column(spark, ["a \n \n\n b\nc\n"], lambda c: T.txt_to_markdown(F.lit("d"), c)) == ["# d\n\na\n\nb\nc\n"]


FRAMES = [
    ("Faturamento na Q1 de 2026?", ("quantity_period", 1, "2026", "q1", False)), ("Quanto na P1 de 2026", ("quantity_period", 1, "2026", "p1", False)), ("o que houve no P1-2026-077", ("incident", None, None, None, False)),
    ("Meta de 2025?", ("generic", None, "2025", None, False)), ("como fazer deploy", ("procedure", None, None, None, False)), ("como fazer deploy em 2026", ("generic", None, "2026", None, False)),
    ("Quantas pessoas trabalham aqui", ("quantity", None, None, None, True)), ("O que é a Brisa?", ("definition", None, None, None, False)), ("olá", ("generic", None, None, None, False)), (None, ("generic", None, None, None, False)),
]


def test_frames(spark):
    got = column(spark, [q for q, _ in FRAMES], parse_frame)
    assert [(g["kind"], g["period_n"], g["year"], g["period_token"], g["people"]) for g in got] == [f for _, f in FRAMES]
    assert got[2]["drop"] == [] and got[8]["drop"] == [] and set(got[6]["drop"]) == {*L.LIGHT, *L.WORK} and set(got[4]["drop"]) == set(L.LIGHT)


def plain_sentences(text):
    """A slow reading of the rule, one character at a time."""
    out = []
    for block in re.split(r"\n{2,}", text):
        block = block.strip()
        if not block or block.startswith("#"):
            continue
        lines = block.split("\n")
        if any(x.strip().startswith("|") for x in lines):
            out += [x.strip() for x in lines if len(x.strip()) > 24 and not x.strip().startswith("|")]
            continue
        held = ""
        for i, c in enumerate(block):
            held += c
            if c not in ".!?":
                continue
            words_ = held.rstrip(".!?").split()
            short = bool(words_) and words_[-1].isalpha() and len(words_[-1]) <= 4
            digit = held[-2:-1].isdigit() or block[i + 1 : i + 2].isdigit()
            if c == "." and (short or digit):
                continue
            if len(held.strip()) > 24:
                out.append(held.strip())
            held = ""
        if len(held.strip()) > 24:
            out.append(held.strip())
    return out or ([text.strip()] if len(text.strip()) > 24 else [])


def test_sentences():
    assert split_sentences("Ele mora em casa. Depois viaja para longe daqui.") == ["Ele mora em casa. Depois viaja para longe daqui."]
    assert split_sentences("A versão 2.5 saiu com muitas novidades. Outra frase bem comprida aqui!") == ["A versão 2.5 saiu com muitas novidades.", "Outra frase bem comprida aqui!"]
    assert split_sentences(None) == [] and split_sentences("curta.") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["palavra", "casa", "de", ".", "!", "?", " ", " ", "\n", "\n\n", "2", "# t", "| a | b", "comprimento"]), max_size=40).map("".join))
def test_sentences_against_the_slow_reading(text):
    assert split_sentences(text) == plain_sentences(text)


def test_windows():
    assert split_windows("a" * 1000) == ["a" * 800, "a" * 320]
    assert split_windows("  ") == [] and split_windows(None) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["abc", "de. ", "f? ", "\n\n", "\n\n\n", " ", "ghij"]), max_size=60).map("".join), st.integers(8, 40), st.integers(0, 7))
def test_windows_cover_the_text(text, size, overlap):
    clean = re.sub(r"\n{3,}", "\n\n", text).strip()
    parts = split_windows(text, size, overlap)
    assert all(len(p) <= size and p and p in clean for p in parts)
    assert set("".join(parts)) >= set(clean) - set(" \n")
    if clean:
        assert clean.startswith(parts[0]) and clean.endswith(parts[-1])
