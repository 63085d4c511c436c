import re
from collections import Counter

from pyspark.sql import functions as F

from docweave.llm import decontam, quality
from tests.llm.helpers import awkward, docs, filler, lower, prose, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_decontam(texts, items, n=13):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if who := windows.get(tuple(w[j : j + k])):
                    found |= who
                    hit |= set(range(j, j + k))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_find_contamination(spark):
    item = filler(9, 30)
    texts = [*awkward(), "x " + item.upper() + " y", item.replace(" ", "-\n"), filler(7, 400) + " " + " ".join(item.split()[:13]), "short item!", "a short  ITEM here", item[:-3]]
    items = [(1, item), (2, "short item"), (3, None), (4, "!!"), (5, item), (2, "short item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontam.MAX_WINDOWS, 5):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontam.find_contamination(docs(spark, texts, extra=("n_hit", "item_ids")), bench, max_windows=limit).collect()}
        assert [got[i] for i in range(len(texts))] == brute_decontam(texts, items)
    spans = {r["doc_id"]: r["spans"] for r in decontam.find_contamination(docs(spark, texts), bench).collect()}
    raw = texts[len(awkward())].encode()
    (span,) = spans[len(awkward())]
    assert raw[span["start"] : span["end"]].decode() == item.upper()


def test_items_without_an_id_and_blocks(spark):
    item = filler(9, 20)
    bench = spark.createDataFrame([(None, item), (3, item + " more"), (None, "lonely words"), (1, item)], "item_id long, text string")
    texts = [item, "x " + item + " more", "lonely words", None, filler(2, 30)]
    d = docs(spark, texts, ids=[5, None, 5, 6, None])
    want = [(5, 20, [1, 3, None]), (None, 21, [1, 3, None]), (5, 2, [None]), (6, 0, []), (None, 0, [])]
    for limit in (decontam.MAX_WINDOWS, 5):
        got = [(r["doc_id"], r["n_hit"], r["item_ids"]) for r in decontam.find_contamination(d, bench, max_windows=limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert sorted(str(r["doc_id"]) for r in decontam.remove_contaminated(d, bench, max_windows=limit).collect()) == ["6", "None"]
        assert decontam.remove_contaminated(d.unionByName(d), bench, max_windows=limit).count() == 4


def test_a_window_of_many_items_is_one_entry():
    s = decontam.NgramSet([(i, filler(9, 13)) for i in range(500)] + [(7, filler(9, 13) + " x")])
    keys, _, edge, items, *_ = s.tables[13]
    assert len(keys) == 2 and edge.tolist() == [0, 500, 501] or edge.tolist() == [0, 1, 501]
    assert len(items) == 501


def test_remove_contaminated(spark):
    item = filler(9, 30)
    texts = ["a " + item, filler(3, 900) + " " + item, "clean text", None, ""]
    d = docs(spark, texts, extra=("n_words",))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontam.remove_contaminated(d, bench)
    assert left.columns == d.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.remove_contaminated(d, none).count() == 5
    assert decontam.remove_contaminated(docs(spark, []), bench).count() == 0


def brute_counts(text):
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(tri), set()
    for i, t in enumerate(tri):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_base_counts(spark):
    texts = [*awkward(), "a\na\n\n\na b\n a\na", "a b c a b c", "a a a", "#*$ |<>&%", "x\n" * 60]
    got = {r["doc_id"]: r.asDict() for r in quality.score_quality(docs(spark, texts, extra=("kept", "class_js"))).collect()}
    for i, t in enumerate(texts):
        want = brute_counts(t)
        assert {k: got[i][k] for k in want} == want, i
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_divergence(spark):
    clean = [prose(i, 40) + "." for i in range(40)]
    junk = [" ".join(f"{w.upper()}!!$$$" for w in filler(99 + i, 80).split()) for i in range(2)]
    d = docs(spark, clean + junk)
    kept = {r["doc_id"] for r in quality.score_quality(d).where("kept").collect()}
    assert kept == set(range(40))
    left = quality.filter_quality(d)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == kept
    # The guard: a short document is judged by the base rule alone.
    rules = quality.QualityRules(min_words=100)
    assert {40, 41} <= {r["doc_id"] for r in quality.score_quality(d, rules).where("kept").collect()}


def test_a_small_language_is_no_measure_of_itself(spark):
    clean = [prose(i, 100) + "." for i in range(120)]
    junk = [" ".join(f"{w.upper()}!!$$$" for w in filler(99 + i, 80).split()) for i in range(2)]
    other = [prose(300, 100).translate({ord(c): chr(0x430 + i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}) + "."]
    d = docs(spark, clean + junk + other).withColumn("lang", F.when(F.col("doc_id") < 120, "en").when(F.col("doc_id") < 122, "xx").otherwise("yy"))
    got = {r["doc_id"]: r for r in quality.score_quality(d).collect()}
    assert all(got[i]["kept"] for i in range(120)) and not got[120]["kept"] and not got[121]["kept"]
    assert got[120]["class_js"] > 0.3 and got[120]["word_js"] == 0.0
    assert got[122]["kept"] and got[122]["class_js"] < 0.1  # another script is no fault


def test_documents_that_fail_the_base_rule_are_no_reference(spark):
    d = docs(spark, [prose(i, 100) for i in range(120)] + ["$$$ ### " * 400] * 9)
    refs = quality.language_references(d)
    assert refs["en"]["classes"][5] == 0 and len(refs["en"]["words"]) <= quality.QualityRules().common_share
    assert quality.language_references(docs(spark, ["short"])) == {}


def test_common_words_have_any_length(spark):
    long_word = "internacionalização" * 2
    d = docs(spark, [" ".join(f"{w} {long_word}" for w in filler(i, 100).split()) for i in range(60)])
    refs = quality.language_references(d)
    assert len(refs["en"]["words"]) == 1 and abs(refs["en"]["shares"][0] - 0.5) < 1e-9


def test_null_ids_and_repeated_rows(spark):
    d = docs(spark, [prose(1, 40)] * 3, ids=[4, 4, None])
    got = quality.score_quality(d.unionByName(d)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["4"] * 4 + ["None"] * 2 and len({r["kept"] for r in got}) == 1


def test_null_languages_and_many(spark):
    d = docs(spark, [filler(i, 60) for i in range(6)]).withColumn("lang", F.when(F.col("doc_id") > 2, F.col("doc_id").cast("string")))
    assert quality.score_quality(d, quality.QualityRules(max_languages=2)).count() == 6
    assert quality.score_quality(docs(spark, [])).count() == 0
