import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import components, linededup, neardup, substrings
from docweave.llm.textblock import Block, lut_is_space, span_hash, window_hash
from tests.llm.helpers import SPACE_WORDS, awkward, docs, filler, lower, sha, words

TEXT = st.text(alphabet=st.sampled_from(list("ab \n\té\x0b😀")), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_blocks_see_words_and_lines_as_python_does(texts):
    b = Block(pa.array(texts, pa.string()))
    s, e, row = b.spans(lut_is_space())
    assert [(r, b.data[x:y].tobytes().decode()) for x, y, r in zip(s, e, row)] == [(i, w) for i, t in enumerate(texts) for w in SPACE_WORDS.findall(t or "")]
    s, e, row = b.line_spans()
    assert [(r, b.data[x:y].tobytes().decode()) for x, y, r in zip(s, e, row)] == [(i, w) for i, t in enumerate(texts) for w in (t or "").split("\n")]


def test_span_hash_depends_on_content_alone():
    data = np.frombuffer(b"abc xabc" + b"q" * 300 + b" " + b"q" * 300, np.uint8)
    h = span_hash(data, np.array([0, 5, 8, 309]), np.array([3, 8, 308, 609]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]
    w = window_hash(np.arange(20, dtype=np.uint64), 13)
    assert len(w) == 8 and len(set(w.tolist())) == 8


def test_span_hash_takes_little_memory():
    import tracemalloc

    lens = np.resize([3, 90, 1, 0, 7, 500], 20_000)
    lens[11_111] = 200_000  # longer than what is hashed at a time
    starts = np.cumsum(lens + 1) - lens - 1
    data = np.resize(np.frombuffer(b"some words and more of them", np.uint8), int(lens.sum()) + len(lens))
    some = np.arange(0, len(lens), 97)
    one = [int(span_hash(data, starts[i : i + 1], starts[i : i + 1] + lens[i : i + 1], 5)[0]) for i in some]
    tracemalloc.start()
    h = span_hash(data, starts, starts + lens, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert h[some].tolist() == one
    assert most < 20 << 20  # 72 bytes for each of the text's 2 million would be more


# ---- near duplicates


def near_truth(texts, percent=85):
    sets = {}
    for i, t in enumerate(texts):
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants(seed, n, edits, size=200):
    base = filler(seed, size).split()
    out = [" ".join(base)]
    for i in range(n):
        w = list(base)
        for k in range(edits):
            w[(i * 31 + k * 57) % size] = f"edit{i}x{k}"
        out.append(" ".join(w))
    return out


def check_near(spark, texts):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, texts, extra=("node", "bands", "n_shingles"))).collect()}
    for i, (n, c) in near_truth(texts).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), i


def test_near_duplicates(spark):
    # In the last group only the base is near all others: the others meet through it.
    check_near(spark, awkward() + variants(11, 8, 1) + variants(12, 8, 5) + variants(13, 20, 3)[1:] + variants(14, 30, 3))


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_MEMBERS", 6)
    monkeypatch.setattr(neardup, "RARE", 3)
    check_near(spark, variants(15, 25, 3)[::-1] + variants(16, 12, 4)[::-1])


def test_a_cluster_of_many_thousand_near_copies(spark, monkeypatch):
    """20,000 near copies are one component without a square of comparisons: each block is compared inside only."""
    monkeypatch.setattr(neardup, "CELL_MEMBERS", 400)
    seen = []
    real = neardup._compared
    monkeypatch.setattr(neardup, "_compared", lambda docs, dealt, percent, square: seen.append((dealt.count(), square)) or real(docs, dealt, percent, square))
    base = filler(17, 100).split()
    texts = [" ".join([*base, f"end{i}"]) for i in range(20_000)] + [filler(18, 50)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got.pop(20_000) == 20_000 and set(got.values()) == {0}
    assert sum(n for n, square in seen if square) == 0 and sum(n for n, _ in seen) < 25_000


def test_recall_of_banding_at_the_threshold(spark):
    """Pairs of similarity 0.85 to 0.9, sets of 60 to 600 shingles: none may escape."""
    texts, n = [], 0
    for i in range(300):
        size = (60, 200, 600)[i % 3]
        base = filler(5000 + i, size + 4).split()
        out = max(1, int(size * (0.05 + 0.03 * (i % 2))))  # words replaced at the end lose as many shingles
        texts += [" ".join(base), " ".join(base[:-out] + [f"x{i}y{k}" for k in range(out)])]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    for i in range(0, len(texts), 2):
        a, b = ({tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts[i : i + 2])
        if 100 * len(a & b) >= 85 * len(a | b):
            n += 1
            assert got[i + 1] == i
    assert n >= 200


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=1, max_size=25))
def test_intersections(sets):
    values = np.array([x for s in sets for x in sorted(s)], np.int64)
    got = neardup.intersections(values, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            assert got[i, j] == len(a & sets[j])


def test_near_duplicates_edge_tables(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    t = filler(1, 40)
    got = neardup.near_duplicates(docs(spark, [t, t, t, None, ""], ids=[5, 5, None, 7, 8])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("5", "5", True), ("5", "5", True), ("7", "7", True), ("8", "8", True), ("None", "None", True)]
    d = docs(spark, [t, t + " x", "other", None], extra=("kept", "_gone"))
    left = neardup.drop_near_duplicates(d)
    assert left.columns == d.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3]


def test_sketches_fill_and_agree():
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 400, dtype=np.uint64))
    a, b = h[:380], h[20:]
    s = neardup.sketches(np.concatenate([a, b, a[:1]]), np.array([380, 380, 1]))
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 360 / 400) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == 0 and got[201] == got[200] == 200 and 300 not in got
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- substrings


def substring_truth(rows, k=13):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substring_dedup(spark):
    shared = filler(21, 40)
    texts = awkward() + [f"{filler(50 + i, 20)} {shared}\n{filler(80 + i, 20)}" for i in range(12)] + ["a " * 40, "a b " * 30, "b a " * 30, shared.replace(" ", "\t\n "), " ".join(shared.split()[:13]), " ".join(shared.split()[:12])]
    rows = list(enumerate(texts))
    want = substring_truth(rows)
    for how in ({}, {"hot": 2, "bloom_bytes": 64}, {"hot": 0}):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_substrings(docs(spark, texts, extra=("key", "mask", "_places")), **how).collect()}
        assert got == want


def test_substring_chunks_keep_keys_together(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_SEGMENTS", 5)
    monkeypatch.setattr(substrings, "STREAM_SEGMENTS", 2)
    monkeypatch.setattr(substrings, "TASK_SEGMENTS", 3)
    monkeypatch.setattr(substrings, "BLOOM_PIECE", 256)
    texts = [f"{filler(50 + i, 15)} {filler(21, 40)} {filler(i % 3, 30)}" for i in range(15)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_substrings(docs(spark, texts)).collect()}
    assert got == substring_truth(list(enumerate(texts)))


def test_substring_edge_tables(spark):
    assert substrings.dedup_substrings(docs(spark, [])).count() == 0
    t = filler(1, 20)
    got = substrings.dedup_substrings(docs(spark, [t, t, t, None], ids=[3, 3, None, 4]), with_text=True).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in got) == [("3", 0, t), ("3", 0, t), ("4", 0, ""), ("None", 20, "")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 4))
def test_matching_statistics(segments, k):
    """Against all substrings: the longest run before each place that stands elsewhere too, and least documents."""
    text = np.array([x for s in segments for x in [*s, 0]], np.int64)
    doc = np.repeat(np.arange(len(segments))[::-1] * 10, [len(s) + 1 for s in segments])
    index = substrings.FMIndex(text, 12, doc)
    begins = np.cumsum([0, *(len(s) + 1 for s in segments)])[:-1]
    ends = [(b + i, b) for s, b in zip(segments, begins) for i in range(1, len(s) + 1)]
    length, lo, hi = index.matching(text, np.array([e for e, _ in ends]), np.array([b for _, b in ends]), k)
    runs = {}
    for s, b in zip(segments, begins):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                runs.setdefault(tuple(s[i:j]), []).append(doc[b])
    for (e, b), n, a, z in zip(ends, length, lo, hi):
        assert n == max((m for m in range(1, e - b + 1) if len(runs[tuple(text[e - m : e])]) > 1), default=0)
        if n >= k:
            assert z - a == len(runs[tuple(text[e - k : e])]) and index.least(np.array([a]), np.array([z]))[0] == min(runs[tuple(text[e - k : e])])


def test_a_passage_of_many_documents_is_a_row_a_task(spark):
    shared = filler(21, 40)
    texts = [f"a{i} b{i} c{i} {shared}" for i in range(3000)]
    d = docs(spark, texts).repartition(2).cache()
    anchors = substrings.shared_anchors(d)
    bloom = spark.sparkContext.broadcast(substrings.anchor_filter(anchors, anchors.count()))
    assert substrings.live_segments(d, bloom).where("lo < hi").count() <= 2 * 20  # of the passage; the others differ in a word before it
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(d).collect()}
    assert got == {i: 40 if i else 0 for i in range(3000)}


# ---- lines


def line_truth(rows, k):
    def full(t):
        return [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n")) if words(x)]

    seqs = {i: full(t) for i, t in rows}
    first, gone = {}, {i: set() for i, _ in rows}
    for i in sorted(seqs):
        s = seqs[i]
        for j in range(len(s) - k + 1):
            w = tuple(x for _, x in s[j : j + k])
            if first.setdefault(w, (i, j)) != (i, j):
                gone[i] |= {s[j + m][0] for m in range(k)}
    return {i: (len(seqs[i]), len(gone[i]), sha("\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i]))) for i, t in rows}


def test_line_dedup(spark):
    a, b, c, d = (filler(i, 6) for i in range(4))
    texts = awkward() + [f"{a}\n{b}\n{c}", f"{b}\n\n {c} \n{d}", f"{d}\n{a}\n{b}", f"{a}\n{b}\n{c}", "x\nx\nx\nx\nx", "\n\n", f"{c}\n{d}\n{c}\n{d}", f"{a}\r\n{b}\r\n{c}"]
    rows = list(enumerate(texts))
    for k in (1, 2, 3):
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in linededup.line_report(docs(spark, texts, extra=("line", "name", "_lines")), k).collect()}
        assert got == line_truth(rows, k), k


def test_dedup_lines_and_runs(spark):
    a, b, c = (filler(i, 6) for i in range(3))
    d = docs(spark, [f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}", f"{c}\n{a}\n{b}\nnew", None, ""], extra=("hash", "_lines", "_doc"))
    left = linededup.dedup_lines(d)
    assert left.columns == d.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    assert got == {0: (f"{a}\n{b}\n{c}", len(f"{a}\n{b}\n{c}")), 2: (f"{c}\nnew", len(c) + 4), 3: (None, 0), 4: ("", 0)}
    runs = sorted((r["doc"], r["line"], r["n_lines"], r["source_doc"], r["source_line"]) for r in linededup.repeated_runs(d).collect())
    assert runs == [(1, 0, 3, 0, 0), (2, 1, 2, 0, 0)]
    assert linededup.line_report(docs(spark, [])).count() == 0
    again = linededup.line_report(docs(spark, [f"{a}\n{b}"] * 3, ids=[1, 1, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in again) == [("1", 0), ("1", 0), ("None", 2)]


def test_long_runs_and_the_intervals_they_come_from(spark, monkeypatch):
    """Runs of 3 to 50 lines are found whole, in intervals of doubling width, over many ranges."""
    monkeypatch.setattr(linededup, "RANGE_ROWS", 20)
    line = lambda i: filler(1000 + i, 4)
    source = "\n".join(line(i) for i in range(120))
    sizes = [3, 4, 5, 7, 8, 13, 16, 31, 32, 50]
    texts = [source] + ["\n".join([line(500 + n), *([line(i) for i in range(2 * n, 3 * n)] if n <= 40 else [line(i) for i in range(n, 2 * n)]), line(700 + n)]) for n in sizes]
    d = docs(spark, texts)
    runs = {(r["doc"], r["line"]): (r["n_lines"], r["source_doc"], r["source_line"]) for r in linededup.repeated_runs(d).collect()}
    for i, n in enumerate(sizes, 1):
        at = 2 * n if n <= 40 else n
        whole = [k for k in runs if k[0] == i]
        # The run is one if its earliest copies lie in the source alone.
        assert runs[i, 1] == (n, 0, at) and whole == [(i, 1)], (n, whole)
    widths = [w for w, _ in linededup.suffix_intervals(d)]
    assert widths == [1, 2, 4, 8, 16, 32]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in linededup.line_report(d).collect()}
    assert got == line_truth(list(enumerate(texts)), 2)


def test_intervals_across_ranges(spark, monkeypatch):
    """One line in all documents, more rows than a range holds: its interval goes on over ranges."""
    monkeypatch.setattr(linededup, "RANGE_ROWS", 7)
    a, b = filler(1, 5), filler(2, 5)
    texts = [f"{a}\n{filler(50 + i, 4)}\n{a}\n{b}" if i % 3 else f"{a}\n{b}\n{a}\n{b}\n{a}" for i in range(40)]
    rows = list(enumerate(texts))
    for k in (1, 2, 3, 5):
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in linededup.line_report(docs(spark, texts), k).collect()}
        assert got == line_truth(rows, k), k
    twice = docs(spark, texts).unionByName(docs(spark, texts))
    got = [(r["doc_id"], r["n_removed"]) for r in linededup.line_report(twice).collect()]
    assert sorted(got) == sorted(2 * [(i, n) for i, (_, n, _) in line_truth(rows, 2).items()])


def test_repeated_long_lines_go_whatever_their_neighbours(spark):
    a, b, c, d = (filler(i, 6) for i in range(4))
    long, short = filler(30, 13), filler(31, 12)
    texts = [f"{a}\n{long}\n{b}", f"{c}\n  {long} \n{d}", long, f"{short}\n{c}", f"{d}\n{short}", f"{b}\n{d}\n{long}\n{filler(40, 20)}\n{long}", f"{c}\n{long}\n{b}\nx"]
    # Document 6 repeats (c, long) and (long, b) as runs of two lines; the repeated line of 4 is too short to be a run.
    want = {0: texts[0], 1: f"{c}\n{d}", 3: texts[3], 4: texts[4], 5: f"{b}\n{d}\n{filler(40, 20)}", 6: "x"}
    left = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, texts, extra=("long", "_long"))).collect()}
    assert left == want
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in linededup.line_report(docs(spark, texts), long_words=13).collect()}
    assert got == {i: (n, sha(want.get(i, ""))) for i, n in enumerate([0, 1, 1, 0, 0, 2, 3])}
