import os

import corpus_pipeline
from docweave.llm.packing import CAPACITY
from docweave.llm.tokens import encoder
from tests.llm.helpers import docs, filler, prose
from tests.llm.test_decontam_quality import brute_decontam
from tests.llm.test_dedup import near_truth, variants


def page(i):
    return "\n".join(prose(100 * i + j, 15) for j in range(4))


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept; what stays and goes is known by construction."""
    item = filler(9, 40)
    clean = [page(i) for i in range(1, 31)]
    near = clean[3].replace(clean[3].split()[0], "changed", 1).replace("\n", " ")
    texts = [*clean, clean[0], near, page(50) + " " + item, "too short", None, " ".join(f"{w.upper()}!!$$$" for w in filler(7, 90).split())]
    d = docs(spark, texts)
    os.makedirs(tmp_path / "sf")
    d.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/sf/benchmark.parquet")
    cur, kept = spark.read.parquet(f"file://{tmp_path}/sf/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, cur, f"file://{tmp_path}/sf")
        if name != "pack":
            assert out.columns == d.columns
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        cur = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r["text"] for r in cur.collect()} if name != "pack" else cur.collect()
    n = len(clean)
    assert set(kept["quality_rules"]) == set(range(n + 3))
    assert set(kept["line_dedup"]) == set(range(n)) | {n + 1, n + 2}  # a copy has no line of its own
    ids = sorted(kept["line_dedup"])
    truth = near_truth([kept["line_dedup"][i] for i in ids])
    assert set(kept["near_dedup"]) == {ids[i] for i, (_, c) in truth.items() if c == i} == set(range(n)) | {n + 2}
    ids = sorted(kept["near_dedup"])
    hit = brute_decontam([kept["near_dedup"][i] for i in ids], [(1, item)])
    assert set(kept["decontaminate"]) == {i for i, (w, h, _) in zip(ids, hit) if not (h and 20 * h >= w)} == set(range(n))
    lengths = {}
    for r in kept["pack"]:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= CAPACITY
    assert lengths == {i: len(encoder().full.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept["decontaminate"].items()}


def test_run(spark, tmp_path):
    docs(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_near_dedup_stage_takes_similarity_of_80_percent(spark):
    # By edits, most variants lie at 0.95, 0.86, 0.81 and 0.77 of their base; one of 5 edits (22) is at 0.806.
    texts = [t for edits in (1, 3, 4, 5) for t in variants(20 + edits, 6, edits)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), "").collect()}
    assert kept == {i for i, (_, c) in near_truth(texts, 80).items() if c == i} == {0, 7, 14, 21, *range(23, 28)}


def test_awkward_rows_and_what_is_left_on_disk(spark, tmp_path):
    """Very long texts, null ids, repeated rows, clashing columns; afterwards only the last stage's folder is there."""
    long_text = "\n".join(prose(9000 + i, 12) for i in range(900))
    texts = [page(i) for i in range(1, 12)] + [long_text, None, "", page(1), page(2) + "\n" + page(3)]
    names = ("piece", "offset", "name", "node", "cluster", "__dw_x", "class_js", "n_hit")
    d = docs(spark, texts, extra=names, ids=[*range(10), None, *range(11, len(texts))])
    d = d.unionByName(d.where("doc_id = 5"))
    d.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, filler(9, 40)), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    new = set(os.listdir(root)) - before
    assert len(new) == 1 and new.pop().startswith("stage-pack-")
    rows = out.collect()
    ids = lambda t: [*encoder().full.encode(t, add_special_tokens=False).ids, 0]
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    # 14 is a copy of 0 and loses all lines, 15 those of 1 and 2; both rows of 5 are one document and stay.
    want = {i: len(ids(texts[i])) for i in range(10)} | {None: len(ids(texts[10])), 11: len(ids(long_text))}
    want[5] *= 2
    assert total == want and len(ids(long_text)) > 20_000
