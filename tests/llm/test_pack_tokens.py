import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.llm import packing, tokenstore
from docweave.llm.tokens import encode_rows, encoder
from docweave.runtime import cut, shared_path
from tests.llm.helpers import awkward, docs

ODD = ["it's 'some' l'été's", "Ünïcode ÀÉ×÷ ½ ﬁ ² x²y", "é áb", "<|endoftext|>a <|startoftext|>", "\tab\x0bc\x1cd\xa0e", "ΑΣ Σας", "#*$%,.!!a1b2__x_y", "", None, "don't we'LL 'RE'd", "a\x00b \x7f", "ß ÿ Ÿ İ ı"]


def expected(text):
    return encoder().full.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_ids(texts):
    ids, n = encode_rows(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == expected(t)


def test_ids_equal_the_library():
    check_ids(ODD + awkward())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_ids_equal_the_library_on_any_text(texts):
    check_ids(texts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano(values):
    v = sorted(values)
    ef = tokenstore.EliasFano.from_bytes(tokenstore.EliasFano.encode(np.array(v, np.uint64)).to_bytes())
    assert ef.all().tolist() == v
    for i in {0, len(v) // 2, len(v) - 1} if v else ():
        assert ef.select(i) == v[i]
        for j in {i, i + 1, i + 300, len(v)}:
            if j <= len(v):
                assert ef.select_range(i, j).tolist() == v[i:j]


def test_store_round_trip(spark):
    texts = awkward()
    ids = [10 - i for i in range(len(texts))]
    path = shared_path(spark, "t")
    manifest = tokenstore.write_store(docs(spark, texts, extra=("ids", "start"), ids=ids), path, shard_bytes=20_000)
    assert manifest.count() > 1
    got = {r["doc_id"]: r for r in tokenstore.read_store(spark, path).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts)):
        want = [*expected(t), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), crc(want))
        start += len(want)
    shard = tokenstore.ShardReader(manifest.orderBy("shard").first()["file"])
    first = shard.doc_ids().tolist()
    assert shard.ids(len(first) - 1).tolist() == [*expected(dict(zip(ids, texts))[first[-1]]), 2]


def test_store_of_nothing_nulls_and_repeats(spark):
    path = shared_path(spark, "t")
    tokenstore.write_store(docs(spark, []), path)
    assert tokenstore.read_store(spark, path).count() == 0
    path = shared_path(spark, "t")
    tokenstore.write_store(docs(spark, ["b", "a", "a", "n"], ids=[1, 1, 1, None]), path)
    assert sorted((str(r["doc_id"]), r["start"]) for r in tokenstore.read_store(spark, path).collect()) == [("1", 2), ("1", 4), ("1", 6), ("None", 0)]


def test_op10_query(spark, tmp_path):
    """The registered query on written tables; documents are read back by ranges of the select structure."""
    texts = [*awkward(), *(f"n {i}" for i in range(600)), "long " * 9000]
    ids = [i * 7 for i in range(len(texts))]
    docs(spark, texts, extra=("start", "n_tokens"), ids=ids).write.parquet(f"file://{tmp_path}/documents.parquet")
    got, start = {r["doc_id"]: r for r in tokenstore.op10_token_store(spark, f"file://{tmp_path}").collect()}, 0
    for i, t in zip(ids, texts):
        want = [*expected(t), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), crc(want))
        start += len(want)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_documents(spark):
    texts = awkward()
    rows = packing.pack_documents(docs(spark, texts, extra=("piece", "_salt", "offset")), capacity=64).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = [*expected(t), 0]
        for k in range(0, len(ids), 64):
            want[i, k // 64] = (k, len(ids[k : k + 64]), crc(ids[k : k + 64]))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    total = sum(w[1] for w in want.values())
    assert check_packing(rows, 64) <= -(-total // 64) + 3


def test_pack_repeats_and_nothing(spark):
    assert packing.pack_documents(docs(spark, [])).count() == 0
    rows = packing.pack_documents(docs(spark, ["a b c"] * 9, ids=[1] * 9), capacity=8).collect()
    assert len(rows) == 9 and check_packing(rows, 8) == 5


def test_sequences_hold_the_ids(spark):
    texts = awkward()[:12]
    packed = packing.pack_documents(docs(spark, texts), capacity=64, with_ids=True)
    whole = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == [*expected(texts[r["doc_id"]]), 0][r["start"] : r["start"] + r["length"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(8, 60))
def test_plan_places_every_piece_once(lengths, level):
    hist = np.bincount(np.array(lengths, int), minlength=51)
    plan = packing.Plan(hist, 50, level)
    count, seen = Counter(), {}
    for n in lengths:
        seq, off = plan.place(np.array([n]), np.array([count[n]]))
        count[n] += 1
        seen.setdefault(int(seq[0]), []).append((int(off[0]), n))
    assert set(seen) <= set(range(plan.sequences))
    for parts in seen.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 50


def test_a_plan_with_fewer_pieces_of_each_length_than_a_level_stands_for():
    hist = np.full(51, 9, np.int64)
    plan = packing.Plan(hist, 50, level_items=8)
    seq, off = plan.place(np.repeat(np.arange(1, 51), 9), np.tile(np.arange(9), 50))
    assert (seq >= 0).all() and (off >= 0).all() and len(set(zip(seq.tolist(), off.tolist()))) == 450


def brute_pack(lengths, capacity, open_first):
    """The rule as it is said: the sum of squares is computed for every choice."""
    bins = []

    def squares(gaps):
        return sum(n * n for g, n in Counter(gaps).items() if g)

    for s in lengths:
        gaps = [capacity - sum(b) for b in bins]
        choices = []
        for gap in sorted({g for g in gaps if g >= s}):
            i = gaps.index(gap)
            choices.append((squares(gaps[:i] + [gap - s] + gaps[i + 1 :]), 0, gap, i))
        if not (choices and open_first):
            choices.append((squares([*gaps, capacity - s]), 1, capacity, len(bins)))
        _, _, _, i = min(choices)
        if i == len(bins):
            bins.append([])
        bins[i].append(s)
    return sorted(map(sum, bins))  # bins of one gap are alike to the rule


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40), st.booleans())
def test_packing_follows_the_rule(lengths, open_first):
    lengths = sorted(lengths, reverse=True)
    where, offset, n = packing.pack_lengths(np.array(lengths, np.int64), 20, open_first)
    bins = {}
    for b, s in zip(where.tolist(), lengths):
        bins.setdefault(b, []).append(s)
    assert sorted(map(sum, bins.values())) == brute_pack(lengths, 20, open_first) and len(bins) == n


def test_frequent_lengths_are_ranked_by_salts(spark):
    texts = [f"a b c w{i}" for i in range(60)] + ["x " * 90] * 5 + ["q"] * 40
    rows = packing.place_pieces(cut(packing.token_pieces(docs(spark, texts, ids=[None, *range(1, len(texts))]), capacity=32)), 32, 16, rank_rows=7).collect()
    ids = {i: [*expected(t), 0] for i, t in enumerate(texts)}
    assert Counter((r["doc_id"] or 0, r["start"], r["length"]) for r in rows) == Counter((i, s, len(x[s : s + 32])) for i, x in ids.items() for s in range(0, len(x), 32))
    assert check_packing(rows, 32) <= -(-sum(map(len, ids.values())) // 32) + 8


def test_op1_query(spark, tmp_path):
    """The registered query on written tables: contract columns, no lost piece, gapless sequences."""
    texts = [*awkward(), "long " * 5000, *(f"short {i}" for i in range(30))]
    docs(spark, texts, extra=("piece", "offset")).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = packing.op1_pack(spark, f"file://{tmp_path}").collect()
    want = {}
    for i, t in enumerate(texts):
        ids = [*expected(t), 0]
        want |= {(i, k // 2048): (k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows, 2048) == -(-sum(w[1] for w in want.values()) // 2048)


def test_sum_of_squares_choice():
    # Open bins with gaps 6 and 4; a piece of 4 completes one bin rather than making a second gap of 2.
    where, offset, n = packing.pack_lengths(np.array([6, 4, 4]), 10)
    assert n == 2 and where.tolist() == [0, 0, 1] and offset.tolist() == [0, 6, 0]


def test_shared_root_is_the_sessions(spark):
    assert shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("texts", [[], [None], [""], ["", None, ""]])
def test_no_ids(texts):
    ids, n = encode_rows(pa.array(texts, pa.string()))
    assert len(ids) == 0 and n.tolist() == [0] * len(texts)


def test_frequent_pieces_stay_when_the_table_fills(monkeypatch):
    from docweave.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 1000)
    enc, asked = tokens.WordEncoder(tokens.default_path()), Counter()
    bpe = enc._bpe
    monkeypatch.setattr(enc, "_bpe", lambda pieces: (asked.update(pieces), bpe(pieces))[1])
    letters = "abcdefghijklmnop"
    for k in range(9):
        texts = ["common words stay " + " ".join("q" + "".join(letters[(i + 400 * k) >> s & 15] for s in (0, 4, 8)) for i in range(400))]
        ids, n = enc.encode(tokens.Block(pa.array(texts)))
        assert ids.tolist() == expected(texts[0]) and n.tolist() == [len(ids)]
    assert asked[b"common"] == asked[b"words"] == asked[b"stay"] == 1 and len(asked) > 3000


def test_a_word_before_a_line_break_is_taken_apart_like_others(monkeypatch):
    from docweave.llm import tokens

    enc = tokens.WordEncoder(tokens.default_path())
    whole, asked = enc._whole, []
    monkeypatch.setattr(enc, "_whole", lambda words: (asked.extend(words), whole(words))[1])
    text = "one line.\nand\tanother\x0b\x0c\rhere. don't\n"
    assert enc.encode(tokens.Block(pa.array([text])))[0].tolist() == expected(text)
    assert asked == [b"don't"]


def test_pieces_whose_first_hash_is_equal(monkeypatch):
    from docweave.llm import tokens

    keys = tokens.piece_keys
    monkeypatch.setattr(tokens, "piece_keys", lambda *a: (keys(*a)[0] >> np.uint64(62) << np.uint64(62), keys(*a)[1]))
    texts = ["many words of one slot", "and of another", "many slots"]
    ids, n = tokens.WordEncoder(tokens.default_path()).encode(tokens.Block(pa.array(texts)))
    assert ids.tolist() == [i for t in texts for i in expected(t)] and n.tolist() == [len(expected(t)) for t in texts]


def test_more_pieces_than_are_looked_up_at_a_time(monkeypatch):
    from docweave.llm import tokens

    monkeypatch.setattr(tokens, "CHUNK", 7)
    texts = ["a row of so many words that it is looked up in parts, 12 of them", None, "x", "", "and a second " * 9]
    ids, n = tokens.WordEncoder(tokens.default_path()).encode(tokens.Block(pa.array(texts)))
    assert ids.tolist() == [i for t in texts for i in expected(t)] and n.tolist() == [len(expected(t)) for t in texts]


def test_arrow_batches_are_bounded_by_bytes(spark):
    from docweave import runtime

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    rows = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    spark.conf.unset(runtime.ARROW_SETTING)
    runtime.ship_package(spark)
    got = rows.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 3000 and max(r["bytes"] for r in got) < runtime.ARROW_BYTES + 20_000
    spark.conf.set(runtime.ARROW_SETTING, "9m")
    runtime.ship_package(spark)
    assert spark.conf.get(runtime.ARROW_SETTING) == "9m"
    spark.conf.unset(runtime.ARROW_SETTING)
