"""Substring dedup with compressed FM-indexes: backward search over wavelet matrices.

A window is ``k`` successive words of a document; it repeats if its words also start in a document
with a smaller doc_id. To find repeats among all documents without comparing each with each:

1. Every window has an anchor, the least hash of its 5-word runs, so equal windows have equal anchors.
   Successive windows with one anchor form a segment, of 9 windows at most. Anchors that occur in one
   document only (a partial aggregate of least and greatest doc_id tells) cannot repeat.
2. A second scan keeps segments whose anchor is in a Bloom filter of the others. The filter's size is
   chosen by their count and bounded, its pieces are put together by key; beyond the bound more segments pass,
   and nothing is lost. Equal segments are merged before they leave a task, with the least and greatest doc_id,
   so a passage in millions of documents is one row a task. Segments are dealt out by anchor.
3. Each shard indexes its distinct segments: the BWT of their words in a wavelet matrix, and the document
   of each suffix; neither suffix array nor text is kept. Then the segments are streamed against the index, some
   thousands at a time, and searched backwards from every end: the matching statistic of a place is how
   many words before it occur elsewhere in the index too. Where it reaches k, the least document of
   the interval of k words is the window's. An anchor of more than ``hot`` distinct segments doesn't fit a shard:
   its segments are dealt by single windows in a second round of the same kind.
4. A third scan names every segment's places again, which join with the answers by the segment's fingerprint;
   adaptive execution splits a frequent one. The windows whose least document is smaller than their
   own are removed.

Defined results: null and word-less texts have no windows; null doc_ids count as larger than all
others; rows of one doc_id don't repeat each other; texts shorter than k words stay; an empty table
gives no rows; extra columns stay out of the search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.textblock import Block, blocks, in_one_row, lut_is_space, mix, span_hash, window_hash
from docweave.runtime import cut, ship_package

WINDOW = 13
GRAM = 5
BLOOM_BYTES = 64 << 20
HOT = 50_000
CHUNK_SEGMENTS = 60_000  # distinct segments of an index, about
STREAM_SEGMENTS = 8_000  # searched at a time
TASK_SEGMENTS = 150_000  # distinct segments that a scanning task holds
BLOOM_PIECE = 1 << 15  # bytes
LAST = 2**63 - 1
U = np.uint64
SPACE = lut_is_space()


# ---- the index ---------------------------------------------------------------------------------


class WaveletMatrix:
    """Rank over a sequence of small integers, a bit plane per level with sampled counts."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.planes = len(seq), []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            raw = np.zeros((self.n + 64) // 64 * 64, np.uint8)
            raw[: self.n] = bit
            words = np.packbits(raw, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int32)
            self.planes.append((level, words, (np.cumsum(ones) - ones).astype(np.int32), self.n - int(bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``at``. ``start``: where it begins in the last plane."""
        for level, words, count, zeros in self.planes:
            w = at >> 6
            ones = count[w] + np.bitwise_count(words[w] & ((U(1) << (at & 63).astype(np.uint64)) - U(1)))
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at - start[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols, at least, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    width = 1
    while True:
        tail = np.zeros(n, np.int64)
        if width < n:
            tail[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + tail
        order = np.argsort(key, kind="stable")
        width *= 2
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        rank = new
        if width >= depth or (n and int(rank.max()) == n - 1):
            return order


class FMIndex:
    """Over a text of positive symbols with 0 as separator; patterns hold no separator and ``depth`` symbols at most.

    ``doc``: a number for each place of the text; the index keeps it in the order of the suffixes.
    """

    def __init__(self, text: np.ndarray, depth: int, doc: np.ndarray | None = None):
        self.n = len(text)
        order = suffix_order(text, depth)
        self.doc = None if doc is None else doc[order]
        bwt = text[order - 1]  # place -1 is the text's last symbol
        sigma = int(text.max(initial=0)) + 1
        counts = np.bincount(text, minlength=sigma)
        self.first = np.cumsum(counts) - counts
        bits = max(1, int(sigma - 1).bit_length())
        self.tree = WaveletMatrix(bwt, bits)
        self.start = self.tree.rank(np.arange(sigma), np.zeros(sigma, np.int64), np.zeros(sigma, np.int64))

    def matching(self, text: np.ndarray, ends: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place in ``ends`` of a streamed text: how many symbols before it, back to ``begins`` at most,
        stand together at several places of the index; and the interval of the k symbols before it, empty if fewer do.
        """
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        low_k, high_k = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        length = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(ends > begins)
        step = 0
        while len(live):
            step += 1
            c = text[ends[live] - step]
            a = self.first[c] + self.tree.rank(c, lo[live], self.start)
            z = self.first[c] + self.tree.rank(c, hi[live], self.start)
            many = z - a > 1
            live, a, z = live[many], a[many], z[many]
            lo[live], hi[live], length[live] = a, z, step
            if step == k:
                low_k[live], high_k[live] = a, z
            live = live[ends[live] - step > begins[live]]
        return length, low_k, high_k

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least ``doc`` in each interval; none may be empty. Intervals of one depth are equal or apart."""
        a, which = np.unique(lo, return_inverse=True)
        z = np.zeros(len(a), np.int64)
        z[which] = hi
        cuts = np.stack([a, z], 1).reshape(-1)
        doc = np.append(self.doc, LAST) if len(cuts) and cuts[-1] == self.n else self.doc
        return np.minimum.reduceat(doc, cuts)[::2][which] if len(cuts) else np.zeros(0, np.int64)


# ---- segments ----------------------------------------------------------------------------------


def _segments(b: Block, k: int):
    """Word spans, and per segment: anchor, first word, windows, content fingerprint."""
    starts, ends, row = b.spans(SPACE)
    word = span_hash(b.data, starts, ends)
    n = len(word) - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return starts, ends, row, np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    gram = min(GRAM, k)
    m, width, need = window_hash(word, gram), 1, k - gram + 1
    while width * 2 <= need:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < need:
        m = np.minimum(m[: len(m) - (need - width)], m[need - width :])
    m = m[:n]
    ok = in_one_row(row, k)
    at = np.flatnonzero(ok)
    new = np.ones(len(at), bool)
    new[1:] = (m[at[1:]] != m[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    run = np.cumsum(new) - 1
    place = np.arange(len(at)) - np.flatnonzero(new)[run] if len(at) else none
    new |= place % need == 0  # a periodic text keeps one anchor for long
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    w = window_hash(word, k)
    fp = mix(w[first] * U(31) + w[first + count - 1] + count.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    return starts, ends, row, m[first], first, count, fp, w


def _doc_key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def shared_anchors(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """The anchors that occur in more than one doc_id."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                _, _, row, key, first, _, _, _ = _segments(Block(part.column(1)), k)
                if not len(key):
                    continue
                doc = np.asarray(part.column(0))[row[first]]
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                cols = [key[edge].view(np.int64), np.minimum.reduceat(doc, edge), np.maximum.reduceat(doc, edge)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "lo", "hi"])

    rows = docs.select(_doc_key().alias("doc_id"), "text").mapInArrow(run, "key long, lo long, hi long")
    return rows.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key")


class Bloom:
    """Three probes into a bit table whose size is a power of two."""

    def __init__(self, bytes_: int):
        self.bits = np.zeros(bytes_, np.uint8)

    def _places(self, key: np.ndarray):
        mask = U(len(self.bits) * 8 - 1)
        for i in (1, 2, 3):
            yield (mix(key + U(i * 0x9E3779B97F4A7C15 & 2**64 - 1)) & mask).astype(np.int64)

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for p in self._places(key):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return out


def anchor_filter(anchors: DataFrame, n: int, limit: int = BLOOM_BYTES) -> Bloom:
    """A filter of the ``n`` anchors: bits are dealt out by piece and set there; the pieces, ``limit`` bytes at most, are collected."""
    spark = anchors.sparkSession
    out = Bloom(min(limit, max(1 << 10, 1 << int(n * 12 // 8).bit_length())))
    size, piece = len(out.bits), min(len(out.bits), BLOOM_PIECE)

    def places(batches):
        b = Bloom(size)
        for batch in batches:
            for at in b._places(np.asarray(batch.column(0)).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array((at // (piece * 8)).astype(np.int32)), pa.array((at % (piece * 8)).astype(np.int32))], ["piece", "bit"])

    def fill(batches):
        table: dict[int, np.ndarray] = {}
        for batch in batches:
            which, bit = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i in np.unique(which).tolist():
                at = bit[which == i]
                np.bitwise_or.at(table.setdefault(i, np.zeros(piece, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        if table:
            yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.int32()), pa.array([x.tobytes() for x in table.values()], pa.binary())], ["piece", "bits"])

    parts = max(1, min(size // piece, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bits = anchors.select("key").mapInArrow(places, "piece int, bit int").repartition(parts, "piece").mapInArrow(fill, "piece int, bits binary")
    for r in bits.toLocalIterator():
        out.bits[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["bits"], np.uint8)
    return out


def _text_of(b: Block, s: np.ndarray, e: np.ndarray) -> pa.Array:
    n = e - s
    at = np.arange(int(n.sum())) + np.repeat(s - (np.cumsum(n) - n), n)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(b.data[at])])


_SEGMENT = "key long, fp long, windows int, text binary, lo long, hi long"
_SEGMENT_COLUMNS = [x.split()[0] for x in _SEGMENT.split(", ")]


def _merged(held: list[pa.Table]) -> pa.Table:
    """Of equal segments one, with the least and greatest document of all."""
    rows = pa.concat_tables(held).combine_chunks()
    key, fp = np.asarray(rows["key"]), np.asarray(rows["fp"])
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])) if len(key) else np.zeros(0, np.int64)
    if not len(edge):
        return rows
    one = rows.take(pa.array(order[edge]))
    lo, hi = np.minimum.reduceat(np.asarray(rows["lo"])[order], edge), np.maximum.reduceat(np.asarray(rows["hi"])[order], edge)
    return one.set_column(4, "lo", pa.array(lo)).set_column(5, "hi", pa.array(hi))


def _kept(part: pa.RecordBatch, bloom: Bloom, k: int):
    """The block, its word spans and rows, and the key, first word, windows and fingerprint of segments that may repeat."""
    b = Block(part.column(1))
    starts, ends, row, key, first, count, fp, _ = _segments(b, k)
    keep = bloom.has(key)
    return b, starts, ends, row, key[keep], first[keep], count[keep], fp[keep]


def live_segments(docs: DataFrame, bloom, k: int = WINDOW) -> DataFrame:
    """anchor key, content fingerprint, windows, text, least and greatest doc_id of segments, merged inside each task."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in blocks(batch, "text"):
                b, starts, ends, row, key, first, count, fp = _kept(part, bloom.value, k)
                if not len(key):
                    continue
                doc = np.asarray(part.column(0))[row[first]]
                order = np.lexsort((first, fp))
                key, first, count, fp, doc = key[order], first[order], count[order], fp[order], doc[order]
                edge = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
                text = _text_of(b, starts[first[edge]], ends[first[edge] + count[edge] + k - 2])
                cols = [pa.array(key[edge].view(np.int64)), pa.array(fp[edge].view(np.int64)), pa.array(count[edge].astype(np.int32)), text, pa.array(np.minimum.reduceat(doc, edge)), pa.array(np.maximum.reduceat(doc, edge))]
                held.append(pa.Table.from_arrays(cols, _SEGMENT_COLUMNS))
                n += len(edge)
                if n > TASK_SEGMENTS:
                    held = [_merged(held)]
                    n = len(held[0])
                    if n > TASK_SEGMENTS // 2:
                        yield from held[0].to_batches(20_000)
                        held, n = [], 0
        if held:
            yield from _merged(held).to_batches(20_000)

    return docs.select(_doc_key().alias("doc_id"), "text").mapInArrow(run, _SEGMENT)


def places(docs: DataFrame, bloom, k: int = WINDOW) -> DataFrame:
    """fp, doc_id, text hash and first word of every segment that may repeat."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                _, _, _, row, _, first, _, fp = _kept(part, bloom.value, k)
                r = row[first]
                place = first - np.searchsorted(row, r)
                cols = [fp.view(np.int64), np.asarray(part.column(0))[r], np.asarray(part.column(2))[r], place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["fp", "doc_id", "hash", "place"])

    rows = docs.select(_doc_key().alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    return rows.mapInArrow(run, "fp long, doc_id long, hash long, place int")


def window_least_doc(texts: pa.Array, windows: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """For every window of the distinct segments, in order, the least doc over all segments with it."""
    b = Block(texts)
    starts, ends, row = b.spans(SPACE)
    _, ids = np.unique(span_hash(b.data, starts, ends), return_inverse=True)
    words = np.bincount(row, minlength=b.n)
    text = np.zeros(len(ids) + b.n, np.int64)  # a separator follows each segment
    text[np.arange(len(ids)) + row] = ids + 1
    begin = np.cumsum(words + 1) - words - 1
    index = FMIndex(text, int(words.max(initial=k)), np.repeat(doc, words + 1))
    out = []
    for at in range(0, b.n, STREAM_SEGMENTS):
        seg = np.repeat(np.arange(at, min(b.n, at + STREAM_SEGMENTS)), windows[at : at + STREAM_SEGMENTS])
        n = windows[at : at + STREAM_SEGMENTS]
        nth = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        length, lo, hi = index.matching(text, begin[seg] + nth + k, begin[seg], k)
        least = doc[seg].copy()
        over = np.flatnonzero(length >= k)
        least[over] = index.least(lo[over], hi[over])
        out.append(least)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_ANSWER = "fp long, least array<long>, key long, windows int, text binary, lo long, hi long"
_ANSWER_COLUMNS = [x.split()[0] for x in _ANSWER.split(", ")]
_ANSWER_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]


def _solved(rows: pa.Table, k: int) -> pa.RecordBatch:
    """fp and least documents of its windows, of the segments of which a window has a smaller one."""
    rows = rows.combine_chunks()
    windows = np.asarray(rows["windows"]).astype(np.int64)
    least = window_least_doc(rows["text"].chunk(0), windows, np.asarray(rows["lo"]), k)
    off = np.concatenate([[0], np.cumsum(windows)])
    hit = np.minimum.reduceat(least, off[:-1]) < np.asarray(rows["hi"])
    lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(least))
    n = int(hit.sum())
    return pa.RecordBatch.from_arrays([rows["fp"].chunk(0).filter(pa.array(hit)), lists.filter(pa.array(hit)), *(pa.nulls(n, t) for t in _ANSWER_TYPES[2:])], _ANSWER_COLUMNS)


def _apart(rows: pa.Table, k: int) -> pa.RecordBatch:
    """Segments of an anchor that is too frequent, window by window: parent fp, and a segment of one window, in ``least`` its number."""
    rows = rows.combine_chunks()
    b = Block(rows["text"].chunk(0))
    starts, ends, row = b.spans(SPACE)
    first = np.searchsorted(row, np.arange(b.n))
    windows = np.asarray(rows["windows"]).astype(np.int64)
    seg = np.repeat(np.arange(b.n), windows)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = first[seg] + nth
    w = window_hash(span_hash(b.data, starts, ends), k)[at]
    text = _text_of(b, starts[at], ends[at + k - 1])
    number = pa.ListArray.from_arrays(pa.array(np.arange(len(seg) + 1, dtype=np.int32)), pa.array(nth))
    cols = [pa.array(np.asarray(rows["fp"])[seg]), number, pa.array(w.view(np.int64)), pa.array(np.ones(len(seg), np.int32)), text, pa.array(np.asarray(rows["lo"])[seg]), pa.array(np.asarray(rows["hi"])[seg])]
    return pa.RecordBatch.from_arrays(cols, _ANSWER_COLUMNS)


def _shard(k: int, hot: int):
    """Rows come sorted by key and fp. Whole keys are solved together; what is held are distinct segments."""

    def run(batches):
        held, n, tail, split = [], 0, None, False  # complete keys; the key at hand and whether it was too large

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = _merged([rows] if tail is None else [tail, rows])
            if not len(rows):
                continue
            keys = np.asarray(rows["key"])
            edge = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
            tail = rows.slice(int(edge[-2]))
            plain = []
            for a, z in zip(edge[:-2].tolist(), edge[1:-1].tolist()):
                if split or z - a > hot:
                    split = False
                    yield _apart(rows.slice(a, z - a), k)
                else:
                    plain.append((a, z))
            if plain:
                a, z = plain[0][0], plain[-1][1]
                if z - a == sum(y - x for x, y in plain):
                    held.append(rows.slice(a, z - a))
                else:
                    held += [rows.slice(x, y - x) for x, y in plain]
                n += sum(y - x for x, y in plain)
            if n >= CHUNK_SEGMENTS:
                yield _solved(pa.concat_tables(held), k)
                held, n = [], 0
            if split or len(tail) > hot:  # the last key may go on in the next batch
                yield _apart(tail, k)
                tail, split = tail.slice(0, 0), True
        if tail is not None and len(tail):
            if split:
                yield _apart(tail, k)
            else:
                held.append(tail)
        if held:
            yield _solved(pa.concat_tables(held), k)

    return run


def _dealt(segments: DataFrame, parts: int) -> DataFrame:
    return segments.select(*_SEGMENT_COLUMNS).repartition(parts, "key").sortWithinPartitions("key", "fp")


def window_answers(segments: DataFrame, k: int, hot: int, parts: int) -> DataFrame:
    """fp and the least documents of its windows (``LAST`` for unknown), of segments that may have something to remove."""
    solved = cut(_dealt(segments, parts).mapInArrow(_shard(k, hot), _ANSWER), "answers")
    answers = solved.where("key is null").select("fp", "least")
    apart = solved.where("key is not null")
    if apart.isEmpty():
        return answers
    # Of equal windows one is enough, with the least and greatest document of all.
    single = apart.groupBy("key").agg(F.first("windows").alias("windows"), F.first("text").alias("text"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("fp", F.col("key"))
    found = cut(_dealt(single, parts).mapInArrow(_shard(k, LAST), _ANSWER), "answers").select(F.col("fp").alias("key"), F.col("least")[0].alias("first"))
    whole = apart.select(F.col("fp").alias("parent"), F.col("least")[0].alias("nth"), "key").join(found, "key")
    numbered = whole.groupBy("parent").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("nth").cast("int"), "first")))).alias("m"))
    least = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.col("m")[i], F.lit(LAST)))
    return answers.unionByName(numbered.select(F.col("parent").alias("fp"), least.alias("least")))


def repeated_windows(docs: DataFrame, k: int = WINDOW, hot: int = HOT, bloom_bytes: int = BLOOM_BYTES) -> DataFrame:
    """doc_id, hash (of the text), place (first word of a segment), mask (bit i: its window i repeats)."""
    spark = docs.sparkSession
    ship_package(spark)
    anchors = cut(shared_anchors(docs, k), "anchors")
    n = anchors.count()
    bloom = spark.sparkContext.broadcast(anchor_filter(anchors, n, bloom_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100_000)
    answers = window_answers(live_segments(docs, bloom, k), k, hot, parts)
    found = places(docs, bloom, k).join(answers, "fp")
    bits = F.transform("least", lambda d, i: F.when(d < F.col("doc_id"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    mask = F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return found.select("doc_id", "hash", "place", mask.alias("mask")).where("mask <> 0")


def _with_spans(docs: DataFrame, k: int, **how) -> DataFrame:
    found = cut(repeated_windows(docs, k, **how), "repeats")
    by_doc = found.groupBy("doc_id", "hash").agg(F.collect_list("place").alias("_places"), F.collect_list("mask").alias("_masks"))
    by_doc = by_doc.select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"), "_places", "_masks")
    return docs.join(by_doc, (_doc_key() == F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")), "left").drop("_doc", "_hash")


def removed_words(n: int, places: list | None, masks: list | None, k: int) -> np.ndarray:
    """Which of n words lie in a window that repeats."""
    if not places:
        return np.zeros(n, bool)
    p, m = np.array(places, np.int64), np.array(masks, np.int64)
    d = np.zeros(n + 1, np.int64)
    i = 0
    while (m >> i).any():
        s = p[(m >> i & 1) == 1] + i
        np.add.at(d, s, 1)
        np.add.at(d, s + k, -1)
        i += 1
    return np.cumsum(d[:-1]) > 0


def _keep(text: str | None, places, masks, k: int) -> tuple[int, int, bytes]:
    words = (text or "").encode().split()
    gone = removed_words(len(words), places, masks, k)
    kept = [w for w, g in zip(words, gone.tolist()) if not g] if places else words
    return len(words), int(gone.sum()), b" ".join(kept)


def dedup_substrings(docs: DataFrame, k: int = WINDOW, with_text: bool = False, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept``, the words that stay, joined by spaces)."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                rows = [_keep(t, p, m, k) for t, p, m in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)))]
                cols = [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([r[2].decode() for r in rows])] * with_text, names)

    rows = _with_spans(docs.select("doc_id", "text"), k, **how).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_places", "_masks")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\t-\r ]+') as w from documents
), win as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w)
), first as (select s, min(doc_id) as least from win group by s
), gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from win join first using (s) where least < doc_id
), kept as (
  select doc_id, string_agg(word, ' ' order by j) as t, count(*) as n
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from w) left join (select *, true as hit from gone) using (doc_id, j) where hit is null group by doc_id
)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""
