"""Benchmark decontamination: a hash set of test n-grams is broadcast and token windows are scanned.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII bytes. A window is
``n`` successive words of an item; an item of fewer words, but not none, is one window. A document
word inside any occurrence of a window is hit. Every hash hit is verified word for word.

What is broadcast is one block of at most ``max_windows`` windows (one longer item may exceed it): about
26 bytes a window, its hash, its place in its item's text, and its items. A benchmark of one block
takes one narrow pass over the documents. For a larger one the documents pass once a block, each pass
writes narrow rows of what it hit and its broadcast is destroyed before the next; these rows are
then merged by document. So no worker ever holds two blocks.

Defined results: null texts and texts without words have no hits; null or word-less items have no
windows; repeated item rows count once by ``item_id``, and rows without an id are one item, whose id is null
and last in ``item_ids``; an empty benchmark hits nothing; repeated document rows, and rows with a null
doc_id, are all returned, each judged by its own text. Output columns replace input columns of their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.textblock import Block, blocks, in_one_row, span_hash, window_hash
from docweave.runtime import cut, ship_package

NGRAM = 13
MAX_WINDOWS = 500_000
NO_ID = np.int64(2**63 - 1)  # stands for a null item_id

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
NOT_WORD = ~_WORD
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[NOT_WORD] = 32


class NgramSet:
    """Distinct windows of benchmark items, sorted by hash, per length; all in flat arrays."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int = NGRAM):
        self.n = n
        b = Block(pa.array([t or "" for _, t in items], pa.string()))
        self.data = _FOLD[b.data]
        self.starts, self.ends, row = b.spans(NOT_WORD)
        ids = np.array([NO_ID if i is None else i for i, _ in items], np.int64)
        words = np.bincount(row, minlength=b.n)
        h = span_hash(self.data, self.starts, self.ends)
        self.tables: dict[int, tuple] = {}
        for k in np.unique(np.minimum(words[words > 0], n)).tolist():
            at = np.flatnonzero(in_one_row(row, k))
            at = at[np.minimum(words, n)[row[at]] == k]
            w = window_hash(h, k)[at]
            order = np.lexsort((ids[row[at]], w))
            self.tables[k] = self._table(k, w[order], at[order], ids[row[at]][order])

    def _table(self, k: int, w: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple:
        """Hashes, first words of distinct windows, and their items as slices of a flat array.

        Of windows with one hash that differ in words, each is one entry: the hash then has several.
        """
        text = [self._text(k, i) for i in at.tolist()] if len(w) > 1 and (w[1:] == w[:-1]).any() else None
        if text is not None:
            same = np.array([False, *(w[i] == w[i - 1] and text[i] != text[i - 1] for i in range(1, len(w)))])
            if same.any():  # a collision: order each hash's windows by their words
                order = np.array(sorted(range(len(w)), key=lambda i: (int(w[i]), text[i], int(item[i]))))
                w, at, item, text = w[order], at[order], item[order], [text[i] for i in order.tolist()]
            new = np.array([True, *(w[i] != w[i - 1] or text[i] != text[i - 1] for i in range(1, len(w)))])
        else:
            new = np.ones(len(w), bool)
        keep = new.copy()
        keep[1:] |= item[1:] != item[:-1]  # an item's window that comes again counts once
        edge = np.append(np.cumsum(keep)[new] - 1, int(keep.sum()))
        bits = min(22, max(16, int(len(w)).bit_length() + 4))
        gate = np.zeros(1 << bits, bool)
        gate[(w >> np.uint64(64 - bits)).astype(np.int64)] = True
        return w[new], at[new].astype(np.int32), edge.astype(np.int32), item[keep], bits, gate

    def _text(self, k: int, first: int) -> bytes:
        return b" ".join(self.data[self.starts[first] : self.ends[first + k - 1]].tobytes().split())

    def scan(self, b: Block) -> tuple[tuple, np.ndarray, list[set[int]]]:
        """The words' spans and rows; which words are hit; item sets per row."""
        folded = _FOLD[b.data]
        starts, ends, row = b.spans(NOT_WORD)
        h = span_hash(folded, starts, ends)
        hit = np.zeros(len(starts) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(b.n)]
        for k, (keys, first, edge, item, bits, gate) in self.tables.items():
            w = window_hash(h, k)
            at = np.flatnonzero(gate[(w >> np.uint64(64 - bits)).astype(np.int64)])
            at = at[in_one_row(row, k)[at]] if len(at) else at
            p = np.searchsorted(keys, w[at])
            real = keys[np.minimum(p, len(keys) - 1)] == w[at]
            for i, e in zip(at[real].tolist(), p[real].tolist()):
                text = b" ".join(folded[starts[i] : ends[i + k - 1]].tobytes().split())
                while e < len(keys) and keys[e] == w[i]:
                    if self._text(k, int(first[e])) == text:
                        items[int(row[i])].update(item[edge[e] : edge[e + 1]].tolist())
                        hit[i] += 1
                        hit[i + k] -= 1
                        break
                    e += 1
        return (starts, ends, row), np.cumsum(hit[:-1]) > 0, items


def benchmark_blocks(bench: DataFrame, n: int = NGRAM, max_windows: int = MAX_WINDOWS) -> Iterator[NgramSet]:
    """NgramSets of whole items, each of at most ``max_windows`` windows (one item may exceed it alone).

    Items stream to the driver partition by partition, so no more than a block is held there.
    """
    held, size = [], 0
    for item, text in bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        k = len(text or "") // 2 + 1
        if held and size + k > max_windows:
            yield NgramSet(held, n)
            held, size = [], 0
        held.append((item, text))
        size += k
    yield NgramSet(held, n)


def _runs(hit: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of hit words inside a row."""
    before = np.concatenate([[False], hit[:-1] & (row[1:] == row[:-1])]) if len(hit) else hit
    after = np.concatenate([hit[1:] & (row[1:] == row[:-1]), [False]]) if len(hit) else hit
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _report(b: Block, spans: tuple, hit: np.ndarray, items: list) -> list[pa.Array]:
    """n_words, n_hit, item_ids and spans of a block's rows."""
    starts, ends, row = spans
    first, last = _runs(hit, row)
    off = b.offsets[row[first]]
    pairs = pa.StructArray.from_arrays([pa.array(starts[first] - off), pa.array(ends[last] - off)], ["start", "end"])
    where = pa.array(np.searchsorted(row[first], np.arange(b.n + 1)).astype(np.int32))
    ids = [[None if x == NO_ID else x for x in sorted(s)] for s in items]
    return [pa.array(np.bincount(row, minlength=b.n), pa.int64()), pa.array(np.bincount(row[hit], minlength=b.n), pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.ListArray.from_arrays(where, pairs)]


_FOUND = ["n_words", "n_hit", "item_ids", "spans"]
_FOUND_DDL = "n_words long, n_hit long, item_ids array<long>, spans array<struct<start:long,end:long>>"


def _block_hits(docs: DataFrame, ngrams: NgramSet) -> DataFrame:
    """__dw_doc, __dw_hash, first and last hit words and items of the rows that one block hits, written."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(ngrams)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                b = Block(part.column(2))
                (_, _, row), hit, items = shared.value.scan(b)
                first, last = _runs(hit, row)
                base = np.searchsorted(row, np.arange(b.n))
                cols = [part.column(0), part.column(1), _lists((first - base[row[first]]).astype(np.int32), row[first], b.n), _lists((last - base[row[last]]).astype(np.int32), row[last], b.n), pa.array([sorted(s) for s in items], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["__dw_doc", "__dw_hash", "first", "last", "items"]).filter(pa.array([bool(s) for s in items], pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("__dw_doc"), F.xxhash64("text").alias("__dw_hash"), "text")
    out = cut(rows.mapInArrow(run, "__dw_doc long, __dw_hash long, first array<int>, last array<int>, items array<long>"), "hits")
    shared.destroy()
    return out


def _scanned(docs: DataFrame, bench: DataFrame, n: int, max_windows: int, finish, schema) -> DataFrame:
    """``finish(batch, block, spans, hit, items)`` of every block of rows of ``docs``, which has ``text``."""
    spark = docs.sparkSession
    ship_package(spark)
    sets = benchmark_blocks(bench, n, max_windows)
    one, more = next(sets), next(sets, None)
    if more is None:
        shared = spark.sparkContext.broadcast(one)

        def run(batches):
            for batch in batches:
                for part in blocks(batch, "text"):
                    b = Block(part.column(part.schema.get_field_index("text")))
                    yield finish(part, b, *shared.value.scan(b))

        return docs.mapInArrow(run, schema)

    hits = _block_hits(docs, one).unionByName(_block_hits(docs, more))
    for ngrams in sets:
        hits = hits.unionByName(_block_hits(docs, ngrams))
    by_doc = hits.groupBy("__dw_doc", "__dw_hash").agg(*[F.flatten(F.collect_list(c)).alias(f"__dw_{c}") for c in ("first", "last", "items")])
    key = F.xxhash64("text") == F.col("__dw_hash")
    joined = docs.join(by_doc, F.col("doc_id").cast("long").eqNullSafe(F.col("__dw_doc")) & key, "left").drop("__dw_doc", "__dw_hash")

    columns = docs.columns

    def merge(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                at = part.schema.get_field_index
                b = Block(part.column(at("text")))
                spans = b.spans(NOT_WORD)
                base = np.searchsorted(spans[2], np.arange(b.n))
                hit = np.zeros(len(spans[0]), bool)
                for i, (first, last) in enumerate(zip(part.column(at("__dw_first")).to_pylist(), part.column(at("__dw_last")).to_pylist())):
                    for x, y in zip(first or (), last or ()):
                        hit[base[i] + x : base[i] + y + 1] = True
                yield finish(part.select(columns), b, spans, hit, [set(x or ()) for x in part.column(at("__dw_items")).to_pylist()])

    return joined.mapInArrow(merge, schema)


def find_contamination(docs: DataFrame, bench: DataFrame, n: int = NGRAM, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids and spans (start, end of hit runs in UTF-8 bytes of the text)."""

    def finish(part, b, spans, hit, items):
        return pa.RecordBatch.from_arrays([part.column(0), *_report(b, spans, hit, items)], ["doc_id", *_FOUND])

    return _scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bench, n, max_windows, finish, f"doc_id long, {_FOUND_DDL}")


def remove_contaminated(docs: DataFrame, bench: DataFrame, n: int = NGRAM, share: int = 20, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs``, all columns, but those with n_hit > 0 and share * n_hit >= n_words."""

    def finish(part, b, spans, hit, items):
        row = spans[2]
        n_words, n_hit = np.bincount(row, minlength=b.n), np.bincount(row[hit], minlength=b.n)
        return part.filter(pa.array(~((n_hit > 0) & (share * n_hit >= n_words))))

    return _scanned(docs, bench, n, max_windows, finish, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = r"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') from benchmark
), item_windows as (
  select distinct id as item_id, k, array_to_string(w[i : i + k - 1], ' ') as win
  from (select id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from words where kind = 'b' and len(w) > 0)
), sizes as (select distinct k from item_windows
), doc_windows as (
  select id as doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as win
  from (select id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, sizes where kind = 'd' and len(w) >= k)
), found as (select doc_id, i, d.k, item_id from doc_windows d join item_windows using (k, win)
), hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from found) group by doc_id
), items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from found) group by doc_id)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit on id = hit.doc_id left join items on id = items.doc_id where kind = 'd'
"""
