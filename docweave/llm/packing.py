"""Sum-of-squares packing of token pieces into sequences of a fixed capacity.

Each piece goes to the bin for which the sum, over residual gaps, of squared counts of open bins
becomes smallest. By default a new bin is opened only where no open bin fits, which packs tighter;
with ``open_first=False`` a new bin competes with the open ones.

A full piece is a sequence by itself and needs no plan. For the others only the histogram of lengths
matters to the rule, and it has fewer than ``capacity`` entries whatever the input size. So the packing
runs on the histogram, largest lengths first: with N pieces, it is packed in levels of about ``level_items``
items, where an item of level i stands for ``k_i`` equal pieces and each bin for ``k_i`` equal sequences.
The levels cover every piece once. Pieces then find their place by their rank among pieces of their
length, which comes from salted per-length counts: a length gets one salt for each ``RANK_ROWS`` of its
pieces, so that no length, however frequent, meets in one task.

Defined results: a null text is empty (the end id alone); a longer document is cut into pieces of
``capacity`` ids, the last may be shorter; repeated rows and rows with a null doc_id are packed each; an
empty table has no sequences; equal pieces are ordered by doc_id, then a hash of the row; extra columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.textblock import Block, blocks
from docweave.llm.tokens import default_path, encoder
from docweave.runtime import cut, ship_package

CAPACITY = 2048
END_ID = 0
LEVEL_ITEMS = 1 << 17
RANK_ROWS = 200_000  # pieces of one length that one task ranks, about
ENCODE_BYTES = 1 << 19  # of text at a time; its arrays take some fifty times as much, larger ones aren't faster


def pack_lengths(lengths: np.ndarray, capacity: int, open_first: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item of an array of lengths, and the number of bins.

    Of the bins that compete the least sum of squares wins; of equal ones, an open one and the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:capacity]) + s
        cost = 1 - 2 * count[gaps] + np.where(gaps > s, 2 * count[gaps - s] + 1, 0)
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if len(gaps) and (open_first or cost.min() <= fresh):
            gap = int(gaps[np.argmin(cost)])
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, n
            n += 1
        where[i], offset[i] = b, capacity - gap
        left = gap - s
        if left:
            bins[left].append(b)
            count[left] += 1
    return where, offset, n


class Plan:
    """Where the r-th piece of a length goes."""

    def __init__(self, histogram: np.ndarray, capacity: int = CAPACITY, level_items: int = LEVEL_ITEMS):
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        self.capacity, self.levels, base, done = capacity, [], 0, np.zeros_like(left)
        while left.sum():
            k = max(1, int(-(-left.sum() // level_items)))
            take = left // k
            if not take.sum():  # many lengths, few pieces of each: whole lengths, one at least
                k, before = 1, np.cumsum(left) - left
                take = np.where((before + left <= level_items) | (before == 0), left, 0)
            lengths = np.repeat(np.arange(capacity, 0, -1), take[:0:-1])
            where, offset, bins = pack_lengths(lengths, capacity)
            first = np.zeros(capacity + 1, np.int64)
            first[capacity:0:-1] = np.cumsum(take[:0:-1]) - take[:0:-1]
            self.levels.append((k, done.copy(), done + take * k, first, where, offset, base))
            base += bins * k
            done += take * k
            left -= take * k
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.full(len(length), -1, np.int64), np.full(len(length), -1, np.int64)
        for k, lo, hi, first, where, offset, base in self.levels:
            m = (rank >= lo[length]) & (rank < hi[length])
            r = rank[m] - lo[length[m]]
            item = first[length[m]] + r // k
            seq[m], off[m] = base + where[item] * k + r % k, offset[item]
        return seq, off


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids as little-endian u32."""
    ship_package(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in blocks(batch, "text", ENCODE_BYTES):
                ids, n = enc.encode(Block(part.column(1)))
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = ((np.cumsum(n) - n)[row] + start) * 4
                raw = ids.astype("<u4").tobytes()
                cuts = [raw[a:z] for a, z in zip(at.tolist(), (at + 4 * length).tolist())]
                cols = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, cuts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(cuts, pa.binary())] * with_ids, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, level_items: int = LEVEL_ITEMS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read more than once: pass something written.

    What reaches the driver is a count for each length and one for each ``rank_rows`` pieces. Sequences of
    full pieces have negative numbers.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    rest = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*rest)
    whole = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = pieces.where(F.col("length") < capacity)

    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():
        histogram[length] = n
    salts = 1 + histogram // rank_rows
    at = F.element_at(F.array(*map(F.lit, salts.tolist())), F.col("length").cast("int") + 1) if salts.max() > 1 else F.lit(1)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), at).cast("int"))
    first = np.cumsum(salts) - salts  # a length's counts stand side by side
    before = np.zeros(int(salts.sum()), np.int64)
    if salts.max() > 1:
        for length, salt, n in salted.groupBy("length", "_salt").count().collect():
            before[first[length] + salt] = n
        total = np.cumsum(before) - before
        before = total - np.repeat(total[first], salts)
    shared = spark.sparkContext.broadcast((Plan(histogram, capacity, level_items), first, before))
    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(w) - 1)

    def run(batches):
        plan, first, before = shared.value
        for b in batches:
            get = lambda c: np.asarray(b.column(b.schema.get_field_index(c))).astype(np.int64)
            length = get("length")
            seq, off = plan.place(length, before[first[length] + get("_salt")] + get("_rank"))
            keep = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], [*rest, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, offset long").unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    return place_pieces(cut(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id and its ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
