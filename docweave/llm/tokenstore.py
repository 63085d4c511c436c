"""Token-id files with Elias-Fano encoded document boundaries.

A store is a folder of shards. A shard holds the ids of documents that follow each other by doc_id:
the id array (2 or 4 bytes an id), then the footer with doc_ids and boundaries, both as Elias-Fano
sequences. Of a boundary the low ``l`` bits are packed side by side and the high part is a unary bit
vector; a table of every 256th one bit lets ``select`` find a boundary in near-minimal space.

Layout, little-endian: b"EFTOK1\\0\\0", ids, doc_id sequence, boundary sequence, footer
(u64 documents, u64 ids, u64 id width, i64 first doc_id, u64 length of the doc_id sequence, u64
length of the boundary sequence, b"EFTOK1\\0\\0"). A sequence: u64 entries, u64 l, u64 high bits, then
low words, high words and select samples, each u64.

Defined results: a null text is empty and has the end id alone; equal doc_ids follow each other in
order of their texts; rows with a null doc_id come first and read back as null; an empty table makes
an empty store; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.textblock import Block, blocks
from docweave.llm.tokens import default_path, encoder
from docweave.runtime import shared_path, ship_package

MAGIC = b"EFTOK1\0\0"
SAMPLE = 256
FOOT = struct.Struct("<QQQqQQ8s")
END_ID = 2
SHARD_BYTES = 48 << 20
READ_DOCS, READ_TASKS = 8192, 20_000  # documents a select, and tasks of one read, at most
U = np.uint64


class EliasFano:
    """A non-decreasing sequence of unsigned integers with random access."""

    def __init__(self, n: int, l: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.l, self.bits, self.low, self.high, self.samples = n, l, bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n * l + 63) // 64 + 1, np.uint64)
        if l:
            part = v & U((1 << l) - 1)
            at = np.arange(n, dtype=np.uint64) * U(l)
            word, shift = (at >> U(6)).astype(np.int64), at & U(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U(l) > U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        ones = (v >> U(l)).astype(np.int64) + np.arange(n)
        bits = int(ones[-1]) + 1 if n else 0
        raw = np.zeros((bits + 63) // 64 * 64, np.uint8)
        raw[ones] = 1
        high = np.packbits(raw, bitorder="little").view(np.uint64)
        return cls(n, l, bits, low, high, ones[::SAMPLE].astype(np.uint64))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * U(self.l)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        got = self.low[word] >> shift
        over = shift + U(self.l) > U(64)
        got[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return got & U((1 << self.l) - 1)

    def select(self, i: int) -> int:
        """Entry ``i``: from the nearest sample, whole words are counted, then bits of one word."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = at >> 6
        cur = int(self.high[word]) >> (at & 63) << (at & 63)
        while True:
            ones = cur.bit_count()
            if left < ones:
                break
            left -= ones
            word += 1
            cur = int(self.high[word])
        for _ in range(left):
            cur &= cur - 1
        place = word * 64 + (cur & -cur).bit_length() - 1
        return ((place - i) << self.l) | int(self._lows(np.array([i]))[0])

    def select_range(self, start: int, end: int) -> np.ndarray:
        """Entries ``start`` to ``end`` - 1: only the words from one sample to the next behind them are looked at."""
        if end <= start:
            return np.zeros(0, np.uint64)
        if not 0 <= start < end <= self.n:
            raise IndexError((start, end))
        begin = int(self.samples[start // SAMPLE])
        behind = (end - 1) // SAMPLE + 1
        stop = int(self.samples[behind]) + 1 if behind < len(self.samples) else self.bits
        a, z = begin >> 6, (stop + 63) >> 6
        ones = np.flatnonzero(np.unpackbits(self.high[a:z].view(np.uint8), bitorder="little")) + (a << 6)
        skip = int(np.searchsorted(ones, begin)) + start % SAMPLE
        i = np.arange(start, end)
        return ((ones[skip : skip + end - start] - i).astype(np.uint64) << U(self.l)) | self._lows(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), count=self.bits, bitorder="little")) if self.n else np.zeros(0, np.int64)
        i = np.arange(self.n)
        return ((ones - i).astype(np.uint64) << U(self.l)) | self._lows(i)

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", self.n, self.l, self.bits) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, l, bits = struct.unpack_from("<QQQ", raw)
        words = np.frombuffer(raw, np.uint64, offset=24)
        a = (n * l + 63) // 64 + 1
        b = a + (bits + 63) // 64
        return cls(n, l, bits, words[:a], words[a:b], words[b : b + (n + SAMPLE - 1) // SAMPLE])


def open_fs(path: str):
    """The pyarrow file system of a URI or local path, and the path there."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Streams ids to a file; boundaries and doc_ids are kept until the footer is written."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = open_fs(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.out.write(MAGIC)
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        self.docs.append(doc_ids)
        self.counts.append(counts)

    def close(self) -> tuple[int, int]:
        docs, counts = np.concatenate(self.docs), np.concatenate(self.counts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        first = int(docs[0])
        a = EliasFano.encode(docs.astype(np.uint64) - U(first & (2**64 - 1))).to_bytes()
        b = EliasFano.encode(ends).to_bytes()
        self.out.write(a)
        self.out.write(b)
        self.out.write(FOOT.pack(len(docs), int(ends[-1]), self.kind.itemsize, first, len(a), len(b), MAGIC))
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return len(docs), int(ends[-1])


class ShardReader:
    """Random access to one shard: ``ids(i)`` reads only document i's ids."""

    def __init__(self, path: str):
        self.fs, self.path = open_fs(path)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        self.n, self.total, self.width, self.first, a, b, magic = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        at = size - FOOT.size - a - b
        if at != 8 + self.total * self.width:
            raise ValueError(f"{path}: lengths don't agree")
        self.docs = EliasFano.from_bytes(self.file.read_at(a, at))
        self.bounds = EliasFano.from_bytes(self.file.read_at(b, at + a))

    def doc_ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        return (self.docs.select_range(start, self.n if end is None else end) + U(self.first & (2**64 - 1))).astype(np.int64)

    def offsets(self, start: int, end: int) -> np.ndarray:
        """Where documents ``start`` to ``end`` - 1 begin, and where the last of them ends."""
        return self.bounds.select_range(start, end + 1).astype(np.int64)

    def range(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, 8 + start * self.width), self.kind)

    def ids(self, i: int) -> np.ndarray:
        return self.range(self.bounds.select(i), self.bounds.select(i + 1))


NULL_ID = -(2**63)


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a store; returns its manifest (shard, file, n_docs, n_ids), read from what was written.

    Texts are dealt out by ranges of doc_id, so each task encodes and writes one run of documents.
    """
    spark = docs.sparkSession
    ship_package(spark)
    tokenizer = tokenizer or default_path()
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, int(-(-size // shard_bytes)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        out, file = None, f"{path}/shard-{shard:07d}.eft"
        enc = encoder(tokenizer)
        width = 2 if len(enc.ends) <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        for batch in batches:
            for part in blocks(batch, "text", 2 << 20):
                ids, n = enc.encode(Block(part.column(1)))
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                out = out or ShardWriter(file, width)
                out.add(np.asarray(part.column(0)), ids, n)
        if out is not None:
            d, i = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, file, d, i)], ["shard", "file", "n_docs", "n_ids"])

    manifest = dealt.mapInArrow(run, "shard long, file string, n_docs long, n_ids long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (over the whole store), n_tokens and ids_crc32 of every document, from the files.

    A running sum over the manifest, one small row per shard, gives each shard's first position; the
    list of shards stays a table. Offsets come from the boundaries' select structure, ``READ_DOCS`` at a time.
    """
    ship_package(spark)
    manifest = spark.read.parquet(f"{path}/manifest")
    base = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")
    listed = manifest.select("file", base.alias("base")).repartition(max(1, min(READ_TASKS, manifest.count())))

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = ShardReader(file)
                for lo in range(0, s.n, READ_DOCS):
                    hi = min(s.n, lo + READ_DOCS)
                    doc, bound = s.doc_ids(lo, hi), s.offsets(lo, hi)
                    at = 0
                    while at < hi - lo:  # about a million ids, or one longer document, at a time
                        end = min(hi - lo, max(at + 1, int(np.searchsorted(bound, bound[at] + (1 << 20), side="right")) - 1))
                        raw = s.range(int(bound[at]), int(bound[end])).astype("<u4").tobytes()
                        b = ((bound[at : end + 1] - bound[at]) * 4).tolist()
                        crc = [zlib.crc32(raw[x:y]) for x, y in zip(b, b[1:])]
                        ids = doc[at:end]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(bound[at:end] + base), pa.array(np.diff(bound[at : end + 1])), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = end

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokenstore")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path)
