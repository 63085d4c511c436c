"""MinHash near-duplicates: fast similarity sketching, banding, and verification on full shingle sets.

A document's set holds its distinct 5-word shingles (words are lower-cased A-Z runs without ASCII white
space); with fewer words, the whole sequence is one shingle. Sketches come from rounds of hashed bin
placement: in round i every shingle falls into one hashed bin with a hashed value, in round t + i all
fall into bin i; a bin keeps the least value of the first round that reached it. So every bin is
filled after 2t rounds at most, mostly after one or two, and two sketches agree in a bin with the sets'
Jaccard similarity as probability.

Equal sets are one node. Nodes that share a band are candidates, and the candidates' connected components
are clusters, each node being in one. So a node's full set is shipped once, to its cluster's task, which
confirms links by exact intersection counts, 100 * intersection >= percent * union, and returns stars,
as many rows as members. A cluster beyond ``CELL_MEMBERS`` or ``CELL_SHINGLES`` is dealt into blocks:

1. Each block is compared inside. What is confirmed is contracted, one node stands for its component, and these
   are dealt into new blocks, as long as each round merges a good part of them. That is linear work, and
   a cluster of near copies, however large, ends here as one component.
2. Nodes all of whose bands hold a single component need no more. The others, which share a band
   with a node of another component, form new, smaller clusters; only of these all pairs of blocks are compared.

So no task holds more than two blocks, and only texts that look alike and aren't are compared in squares.
Components of all stars are the result.

With 25 bands of 5, a pair at similarity 0.85 shares no band with probability 5e-7, one at 0.8 with 5e-5.

Defined results: null and word-less texts have empty sets, link with nothing and stay; rows of one
doc_id are one document; rows with a null doc_id have a null component and stay; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.components import connected_components
from docweave.llm.textblock import Block, blocks, in_one_row, lut_is_space, lut_lower, mix, span_hash, window_hash
from docweave.runtime import cut, ship_package

WORDS = 5
PERCENT = 85
BANDS, ROWS = 25, 5
CELL_MEMBERS, CELL_SHINGLES = 3000, 1_000_000  # of one cluster, compared in one task
ROUNDS, SHRINK = 20, 0.25  # of contracting large clusters: at most, and what share a round must merge to go on
RARE = 8  # shingles of so few members are counted pair by pair, others by bit sets
U = np.uint64
SPACE, LOWER = lut_is_space(), lut_lower()


def shingle_sets(b: Block, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and each row's count."""
    starts, ends, row = b.spans(SPACE)
    word = span_hash(LOWER[b.data], starts, ends)
    ok = np.flatnonzero(in_one_row(row, k))
    h, r = window_hash(word, k)[ok], row[ok]
    n_words = np.bincount(row, minlength=b.n)
    first = np.cumsum(n_words) - n_words
    for few in range(1, k):
        short = np.flatnonzero(n_words == few)
        if len(short):
            h = np.concatenate([h, mix(window_hash(word, few)[first[short]] + U(few))])
            r = np.concatenate([r, short])
    order = np.argsort(r, kind="stable")
    h, r = h[order], r[order]
    n = np.bincount(r, minlength=b.n)
    ends_ = np.cumsum(n)
    for a, z in zip((ends_ - n).tolist(), ends_.tolist()):
        if z - a > 1:
            h[a:z].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], np.bincount(r[keep], minlength=b.n)


def sketches(h: np.ndarray, n: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketches of the sets, one row each; rows of empty sets are left at the maximum."""
    free = U(2**64 - 1)
    out = np.full((len(n), bins), free, np.uint64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(n)), n)
    left = h
    for i in range(2 * bins):
        x = mix(left + U((i + 1) * 0xD1342543DE82EF95 & (2**64 - 1)))
        at = row * bins + (((x >> U(32)) * U(bins) >> U(32)).astype(np.int64) if i < bins else i - bins)
        np.minimum.at(flat, at, (U(i) << U(40)) | (x & U(0xFFFFFFFF)))
        open_ = (out == free).any(1)
        keep = open_[row]
        row, left = row[keep], left[keep]
        if not len(row):
            break
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15), (len(sketch), bands)).copy()
    for i in range(rows):
        key = mix(key * U(0xBF58476D1CE4E5B9) + parts[:, :, i])
    return key


def _sums(h: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([[U(0)], np.cumsum(mix(h + U(salt)), dtype=np.uint64)])
    end = np.cumsum(n)
    return mix(total[end] - total[end - n] + n.astype(np.uint64))


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two set fingerprints, and the band keys; one row per input row."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                h, n = shingle_sets(Block(part.column(1)))
                keys = band_keys(sketches(h, n)).view(np.int64)
                full = n > 0
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(keys[full].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(_sums(h, n, 1).view(np.int64)), pa.array(_sums(h, n, 2).view(np.int64)), bands], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its shingle hashes, of the documents that ``nodes`` names, with its other columns."""
    more = [f for f in nodes.schema.fields if f.name != "node"]
    ddl = ", ".join(["node long", *(f"{f.name} {f.dataType.simpleString()}" for f in more), "shingles array<long>"])

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                h, n = shingle_sets(Block(part.column(1)))
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], sets], ["node", *(f.name for f in more), "shingles"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node")
    return wanted.select("node", "text", *(f.name for f in more)).mapInArrow(run, ddl)


def intersections(values: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """How many values each two of m sets share, as a matrix filled above the diagonal."""
    out = np.zeros((m, m), np.int32)
    _, which, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[which] > 1
    which, row = which[shared], row[shared]
    order = np.lexsort((row, which))
    which, row, df = which[order], row[order], count[which[order]]
    for k in range(2, RARE + 1):
        groups = row[df == k].reshape(-1, k)
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(out, (groups[:, i], groups[:, j]), 1)
    often = df > RARE
    _, col = np.unique(which[often], return_inverse=True)
    if len(col):
        bits = np.zeros((m, int(col.max()) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (row[often], col >> 6), U(1) << (col & 63).astype(np.uint64))
        for i in range(m - 1):
            out[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(1, dtype=np.int32)
    return out


def cell_stars(nodes: np.ndarray, sizes: np.ndarray, values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes that link inside one cell."""
    m = len(nodes)
    both = intersections(values, np.repeat(np.arange(m), sizes), m).astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked = np.triu(linked, 1)
    linked |= linked.T
    label, left = np.full(m, -1), np.ones(m, bool)
    for i in np.argsort(nodes, kind="stable"):
        if not left[i]:
            continue
        reach, front = np.zeros(m, bool), np.array([i])
        reach[i] = True
        while len(front):
            new = linked[front].any(0) & ~reach
            reach |= new
            front = np.flatnonzero(new)
        label[reach] = i
        left &= ~reach
    star = np.flatnonzero(nodes[label] != nodes)
    return nodes[star], nodes[label[star]]


def _links(percent: int):
    def run(batches):
        held: list[tuple] = []  # of the cell at hand: nodes, sizes, values
        cell = None

        def solve():
            nodes, sizes, values = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cell_stars(nodes, sizes, values, percent)], ["u", "v"])

        for b in batches:
            keys = np.stack([np.asarray(b.column(i)) for i in (0, 1, 2)], 1)
            lists = b.column(4)
            off = np.asarray(lists.offsets).astype(np.int64)
            flat = np.asarray(lists.values)
            nodes = np.asarray(b.column(3))
            edge = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for x, y in zip(edge, edge[1:]):
                if x == y:
                    continue
                if cell is not None and tuple(keys[x]) != cell:
                    yield solve()
                    held = []
                cell = tuple(keys[x])
                held.append((nodes[x:y], np.diff(off[x : y + 1]), flat[off[x] : off[y]]))
        if held:
            yield solve()

    return run


def _blocks(members: DataFrame, salt: int = 0) -> DataFrame:
    """node, cluster, n_shingles, and into how many blocks (g) the cluster is dealt, and in which one the node is.

    Blocks of half a cell: a pair of blocks is a cell at most.
    """
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    fits = (F.col("m") <= CELL_MEMBERS) & (F.col("s") <= CELL_SHINGLES)
    parts = F.when(fits, 1).otherwise(F.greatest(F.ceil(2 * F.col("m") / CELL_MEMBERS), F.ceil(2 * F.col("s") / CELL_SHINGLES)))
    own = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("g")).cast("int").alias("own")
    return members.join(size.select("cluster", parts.cast("int").alias("g")), "cluster").select("node", "cluster", "n_shingles", "g", own)


def _compared(docs: DataFrame, dealt: DataFrame, percent: int, square: bool) -> DataFrame:
    """Stars (u, v) of confirmed links inside each block, and with ``square`` inside each pair of blocks."""
    sets = full_sets(docs, dealt.select("node", "cluster", "g", "own"))
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)) if square else F.col("own"))
    cells = cells.select("cluster", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "node", "shingles")
    at_work = cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return cut(at_work.mapInArrow(_links(percent), "u long, v long"), "stars")


def _with_component(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """``nodes`` with the component of each by ``stars``, itself if it has none."""
    comp = connected_components(stars).dropDuplicates(["node"])
    return cut(nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")), "contracted")


def _large_clusters(docs: DataFrame, rows: DataFrame, large: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """``stars`` with what is missing between the blocks of ``large`` clusters. ``rows``: node and band key."""
    nodes = large.select("node", "cluster", "n_shingles")
    left, before = nodes, nodes.count()
    for salt in range(1, ROUNDS + 1):
        merged = _with_component(nodes, stars)
        left = merged.where("node = component").select("node", "cluster", "n_shingles")
        n = left.count()
        if n > before * (1 - SHRINK):
            break
        before = n
        stars = stars.unionByName(_compared(docs, _blocks(left, salt), percent, False))
    merged = _with_component(nodes, stars)
    # Bands that hold several components, their nodes, and the clusters that these form.
    places = cut(rows.join(merged.select("node", "component", "n_shingles"), "node"), "places")
    mixed = places.groupBy("b").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("first")).where("lo <> hi").select("b", "first")
    still = cut(places.join(mixed, "b"), "mixed")
    clusters = connected_components(still.select(F.col("node").alias("u"), F.col("first").alias("v"))).dropDuplicates(["node"])
    members = clusters.join(still.select("node", "n_shingles").distinct(), "node").withColumnRenamed("component", "cluster")
    return stars.unionByName(_compared(docs, cut(_blocks(members), "blocks"), percent, True))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    drawn = cut(sketch_documents(docs), "sketch")
    real = drawn.where("doc_id is not null and n_shingles > 0")
    reps = cut(real.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "sets1")
    rows = reps.select("node", F.explode("bands").alias("b"))
    first = rows.groupBy("b").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last").drop("last")
    clusters = connected_components(rows.join(first, "b").select(F.col("node").alias("u"), "v")).dropDuplicates(["node"])
    members = clusters.withColumnRenamed("component", "cluster").join(reps.select("node", "n_shingles"), "node")
    dealt = cut(_blocks(members), "blocks")
    stars = _compared(docs, dealt, percent, False)
    large = dealt.where("g > 1")
    if not large.isEmpty():
        stars = _large_clusters(docs, rows, large, stars, percent)
    comp = cut(connected_components(stars), "comp")
    # A node is the smallest of its copies, so a component's smallest node is its smallest doc_id.
    named = reps.join(comp, "node", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "node").alias("component"))
    plain = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    out = drawn.drop("bands").join(named, ["fp1", "fp2", "n_shingles"], "left").select("doc_id", "n_shingles", plain.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is its group's smallest doc_id."""
    gone = cut(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone.withColumnRenamed("doc_id", "__dw_gone"), docs["doc_id"] == F.col("__dw_gone"), "left_anti")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\t-\r ]+') as w from documents
), sh as (
  select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from sh group by 1
), sets as (select doc_id, hash(list(s order by s)) as key, count(*) as n from sh group by 1
), reps as (select min(doc_id) as node, key, n from sets group by key, n
), own as (select node, sh.s from reps join sh on node = doc_id
), links as (
  select x.node as a, y.node as b from own x join own y on x.s = y.s and x.node < y.node join n p on p.doc_id = x.node join n q on q.doc_id = y.node
  group by x.node, y.node, p.n, q.n having 100 * count(*) >= 85 * (p.n + q.n - count(*))
), edges as (select a, b from links union select b, a from links
), r(node, root) as (select node, node from reps union select edges.b, r.root from r join edges on edges.a = r.node and r.root < edges.b
), reach as (select node, min(root) as root from r group by 1
)
select w.doc_id, coalesce(sets.n, 0)::bigint as n_shingles, coalesce(root, w.doc_id) as component_id, coalesce(root, w.doc_id) = w.doc_id as kept
from w left join sets using (doc_id) left join reps on reps.key = sets.key and reps.n = sets.n left join reach using (node)
"""
