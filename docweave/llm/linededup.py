"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is the sequence of its lines that have a word; a line's id is a 128-bit hash of its bytes
without outer white space. A suffix begins at a place (doc_id, text hash, line). Round by round the
suffixes are sorted by their first 1, 2, 4, ... lines: the key is the pair of ranks of their two halves,
and their order is one of ranges, dealt out to tasks by key and place. Suffixes with equal keys lie side
by side and share a rank: they are an interval of the suffix array whose longest common prefix
is at least that many lines, and its first place is the earliest. Suffixes alone in their interval leave
(their order among each other decides nothing), and rounds go on until none is left. For ``min_lines``
that aren't a power of two, one round joins overlapping halves.

Of each suffix the longest interval in which an earlier place stands counts. Where such intervals
overlap or touch on one diagonal (the same distance to the same source) they are one repeated run: it can't
be made longer there. All lines of repeated runs of ``min_lines`` or more are deleted, so the earliest copy stays.
With ``long_words``, a repeated run of one line counts too if the line has so many words. A place that
is first in all its intervals never goes.

No interval of equal keys meets in one task: ranges are of key and place, so a line that stands in
every document is spread over as many tasks as its rows need. Only intervals at the edge of a range can
go on in the next, and their first places, two a task at most, are what passes the driver.

Defined results: a null text has no lines; lines without a word are never deleted and don't part a run;
null doc_ids come last; rows of one doc_id and one text are one document; a run may repeat inside one
document; an empty table gives no rows. Extra columns are kept by ``dedup_lines`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.textblock import Block, blocks, lut_is_space, span_hash
from docweave.runtime import cut, ship_package

MIN_LINES = 2
LONG_WORDS = 13  # words from which a line is a run by itself
RANGE_ROWS, MAX_RANGES = 60_000, 10_000  # suffixes a range, about, and how many ranges at most
LAST = 2**63 - 1
SPACE = lut_is_space()


def _doc_key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _full_lines(b: Block):
    """Trimmed spans and rows of lines that have a word, and whether each line has one."""
    starts, ends, row = b.line_spans()
    solid = np.flatnonzero(~SPACE[b.data])
    a, z = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = z > a
    return solid[a[full]] if full.any() else np.zeros(0, np.int64), solid[z[full] - 1] + 1 if full.any() else np.zeros(0, np.int64), row[full], full


def line_ids(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """doc, hash, line (0.. among lines with a word), whether it is long, and the id (a, b) of every line."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                b = Block(part.column(1))
                s, e, row, _ = _full_lines(b)
                n = np.bincount(row, minlength=b.n)
                line = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                long = np.zeros(len(row), bool)
                if long_words is not None:
                    word = b.spans(SPACE)[0]
                    long = np.searchsorted(word, e) - np.searchsorted(word, s) >= long_words
                cols = [np.asarray(part.column(0))[row], np.asarray(part.column(2))[row], line.astype(np.int32), long, span_hash(b.data, s, e, 1).view(np.int64), span_hash(b.data[::-1], len(b.data) - e[::-1], len(b.data) - s[::-1], 2)[::-1].copy().view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc", "hash", "line", "long", "a", "b"])

    rows = docs.select(_doc_key().alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    return rows.mapInArrow(run, "doc long, hash long, line int, long boolean, a long, b long")


# ---- intervals of the suffix array -----------------------------------------------------------------

PLACE = ["doc", "hash", "line"]
_INTERVAL = "doc long, hash long, line int, long boolean, rank long, source_doc long, source_hash long, source_line int, edge boolean, a long, b long"
_COLUMNS = [x.split()[0] for x in _INTERVAL.split(", ")]


def _mark(batches):
    """Ranks and first places of the intervals in one sorted range; what is alone inside it goes.

    The range's first and last interval may go on beyond it: their rows keep their key and are ``edge``.
    """
    from pyspark import TaskContext

    top = TaskContext.get().partitionId() << 40
    held, seen, inner = None, 0, False

    def out(x, begin, at, edge):
        """Rows of the intervals that begin at ``begin``; ``at``: rows before these."""
        n = np.diff(np.append(begin, len(x["doc"])))
        keep = np.repeat((n > 1) | edge, n)
        first = np.repeat(begin, n)[keep]
        cols = [x[c][keep] for c in (*PLACE, "long")] + [top + at + first] + [x[c][first] for c in PLACE] + [np.full(len(first), edge)] + [x[c][keep] * edge for c in "ab"]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _COLUMNS)

    for batch in batches:
        x = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*PLACE, "long", "a", "b")}
        if held is not None:
            x = {c: np.concatenate([held[c], x[c]]) for c in x}
        n = len(x["doc"])
        if not n:
            continue
        new_key = np.ones(n, bool)
        new_key[1:] = (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])
        again = np.zeros(n, bool)  # a document that the table has twice
        again[1:] = ~new_key[1:] & (x["doc"][1:] == x["doc"][:-1]) & (x["hash"][1:] == x["hash"][:-1]) & (x["line"][1:] == x["line"][:-1])
        if again.any():
            x = {c: v[~again] for c, v in x.items()}
            new_key = new_key[~again]
        begin = np.flatnonzero(new_key)
        last = int(begin[-1])
        if last:
            if not inner:  # the first interval may have begun in the range before
                z = int(begin[1])
                yield out({c: v[:z] for c, v in x.items()}, begin[:1], seen, True)
                inner = True
                if last > z:
                    yield out({c: v[z:last] for c, v in x.items()}, begin[1:-1] - z, seen + z, False)
            else:
                yield out({c: v[:last] for c, v in x.items()}, begin[:-1], seen, False)
        held, seen = {c: v[last:] for c, v in x.items()}, seen + last
    if held is not None and len(held["doc"]):
        yield out(held, np.zeros(1, np.int64), seen, True)


def intervals(keyed: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Suffixes that share their key (a, b) with others: place, long, rank, first place; and how many there are.

    ``keyed``: doc, hash, line, long, a, b, about ``rows`` rows. Ranks ascend with the key.
    """
    spark, ranges = keyed.sparkSession, min(MAX_RANGES, 1 + rows // RANGE_ROWS)
    order = ["a", "b", *PLACE]
    marked = cut(keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_mark, _INTERVAL), "intervals")
    first = F.struct("rank", "source_doc", "source_hash", "source_line")
    # Two edges a range at most, and one row for all that lies inside.
    found = marked.groupBy("edge", "a", "b").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).collect()
    edges = [(r["a"], r["b"], *r["first"]) for r in found if r["edge"] and r["n"] > 1]
    names = F.broadcast(spark.createDataFrame(edges, "a long, b long, rank long, source_doc long, source_hash long, source_line int"))
    columns = [*PLACE, "long", "rank", "source_doc", "source_hash", "source_line"]
    across = marked.where("edge").select(*PLACE, "long", "a", "b").join(names, ["a", "b"]).select(*columns)
    return marked.where("not edge").select(*columns).unionByName(across), sum(r["n"] for r in found if not r["edge"] or r["n"] > 1)


def suffix_intervals(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> list[tuple[int, DataFrame]]:
    """Per round its width in lines and the intervals of the suffixes that repeat at that width."""
    lines = cut(line_ids(docs, long_words), "lines")
    rounds, width = [], 1
    rows, n = intervals(lines, lines.count())
    while n:
        rounds.append((width, rows))
        step = min(width, min_lines - width) if width < min_lines else width
        # The rank of the suffix ``step`` lines on; without one, this suffix is alone at the new width.
        on = Window.partitionBy("doc", "hash").orderBy("line").rangeBetween(step, step)
        paired = rows.select(*PLACE, "long", F.col("rank").alias("a"), F.max("rank").over(on).alias("b")).where("b is not null")
        rows, n = intervals(cut(paired, "pairs"), n)
        width += step
    return rounds


def _later(rows: DataFrame) -> DataFrame:
    return rows.where("doc <> source_doc or hash <> source_hash or line <> source_line")


_RUN = "doc long, hash long, line int, n_lines int, source_doc long, source_hash long, source_line int"


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Repeated runs, none longer on its diagonal: doc, hash, line, n_lines, and the place of the copy that stays."""
    return _runs(docs.sparkSession, suffix_intervals(docs, min_lines), min_lines)


def _runs(spark: SparkSession, rounds: list[tuple[int, DataFrame]], min_lines: int) -> DataFrame:
    """A document's rows are dealt out once, by document."""
    long_enough = [_later(rows).withColumn("width", F.lit(width)) for width, rows in rounds if width >= min_lines]
    if not long_enough:
        return spark.createDataFrame([], _RUN)
    found = reduce(DataFrame.unionByName, long_enough)
    found = found.select(*PLACE, F.struct("width", "source_doc", "source_hash", "source_line").alias("best")).repartition("doc", "hash")
    best = found.groupBy(*PLACE).agg(F.max("best").alias("best")).select(*PLACE, "best.*")
    diagonal = ["doc", "hash", "source_doc", "source_hash", "shift"]
    w = Window.partitionBy(*diagonal).orderBy("line")
    ends = F.max(F.col("line") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("shift", F.col("source_line") - F.col("line")).withColumn("new", F.coalesce((F.col("line") > ends).cast("int"), F.lit(1)))
    best = best.withColumn("run", F.sum("new").over(w))
    runs = best.groupBy(*diagonal, "run").agg(F.min("line").alias("line"), F.max(F.col("line") + F.col("width")).alias("end"))
    return runs.select(*PLACE, (F.col("end") - F.col("line")).alias("n_lines"), "source_doc", "source_hash", (F.col("line") + F.col("shift")).alias("source_line"))


def _with_lines(docs: DataFrame, min_lines: int, long_words: int | None) -> DataFrame:
    """``docs`` with its repeated runs, and long lines as runs of one."""
    rounds = suffix_intervals(docs, min_lines, long_words)
    gone = _runs(docs.sparkSession, rounds, min_lines).select(*PLACE, "n_lines")
    if long_words is not None and rounds:
        gone = gone.unionByName(_later(rounds[0][1]).where("long").select(*PLACE, F.lit(1).alias("n_lines")))
    gone = gone.groupBy(F.col("doc").alias("__dw_doc"), F.col("hash").alias("__dw_hash")).agg(F.collect_list(F.struct("line", "n_lines")).alias("__dw_runs"))
    return docs.join(gone, (_doc_key() == F.col("__dw_doc")) & (F.xxhash64("text") == F.col("__dw_hash")), "left").drop("__dw_doc", "__dw_hash")


def delete_runs(text: str, runs: list[dict], full: list[bool]) -> tuple[str, int, int]:
    """The text without the lines of ``runs``; lines left and deleted, of those with a word."""
    gone = set()
    for r in runs:
        gone.update(range(r["line"], r["line"] + r["n_lines"]))
    kept, n, removed = [], 0, 0
    for line, has in zip(text.split("\n"), full):
        if has:
            n += 1
            if n - 1 in gone:
                removed += 1
                continue
        kept.append(line)
    return "\n".join(kept), n - removed, removed


def _solve(part: pa.RecordBatch, text: int, runs: int):
    b = Block(part.column(text))
    _, _, _, full = _full_lines(b)
    _, _, row = b.line_spans()
    n = np.bincount(row[full], minlength=b.n)
    first = np.searchsorted(row, np.arange(b.n + 1))
    out = []
    for i, at in enumerate(part.column(runs).to_pylist()):
        out.append(delete_runs(part.column(text)[i].as_py(), at, full[first[i] : first[i + 1]].tolist()) if at else (None, int(n[i]), 0))
    return out


def line_report(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 of the text that stays."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                got = _solve(part, 1, 2)
                sha = [hashlib.sha256((t if t is not None else (part.column(1)[i].as_py() or "")).encode()).hexdigest() for i, (t, _, _) in enumerate(got)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k + r for _, k, r in got], pa.int64()), pa.array([r for _, _, r in got], pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    rows = _with_lines(docs.select("doc_id", "text"), min_lines, long_words).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__dw_runs")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` with later copies of line runs and of long lines deleted from ``text``, and ``n_chars`` counted anew there.

    A document of which no line with a word is left goes.
    """
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                at = part.schema.get_field_index
                got = _solve(part, at("text"), at("__dw_runs"))
                cols = {c: part.column(at(c)) for c in columns}
                changed = [t for t, _, _ in got]
                if any(t is not None for t in changed):
                    cols["text"] = pa.array([old if t is None else t for old, t in zip(cols["text"].to_pylist(), changed)], cols["text"].type)
                    if "n_chars" in cols:
                        cols["n_chars"] = pa.array([old if t is None else len(t) for old, t in zip(cols["n_chars"].to_pylist(), changed)], cols["n_chars"].type)
                keep = pa.array([not (r and not k) for _, k, r in got])
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(keep)

    return _with_lines(docs, min_lines, long_words).mapInArrow(run, docs.schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), long_words=LONG_WORDS)


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as nth
  from documents where text is not null
), full_lines as (
  select *, row_number() over (partition by doc_id order by nth) - 1 as pos,
         regexp_replace(line, '^[\t-\r ]+|[\t-\r ]+$', '', 'g') as key
  from lines where regexp_matches(line, '[^\t-\r ]')
), pairs as (
  select doc_id, pos, key, lead(key) over (partition by doc_id order by pos) as next from full_lines
), earliest as (
  select key, next, min(row(doc_id, pos)) as first from pairs where next is not null group by key, next
), later as (
  select p.doc_id, p.pos from pairs p join earliest e on p.key = e.key and p.next = e.next where row(p.doc_id, p.pos) <> e.first
), alone as (
  select key, min(row(doc_id, pos)) as first from full_lines where len(regexp_extract_all(key, '[^\t-\r ]+')) >= 13 group by key
), gone as (
  select doc_id, pos from later union select doc_id, pos + 1 from later
  union select l.doc_id, l.pos from full_lines l join alone a on l.key = a.key where row(l.doc_id, l.pos) <> a.first
), kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.nth) as text, count(*) as n
  from lines l left join full_lines f on l.doc_id = f.doc_id and l.nth = f.nth left join gone g on f.doc_id = g.doc_id and f.pos = g.pos
  where g.doc_id is null group by l.doc_id
)
select d.doc_id, coalesce(f.n, 0)::bigint as n_lines, coalesce(g.n, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join (select doc_id, count(*) as n from full_lines group by doc_id) f on d.doc_id = f.doc_id
left join (select doc_id, count(*) as n from gone group by doc_id) g on d.doc_id = g.doc_id left join kept k on d.doc_id = k.doc_id
"""
