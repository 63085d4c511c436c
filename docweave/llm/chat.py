"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth-first.

A turn is formatted as ``<s>role\\ntext</s>``. Control strings inside roles and texts get a backslash
after their first character (one more if they have some), so they can't be taken for marks and the
texts can be read back. Conversations that begin with equal turns share nodes. A run of nodes without
branches is a segment; nodes are sorted by their path of segments, then depth, which is a depth-first
order, and laid on one token stream. A node has its stream interval, its position ids (it goes on
where its parent ends), the interval of its tokens under the loss mask (the text of an assistant turn),
and the stream intervals of its ancestors, one a segment, which are all that its tokens may attend
to besides their own past. So a long conversation of its own has one interval a node, not one for
each turn before.

Tokens are code points, or with ``tokenizer`` the ids of that vocabulary (without loss intervals).
Everything is done by keys: a first turn that a third of all conversations share is one node after
partial aggregation, nodes are dealt out by ranges of whole paths, and the join that looks up ancestors
has one row a key on one side, so adaptive execution can split a frequent key on the other.
A conversation is the unit of work: its turns meet in one task.

Defined results: a null text or role is empty; rows of one turn number are ordered by role, then text;
null turn numbers come first; null conv_ids form one conversation; an empty table gives no nodes;
extra columns are ignored; repeated rows are repeated turns. The query adds conversation -7: turns that the data
has under that number would be in the same conversation.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.runtime import cut, ship_package

START, STOP = "<s>", "</s>"
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the interval of its text."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + STOP, len(head), len(head) + len(body)


def read_turn(formatted: str) -> tuple[str, str]:
    if not (formatted.startswith(START) and formatted.endswith(STOP)):
        raise ValueError("no formatted turn")
    head, _, body = formatted[len(START) : -len(STOP)].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(body)


_NODE = "conv_id long, depth int, node string, parent string, text string, role string, size long, before long, loss_start long, loss_end long, is_leaf boolean, ids array<int>"


def conversation_nodes(turns: DataFrame, loss_role: str = "assistant", tokenizer: str | None = None) -> DataFrame:
    """One row per conversation and turn: its node, a hash of all turns so far, and where it begins."""
    ship_package(turns.sparkSession)
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = turns.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    names = [x.split()[0] for x in _NODE.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]

    def run(batches):
        if tokenizer:
            from docweave.llm.tokens import encode_rows
        for batch in batches:
            rows, size = [], 0
            for conv, turns_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                parent, before = "", 0
                turns_ = turns_.as_py()
                for depth, t in enumerate(turns_):
                    text, a, z = format_turn(t["role"], t["text"])
                    node = hashlib.blake2b(f"{parent}\0{text}".encode(), digest_size=12).hexdigest()
                    ids = encode_rows(pa.array([text]), tokenizer)[0].astype(np.int32).tolist() if tokenizer else None
                    n = len(ids) if tokenizer else len(text)
                    masked = t["role"] == loss_role and not tokenizer
                    rows.append((conv, depth, node, parent or None, text, t["role"], n, before, a if masked else None, z if masked else None, depth + 1 == len(turns_), ids))
                    parent, before, size = node, before + n, size + len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return convs.mapInArrow(run, _NODE)


def prefix_tree(turns: DataFrame, loss_role: str = "assistant", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The emitted nodes, and conv_id with the node it ends in (``leaf``).

    Nodes: node, parent, depth, segment, segments, text, role, ids, stream_start, stream_end, position_start,
    loss_start and loss_end (in the stream), and ``ancestors``, an array of (start, end) from the first turn on.
    """
    spark = turns.sparkSession
    rows = cut(conversation_nodes(turns, loss_role, tokenizer), "chatrows")
    members = rows.where("is_leaf").select("conv_id", F.col("node").alias("leaf"))
    nodes = rows.drop("conv_id", "is_leaf").dropDuplicates(["node"])
    edges = nodes.select("node", "parent")
    forks = edges.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("parent")
    starts = edges.where("parent is null").select("node").unionByName(edges.join(forks, "parent", "left_semi").select("node")).withColumn("start", F.lit(True))
    along = Window.partitionBy("conv_id").orderBy("depth")
    paths = rows.select("conv_id", "depth", "node").join(starts, "node", "left").withColumn("segments", F.collect_list(F.when(F.col("start"), F.col("node"))).over(along))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A segment sorts before all that branch from it.
    nodes = nodes.join(paths.dropDuplicates(["node"]).select("node", "segments"), "node")
    ordered = nodes.repartitionByRange(n, "segments", "depth").sortWithinPartitions("segments", "depth")

    def lay(batches):
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            size = np.asarray(b.column(b.schema.get_field_index("size")))
            local = at + np.cumsum(size) - size
            at += int(size.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(local.astype(np.int64))], [*b.schema.names, "part", "local"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    laid = cut(ordered.mapInArrow(lay, f"{fields}, part int, local long"), "chatnodes")
    # One number per partition reaches the driver.
    sums = sorted((r["part"], r["n"]) for r in laid.groupBy("part").agg(F.sum("size").alias("n")).collect())
    base, bases = 0, []
    for part, size in sums:
        bases.append((part, base))
        base += size
    based = laid.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
    start = F.col("base") + F.col("local")
    placed = based.select(
        "node", "parent", "depth", "segments", "text", "role", "ids", start.alias("stream_start"), (start + F.col("size")).alias("stream_end"), F.col("before").alias("position_start"),
        (start + F.col("loss_start")).alias("loss_start"), (start + F.col("loss_end")).alias("loss_end"),
    )
    placed = cut(placed, "chatplaced")
    own = F.element_at("segments", -1).alias("segment")
    spans = placed.groupBy(own).agg(F.struct(F.min("stream_start").alias("start"), F.max("stream_end").alias("end")).alias("span"), F.first("segments").alias("segments"))
    spans = cut(spans, "chatsegments")
    up = spans.where(F.size("segments") > 1).select("segment", F.explode(F.slice("segments", F.lit(1), F.size("segments") - 1)).alias("up"))
    above = up.join(spans.select(F.col("segment").alias("up"), "span"), "up").groupBy("segment").agg(F.array_sort(F.collect_list("span")).alias("above"))
    whole = spans.select("segment", F.col("span.start").alias("_start")).join(above, "segment", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    inside = F.when(F.col("stream_start") > F.col("_start"), F.array(F.struct(F.col("_start").alias("start"), F.col("stream_start").alias("end")))).otherwise(none)
    out = placed.withColumn("segment", own).join(whole, "segment")
    return out.withColumn("ancestors", F.concat(F.coalesce("above", none), inside)).drop("_start", "above"), members


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id and its conversation read from the emitted stream, by way of attention intervals.

    Each distinct leaf is read once: its own tokens follow those of its segments, which are its ancestor intervals.
    """
    ship_package(nodes.sparkSession)
    leaves = members.select("leaf").distinct()
    own = nodes.select(F.col("node").alias("leaf"), F.col("depth").alias("last"), "segments")
    wanted = leaves.join(own, "leaf").select("leaf", "last", F.explode("segments").alias("segment"))
    piece = nodes.select("segment", "depth", F.struct("stream_start", "text", "loss_start", "loss_end").alias("piece"))
    whole = wanted.join(piece, (wanted["segment"] == piece["segment"]) & (F.col("depth") <= F.col("last"))).groupBy("leaf").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))

    def run(batches):
        for batch in batches:
            rows = []
            for leaf, pieces in zip(batch.column(0).to_pylist(), batch.column(1)):
                turns, loss, chars, n_loss = hashlib.sha256(), hashlib.sha256(), 0, 0
                pieces = pieces.as_py()
                for p in pieces:
                    role, text = read_turn(p["text"])
                    turns.update(f"{role}\n{text}\n".encode())
                    chars += len(p["text"])
                    if p["loss_start"] is not None:
                        under = unescape(p["text"][p["loss_start"] - p["stream_start"] : p["loss_end"] - p["stream_start"]])
                        loss.update(under.encode())
                        n_loss += len(under)
                rows.append((leaf, len(pieces), turns.hexdigest(), n_loss, loss.hexdigest(), chars))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = whole.mapInArrow(run, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(read, "leaf").drop("leaf")


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(*prefix_tree(turns))


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), f as (
  select *, '<s>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') || chr(10)
            || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') || '</s>' as formatted from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(length(formatted))::bigint as formatted_chars
from f group by conv_id
"""
