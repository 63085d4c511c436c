"""Index statistics: postings, TF-IDF, BM25 and the term co-occurrence graph as long tables.

All take chunks with ``pos`` (a unique long) and ``text``. Counts are partial and final hash
aggregates; statistics of one row are cross-joined as broadcasts of exactly one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import max_year, tokens, unique_terms

NEIGHBORS = 24


def term_counts(chunks: DataFrame) -> DataFrame:
    """pos, term, tf."""
    return chunks.select("pos", F.explode(tokens("text")).alias("term")).groupBy("pos", "term").agg(F.count(F.lit(1)).alias("tf"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """pos, len: tokens, of all chunks, also those without any."""
    return chunks.select("pos", F.size(tokens("text")).cast("long").alias("len"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(chunks: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return chunk_lengths(chunks).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))


def tfidf_vocabulary(df: DataFrame, size: DataFrame, min_df: int = 1, max_df: float = 0.95) -> DataFrame:
    """term, df, idf of terms within the limits; if none is, of all."""
    d = df.crossJoin(F.broadcast(size.select("n")))
    inside = (F.col("df") >= min_df) & (F.col("df") <= F.greatest((F.col("n") * max_df).cast("long"), F.lit(1)))
    some = d.agg(F.coalesce(F.max(inside.cast("int")), F.lit(0)).alias("some"))
    return d.crossJoin(F.broadcast(some)).where(inside | (F.col("some") == 0)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def with_term_ids(vocabulary: DataFrame) -> DataFrame:
    """term_id by alphabet. Ids come from range partitions, so no partition holds the whole vocabulary."""
    from docweave.operators.order import global_row_number

    return global_row_number(vocabulary, ["term"], "term_id", start=0)


def tfidf_weights(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """pos, term, weight: L2-normalised per chunk. A chunk's length cancels and isn't needed."""
    w = counts.join(vocabulary, "term").select("pos", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("pos")))
    return w.select("pos", "term", (F.col("w") / norm).alias("weight"))


def bm25_idf(df: DataFrame, size: DataFrame) -> DataFrame:
    n = F.col("n")
    return df.crossJoin(F.broadcast(size.select("n"))).select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def bm25_postings(counts: DataFrame, lengths: DataFrame, df: DataFrame, size: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """pos, term, impact: what a query term adds to the chunk's score. Search is then one join and sum."""
    p = counts.join(lengths, "pos").join(bm25_idf(df, size).select("term", "idf"), "term").crossJoin(F.broadcast(size.select("avgdl")))
    tf, dl = F.col("tf"), F.col("len") / F.greatest("avgdl", F.lit(1e-9))
    return p.select("pos", "term", (F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl))).alias("impact"))


def _graph_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("pos", unique_terms("text").alias("terms")).where(F.size("terms") >= 2)


def graph_df(chunks: DataFrame) -> DataFrame:
    """term, df and n over chunks of two terms or more."""
    g = _graph_chunks(chunks)
    df = g.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(g.agg(F.count(F.lit(1)).alias("n"))))


def cooccurrence(chunks: DataFrame) -> DataFrame:
    """a, b, c and the first place of b beside a, for both orders of each pair.

    Pairs are made inside a chunk, in one narrow step, once per unordered pair; chunks are bounded by
    their window size. The mirror comes after aggregation.
    """
    pairs = F.flatten(F.transform("terms", lambda a, i: F.transform(F.slice("terms", i + 2, F.size("terms")), lambda b, j: F.struct(a.alias("a"), b.alias("b"), i.alias("i"), (i + j + 1).alias("j")))))
    p = _graph_chunks(chunks).select("pos", F.explode(pairs).alias("p"))
    swap = F.col("p.a") > F.col("p.b")
    at = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y)).cast("long")
    one = p.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b"), "pos", F.shiftleft(at("p.j", "p.i"), 32).bitwiseOR(at("p.i", "p.j")).alias("at"))
    # Numbers only, so that rows are summed by hash; a least struct would sort them all. A chunk has a pair once, so places don't tie.
    c = one.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("pos"), F.min_by("at", "pos").alias("at"))
    seen = lambda x: F.struct("pos", x.cast("int").alias("at"))
    c = c.select("a", "b", "c", seen(F.shiftright("at", 32)).alias("seen_a"), seen(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).alias("seen_b"))
    both = F.explode(F.array(F.struct("a", "b", F.col("seen_b").alias("seen")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("seen_a").alias("seen"))))
    return c.select("c", both.alias("e")).select("e.a", "e.b", "c", "e.seen")


def neighbors(pairs: DataFrame, gdf: DataFrame, keep: int = NEIGHBORS) -> DataFrame:
    """a, b, weight, rank, df_b: each term's ``keep`` best neighbours; ties in order of first sight.

    The rank filter is lowered to a group limit, so each task sends on ``keep`` rows a term at most.
    """
    scored = pairs.join(gdf.select(F.col("term").alias("b"), F.col("df").alias("df_b"), "n"), "b")
    scored = scored.withColumn("weight", F.col("c") * (F.log((F.col("n") + 1) / (F.col("df_b") + 1)) + 1))
    w = Window.partitionBy("a").orderBy(F.desc(F.round("weight", 9)), "seen", "b")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("a", "b", "weight", "rank", "df_b")


def latest_year(chunks: DataFrame) -> DataFrame:
    """One row: the greatest 20dd in period, metric and the first 400 characters of any chunk."""
    blob = F.concat_ws(" ", "period", "metric", F.substring("text", 1, 400))
    return chunks.agg(F.max(max_year(blob)).cast("string").alias("latest_year"))
