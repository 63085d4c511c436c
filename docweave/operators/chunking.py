"""Sections, prose and table blocks, table facts and windows: documents into chunks.

Lines are rows: sections and blocks are gaps and islands over them. Tables differ in their columns, so
facts are unpivoted from arrays of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import lexicon as L
from docweave.functions.sentences import windows
from docweave.functions.text import clean_cell, collapse_prose, is_period_label, is_table_line

TRIM = r"^\s+|\s+$"


def lines(docs: DataFrame, key: str = "doc_pos", text: str = "text") -> DataFrame:
    """key, line_pos, line."""
    return docs.select(key, F.posexplode(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")).alias("line_pos", "line"))


def split_sections(docs: DataFrame) -> DataFrame:
    """doc_pos, section_pos, heading, body. A heading is a line of 1-6 ``#`` and a title, fenced or not.

    A heading without body is its own body; text before the first heading has none.
    """
    rows = lines(docs)
    is_head = F.regexp_replace("line", TRIM, "").rlike(r"^#{1,6}\s+\S")
    w = Window.partitionBy("doc_pos").orderBy("line_pos")
    rows = rows.withColumn("head", is_head).withColumn("section_pos", F.sum(F.col("head").cast("long")).over(w))
    ordered = F.array_sort(F.collect_list(F.struct("line_pos", "head", "line")))
    whole = rows.groupBy("doc_pos", "section_pos").agg(ordered.alias("l"))
    heading = F.when(F.col("l")[0]["head"], F.regexp_replace(F.col("l")[0]["line"], TRIM, "")).otherwise("")
    body = F.regexp_replace(F.array_join(F.transform(F.filter("l", lambda x: ~x["head"]), lambda x: x["line"]), "\n"), TRIM, "")
    got = whole.select("doc_pos", "section_pos", heading.alias("heading"), body.alias("body"))
    filled = F.when(F.col("body") != "", F.col("body")).otherwise(F.regexp_replace(F.regexp_replace("heading", r"^[# ]+|[# ]+$", ""), TRIM, ""))
    got = got.withColumn("body", filled)
    empty = F.max((F.col("body") != "").cast("int")).over(Window.partitionBy("doc_pos")) == 0
    return got.withColumn("_empty", empty).where((F.col("body") != "") | (F.col("heading") != "") | (F.col("_empty") & (F.col("section_pos") == 0))).drop("_empty")


def prose_and_tables(sections: DataFrame) -> DataFrame:
    """doc_pos, section_pos, heading, block_pos, kind ('prose' or 'table'), block; empty blocks are left out."""
    key = ["doc_pos", "section_pos", "heading"]
    rows = sections.select(*key, F.posexplode(F.split("body", "\n")).alias("line_pos", "line")).withColumn("table", is_table_line("line"))
    w = Window.partitionBy("doc_pos", "section_pos").orderBy("line_pos")
    change = F.coalesce((F.col("table") != F.lag("table").over(w)).cast("long"), F.lit(0))
    rows = rows.withColumn("change", change).withColumn("block_pos", F.sum("change").over(w))
    whole = rows.groupBy(*key, "block_pos", "table").agg(F.array_sort(F.collect_list(F.struct("line_pos", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    block = F.when(F.col("table"), F.regexp_replace(text, TRIM, "")).otherwise(collapse_prose(text))
    return whole.select(*key, "block_pos", F.when(F.col("table"), "table").otherwise("prose").alias("kind"), block.alias("block")).where("block <> ''")


def _row(cells) -> F.Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _mini_table(head, cells) -> F.Column:
    return F.concat(_row(head), F.lit("\n"), _row(F.transform(head, lambda _: F.lit("---"))), F.lit("\n"), _row(cells))


def table_facts(tables: DataFrame) -> DataFrame:
    """Unpivot of Markdown tables: the key columns, fact_pos, text, period, metric.

    ``tables`` has ``block`` and ``heading``. If at least half of the columns behind the first are periods, a
    fact is a filled cell; otherwise it is a row, dated by a first cell that is a date.
    """
    key = [c for c in tables.columns if c not in ("block", "kind")]
    real = F.filter(F.split("block", "\n"), lambda s: is_table_line(s) & ~F.regexp_replace(s, TRIM, "").rlike(L.SEPARATOR_ROW))
    cells = F.transform(real, lambda s: F.transform(F.split(F.regexp_replace(F.regexp_replace(s, TRIM, ""), r"^\|+|\|+$", ""), r"\|"), clean_cell))
    t = tables.select(*key, cells.alias("rows")).where(F.size("rows") > 1).withColumn("head", F.col("rows")[0])
    width = F.size("head")
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width)
    data = F.transform(F.filter(F.slice("rows", 2, F.size("rows")), lambda r: F.exists(r, lambda c: c != "")), fit)
    timed = F.size(F.filter(F.slice("head", 2, width), is_period_label))
    by_period = (width > 1) & (timed >= F.greatest(F.lit(1), F.floor(width / 2)))
    t = t.select(*key, "head", by_period.alias("by_period"), F.posexplode(data).alias("row_pos", "row"))
    cell = F.transform("row", lambda c, i: F.struct(i.alias("i"), c.alias("value")))
    wanted = F.filter(cell, lambda c: (c["i"] > 0) & ~c["value"].isin("", "-", "---") & (F.col("row")[0] != ""))
    pairs = F.transform(F.filter(F.arrays_zip(F.col("head").alias("h"), F.col("row").alias("c")), lambda p: (p["h"] != "") & (p["c"] != "")), lambda p: F.concat(p["h"], F.lit(": "), p["c"]))
    one = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("value")))
    t = t.withColumn("pairs", pairs).withColumn("cell", F.explode(F.when(F.col("by_period"), wanted).otherwise(one))).where(F.col("by_period") | (F.size("pairs") > 0))
    first, period = F.col("row")[0], F.get("head", F.col("cell.i"))
    label = F.when(F.col("head")[0] == "", "indicador").otherwise(F.col("head")[0])
    said = F.when(F.col("by_period"), F.concat(first, F.lit(" em "), period, F.lit(": "), F.col("cell.value"), F.lit("."))).otherwise(F.concat(F.array_join("pairs", "; "), F.lit(".")))
    shown = F.when(F.col("by_period"), _mini_table(F.array(label, period), F.array(first, F.col("cell.value")))).otherwise(_mini_table(F.col("head"), F.col("row")))
    title = F.regexp_replace("heading", TRIM, "")
    text = F.concat(F.when(title != "", F.concat(title, F.lit("\n\n"))).otherwise(""), said, F.lit("\n\n"), shown)
    when = F.when(F.col("by_period"), period).when(first.rlike(L.DATE_CELL), first).otherwise("")
    place = F.struct("row_pos", F.col("cell.i").alias("cell_pos"))
    return t.select(*key, place.alias("fact_pos"), F.regexp_replace(text, TRIM, "").alias("text"), when.alias("period"), first.alias("metric"))


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Chunks of documents (doc_pos, source, text, ext, pages): facts of tables, windows of prose.

    chunk_id is ``file::n``; ``pos`` numbers all chunks by document and place.
    """
    from docweave.operators.order import global_row_number

    blocks = prose_and_tables(split_sections(docs))
    key = ["doc_pos", "section_pos", "heading", "block_pos"]
    tables = blocks.where("kind = 'table'")
    facts = table_facts(tables).withColumn("kind", F.lit("table_fact"))
    no_facts = tables.join(facts.select(*key[:2], "block_pos").distinct(), ["doc_pos", "section_pos", "block_pos"], "left_anti")
    prose = blocks.where("kind = 'prose'").unionByName(no_facts)
    cut = prose.select(*key, F.posexplode(windows(size, overlap)("block")).alias("n", "window"))
    head = F.when(F.col("heading") != "", F.concat("heading", F.lit("\n\n"))).otherwise("")
    cut = cut.select(*key, F.struct(F.col("n").alias("row_pos"), F.lit(-1).alias("cell_pos")).alias("fact_pos"), F.regexp_replace(F.concat(head, "window"), TRIM, "").alias("text"), F.lit("").alias("period"), F.lit("").alias("metric"), F.lit("prose").alias("kind"))
    every = facts.select(*cut.columns).unionByName(cut)
    place = Window.partitionBy("doc_pos").orderBy("section_pos", "block_pos", "fact_pos")
    named = every.withColumn("index", F.row_number().over(place) - 1).join(docs.select("doc_pos", "source", "ext", "pages"), "doc_pos")
    name = F.regexp_extract("source", r"([^/\\]*)$", 1)
    section = F.regexp_replace(F.regexp_replace("heading", r"^[# ]+|[# ]+$", ""), TRIM, "")
    out = named.select("doc_pos", F.concat(name, F.lit("::"), "index").alias("chunk_id"), "source", "text", "index", "ext", "pages", name.alias("source_name"), section.alias("section"), "kind", "period", "metric")
    return global_row_number(out, ["doc_pos", "index"], "pos", start=0)
