"""Files as DataFrames: loading documents, and converting folders to Markdown.

Bytes come from the ``binaryFile`` source, so any store that Spark reads will do; converters run where the
files are read. Paths are kept relative to the folder that was asked for.
"""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.order import global_row_number
from docweave.runtime import ship_package
from docweave.sources import convert as C

DONE, EXISTS, EMPTY = "", "já existe (use --force)", "arquivo vazio"


def _files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, rel, suffix, content of the files below ``path`` with one of the suffixes, in any case."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(f"Caminho inexistente: {path}")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    full = os.path.abspath(path) if "://" not in path else path
    root = full if "://" in path or os.path.isdir(full) else os.path.dirname(full)
    place = F.url_decode(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("+"), F.lit("%2B"))) if "://" not in path else F.col("path")
    rel = F.regexp_replace(F.replace(place, F.lit(root.rstrip("/")), F.lit("")), "^/+", "")
    return df.withColumn("suffix", suffix).where(F.col("suffix").isin(*suffixes)).withColumn("rel", rel)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_pos, source, text, ext, pages of readable files in order of path; blank ones are left out."""
    ship_package(spark)

    def read(batches):
        for b in batches:
            rows = [(rel, *C.to_text(s, raw), s) for rel, s, raw in zip(*(b.column(i).to_pylist() for i in range(3)))]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()))], ["source", "text", "pages", "ext"])

    docs = _files(spark, path, C.READABLE).select("rel", "suffix", "content").mapInArrow(read, "source string, text string, pages int, ext string")
    return global_row_number(docs.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != ""), ["source"], "doc_pos", start=0).select("doc_pos", "source", "text", "ext", "pages")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """source, target (relative, .md), markdown of every convertible file."""
    ship_package(spark)
    if "://" not in path and os.path.isfile(path) and not path.lower().endswith(C.CONVERTIBLE):
        raise ValueError(f"Extensão não suportada: {os.path.splitext(path)[1]}. Use: {', '.join(sorted(C.CONVERTIBLE))}")

    def read(batches):
        for b in batches:
            rel, suffix, raw = (b.column(i).to_pylist() for i in range(3))
            stems = [r.rsplit("/", 1)[-1][: -len(s)] for r, s in zip(rel, suffix)]
            yield pa.RecordBatch.from_arrays([pa.array(rel, pa.string()), pa.array([r[: -len(s)] + ".md" for r, s in zip(rel, suffix)], pa.string()), pa.array(list(map(C.to_markdown, stems, suffix, raw)), pa.string())], ["source", "target", "markdown"])

    return _files(spark, path, C.CONVERTIBLE).select("rel", "suffix", "content").mapInArrow(read, "source string, target string, markdown string")


def _empty_files(path: str) -> list[str]:
    """Relative names of convertible files of no bytes, which Spark's readers pass over."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    base = root if info.type != fs.FileType.File else root.rsplit("/", 1)[0]
    return [f.path[len(base.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File and f.size == 0 and f.path.lower().endswith(C.CONVERTIBLE)]


def convert_files(spark: SparkSession, path: str, dest: str, overwrite: bool = False) -> DataFrame:
    """Write Markdown below ``dest``; the log source, target, skipped, reason.

    Workers write their own files through the store's file system; nothing passes the driver. A path without
    a scheme is one of Spark's default file system, which all executors share on a cluster.
    """
    if "://" not in dest and not spark.sparkContext.master.startswith("local"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dest)
        dest = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
        if dest.startswith("file:"):
            raise ValueError("on a cluster, dest must name a folder of a file system that all executors share")
    files = markdown_files(spark, path)
    empty = _empty_files(path)
    if not empty and files.isEmpty():
        raise ValueError(f"Nenhum arquivo conversível em {path}")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(dest) if "://" in dest else (fs.LocalFileSystem(), os.path.abspath(dest))
        for b in batches:
            why = []
            for target, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                full = f"{root}/{target}"
                if not overwrite and store.get_file_info(full).type != fs.FileType.NotFound:
                    why.append(EXISTS)
                elif not text.strip():
                    why.append(EMPTY)
                else:
                    store.create_dir(full.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(full) as f:
                        f.write(text.encode())
                    why.append(DONE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([w != DONE for w in why]), pa.array(why)], ["source", "target", "skipped", "reason"])

    from docweave.runtime import cut

    ddl = "source string, target string, skipped boolean, reason string"
    blank = spark.createDataFrame([(e, os.path.splitext(e)[0] + ".md", True, EMPTY) for e in empty], ddl)
    return cut(files.mapInArrow(write, ddl).unionByName(blank), "converted")


def html_to_text(c):
    """Markdown of an HTML column."""

    def run(html: pd.Series) -> pd.Series:
        return html.map(C.html_text, na_action="ignore")

    return F.pandas_udf(run, "string")(c)
