"""An inbox folder as a stream: new text files become chunks in an index folder, batch by batch.

Each micro-batch writes under its own id, so a batch that runs again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.functions.sentences import windows
from docweave.runtime import ship_package


def inbox(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """source, text, modified of files as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").rlike(r"\.(txt|md)$")).select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def stream_chunks(docs: DataFrame, out: str, checkpoint: str, size: int = 800, overlap: int = 120) -> StreamingQuery:
    """Write (source, index, text, modified) of each micro-batch to ``out``/batch=<id>."""
    ship_package(docs.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        cut = batch.select("source", "modified", F.posexplode(windows(size, overlap)("text")).alias("index", "chunk"))
        cut.select("source", "index", F.col("chunk").alias("text"), "modified").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Of every source the chunks of its last version."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("source").agg(F.max(F.struct("modified", "batch")).alias("last"))
    return rows.join(last, "source").where(F.struct("modified", "batch") == F.col("last")).drop("last", "batch")
