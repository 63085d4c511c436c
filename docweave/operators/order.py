"""Row numbers over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.runtime import cut


def global_row_number(df: DataFrame, keys: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with its rank by ``keys``: range partitions are numbered inside, then shifted.

    One count per partition is what the shift needs. The ranged table is written once, so that both
    reads see the same partitions.
    """
    ranged = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_shift"))
    w = Window.partitionBy("_part").orderBy(*keys)
    return ranged.join(F.broadcast(shift), "_part").withColumn(name, F.row_number().over(w) + F.col("_shift") + (start - 1)).drop("_part", "_shift")
