"""Places in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import materialise


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with its 0-based place in the global order, as column `name`.

    Rows are dealt to ranges and written with the number of their range; only
    one count for each range meets in one task.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(before, "_range").withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_before")
