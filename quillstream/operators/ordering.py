"""Global positions without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with the position of each row (from 1) in ``order``, which must be total.

    Rows are range-partitioned; each range is numbered on its own from the number of rows
    before it, of which there is one for each range.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, starts = 0, []
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():  # a row a partition
        starts.append((r["_range"], before))
        before += r["count"]
    starts = ranged.sparkSession.createDataFrame(starts, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_before") + place).cast("int")).drop("_range", "_before")
