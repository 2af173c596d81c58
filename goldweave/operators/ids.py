"""Dense numbers over a total order, without a single task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import cut


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The columns of df with a number from 1 in the given order, whose columns identify a row.

    Rows are dealt by ranges of the order; each range numbers its own rows behind the number of rows in the ranges before.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, inside).join(F.broadcast(starts), "_range").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_range", "_start")
