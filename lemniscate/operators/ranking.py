"""Consecutive numbers over a whole table, counted part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemniscate.session import stored


def numbered(rows: DataFrame, order: list[str], per: list[str] | None = None, name: str = "n") -> DataFrame:
    """``rows`` with their numbers from 0 in ``order``, counted anew for each ``per`` (which must not be null).

    The table is dealt into ranges of the order and written; a row's number is
    its rank in its range after the rows of the ranges before, so no task
    ranks more than a range, and only counts by range are added up.
    """
    per = per or []
    dealt = stored(rows.repartitionByRange(*per, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    # At most groups x ranges rows.
    earlier = Window.partitionBy(*per).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*per, "_range").agg(F.count(F.lit(1)).alias("_count"))
    before = counts.select(*per, "_range", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*per, "_range").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(before), [*per, "_range"]).select(*rows.columns, (F.col("_before") + F.col("_within")).alias(name))
