"""Scans over an ordered table in many tasks: values carried forward, running sums.

The table is dealt into ranges of its order and written.  Each range gives its
last value or its sum, ranges are scanned (there are as many rows as ranges and
groups), and what the ranges before one hand over is joined back.  No task
sorts or scans more than a range, so one file or one group may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemniscate.session import stored


def _dealt(rows: DataFrame, order: list[str], per: list[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with the values under marked names and their range's number."""
    with_values = rows.select("*", *[v.alias(f"_v_{name}") for name, v in values.items()])
    return stored(with_values.repartitionByRange(*per, *order).withColumn("_range", F.spark_partition_id()), "dealt")


def _joined(dealt: DataFrame, before: DataFrame, per: list[str]) -> DataFrame:
    same = F.col("_range") == F.col("_r")
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return dealt.join(before, same, "left")


def carried(rows: DataFrame, order: list[str], per: list[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with, under each name, the value's last non-null at or above the row in its group; ``order`` must tell rows apart."""
    dealt = _dealt(rows, order, per, values)
    own = Window.partitionBy(*per, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*[f"_p_{c}" for c in per]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    last = dealt.groupBy(*[F.col(c).alias(f"_p_{c}") for c in per], F.col("_range").alias("_r")).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_l_{n}") for n in values]
    )
    before = last.select(*[f"_p_{c}" for c in per], "_r", *[F.last(f"_l_{n}", ignorenulls=True).over(above).alias(f"_b_{n}") for n in values])
    now = [F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(own), f"_b_{n}").alias(n) for n in values]
    return _joined(dealt, before, per).select(*rows.columns, *now)


def running(rows: DataFrame, order: list[str], per: list[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with, under each name, the value's sum over the rows above it in its group."""
    dealt = _dealt(rows, order, per, values)
    own = Window.partitionBy(*per, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*[f"_p_{c}" for c in per]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*[F.col(c).alias(f"_p_{c}") for c in per], F.col("_range").alias("_r")).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = sums.select(*[f"_p_{c}" for c in per], "_r", *[F.sum(f"_s_{n}").over(above).alias(f"_b_{n}") for n in values])
    zero = F.lit(0)
    now = [(F.coalesce(F.sum(f"_v_{n}").over(own), zero) + F.coalesce(f"_b_{n}", zero)).alias(n) for n in values]
    return _joined(dealt, before, per).select(*rows.columns, *now)
