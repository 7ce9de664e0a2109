"""Running totals over a total order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpoint, fresh


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], *by: str) -> DataFrame:
    """`df` plus an inclusive running sum for each of `totals`, in `order`, within each group of `by`.

    Rows are dealt to ranges of the order, whose limits Spark samples from the rows, so neither sparse ids nor
    skewed values fill one range; only rows equal in `by` and `order` have to share one. The dealt rows are
    checkpointed, since their ranges must not change between the two reads: one sums the ranges, of which there
    are as many as shuffle partitions, and one sums inside them.
    """
    bucket, *held = fresh(df, "bucket_", *(f"value_{k}" for k in totals))
    keys = fresh(df, *(f"order_{k}" for k in range(len(order))))
    sums_of = fresh(df, *(f"sum_{k}" for k in totals))
    of, *of_by = fresh(df, "of_bucket", *(f"of_{c}" for c in by))
    d = df.withColumns(dict(zip(keys, order)) | dict(zip(held, totals.values())))
    d = checkpoint(d.repartitionByRange(*by, *keys).withColumn(bucket, F.spark_partition_id()))
    sums = d.groupBy(bucket, *by).agg(*(F.sum(v).alias(s) for v, s in zip(held, sums_of)))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(bucket).alias(of), *(F.col(c).alias(x) for c, x in zip(by, of_by)), *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in sums_of))
    same = d[bucket] == sums[of]
    for c, x in zip(by, of_by):
        same = same & d[c].eqNullSafe(sums[x])
    inside = Window.partitionBy(bucket, *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(sums, same).select(*df.columns, *((F.col(s) + F.sum(v).over(inside)).alias(k) for k, v, s in zip(totals, held, sums_of)))


def dense_index(df: DataFrame, order_col: str) -> DataFrame:
    """`df` plus `pos`: 0, 1, 2, ... in the order of a column."""
    d = running_totals(df, [F.col(order_col)], {"pos": F.lit(1)})
    return d.withColumn("pos", F.col("pos") - 1)
