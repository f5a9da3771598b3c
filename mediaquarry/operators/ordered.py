"""Places and predecessors in one global order, without a task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a global order is cut into at most.
RANGES = 64


def ranged(rows: DataFrame, key: Column, ranges: int = RANGES) -> DataFrame:
    """The rows with the number of their range of ``key``, from approximate quantiles; null keys come last."""
    shares = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx(key.cast("double"), shares).alias("range_bounds"))
    place = F.size(F.filter("range_bounds", lambda b: b < key.cast("double")))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("range_no", F.when(key.isNull(), ranges).otherwise(F.coalesce(place, F.lit(0)))).drop("range_bounds")


def numbered(rows: DataFrame, key: Column, order: list[Column], name: str) -> DataFrame:
    """The rows with their number, from 1, by ascending ``key`` and then ``order``: numbers in each range, shifted by the counts before it."""
    cut = ranged(rows, key)
    sizes = cut.groupBy("range_no").agg(F.count("*").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("range_no", before.alias("range_shift"))
    inner = F.row_number().over(Window.partitionBy("range_no").orderBy(key.asc_nulls_last(), *order))
    return cut.withColumn(name, inner).join(F.broadcast(shifts), "range_no").withColumn(name, F.col(name) + F.col("range_shift")).drop("range_no", "range_shift")


def with_previous(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows with ``before``, the struct of the columns in the row before by ``key``; null for the first."""
    cut = ranged(rows, F.col(key))
    now = F.struct(*columns)
    last = cut.groupBy("range_no").agg(F.max_by(now, F.col(key)).alias("range_last"))
    ends = last.select("range_no", F.lag("range_last").over(Window.orderBy("range_no")).alias("range_before"))
    inner = F.lag(now).over(Window.partitionBy("range_no").orderBy(key))
    return cut.withColumn("before", inner).join(F.broadcast(ends), "range_no").withColumn("before", F.coalesce("before", "range_before")).drop("range_no", "range_before")
