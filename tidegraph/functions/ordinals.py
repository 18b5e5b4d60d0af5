"""Global numbering and running sums without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.store import materialize


def _parts(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` ranged by ``order`` and written, so that a row's part is the same whenever it is read."""
    cols = [F.col(c) for c in order]
    return materialize(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranged")


SMALL = 200_000


def numbered(df: DataFrame, order: list[str], out: str, rows_at_most: int | None = None) -> DataFrame:
    """0-based rank of each row by ``order``: rank within its range plus the rows of all ranges before. Equal rows are numbered in any order.

    A table known to have at most ``SMALL`` rows (``rows_at_most``) is numbered in one task.
    """
    if rows_at_most is not None and rows_at_most <= SMALL:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    rows = _parts(df, order)
    count = rows.groupBy("_part").count()
    start = count.select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn("_nth", nth).join(F.broadcast(start), F.col("_part") == F.col("_p")).withColumn(out, (F.col("_nth") + F.col("_start")).cast("long")).drop("_part", "_p", "_nth", "_start")


def running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before each row by ``order`` (unique)."""
    rows = _parts(df, [order])
    total = rows.groupBy("_part").agg(F.sum(value).alias("n"))
    start = total.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(F.broadcast(start), F.col("_part") == F.col("_p")).withColumn(out, (F.col("_own") + F.col("_start")).cast("long")).drop("_part", "_p", "_own", "_start")
