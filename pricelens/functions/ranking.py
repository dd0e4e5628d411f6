"""Distributed global ranking.

``row_number() OVER (ORDER BY ...)`` without a partition moves every row to
one task.  Here the rows are range-partitioned on the order (Spark samples
the bounds once, so a retried task sees the same bounds), numbered inside
each partition, and shifted by the row count of the partitions before it
(a table with one row per partition)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add a 1-based dense position ``name`` following ``order`` (make the
    order total, e.g. end it with a key column, for a deterministic result)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()).persist()
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    w = Window.partitionBy("_pid").orderBy(*order)
    out = s.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_rn")).cast("long")).drop("_pid", "_rn", "_off")
