"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import scratch_path

# Fixed value: the white space of the word rule.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below the shared checkpoint directory and
    read it back: cuts lineage, survives lost executors, and is computed once
    however often the result is read."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside a single expression: the lambda variable is
    evaluated one time, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without keeping the array (null text: 0)."""
    return F.size(words(text)).cast("long")


def symbol_count(text: Column) -> Column:
    """Number of characters of ``#*$%&|<>`` (null text: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]")).cast("long")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that an operator's own columns
    cannot clash with the caller's."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name)


def running_offsets(counts: DataFrame, by: list[str], order: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """Exclusive prefix sums ``out`` of ``value`` along the integer ``order``
    within ``by`` (which may be empty), in two levels, so that no task holds
    more than ``block`` rows plus one row for each block."""
    from pyspark.sql.window import Window

    c = counts.withColumn("_blk", F.floor(F.col(order) / block).cast("long"))
    tops = c.groupBy(*by, "_blk").agg(F.sum(value).alias("_bs"))
    wt = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        *[F.col(k).alias(f"_t_{k}") for k in by], F.col("_blk").alias("_tb"), F.coalesce(F.sum("_bs").over(wt), F.lit(0)).alias("_before")
    )
    on = F.col("_blk") == F.col("_tb")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    j = c.join(tops, on).select(*c.columns, "_before")
    wi = Window.partitionBy(*by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return j.withColumn(out, (F.col("_before") + F.coalesce(F.sum(value).over(wi), F.lit(0))).cast("long")).drop("_blk", "_before")
