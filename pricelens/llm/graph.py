"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import materialize


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, root), root the smallest node of the
    component, for every node that has an edge to another node.

    Alternates the large-star and small-star steps until the edge set no
    longer changes (it is then a set of stars).  Each round is written to the
    shared folder, so lineage stays flat; minima are combined before the
    shuffle, and no neighbourhood is ever gathered into one row.  Nulls and
    loops are ignored; repeated edges do no harm; an empty input gives an
    empty result."""
    pair = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(pair.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges")
    seen = _signature(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        step = small.select("a", F.col("m").alias("b")).unionAll(small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = materialize(step.distinct(), "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
