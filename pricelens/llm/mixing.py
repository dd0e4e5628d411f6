"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token target by water-filling: targets are in proportion to
the weights, no source is asked for more than ``max_epochs`` times its size, and
what a capped source cannot take is shared again among the others.  A target of
e whole epochs and a rest takes every document e times first; the rest is drawn
without replacement, with probabilities that follow the documents' quality:
every document has the exponential key -ln(u) / quality, u a seeded hash, and
the smallest keys are taken until their sizes add up to the rest.  The document on
the edge is taken in part (``taken``); ``copies`` rounds it to whole documents.

A source is never sorted in one task: all rows are dealt over ranges of (source,
key) that Spark cuts at the keys' own quantiles, about ``range_rows`` rows each, so
their number grows with the input whatever the qualities are.  Sizes are summed
per range, and only within a range are rows ordered.  A row number ends the order,
so even one row repeated a billion times spreads over many ranges.

Defined results: a null text has size 0; a null source is a source of its own,
last; a null or non-positive quality counts as the least quality; repeated rows
have equal keys and are taken one after the other; targets of an all-empty
table are 0; an empty table gives no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.functions.ranking import global_rank
from pricelens.llm.common import materialize, packed, running_offsets, symbol_count, word_count

LEAST_QUALITY = 0.05
RANGE_ROWS = 1 << 17  # rows of a key range, about


def symbol_quality(text: Column) -> Column:
    """A document weight in (0, 1]: words against words and symbols."""
    n = word_count(text).cast("double")
    return F.coalesce(F.try_divide(n, n + symbol_count(text)), F.lit(1.0))


def targets(sources: DataFrame, share: float = 1.5, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size) -> the same with weight and target.

    The level at which weights are filled is found by at most as many small
    aggregates over the source table as sources become capped in turn."""
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1).cast("int"))
    s = materialize(ranked.withColumn("weight", weight).drop("rank"), "sources")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    want = share * float(s.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        r = s.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, cap)).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if r["n"] == capped or not r["weight"]:
            break
        capped, level = r["n"], (want - float(r["cap"] or 0.0)) / float(r["weight"])
    if capped == -1 or (r["n"] != capped and not r["weight"]):
        level = math.inf
    return s.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if math.isfinite(level) else cap.cast("double"))


def _drawn(docs: DataFrame, quality: Column | None, id_col: str, text: str, source: str, seed: int) -> list[Column]:
    """id, source, size, draw (a seeded hash) and key of every document."""
    q = symbol_quality(docs[text]) if quality is None else quality
    q = F.greatest(F.coalesce(F.nanvl(q.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_QUALITY))
    draw = F.xxhash64(F.lit(seed), docs[id_col], docs[source], docs[text])
    u = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return [docs[id_col].alias("id"), docs[source].cast("string").alias("source"), word_count(docs[text]).alias("size"),
            draw.alias("draw"), (-F.log(u) / q).alias("key")]


def _named(source: Column) -> Column:
    """A source's name as a key: a null joins and partitions like any value."""
    return F.struct(source.isNull().alias("n"), F.coalesce(source, F.lit("")).alias("s"))


def mix(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source",
        share: float = 1.5, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 2.0, seed: int = 11, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each document: id, source, size, source_size, weight, target,
    taken (words, repeats counted), copies (whole documents), epochs and key."""
    drawn = materialize(docs.select(*_drawn(docs, quality, id_col, text, source, seed), F.monotonically_increasing_id().alias("uid")), "mixing")
    order = ["key", "draw", "id", "uid"]
    dealt = drawn.repartitionByRange(max(1, math.ceil(drawn.count() / range_rows)), F.col("source").asc_nulls_last(), *order)
    rows = materialize(dealt.withColumn("bucket", F.spark_partition_id()), "mixing-ranges")
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").cast("long").alias("source_size")), share, cycle, max_epochs)
    starts = running_offsets(by_bucket, ["source"], "bucket", "bucket_size", "start")
    k = _named(F.col("source"))
    info = starts.select(k.alias("k"), "bucket", "start").join(goal.withColumn("k", k).drop("source"), "k")
    j = rows.withColumn("k", k).join(info, ["k", "bucket"])
    w = Window.partitionBy("k", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(w), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    j = j.withColumn("before", before).withColumn("epochs", epochs.cast("long"))
    j = j.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    j = j.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    j = j.withColumn("copies", (F.col("epochs") + F.when((F.col("size") > 0) & (2 * part >= F.col("size")), 1).otherwise(0)).cast("int"))
    return j.select("id", "source", "size", "source_size", "weight", "target", "taken", "copies", "epochs", "key")


def mixture(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source",
            seed: int = 11, **kw) -> DataFrame:
    """The mixed documents, whole, each as often as ``mix`` takes it: same columns.
    Keys are drawn anew beside the rows, and one cut for each source (a table
    of one row a source) says which are taken, so no text is shuffled."""
    m = mix(docs, quality, id_col, text, source, seed=seed, **kw)
    cut = F.max(F.when(F.col("copies") > F.col("epochs"), F.col("key"))).alias("cut")
    cuts = materialize(m.groupBy(_named(F.col("source")).alias("k")).agg(F.max("epochs").alias("epochs"), cut), "cuts")
    drawn = docs.select(packed(docs), *_drawn(docs, quality, id_col, text, source, seed)).withColumn("k", _named(F.col("source")))
    j = drawn.join(cuts, "k")
    taken = F.col("size") > 0
    copies = F.col("epochs") + F.when(taken & (F.col("key") <= F.col("cut")), 1).otherwise(0)
    return j.select(F.explode(F.array_repeat("row", copies.cast("int"))).alias("row")).select("row.*")
