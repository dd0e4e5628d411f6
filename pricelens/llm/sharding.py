"""Two-pass external shuffle into shards.

Pass 1 scatters every row into one of K memory-sized buckets by a seeded hash of
its place in the input (so repeated rows spread as evenly as any), through one
exchange that sends each bucket to a task of its own.  Pass 2 holds one bucket
at a time, puts it in a fixed order and shuffles it by Spark's own Fisher-Yates
``shuffle``, and writes it.  The buckets one after another are then a uniformly
shuffled order of all rows; shard s is the s-th of nearly equal runs of that
order (law ``rows``: the counts of any two shards differ by at most one).

Only DataFrame operations are used.  Rows are numbered in the order of their
hashes within an input partition, so a retried task numbers them alike even if a
shuffle handed them over in another order; it sees the same bucket and the same
seed, hence writes the same rows.

Defined results: a null text counts as no bytes (size 1); repeated rows each
get a place of their own; an empty table gives no rows; shards beyond the
number of rows stay empty; the caller's columns travel in one struct."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import materialize, packed, running_offsets

BUCKET_BYTES = 32 << 20  # bytes that one task holds at a time
BROADCAST_BUCKETS = 500_000  # up to so many bucket offsets (12 bytes each) go to every task; more are joined by a shuffle


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def row_size(docs: DataFrame) -> Column:
    """Bytes of a row, about: those of its texts, and 8 for every column."""
    long = [f.name for f in docs.schema if f.dataType.typeName() in ("string", "binary")]
    held = [F.coalesce(F.octet_length(docs[f"`{c}`"]), F.lit(0)) for c in long]
    return sum(held, F.lit(8 * len(docs.columns)).cast("long"))


def _unhashable(docs: DataFrame) -> list[str]:
    """Columns that hold maps or variants, which have neither hashes nor an order."""
    return [f.name for f in docs.schema if any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def _by_draw(held: Column, unhashable: list[str]) -> Column:
    """Rows of a bucket in the order of (draw, at), which no two rows share."""
    if not unhashable:
        return F.sort_array(held)
    key = lambda x: F.struct(x["draw"], x["at"])
    return F.array_sort(held, lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0))


def row_hashes(docs: DataFrame) -> list[Column]:
    """Two hashes (h1, h2) of all columns that can be hashed; equal rows are alike."""
    not_of = _unhashable(docs)
    of = [docs[f"`{c}`"] for c in docs.columns if c not in not_of]
    return [F.xxhash64(*of).alias("h1"), F.hash(*of).alias("h2")] if of else [F.lit(0).alias("h1"), F.lit(0).alias("h2")]


def external_shuffle(docs: DataFrame, text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (bucket, pos, row) written to the shared folder: ``row`` the caller's
    columns, ``pos`` the place in the shuffled bucket, from 0."""
    total = docs.agg(F.sum(row_size(docs))).first()[0] or 0
    k = max(1, math.ceil(total / bucket_bytes))
    ordered = docs.select(packed(docs), *row_hashes(docs)).sortWithinPartitions("h1", "h2")
    scattered = ordered.select(F.monotonically_increasing_id().alias("at"), "row")
    scattered = scattered.withColumn("draw", F.xxhash64(F.lit(seed), "at")).withColumn("bucket", F.pmod("draw", F.lit(k)).cast("int"))
    own = scattered.repartitionById(k, F.col("bucket"))
    held = own.groupBy("bucket").agg(_by_draw(F.collect_list(F.struct("draw", "at", "row")), _unhashable(docs)).alias("held"))
    mixed = held.sortWithinPartitions("bucket").select("bucket", F.shuffle("held", seed).alias("held"))
    return materialize(mixed.select("bucket", F.posexplode("held").alias("pos", "x")).select("bucket", "pos", "x.row"), "sharding")


def place(shuffled: DataFrame, shards: int) -> DataFrame:
    """Add shard and slot (from 0) to the rows of ``external_shuffle``."""
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("buckets")).first()
    n = total["n"] or 0
    starts = running_offsets(counts, [], "bucket", "n", "start").select("bucket", "start")
    if total["buckets"] <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    base, rest = divmod(n, shards)
    cut = rest * (base + 1)
    g = F.col("start") + F.col("pos")
    shard = F.when(g < cut, F.floor(g / (base + 1))).otherwise(rest + F.floor((g - cut) / max(base, 1)))
    slot = F.when(g < cut, g % (base + 1)).otherwise((g - cut) % max(base, 1))
    j = shuffled.join(starts, "bucket")
    return j.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("start")


def shard(docs: DataFrame, shards: int = 16, text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (shard, slot, bucket, pos, row) of the shuffled, written table."""
    return place(external_shuffle(docs, text, seed, bucket_bytes), shards)


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the rows, with ``slot``, under ``path``, one folder for each shard."""
    placed = shard(docs, shards, text, seed, bucket_bytes)
    placed.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
