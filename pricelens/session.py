"""Session helpers: building a session for tests/bench, scratch folders and
size-checked broadcasts.

Nothing here changes how a cluster session is configured: callers on a real
cluster pass their own session and we only *read* its settings.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side we hint as broadcast after an explicit check of rows and bytes.  Above
# it the join is left to the planner (sort-merge, or AQE's runtime broadcast).
BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 64 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pricelens") -> SparkSession:
    """Session for tests and the local benchmark.  Sets a checkpoint folder only
    when the environment does not already name one."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session
    (``spark.checkpoint.dir``).  Only a local session without one (tests) gets
    a machine-local folder; on a cluster that is an error."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("PRICELENS_CHECKPOINT_DIR")
    if not conf:
        master = sc.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "/tmp/pricelens-checkpoints"
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder below the shared checkpoint directory (never a
    machine-local temp folder): files written here are visible to every
    executor and survive executor loss."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/pricelens-{name}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (files in the shared checkpoint folder) to cut
    lineage in iterative jobs."""
    ensure_checkpoint_dir(df.sparkSession)
    # an eager reliable checkpoint runs the plan once to count and once more
    # to write the files; keeping it cached in between avoids the second run
    df = df.persist()
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only after proving that the side has at most ``max_rows`` rows
    and ``max_bytes`` bytes (as text, which numbers need more of than in memory);
    otherwise return it untouched so the planner uses a shuffle join."""
    head = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    n, size = head.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """An aggregate that is joined back to its input: checkpointed, so that its
    plan runs once, then hinted as ``broadcast_checked`` does.  The input is
    then not shuffled on a few hot keys."""
    return broadcast_checked(checkpoint(df), max_rows)
