"""Blocked pairwise computation (J6, re-aimed).

Exact silhouette, intra-cluster distances, affinity degrees, k-NN graphs and
spectral products all need pairs of entities, but nothing downstream needs the
pairs themselves.  So the pair space is cut into tiles instead of being
materialised:

* each row gets a block id ``pmod(xxhash64(entity), nb)`` (deterministic, so a
  retried task rebuilds exactly the same tiles); the rows of a block become one
  packed row (arrays of ids, features, labels), sized by bytes, not rows;
* a block ``b`` is sent to the tiles ``(b, j)`` for ``j >= b`` (left role) and
  ``(i, b)`` for ``i < b`` (right role) - an ``explode`` of packed rows and a
  ``groupBy``, no cartesian join.  With n rows of d numbers and blocks of B bytes
  that shuffles (8 n d)^2 / B bytes; ``block_rows`` asks for smaller blocks, but for at
  most ``MAX_BLOCKS`` of them, so that up to MAX_BLOCKS * B bytes the shuffle grows with the rows;
* blocks may be kept within a group (``group``): then only tiles of blocks of
  the same group exist;
* one ``applyInArrow`` task per tile reads the arrays without copying row by
  row, goes through them in pieces of ``PIECE`` rows, and emits only per-row (or
  per-cluster) partial sums, which Spark then adds up.

Every unordered pair is seen in exactly one tile.  A small input is cut into
enough blocks for all cores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_checked

#: Bytes of features in a block.
BLOCK_BYTES = 32 << 20
#: Rows compared at a time within a tile: the distances of a piece stay in a core's cache.
PIECE = 512
#: ``block_rows`` None: as many rows as BLOCK_BYTES hold.
DEFAULT_BLOCK_ROWS = None
#: Blocks that ``block_rows`` may ask for, at most.  Each row is sent to as many tiles as there are
#: blocks, so beyond this only BLOCK_BYTES, which memory needs, makes more of them.
MAX_BLOCKS = 16


class Block:
    """The packed rows of one block inside a task."""

    def __init__(self, rows: pa.StructArray):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def column(self, name: str) -> np.ndarray:
        """A scalar column, as numpy."""
        return self.rows.field(name).to_numpy(zero_copy_only=False)

    def matrix(self, name: str = "features") -> np.ndarray:
        """An array column, as (rows, d) doubles."""
        values = self.rows.field(name)
        if len(values) == 0:
            return np.zeros((0, 0))
        return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def rows_of_bytes(d: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, block_bytes // (8 * max(1, d)))


def n_blocks(vec: DataFrame, block_rows: int | None = None, features: str = "features") -> int:
    """Blocks for all rows: by size, and at least so many that the tiles occupy every core."""
    n, d = vec.agg(F.count(F.lit(1)), F.max(F.size(features))).first()
    by_size = max(1, math.ceil(n / rows_of_bytes(d or 1)))
    if block_rows is not None:
        return max(by_size, min(math.ceil(n / block_rows), MAX_BLOCKS))
    cores = vec.sparkSession.sparkContext.defaultParallelism
    return max(by_size, min(max(math.ceil(math.sqrt(2 * cores)), MAX_BLOCKS), n // 64))


def packed_blocks(vec: DataFrame, nb, entity: str = "entity", group: str | None = None) -> DataFrame:
    """One row a block: (g group or 0, b, nb, rows).  ``nb`` is a number, or a column of it by group."""
    count = F.col(nb) if isinstance(nb, str) else F.lit(nb)
    b = F.pmod(F.xxhash64(F.col(entity)), count.cast("long")).cast("int")
    cols = [c for c in vec.columns if c != nb]
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    keyed = vec.select(g.alias("g"), b.alias("b"), count.cast("int").alias("nb"), F.struct(*cols).alias("row"))
    return keyed.groupBy("g", "b", "nb").agg(F.collect_list("row").alias("rows"))


def tiles(blocks: DataFrame) -> DataFrame:
    """Packed blocks on the upper triangle of each group: adds ``ti``, ``tj`` and ``right``."""
    left = blocks.select("g", F.col("b").alias("ti"), F.explode(F.sequence(F.col("b"), F.col("nb") - 1)).alias("tj"), F.lit(False).alias("right"), "rows")
    right = blocks.where(F.col("b") > 0).select(
        "g", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("ti"), F.col("b").alias("tj"), F.lit(True).alias("right"), "rows")
    return left.unionByName(right)


def run_tiles(placed: DataFrame, keys: list[str], fn: Callable[[Block, Block, bool], pd.DataFrame], schema: str) -> DataFrame:
    """``fn(left, right, diagonal)`` once per tile of (keys, right, rows); a tile with one side
    only is a diagonal one, on which both arguments are the same block."""
    fields = vec_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        rows, right = table.column("rows").combine_chunks(), table.column("right").to_pylist()
        sides = {r: Block(rows[i : i + 1].flatten()) for i, r in enumerate(right)}
        left = sides[False]
        out = fn(left, sides.get(True, left), True not in sides)
        return pa.Table.from_pandas(out, schema=fields, preserve_index=False)

    return placed.groupBy(*keys).applyInArrow(run, schema)


def vec_schema(schema: str) -> pa.Schema:
    """Arrow schema of a DDL text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def pieces(n: int) -> Iterator[slice]:
    for at in range(0, n, PIECE):
        yield slice(at, min(n, at + PIECE))


def sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances (row norms expansion, clipped at 0)."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    d -= 2.0 * a @ b.T
    return np.maximum(d, 0.0, out=d)


def matrix(pdf: pd.DataFrame, col: str = "features") -> np.ndarray:
    if len(pdf) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[col].values])


def map_tiles(
    vec: DataFrame,
    fn: Callable[[Block, Block, bool], pd.DataFrame],
    schema: str,
    nb: int | None = None,
    block_rows: int | None = DEFAULT_BLOCK_ROWS,
    entity: str = "entity",
) -> DataFrame:
    """Run ``fn(left, right, diagonal)`` once per tile of all rows."""
    nb = nb or n_blocks(vec, block_rows)
    return run_tiles(tiles(packed_blocks(vec, nb, entity)), ["g", "ti", "tj"], fn, schema)


def _distance_pieces(a: np.ndarray, b: np.ndarray, diag: bool) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Distances of all rows of two blocks, piece by piece; a row is at 0 from itself.  The same
    numbers as ``sq_dists``, in memory that the next piece overwrites."""
    twice, na, nb = 2.0 * a, (a * a).sum(1), (b * b).sum(1)
    kept = np.empty((2, min(PIECE, len(a)) * min(PIECE, len(b))))
    for i in pieces(len(a)):
        for j in pieces(len(b)):
            shape = i.stop - i.start, j.stop - j.start
            d, dots = (x[: shape[0] * shape[1]].reshape(shape) for x in kept)
            np.add(na[i][:, None], nb[j][None, :], out=d)
            d -= np.matmul(twice[i], b[j].T, out=dots)
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            if diag and i == j:
                np.fill_diagonal(d, 0.0)
            yield i, j, d


def _zeros(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of zeros, which most pieces have none of."""
    zero = d == 0
    return np.nonzero(zero) if zero.any() else (np.empty(0, dtype=np.int64),) * 2


# ---------------------------------------------------------------- consumers
def cluster_distance_sums(vec: DataFrame, entity: str = "entity", cluster: str = "cluster", features: str = "features",
                          nb: int | None = None, block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """For every entity and every cluster: sum of Euclidean distances from
    the entity to the members of that cluster (self excluded), and their
    count.  Output (entity, cluster, other, dsum, cnt)."""
    schema = f"{entity} {vec.schema[entity].dataType.simpleString()}, {cluster} int, other int, dsum double, cnt long"

    def sums(d: np.ndarray, member: np.ndarray, which: np.ndarray) -> np.ndarray:
        return d @ (member[:, None] == which[None, :])

    def fn(L: Block, R: Block, diag: bool) -> pd.DataFrame:
        a, b, lc, rc = L.matrix(features), R.matrix(features), L.column(cluster), R.column(cluster)
        lk, rk = np.unique(lc), np.unique(rc)
        of_left, of_right = np.zeros((len(a), len(rk))), np.zeros((len(b), len(lk)))
        for i, j, d in _distance_pieces(a, b, diag):
            of_left[i] += sums(d, rc[j], rk)
            if not diag:
                of_right[j] += sums(d.T, lc[i], lk)
        out = []
        for block, own, others, total, members in ((L, lc, rk, of_left, rc), (R, rc, lk, of_right, lc))[: 1 if diag else 2]:
            for at, c in enumerate(others):
                n = (members == c).sum() - ((own == c) if diag else 0)
                out.append(pd.DataFrame({entity: block.column(entity), cluster: own, "other": c, "dsum": total[:, at], "cnt": np.broadcast_to(n, len(block))}))
        return pd.concat(out, ignore_index=True)

    v = vec.select(F.col(entity), F.col(cluster).cast("int").alias(cluster), features)
    raw = map_tiles(v, fn, schema, nb, block_rows, entity)
    return raw.groupBy(entity, cluster, "other").agg(F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt"))


def intra_pair_sums(vec: DataFrame, entity: str = "entity", cluster: str = "cluster", features: str = "features",
                    nb: int | None = None, block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Per cluster: sum and count of the non-zero distances over unordered
    same-cluster pairs.  Output (cluster, dsum, cnt).  Blocks hold rows of one
    cluster, so no tile compares rows of two; ``nb`` is the number of blocks a cluster."""
    schema = f"{cluster} int, dsum double, cnt long"

    def fn(L: Block, R: Block, diag: bool) -> pd.DataFrame:
        a, b, total, n = L.matrix(features), R.matrix(features), 0.0, 0
        for i, j, d in _distance_pieces(a, b, diag):
            if diag and i.start > j.start:
                continue  # seen from the other side
            if diag and i == j:
                d = np.triu(d, k=1)
            total += float(d.sum())
            n += int(np.count_nonzero(d))
        return pd.DataFrame({cluster: [int(L.column(cluster)[0])], "dsum": [total], "cnt": [n]})

    v = vec.select(F.col(entity), F.col(cluster).cast("int").alias(cluster), features).where(F.col(cluster).isNotNull())
    if nb is None:
        per = v.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size(features)).alias("_d"))
        by_size = F.ceil(F.col("_n") / F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest("_d", F.lit(1))))))
        asked = F.lit(1) if block_rows is None else F.least(F.ceil(F.col("_n") / F.lit(block_rows)), F.lit(MAX_BLOCKS))
        sizes = per.select(F.col(cluster).alias("_c"), F.greatest(by_size, asked).cast("int").alias("_nb"))
        v = v.join(broadcast_checked(sizes), F.col(cluster) == F.col("_c")).drop("_c")
    else:
        v = v.withColumn("_nb", F.lit(nb))
    raw = run_tiles(tiles(packed_blocks(v, "_nb", entity, cluster)), ["g", "ti", "tj"], fn, schema)
    return raw.groupBy(cluster).agg(F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt"))


def run_distance_sums(vec: DataFrame, slots: int, entity: str = "entity", slot: str = "_c", features: str = "features",
                      block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Distance sums of many labelings from one walk over the tiles.  ``slot`` is an array with one
    entry a labeling: the number (below ``slots``) of the row's cluster among the clusters of all labelings,
    -1 where it has none.  Each distance is computed once and added to the slots of all labelings
    by one matrix product.  Output (entity, slot, s: sum of distances to the members of every slot,
    z: by labeling, the members of the own cluster at distance 0, the row itself left out), one row
    a tile and row; blocks are as small as rows of ``slots`` sums need."""
    schema = f"{entity} {vec.schema[entity].dataType.simpleString()}, {slot} array<int>, s array<double>, z array<bigint>"

    def members(c: np.ndarray) -> np.ndarray:
        out = np.zeros((len(c), slots))
        for r in range(c.shape[1]):
            at = np.flatnonzero(c[:, r] >= 0)
            out[at, c[at, r]] = 1.0
        return out

    def count_zeros(z: np.ndarray, own: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        for r in range(own.shape[1]):
            same = (own[at, r] == other[to, r]) & (own[at, r] >= 0)
            z[:, r] += np.bincount(at[same], minlength=len(z))

    def fn(L: Block, R: Block, diag: bool) -> pd.DataFrame:
        a, b, lc, rc = L.matrix(features), R.matrix(features), L.matrix(slot), R.matrix(slot)
        lm, rm = members(lc), members(rc)
        of_left, of_right = np.zeros((len(a), slots)), np.zeros((len(b), slots))
        zl, zr = np.zeros(lc.shape, dtype=np.int64), np.zeros(rc.shape, dtype=np.int64)
        for i, j, d in _distance_pieces(a, b, diag):
            of_left[i] += d @ rm[j]
            if not diag:
                of_right[j] += d.T @ lm[i]
            at, to = _zeros(d)
            if diag and i == j:
                at, to = at[at != to], to[at != to]
            if len(at):
                count_zeros(zl[i], lc[i], rc[j], at, to)
                if not diag:
                    count_zeros(zr[j], rc[j], lc[i], to, at)
        sides = ((L, lc, of_left, zl), (R, rc, of_right, zr))[: 1 if diag else 2]
        return pd.concat([pd.DataFrame({entity: block.column(entity), slot: list(c), "s": list(s), "z": list(z)}) for block, c, s, z in sides], ignore_index=True)

    n, d = vec.agg(F.count(F.lit(1)), F.max(F.size(features))).first()
    wide = rows_of_bytes(max(d or 1, slots))
    nb = max(n_blocks(vec, block_rows), math.ceil(n / wide))
    return map_tiles(vec.select(entity, slot, features), fn, schema, nb=nb, entity=entity)


def weighted_distance_sums(vec: DataFrame, slots: int, entity: str = "entity", weight: str = "_w", features: str = "features",
                           zeros: bool = False, block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Distance sums of many labelings, whose rows may lie in a cluster several times or in several
    clusters, from one walk over the tiles.  ``weight`` is an array<double> with one entry a slot (a cluster of a
    labeling): how often the row counts in it.  Output (entity, s: by slot, the distances to all rows times
    their weights, z: by slot, the weights of the other rows at distance 0, kept with ``zeros`` only,
    m: 1 once a row), one row a tile and row."""
    schema = f"{entity} {vec.schema[entity].dataType.simpleString()}, s array<double>, z array<double>, m long"

    def fn(L: Block, R: Block, diag: bool) -> pd.DataFrame:
        a, b, lw, rw = L.matrix(features), R.matrix(features), L.matrix(weight), R.matrix(weight)
        of_left, of_right = np.zeros((len(a), slots)), np.zeros((len(b), slots))
        zl, zr = np.zeros((len(a), slots if zeros else 0)), np.zeros((len(b), slots if zeros else 0))
        for i, j, d in _distance_pieces(a, b, diag):
            of_left[i] += d @ rw[j]
            if not diag:
                of_right[j] += d.T @ lw[i]
            if zeros:
                at, to = _zeros(d)
                if diag and i == j:
                    at, to = at[at != to], to[at != to]
                if len(at):
                    np.add.at(zl[i], at, rw[j][to])
                    if not diag:
                        np.add.at(zr[j], to, lw[i][at])
        sides = ((L, of_left, zl), (R, of_right, zr))[: 1 if diag else 2]
        return pd.concat([pd.DataFrame({entity: block.column(entity), "s": list(s), "z": list(z), "m": int(diag)}) for block, s, z in sides], ignore_index=True)

    n, d = vec.agg(F.count(F.lit(1)), F.max(F.size(features))).first()
    nb = max(n_blocks(vec, block_rows), math.ceil(n / rows_of_bytes(max(d or 1, slots))))
    return map_tiles(vec.select(entity, weight, features), fn, schema, nb=nb, entity=entity)
