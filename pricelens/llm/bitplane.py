"""Exact centroid clustering of integer vectors by bit planes (operator 12).

Every kept vector becomes ``floor(scale * x)`` in two's complement, and bit plane
``b`` of its components is packed into 64-bit words (one word for up to 64
components).  A dot product is then

    sum over planes a, b of  w(a) * w(b) * popcount(X_a AND C_b),

with ``w(b) = 2**b`` and a negative weight for the sign plane, so dot products and
squared distances are exact integers.  The packed planes are written once
to the shared folder; each round is one map over them that sends at most k
partial sums a task, so a centroid holding a third of all vectors costs no
more than any other.  Only the k centroids reach the driver.

Defined results: a vector that is null, of another length, or has a null, NaN
or infinite component is left out.  Equal rows are vectors of their own, a null
id is hashed as ``-``, rows with the same id start in the order of their
components.  With fewer than ``k`` vectors there are that many centroids; an
empty table gives an empty result.  Components whose distances could pass 63
bits (beyond about +-2**26.5 for 64 components) raise an error.  Other columns of the input are
not read."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import materialize

WORD = 64
#: Vectors compared at a time: the products of 40 centroids stay within a core's cache.
BLOCK = 2048


class Clustering(NamedTuple):
    #: id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string
    assigned: DataFrame
    #: k integer centroids, on the driver
    centroids: list[list[int]]


def weights(planes: int) -> list[int]:
    """Weight of each plane in two's complement, lowest first."""
    return [2**b for b in range(planes - 1)] + [-(2 ** (planes - 1))]


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(n, d) integers -> (n, words, planes) uint64."""
    n, d = values.shape
    words = -(-d // WORD)
    out = np.empty((n, words, planes), np.uint64)
    bits = np.zeros((n, words * WORD), np.uint8)
    for b in range(planes):
        bits[:, :d] = (values >> b) & 1
        out[:, :, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return out


def unpack(packed: np.ndarray, d: int) -> np.ndarray:
    """Inverse of ``pack``: (n, d) int64."""
    n, _, planes = packed.shape
    out = np.zeros((n, d), np.int64)
    for b, w in enumerate(weights(planes)):
        plane = np.ascontiguousarray(packed[:, :, b]).astype("<u8").view(np.uint8).reshape(n, -1)
        out += np.unpackbits(plane, axis=1, bitorder="little")[:, :d] * np.int64(w)
    return out


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products (n, k) of two packed sets of vectors with as many planes."""
    n, words, planes = x.shape
    out = np.zeros((n, len(c)), np.int64)
    both, count = np.empty(out.shape, np.uint64), np.empty(out.shape, np.uint8)
    for shift in range(2 * planes - 1):
        for sign in (1, -1):
            pairs = [(a, shift - a) for a in range(max(0, shift - planes + 1), min(planes, shift + 1))
                     if ((a == planes - 1) != (shift - a == planes - 1)) == (sign < 0)]
            if not pairs:
                continue
            total = np.zeros(out.shape, np.uint32)
            for a, b in pairs:
                for w in range(words):
                    np.bitwise_and(x[:, w, a, None], c[None, :, w, b], out=both)
                    np.bitwise_count(both, out=count)
                    total += count
            out += sign * (total.astype(np.int64) << shift)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """Exact squared lengths of packed vectors, by the same counts."""
    out = np.zeros(len(x), np.int64)
    w = weights(x.shape[2])
    for a in range(len(w)):
        for b in range(len(w)):
            out += w[a] * w[b] * np.bitwise_count(x[:, :, a] & x[:, :, b]).sum(axis=1, dtype=np.int64)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and squared distance."""
    found, dist = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    length = squares(c)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        d = length[None, :] - 2 * dots(part, c)
        best = d.argmin(axis=1)
        found[at : at + BLOCK] = best
        dist[at : at + BLOCK] = d[np.arange(len(part)), best] + squares(part)
    return found, dist


def _planes_of(batch: pa.RecordBatch, words: int, planes: int) -> np.ndarray:
    raw = b"".join(batch.column("planes").to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, words, planes)


def _kept(df: DataFrame, id_col: str, vector: str, d: int, scale: float) -> DataFrame:
    v = F.col(f"`{vector}`")
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    scaled = F.transform(v, lambda x: F.lit(float(scale)) * x.cast("double"))
    return df.where((F.size(v) == d) & F.forall(v, ok)).select(F.col(f"`{id_col}`").alias("id"), scaled.alias("v"))


def _fits(kept: DataFrame, d: int) -> int:
    """Bit planes that hold every component, from the least and greatest one."""
    lo, hi = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if lo is None:
        return 0
    lo, hi = int(np.floor(lo)), int(np.floor(hi))
    bound = int((2**63 / (4 * d)) ** 0.5) // 2
    if max(-lo, hi) > bound:
        raise ValueError(f"components beyond +-{bound} after scaling: squared distances would not fit 64 bits")
    return max(hi.bit_length(), (-lo - 1).bit_length() if lo < 0 else 0) + 1


def _start(packed: DataFrame, k: int, seed: str) -> list[bytes]:
    name: Column = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("-")))
    rows = packed.select(F.sha2(name, 256).alias("h"), "planes").orderBy("h", "planes").limit(k).collect()
    return [bytes(r["planes"]) for r in rows]


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5,
    components: int = 64, scale: float = 256.0, seed: str = "2",
) -> Clustering:
    """``rounds`` of Lloyd's method on ``floor(scale * x)`` from the ``k`` vectors whose
    ids have the smallest salted hashes, then a last assignment."""
    d, words = components, -(-components // WORD)
    kept = _kept(df, id_col, vector, d, scale)
    id_type = kept.schema["id"].dataType.simpleString()
    out = f"id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    planes = _fits(kept, d)
    if planes == 0:
        return Clustering(df.sparkSession.createDataFrame([], out), [])

    def to_planes(batches):
        for b in batches:
            values = np.floor(b.column("v").flatten().to_numpy(zero_copy_only=False)).astype(np.int64).reshape(-1, d)
            raw = pack(values, planes).reshape(len(values), -1).astype("<u8")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in raw], pa.binary())], ["id", "planes"])

    packed = materialize(kept.mapInArrow(to_planes, f"id {id_type}, planes binary"), "planes")
    start = np.frombuffer(b"".join(_start(packed, k, seed)), "<u8").reshape(-1, words, planes)
    centroids = [[int(x) for x in row] for row in unpack(start, d)]

    for _ in range(rounds):
        c = pack(np.array(centroids, np.int64), planes)

        def totals(batches, c=c):
            sums, n = np.zeros((len(c), d), np.int64), np.zeros(len(c), np.int64)
            for b in batches:
                x = _planes_of(b, words, planes)
                if not len(x):
                    continue
                found, _ = nearest(x, c)
                order = np.argsort(found, kind="stable")
                which, first = np.unique(found[order], return_index=True)
                sums[which] += np.add.reduceat(unpack(x, d)[order], first, axis=0)
                n += np.bincount(found, minlength=len(c))
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(has, pa.int32()), "n": pa.array(n[has], pa.int64()),
                "sums": pa.array(list(sums[has]), pa.list_(pa.int64())),
            })

        parts = packed.select("planes").mapInArrow(totals, "cluster int, n long, sums array<long>")
        state = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in state.collect():  # k centroids of d components
            centroids[r["cluster"]][r["i"]] = r["s"] // r["n"]

    c = pack(np.array(centroids, np.int64), planes)

    def assign(batches):
        for b in batches:
            found, dist = nearest(_planes_of(b, words, planes), c)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.int32()), pa.array(dist, pa.int64())], ["id", "cluster", "distance"])

    assigned = materialize(packed.mapInArrow(assign, f"id {id_type}, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids]
    table = [(j, s, sum(sums.values()), digest[j]) for j, s in sums.items()]  # one row a cluster
    side = df.sparkSession.createDataFrame(table, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(side), F.col("cluster") == F.col("c"))
    return Clustering(joined.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids)


def _sql(k: int = 40, rounds: int = 5) -> str:
    near = """SELECT v.vec_id, v.v, c.c, CAST(list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) AS d
        FROM kept v, {m} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.c) = 1"""
    steps = []
    for r in range(rounds):
        steps.append(f"""near{r} AS MATERIALIZED ({near.format(m=f"m{r}")}),
    sums{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{r}) GROUP BY c, i),
    moved{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM sums{r} GROUP BY c),
    m{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM m{r} o LEFT JOIN moved{r} n USING (c)),""")
    return f"""WITH kept AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k}),
    {" ".join(steps)}
    last AS MATERIALIZED ({near.format(m=f"m{rounds}")})
    SELECT l.vec_id, CAST(l.c AS INTEGER) AS cluster, l.d AS distance, CAST(sum(l.d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(l.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(m.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
    FROM last l JOIN m{rounds} m ON m.c = l.c"""


SQL = _sql()
