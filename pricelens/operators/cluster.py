"""Clustering of entity feature vectors.

Data: ``(entity, features array<double>)``; the entity keeps its own type
(a number, a name).  The vectors are checkpointed once (reliable checkpoint in
the shared checkpoint folder) in partitions that depend on the ids and their
number only, so fits agree whatever the cluster, every pass re-reads them from
there, an executor loss recomputes only lost blocks, and lineage never grows.

* k-means: Spark ML's k-means|| seeding, ``n_init`` seeds, the fit of least
  cost.  The steps are those of its solver, but one pass over the rows takes a
  step of all fits (all k, all seeds).  The tolerance bounds each center's shift;
  it is set so that the squared shift of all centers stays within tol x mean
  feature variance.  Fewer distinct vectors than k give fewer centers.
* fuzzy c-means: memberships u = d^(-2/(m-1)) normalised, centers =
  sum u^m x / sum u^m, stop when ||u_new - u_old||_F < error; the initial
  memberships come from a seeded hash.  Each pass emits partial sums per
  partition from ``mapInPandas`` and Spark adds them; only k x d numbers reach
  the driver.  FPC = sum u^2 / n.
* spectral: see ``spectral``.
"""

from __future__ import annotations

import functools
import operator
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

ALGORITHMS = ("kmeans", "fcm", "spectral")


@dataclass
class ClusterResult:
    algorithm: str
    k: int
    labels: DataFrame  # (entity, cluster)
    centers: DataFrame | None = None  # (cluster, center array<double>)
    memberships: DataFrame | None = None  # (entity, cluster, u)
    info: dict = field(default_factory=dict)


# ------------------------------------------------------------------ helpers
_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 (vectorised)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Deterministic U(0,1) per id for a given salt tuple."""
    h = np.asarray(ids).astype(np.int64).view(np.uint64)
    for s in salt:
        h = _mix(h ^ _mix(np.uint64(s & 0xFFFFFFFFFFFFFFFF) + np.zeros(1, dtype=np.uint64)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _mat(pdf: pd.DataFrame, features: str) -> np.ndarray:
    if len(pdf) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[features].values])


def _d2(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    d = (X * X).sum(1)[:, None] + (C * C).sum(1)[None, :] - 2.0 * X @ C.T
    return np.maximum(d, 0.0)


ROWS_PER_PARTITION = 50_000
PARALLEL_FITS = 8
PACK_ROWS = 4096  # vectors of a block at most, and its bytes
PACK_BYTES = 32 << 20


def entity_type(df: DataFrame, entity: str = "entity") -> str:
    return df.schema[entity].dataType.simpleString()


def prepare(vec: DataFrame, entity: str = "entity", features: str = "features") -> tuple[DataFrame, int, int]:
    """Checkpoint the vectors with a hash ``_h`` of their ids; return (data, n, d)."""
    d = vec.select(F.col(entity).alias("entity"), F.col(features).cast("array<double>").alias("features"))
    n = d.count()
    d = d.repartition(max(1, -(-n // ROWS_PER_PARTITION)), "entity").sortWithinPartitions("entity")
    data = checkpoint(d.withColumn("_h", F.xxhash64("entity"))).persist()
    return data, n, int(data.agg(F.max(F.size("features"))).first()[0] or 0)


def sum_arrays(col: str, length: int):
    """Element-wise sum of an array column as one aggregate expression."""
    return F.array(*[F.sum(F.col(col)[j]) for j in range(length)])


def _centers_df(spark, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(c), [float(x) for x in centers[c]]) for c in range(len(centers))], "cluster int, center array<double>")


def canonical_order(centers: np.ndarray) -> np.ndarray:
    """Permutation that sorts centers lexicographically (stable labels)."""
    return np.lexsort(centers.T[::-1])


# ------------------------------------------------------------------ C1
def kmeans(vec: DataFrame, k: int, **params) -> ClusterResult:
    """One k-means fit; parameters as for ``kmeans_many``."""
    return kmeans_many(vec, [k], **params)[k]


def kmeans_many(vec: DataFrame, ks: Sequence[int], n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 42,
                entity: str = "entity", features: str = "features", data=None, leading: bool = False) -> dict[int, ClusterResult]:
    """k-means for every k of ``ks``, ``leading``: on the first k numbers of the vectors.  Each restart of
    each k is seeded by itself; then each pass over the rows moves all that have not settled yet."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    t0 = time.time()
    own = data is None
    data, n, d = prepare(vec, entity, features) if own else data
    for k in ks:
        _check_k(k, n)
    width = {k: min(k, d) if leading else d for k in ks}
    cut = {k: F.slice("features", 1, k) if leading else F.col("features") for k in ks}
    rows = data.select(F.posexplode("features").alias("j", "x")).groupBy("j").agg(F.var_pop("x").alias("v")).orderBy("j").collect()
    spread = [float(r["v"] or 0.0) for r in rows]
    shift = {k: (tol * float(np.mean(spread[: width[k]] or [0.0])) / k) ** 0.5 for k in ks}

    def seeded(fit: tuple[int, int]) -> np.ndarray:
        """The centers of Spark ML's seeding, without a step of its solver."""
        k, r = fit
        # not persisted here: Spark ML then keeps each running fit's points with their norms (in memory, else on
        # disk); over a persisted table every pass of every fit decodes the rows again
        points = data.select(array_to_vector(cut[k]).alias("features"))
        return np.vstack(KMeans(k=k, seed=seed + r, maxIter=0).fit(points).clusterCenters())

    fits = [(k, r) for k in ks for r in range(n_init)]
    with ThreadPool(min(len(fits), PARALLEL_FITS)) as pool:  # independent fits share the cluster, as in Spark ML's own tuning
        start = dict(zip(fits, pool.map(inheritable_thread_target(vec.sparkSession)(seeded), fits, chunksize=1)))
    ended = _lloyd(_packed(data, n, d), start, d, max_iter, {f: shift[f[0]] for f in fits})
    out = {}
    for k in ks:
        cost, restart = min((ended[k, r].cost, r) for r in range(n_init))
        best = ended[k, restart]
        C = best.centers[canonical_order(best.centers)]
        labels = assign_array(data.select("entity", cut[k].alias("features")), C).withColumnRenamed("entity", entity)
        info = {"algorithm": "kmeans", "k": k, "inertia": cost, "n_iter": best.steps, "converged": best.steps < max_iter, "restart": restart,
                "execution_time": max(ended[k, r].at for r in range(n_init)) - t0}
        out[k] = ClusterResult("kmeans", k, labels, _centers_df(vec.sparkSession, C), None, info)
    if own:
        data.unpersist()
    return out


def _packed(data: DataFrame, n: int, d: int) -> RDD:
    """The vectors as blocks of a matrix, so that no pass decodes them again."""
    rows = max(1, min(PACK_ROWS, PACK_BYTES // (8 * max(1, d))))

    def pack(it):
        for pdf in it:
            if len(pdf):
                yield pd.DataFrame({"x": [_mat(pdf, "features").tobytes()]})

    dealt = data.select("_h", "features").repartition(-(-n // rows), "_h").sortWithinPartitions("_h")
    return dealt.mapInPandas(pack, "x binary").rdd.map(lambda r: bytes(r["x"]))


@dataclass
class _Ended:
    """Where one fit ended."""

    centers: np.ndarray
    cost: float = 0.0  # of the last pass, before its step
    steps: int = 0
    at: float = 0.0


def _lloyd(packed: RDD, start: dict, d: int, max_iter: int, shift: dict) -> dict:
    """Lloyd's steps of all fits (key -> centers, of the first numbers of the rows when they have fewer than
    ``d``), until no center of a fit moves by more than its ``shift``, as Spark ML ends them; a center without
    rows stays.  Key -> ``_Ended``."""
    packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
    out = {f: _Ended(C, at=time.time()) for f, C in start.items()}
    live = list(start)
    for it in range(1, max_iter + 1):
        if not live:
            break
        moving = []
        for f, (s, w, cost) in zip(live, _lloyd_pass(packed, [out[f].centers for f in live], d)):
            old = out[f].centers
            C = np.divide(s, w[:, None], out=old.copy(), where=w[:, None] > 0)
            out[f] = _Ended(C, cost, it, time.time())
            if not (((C - old) ** 2).sum(axis=1) <= shift[f] ** 2).all():
                moving.append(f)
        live = moving
    packed.unpersist()
    return out


def _lloyd_pass(packed: RDD, fits: list[np.ndarray], d: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each fit, the sum and number of the rows nearest to each center, and the cost; added up in a
    tree, so that a few blocks' sums reach the driver however many there are."""
    stop = np.cumsum([len(C) for C in fits])
    begin = stop - [len(C) for C in fits]
    centers = np.vstack([np.pad(C, ((0, 0), (0, d - C.shape[1]))) for C in fits])
    widths = [C.shape[1] for C in fits]

    def step(it):
        total, half = np.zeros((len(centers), d + 2)), (centers * centers).sum(1) / 2
        for x in it:
            block = np.frombuffer(x).reshape(-1, d)
            for lo in range(0, len(block), 2048):
                X = block[lo : lo + 2048]
                near, own, at = half - X @ centers.T, np.zeros((len(X), len(centers))), np.arange(len(X))
                for a, b, w in zip(begin, stop, widths):
                    j = a + near[:, a:b].argmin(1)
                    own[at, j] = 1.0
                    gap = (X[:, :w] - centers[j, :w]).ravel()
                    total[a, d + 1] += gap @ gap
                total[:, :d] += own.T @ X
                total[:, d] += own.sum(0)
        yield total

    total = packed.mapPartitions(step).treeReduce(operator.add)
    return [(total[a:b, :w], total[a:b, d], float(total[a, d + 1])) for a, b, w in zip(begin, stop, widths)]


def assign_array(data: DataFrame, centers: np.ndarray, entity: str = "entity", features: str = "features") -> DataFrame:
    """Nearest-center labels (entity, cluster) for fixed centers, JVM-side:
    the k centers are literals, distances are array expressions."""
    dist = [
        F.struct(
            F.aggregate(F.zip_with(features, F.array(*[F.lit(float(x)) for x in centers[c]]), lambda a, b: (a - b) * (a - b)),
                        F.lit(0.0), lambda acc, x: acc + x).alias("d"),
            F.lit(c).alias("c"),
        )
        for c in range(len(centers))
    ]
    return data.select(F.col(entity).alias(entity), F.array_min(F.array(*dist))["c"].alias("cluster"))


# ------------------------------------------------------------------ C5
def assign(vec: DataFrame, centers: DataFrame | ClusterResult, entity: str = "entity", features: str = "features") -> DataFrame:
    """Label new rows by their nearest center (k-means / fuzzy c-means).
    Spectral results have no centers: an error, like the original."""
    if isinstance(centers, ClusterResult):
        if centers.centers is None:
            raise ValueError(f"{centers.algorithm} does not support assigning new rows")
        centers = centers.centers
    rows = centers.orderBy("cluster").collect()
    C = np.array([r["center"] for r in rows], dtype=float)
    ids = [int(r["cluster"]) for r in rows]
    lab = assign_array(vec, C, entity, features)
    mapping = F.create_map(*[x for i, c in enumerate(ids) for x in (F.lit(i), F.lit(c))])
    return lab.withColumn("cluster", mapping[F.col("cluster")])


# ------------------------------------------------------------------ C2
def fcm(vec: DataFrame, k: int, **params) -> ClusterResult:
    """One fuzzy c-means fit; parameters as for ``fcm_many``."""
    return fcm_many(vec, [k], **params)[k]


def fcm_many(vec: DataFrame, ks: Sequence[int], m: float = 2.0, error: float = 1e-5, max_iter: int = 150, seed: int = 42,
             entity: str = "entity", features: str = "features", data=None) -> dict[int, ClusterResult]:
    """Fuzzy c-means for every k of ``ks``: each pass over the rows moves all fits that have not settled yet."""
    t0 = time.time()
    if m <= 1:
        raise ValueError("fuzzifier m must be > 1")
    own = data is None
    data, n, d = prepare(vec, entity, features) if own else data
    for k in ks:
        _check_k(k, n)
    prev = dict.fromkeys(ks)  # None = the seeded random memberships
    cur = {k: got[0] for k, got in _fcm_pass(data, {k: (None, None) for k in ks}, d, m, seed).items()}
    diff, steps, took = dict.fromkeys(ks, np.inf), dict.fromkeys(ks, max_iter), {}
    it, live = 1, list(ks)
    while it < max_iter and live:
        # memberships from `cur` against those from `prev`; centers for the next step
        for k, (nxt, change) in _fcm_pass(data, {k: (prev[k], cur[k]) for k in live}, d, m, seed, with_prev=True).items():
            diff[k] = change
            if change < error:
                steps[k], took[k] = it, time.time() - t0
            else:
                prev[k], cur[k] = cur[k], nxt
        live = [k for k in live if k not in took]
        it += 1
    out = {}
    for k in ks:
        C = cur[k][canonical_order(cur[k])]
        memberships = _fcm_memberships(data, C, m).withColumnRenamed("entity", entity)
        labels = assign_array(data, C).withColumnRenamed("entity", entity)  # the highest membership is that of the nearest center
        fpc = (memberships.agg(F.sum(F.col("u") * F.col("u"))).first()[0] or 0.0) / n
        info = {"algorithm": "fcm", "k": k, "fpc": float(fpc), "n_iter": steps[k], "converged": bool(diff[k] < error),
                "execution_time": took.get(k, time.time() - t0)}
        out[k] = ClusterResult("fcm", k, labels, _centers_df(vec.sparkSession, C), memberships, info)
    if own:
        data.unpersist()
    return out


def _u_of(X: np.ndarray, C: np.ndarray, m: float) -> np.ndarray:
    d = np.sqrt(_d2(X, C))
    zero = d == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        inv = d ** (-2.0 / (m - 1.0))
        u = inv / inv.sum(1, keepdims=True)
    hit = zero.any(1)
    if hit.any():
        u[hit] = zero[hit] / zero[hit].sum(1, keepdims=True)
    return u


def _u_init(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    u = np.column_stack([uniform(ids, seed, 7919, c) for c in range(k)])
    return u / u.sum(1, keepdims=True)


def _fcm_pass(data, fits: dict, d, m, seed, with_prev=False) -> dict:
    """One pass for all ``fits`` (k -> (prev, cur)): k -> (next centers, change).  Without ``cur``:
    centers from the initial memberships.  With ``cur``: memberships from ``cur`` give the next
    centers, and the membership change against ``prev`` (or the initial ones) is measured."""

    def step(it):
        s, w, diff = {k: np.zeros((k, d)) for k in fits}, {k: np.zeros(k) for k in fits}, dict.fromkeys(fits, 0.0)
        for pdf in it:  # all batches of the partition are combined first
            if len(pdf) == 0:
                continue
            X = _mat(pdf, "features")
            ids = pdf["_h"].to_numpy()
            for k, (prev, cur) in fits.items():
                u = _u_init(ids, k, seed) if cur is None else _u_of(X, cur, m)
                if with_prev:
                    u0 = _u_init(ids, k, seed) if prev is None else _u_of(X, prev, m)
                    diff[k] += float(((u - u0) ** 2).sum())
                um = u ** m
                s[k] += um.T @ X
                w[k] += um.sum(0)
        out = [(k, c, s[k][c].tolist(), float(w[k][c])) for k in fits for c in range(k)]
        out += [(k, -1, [0.0] * d, diff[k]) for k in fits]
        yield pd.DataFrame(out, columns=["k", "c", "s", "e"])

    part = data.mapInPandas(step, "k int, c int, s array<double>, e double")
    sums = part.groupBy("k", "c").agg(F.sum("e").alias("e"), sum_arrays("s", d).alias("s")).collect()
    centers, change = {k: np.zeros((k, d)) for k in fits}, {}
    for r in sums:
        if r["c"] < 0:
            change[r["k"]] = float(np.sqrt(r["e"]))
        else:
            centers[r["k"]][r["c"]] = np.asarray(r["s"], dtype=float) / r["e"]
    return {k: (centers[k], change[k]) for k in fits}


def _fcm_memberships(data: DataFrame, C: np.ndarray, m: float) -> DataFrame:
    k = len(C)

    def step(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            u = _u_of(_mat(pdf, "features"), C, m)
            ids = pdf["entity"].to_numpy()
            yield pd.DataFrame({"entity": np.repeat(ids, k), "cluster": np.tile(np.arange(k), len(ids)), "u": u.reshape(-1)})

    return data.mapInPandas(step, f"entity {entity_type(data)}, cluster long, u double").withColumn("cluster", F.col("cluster").cast("int"))


def _check_k(k: int, n: int) -> None:
    if k < 2:
        raise ValueError("k must be at least 2")
    if k >= n:
        raise ValueError(f"k={k} must be smaller than the number of rows ({n})")


# ------------------------------------------------------------------ C6, C7
def fit(vec: DataFrame, algorithm: str, k: int, data=None, **params) -> ClusterResult:
    if algorithm == "kmeans":
        return kmeans(vec, k, data=data, **params)
    if algorithm == "fcm":
        return fcm(vec, k, data=data, **params)
    if algorithm == "spectral":
        from .spectral import spectral

        return spectral(vec, k, data=data, **params)
    raise ValueError(f"unknown algorithm {algorithm!r}; choose from {ALGORITHMS}")


def _runs_df(spark, rows: list[dict]) -> DataFrame:
    """One row a run: algorithm, k, run, every metric, execution_time, error."""
    from .evaluate import METRICS_SCHEMA

    return spark.createDataFrame(rows, f"algorithm string, k int, run int, {METRICS_SCHEMA}, execution_time double, error string")


def fit_all(vec: DataFrame, algorithm: str, ks: Sequence[int], data, parallel: int = 1, **params) -> dict[int, ClusterResult | Exception]:
    """Every k for one algorithm: the fit, or the error it ended with.  k-means and fuzzy c-means fits share
    their passes, spectral ones their eigenvectors too; if that fails, each k is fitted by itself."""
    from .spectral import spectral_many

    together = {"kmeans": kmeans_many, "fcm": fcm_many, "spectral": spectral_many}.get(algorithm)
    able = [k for k in ks if 2 <= k < data[1]]
    out: dict[int, ClusterResult | Exception] = {}
    if together and len(able) > 1:
        try:
            out = together(vec, able, data=data, **params)
        except Exception:  # each k below then succeeds or names its own error
            pass

    def alone(k: int) -> ClusterResult | Exception:
        try:
            return fit(vec, algorithm, k, data=data, **params)
        except Exception as e:  # one failed fit must not stop the others
            return e

    rest = [k for k in ks if k not in out]
    with ThreadPool(max(1, parallel)) as pool:
        return out | dict(zip(rest, pool.map(inheritable_thread_target(vec.sparkSession)(alone), rest, chunksize=1)))


def assign_runs(data: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """(run, entity, cluster): nearest centers of every run, in one pass over the rows (ties: the smaller number)."""

    def step(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            X, ids = _mat(pdf, "features"), pdf["entity"].to_numpy()
            for run, C in centers.items():
                far = np.column_stack([((X - c) ** 2).sum(axis=1) for c in C])
                yield pd.DataFrame({"run": run, "entity": ids, "cluster": far.argmin(axis=1)})

    rows = data.select("entity", "features").mapInPandas(step, f"run long, entity {entity_type(data)}, cluster long")
    return rows.select(F.col("run").cast("int").alias("run"), "entity", F.col("cluster").cast("int").alias("cluster"))


def sweep(vec: DataFrame, algorithms: Sequence[str] = ALGORITHMS, ks: Sequence[int] = range(2, 11), params: dict | None = None,
          parallel: int = 1) -> DataFrame:
    """Every algorithm x k; a failing pair becomes a row with its error
    (the sweep goes on).  The vectors are prepared once, fits share what they can (``fit_all``), and all
    metrics of all runs come from the same few jobs (``evaluate_runs``); ``parallel`` fits are
    submitted at a time.  One row a run: see ``_runs_df``."""
    spark = vec.sparkSession
    data = prepare(vec)
    ks = list(dict.fromkeys(ks))

    def one(a: str) -> dict:
        return fit_all(data[0], a, ks, data, parallel, **(params or {}).get(a, {}))

    with ThreadPool(min(max(1, parallel), len(algorithms))) as pool:
        fits = dict(zip(algorithms, pool.map(inheritable_thread_target(spark)(one), algorithms, chunksize=1)))
    runs = [(a, k, fits[a][k]) for a in algorithms for k in ks]
    rows = _scored(data[0], runs)
    data[0].unpersist()
    return _runs_df(spark, rows)


def _scored(data: DataFrame, runs: list[tuple[str, int, ClusterResult | Exception]]) -> list[dict]:
    """Rows of ``_runs_df``: the metrics of every fit, all from the same jobs, or the error of a failed one."""
    from .evaluate import evaluate_runs

    spark = data.sparkSession
    good = {i: res for i, (_, _, res) in enumerate(runs) if isinstance(res, ClusterResult)}
    # the centers of a fit are a local table of k rows
    centers = {i: np.array([r["center"] for r in res.centers.orderBy("cluster").collect()]) for i, res in good.items() if res.centers is not None}
    parts = [assign_runs(data, centers)] if centers else []
    parts += [res.labels.select(F.lit(i).alias("run"), "entity", F.col("cluster").cast("int").alias("cluster")) for i, res in good.items() if i not in centers]
    metrics = {}
    if parts:
        given = [(i, c, [float(x) for x in C[c]]) for i, C in centers.items() for c in range(len(C))]
        given = spark.createDataFrame(given, "run int, cluster int, center array<double>")
        labelings = checkpoint(functools.reduce(DataFrame.unionByName, parts))
        scored = evaluate_runs(data.select("entity", "features"), labelings, given, [i for i, res in good.items() if res.algorithm == "kmeans"])
        metrics = {r["run"]: r.asDict() for r in scored.collect()}
    rows = []
    for i, (algorithm, k, res) in enumerate(runs):
        row = {"algorithm": algorithm, "k": int(k), "run": i}
        if i in metrics:
            row |= metrics[i] | {"execution_time": float(res.info.get("execution_time", 0.0))}
        elif isinstance(res, Exception):
            row["error"] = f"{type(res).__name__}: {res}"
        else:
            row["error"] = "ValueError: insufficient clusters: at least two are needed"
        rows.append(row)
    return rows


def compare(vec: DataFrame, algorithms: Sequence[str] = ALGORITHMS, k: int = 3, params: dict | None = None):
    """The same k for several algorithms: per algorithm labels and
    metrics; a failing algorithm becomes a row with its error; the best is the
    one with the highest silhouette.  Returns (runs DataFrame, {algorithm:
    ClusterResult}, best algorithm)."""
    data = prepare(vec)
    runs = [(a, k, fit_all(data[0], a, [k], data, **(params or {}).get(a, {}))[k]) for a in algorithms]
    rows = _scored(data[0], runs)
    data[0].unpersist()
    valid = [row for row in rows if not row.get("error")]
    results = {row["algorithm"]: runs[row["run"]][2] for row in valid}
    best = max(valid, key=lambda r: (r["silhouette"], -r["run"]))["algorithm"] if valid else None
    return _runs_df(vec.sparkSession, rows), results, best
