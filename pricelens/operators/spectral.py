"""Affinity graphs (C3) and spectral clustering (C4) without materialising
the n x n affinity matrix.

The affinity is recomputed tile by tile (``pairwise``) whenever it is
needed; each tile emits only per-row products.  The spectral embedding is
the top-k eigenvectors of A = D^-1/2 W D^-1/2 (W without its diagonal, D its
row sums; isolated rows get scale 1), found on A + I with extra vectors
by the locally optimal block gradient method (Knyazev 2001): Rayleigh-Ritz on
the block, its residual and its last step, whose Gram matrices Spark adds.
Rows of the eigenvector block are divided by
sqrt(degree), signs fixed so each vector's largest entry is positive, then
clustered with k-means.  Work per iteration is O(n^2 d) spread over the
tiles; only (3q)^2 numbers reach the driver.  The steps go on until the eigenvalues
settle to ``tol``; a fit that does not settle within ``max_iter`` steps raises.  Dense
kernels are quadratic in the rows; the k-nearest-neighbour kernel is the
sparse, scalable mode."""

from __future__ import annotations

import math
import operator
import time
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint
from . import pairwise as pw
from .cluster import ClusterResult, _check_k, entity_type, kmeans_many, prepare, sum_arrays

KERNELS = ("rbf", "nearest_neighbors", "polynomial", "sigmoid", "cosine")


def kernel_block(XL: np.ndarray, XR: np.ndarray, kernel, gamma: float, degree: float = 3.0, coef0: float = 1.0) -> np.ndarray:
    """Affinities of two blocks of rows; ``kernel`` is a name of ``KERNELS`` or a
    symmetric function (rows, rows) -> matrix of its own."""
    if callable(kernel):
        return np.asarray(kernel(XL, XR), dtype=np.float64)
    if kernel == "rbf":
        return np.exp(-gamma * pw.sq_dists(XL, XR))
    if kernel == "polynomial":
        return (gamma * XL @ XR.T + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * XL @ XR.T + coef0)
    if kernel == "cosine":
        nl = np.linalg.norm(XL, axis=1)
        nr = np.linalg.norm(XR, axis=1)
        nl[nl == 0] = 1.0
        nr[nr == 0] = 1.0
        return (XL / nl[:, None]) @ (XR / nr[:, None]).T
    raise ValueError(f"unknown kernel {kernel!r}; choose from {KERNELS}")


#: Pivots of the neighbour index, at most; their cells are the unit that the triangle inequality rules out.
MAX_PIVOTS = 256
#: Rows a cell should have, where there are pivots enough.
CELL_ROWS = 4096


def _pivots(vec: DataFrame, count: int, entity: str, features: str) -> np.ndarray:
    """``count`` rows far from each other: farthest-first among the 8 x ``count`` rows with the smallest hashes."""
    rows = vec.select(features, F.xxhash64(entity).alias("_h")).orderBy("_h").limit(8 * count).collect()
    x = np.array([r[features] for r in rows], dtype=np.float64)
    chosen, near = [0], pw.sq_dists(x, x[:1])[:, 0]
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, pw.sq_dists(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def knn_tiles(vec: DataFrame, k: int, entity="entity", features="features", pivots: int | None = None,
              block_rows: int | None = pw.DEFAULT_BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Metric partition index: (rows with their Voronoi cell, its group and the group's number of blocks, pairs of
    cells (i, j) with their groups (gi, gj, nbi, nbj) in which rows
    of cell i may have one of their k nearest neighbours in cell j).  Exact: for rows of cell i the k-th
    distance is at most theta(i) = U(i) + min over cells j, in order, of the k smallest |p_i p_j| + |s p_j|; a row s of
    cell j is nearer than that only if |s p_j| >= |p_i p_j| - U(i) - theta(i), with U the cell's radius.
    Cells near each other travel in one block, so that the copies of a row do not grow with the number of cells."""
    n, d = vec.agg(F.count(F.lit(1)), F.max(F.size(features))).first()
    p = _pivots(vec, max(1, min(MAX_PIVOTS, pivots or -(-n // CELL_ROWS))), entity, features)
    t = entity_type(vec, entity)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d2 = pw.sq_dists(pw.matrix(pdf, features), p)
                cell = d2.argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), away=np.sqrt(d2[np.arange(len(cell)), cell]))

    rows = checkpoint(vec.select(entity, features).mapInPandas(place, f"{entity} {t}, {features} array<double>, cell int, away double"))
    # per cell: rows, radius and the k rows nearest to the pivot: at most MAX_PIVOTS * k numbers
    near = rows.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy("away"))).where(F.col("_r") <= k)
    near = near.groupBy("cell").agg(F.sort_array(F.collect_list("away")).alias("near"))
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).join(near, "cell").collect()
    between = np.sqrt(pw.sq_dists(p, p))
    radius = {r["cell"]: r["radius"] for r in cells}
    least = max(block_rows or 1, -(-n // pw.MAX_BLOCKS))
    groups = _cell_groups({r["cell"]: r["n"] for r in cells}, between, min(pw.rows_of_bytes(d or 1), least))
    of = {c: (g, nb) for g, (mine, nb) in enumerate(groups) for c in mine}
    pairs = []
    slack = 1e-6 * (1.0 + float(between.max(initial=0.0)) + max(radius.values(), default=0.0))  # rounding of the distances
    for i in radius:
        bounds = np.sort(np.concatenate([radius[i] + between[i, r["cell"]] + np.array(r["near"]) for r in cells]))
        theta = bounds[min(k, len(bounds)) - 1]
        for j in radius:
            if radius[j] + slack >= between[i, j] - radius[i] - theta:
                pairs.append((i, j, of[i][0], of[j][0], of[i][1], of[j][1]))
    table = vec.sparkSession.createDataFrame(pairs, "i int, j int, gi int, gj int, nbi int, nbj int")
    sizes = vec.sparkSession.createDataFrame([(c, *x) for c, x in of.items()], "c int, grp int, _nb int")
    return rows.join(F.broadcast(sizes), F.col("cell") == F.col("c")).drop("c"), table  # one row a cell


def _cell_groups(size: dict[int, int], between: np.ndarray, fit: int) -> list[tuple[list[int], int]]:
    """Cells, each followed by the nearest one left, in groups of up to ``fit`` rows: (cells, blocks).  A larger
    cell is a group of its own, of several blocks."""
    groups: list[tuple[list[int], int]] = []
    left, at, rows = dict(size), next(iter(size), 0), 0
    while left:
        at = min(left, key=lambda c: (between[at, c], c))
        n = left.pop(at)
        if groups and rows + n <= fit:
            groups[-1][0].append(at)
            rows += n
        else:
            groups.append(([at], -(-n // fit)))
            rows = n
    return groups


def _best(d2: np.ndarray, who: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of each row's best so far and of its distances ``d2`` to ``who``, in order; of equal ones the earlier."""
    best_d, best_b = best
    if best_d.shape[1] == k and np.isfinite(best_d).all() and not np.isnan(d2).any():
        at, to = np.nonzero(d2 < best_d[:, -1:])  # few are nearer than the k-th so far
        if len(at) * 8 <= d2.size:
            row = np.concatenate([np.repeat(np.arange(len(d2)), k), at])
            dist, ids = np.concatenate([best_d.reshape(-1), d2[at, to]]), np.concatenate([best_b.reshape(-1), who[to]])
            order = np.lexsort((np.arange(len(row)), dist, row))
            first = np.searchsorted(row[order], np.arange(len(d2)))
            keep = order[(first[:, None] + np.arange(k)[None, :])]
            return dist[keep], ids[keep]
    best_d = np.concatenate([best_d, d2], axis=1)
    best_b = np.concatenate([best_b, np.broadcast_to(who, d2.shape)], axis=1)
    keep = np.argsort(best_d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(best_d, keep, 1), np.take_along_axis(best_b, keep, 1)


def knn_graph(vec: DataFrame, n_neighbors: int = 10, entity="entity", features="features",
              block_rows: int | None = pw.DEFAULT_BLOCK_ROWS, pivots: int | None = None) -> DataFrame:
    """Symmetrised k-nearest-neighbour connectivity (the row itself counts as
    one neighbour): edges (a, b, w) with w = 0.5 * (A + A^T).  Rows are compared
    only with cells of a metric partition index that may hold a neighbour; each tile keeps its
    ``n_neighbors`` best candidates per row, and the global best of those is
    exactly the true neighbour set (ties by entity)."""
    t = entity_type(vec, entity)
    rows, cells = knn_tiles(vec, n_neighbors, entity, features, pivots, block_rows)
    may = np.zeros((MAX_PIVOTS, MAX_PIVOTS), dtype=bool)
    for r in cells.select("i", "j").collect():
        may[r["i"], r["j"]] = True
    blocks = checkpoint(pw.packed_blocks(rows.select(entity, features, "cell", "grp", "_nb"), "_nb", entity, "grp"))
    pairs = F.broadcast(cells.select(F.col("gi").alias("i"), F.col("gj").alias("j"), "nbi", "nbj").distinct())  # at most MAX_PIVOTS squared rows
    # block (i, ti) meets block (j, tj) for every pair of groups that is not ruled out
    left = blocks.join(pairs, F.col("g") == F.col("i")).select("i", "j", F.col("b").alias("ti"), F.explode(F.sequence(F.lit(0), F.col("nbj") - 1)).alias("tj"), F.lit(False).alias("right"), "rows")
    right = blocks.join(pairs, F.col("g") == F.col("j")).select("i", "j", F.explode(F.sequence(F.lit(0), F.col("nbi") - 1)).alias("ti"), F.col("b").alias("tj"), F.lit(True).alias("right"), "rows")
    same = (F.col("i") == F.col("j")) & (F.col("ti") == F.col("tj"))
    right = right.where(~same)

    def fn(L, R, diag):
        a, b, ids, others, lc, rc = L.matrix(features), R.matrix(features), L.column(entity), R.column(entity), L.column("cell"), R.column("cell")
        order = np.argsort(others, kind="stable")  # ties by entity
        out = [pd.DataFrame({"a": ids[:0], "b": others[:0], "d2": np.empty(0)})]
        for c in np.unique(lc):
            mine, there = np.flatnonzero(lc == c), order[may[c, rc[order]]]
            x, of = a[mine], ids[mine]
            y, who, where = b[there], others[there], rc[there]
            for i in pw.pieces(len(x)):
                best = np.empty((i.stop - i.start, 0)), np.empty((i.stop - i.start, 0), dtype=others.dtype)
                for j in pw.pieces(len(y)):
                    d2 = pw.sq_dists(x[i], y[j])
                    if diag:
                        d2[(of[i][:, None] == who[j][None, :]) & (where[j] == c)] = 0.0
                    best = _best(d2, who[j], best, n_neighbors)
                out.append(pd.DataFrame({"a": np.repeat(of[i], best[0].shape[1]), "b": best[1].reshape(-1), "d2": best[0].reshape(-1)}))
        return pd.concat(out, ignore_index=True)

    cand = pw.run_tiles(left.unionByName(right), ["i", "j", "ti", "tj"], fn, f"a {t}, b {t}, d2 double")
    w = Window.partitionBy("a").orderBy("d2", "b")
    nn = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_neighbors).select("a", "b")
    both = nn.select("a", "b", F.lit(0.5).alias("w")).unionByName(nn.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.5).alias("w")))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def affinity_degrees(vec: DataFrame, kernel="rbf", gamma: float = 1.0, degree: float = 3.0, coef0: float = 1.0,
                     n_neighbors: int = 10, entity="entity", features="features", block_rows: int | None = pw.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """C3 in aggregate form: (entity, degree) = sum of the affinities of the
    row to every *other* row.  (The dense graph itself is never emitted.)"""
    if kernel == "nearest_neighbors":
        g = knn_graph(vec, n_neighbors, entity, features, block_rows)
        return g.where(F.col("a") != F.col("b")).groupBy(F.col("a").alias(entity)).agg(F.sum("w").alias("degree"))
    return _matvec(vec.select(F.col(entity), features, F.array(F.lit(1.0)).alias("y")),
                   kernel, float(gamma), degree, coef0, 1, entity, features, block_rows).select(entity, F.col("z")[0].alias("degree"))


#: Vectors in the block, where the rows are many enough: a wide block settles in fewer products.  A dense
#: product costs its distances and hardly more for more vectors, a sparse one is in proportion to them.
WIDE = 64
WIDE_SPARSE = 32


def _kernel_pieces(a: np.ndarray, b: np.ndarray, diag: bool, kernel, gamma: float, degree: float, coef0: float) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Affinities of all rows of two blocks, piece by piece, 0 of a row to itself; those of ``rbf`` in memory
    that the next piece overwrites, their exponents -gamma |x - y|^2 from one matrix product."""
    if kernel == "rbf":
        na, nb = gamma * (a * a).sum(1)[:, None], gamma * (b * b).sum(1)[:, None]
        left, right = np.hstack([2.0 * gamma * a, -na, np.ones_like(na)]), np.hstack([b, np.ones_like(nb), -nb])
        kept = np.empty(min(pw.PIECE, len(a)) * min(pw.PIECE, len(b)))
    for i in pw.pieces(len(a)):
        for j in pw.pieces(len(b)):
            if kernel == "rbf":
                shape = i.stop - i.start, j.stop - j.start
                K = np.matmul(left[i], right[j].T, out=kept[: shape[0] * shape[1]].reshape(shape))
                np.exp(np.minimum(K, 0.0, out=K) if gamma >= 0 else np.maximum(K, 0.0, out=K), out=K)
            else:
                K = kernel_block(a[i], b[j], kernel, gamma, degree, coef0)
            if diag and i == j:
                np.fill_diagonal(K, 0.0)
            yield i, j, K


def _product(XL, XR, YL, YR, diag: bool, kernel, gamma: float, degree: float, coef0: float) -> tuple[np.ndarray, np.ndarray]:
    """(W YR, W^T YL) of the affinities W between two blocks of rows."""
    zl, zr = np.zeros((len(XL), YR.shape[1])), np.zeros((len(XR), YL.shape[1]))
    for i, j, K in _kernel_pieces(XL, XR, diag, kernel, gamma, degree, coef0):
        zl[i] += K @ YR[j]
        if not diag:
            zr[j] += K.T @ YL[i]
    return zl, zr


def _matvec(state: DataFrame, kernel, gamma, degree, coef0, q, entity="entity", features="features",
            block_rows: int | None = pw.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(entity, z) with z_i = sum_{j != i} W_ij y_j over the tiles."""
    schema = f"{entity} {entity_type(state, entity)}, z array<double>"

    def fn(L, R, diag):
        zl, zr = _product(L.matrix(features), R.matrix(features), L.matrix("y"), R.matrix("y"), diag, kernel, gamma, degree, coef0)
        sides = [(L, zl), (R, zr)][: 1 if diag else 2]
        return pd.concat([pd.DataFrame({entity: block.column(entity), "z": list(z)}) for block, z in sides], ignore_index=True)

    raw = pw.map_tiles(state, fn, schema, block_rows=block_rows, entity=entity)
    return raw.groupBy(entity).agg(sum_arrays("z", q).alias("z"))


def spectral(vec: DataFrame, k: int, **params) -> ClusterResult:
    """One spectral fit; parameters as for ``spectral_many``."""
    return spectral_many(vec, [k], **params)[k]


def spectral_many(vec: DataFrame, ks: Sequence[int], affinity="rbf", gamma: float = 1.0, n_neighbors: int = 10, degree: float = 3.0,
                  coef0: float = 1.0, n_init: int = 10, seed: int = 42, max_iter: int = 200, tol: float = 1e-6, extra: int = 4,
                  block_rows: int | None = pw.DEFAULT_BLOCK_ROWS, entity="entity", features="features", data=None) -> dict[int, ClusterResult]:
    """Spectral fits for every k of ``ks`` from one block of eigenvectors: those of k are the
    first k of the largest one's."""
    t0 = time.time()
    data, n, d = data if data is not None else prepare(vec, entity, features)
    for k in ks:
        _check_k(k, n)
    top = max(ks)
    sparse = affinity == "nearest_neighbors"
    q = min(n, max(top + extra, min(WIDE_SPARSE if sparse else WIDE, n // 8)))
    info = {"algorithm": "spectral", "affinity": affinity if isinstance(affinity, str) else "callable", "converged": True}
    # rows have numbers of their own, in the order of the entities: no step joins by entity
    rows = checkpoint(data.select("entity", "features").orderBy("entity").withColumn("row", F.monotonically_increasing_id()))
    nb = pw.n_blocks(rows, block_rows)
    fine = max(1, math.ceil(n / nb / pw.rows_of_bytes(6 * q)))  # parts of a block, as its state needs them
    blocks = _blocks(rows, nb, fine, q, seed, not sparse)
    if sparse:
        start, apply = _knn_operator(rows, blocks, n_neighbors, block_rows, nb, fine)
    else:
        start, apply = _dense_operator(blocks, affinity, float(gamma), degree, coef0, nb, fine)
        info["gamma"] = float(gamma)
    S, C, w, it = _leading(apply, start, nb * fine, top, q, max_iter, tol)
    emb = _embed(rows, blocks.mapValues(lambda x: x["row"]).join(S, nb * fine), C)
    shared = time.time() - t0
    fits = kmeans_many(emb, ks, n_init=n_init, seed=seed, leading=True)
    for x in (blocks, S):
        x.unpersist()

    def finish(k: int) -> ClusterResult:
        own = {"k": k, "eigen_iterations": it, "eigenvalues": [x - 1.0 for x in w[:k]], "execution_time": shared + fits[k].info["execution_time"]}
        return ClusterResult("spectral", k, fits[k].labels, None, None, info | own)

    return {k: finish(k) for k in ks}


def _block_of(row: str, nb: int, fine: int):
    """Number of a row's part of a block: the ``fine`` parts of a block follow one another."""
    h = F.xxhash64(row)
    return (F.pmod(h, F.lit(nb).cast("long")) * fine + F.pmod(F.shiftrightunsigned(h, 32), F.lit(fine).cast("long"))).cast("int")


def _blocks(rows: DataFrame, nb: int, fine: int, q: int, seed: int, features: bool) -> RDD:
    """(part, its rows in order, their features if asked for, and start vectors: ones, then hashes)."""
    start = F.array(F.lit(1.0), *[(F.xxhash64(F.lit(seed + j), "entity").cast("double") / F.lit(2.0**64)) for j in range(1, q)])
    held = ["y", "features"] if features else ["y"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        for c in held:
            if table[c].null_count or table[c].combine_chunks().flatten().null_count or len(pc.unique(pc.list_value_length(table[c]))) > 1:
                raise ValueError(f"null or uneven {c}")
        flat = {c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes() for c in held}
        return pa.table({"part": table["part"][:1], "row": [table["row"].to_numpy().tobytes()]} | {c: pa.array([x], pa.binary()) for c, x in flat.items()})

    parts = rows.select(_block_of("row", nb, fine).alias("part"), "row", start.alias("y"), *held[1:])
    packed = parts.groupBy("part").applyInArrow(pack, "part int, row binary" + "".join(f", {c} binary" for c in held))

    def read(r) -> tuple[int, dict[str, np.ndarray]]:
        at = np.frombuffer(r["row"], np.int64)
        return r["part"], {"row": at} | {c: np.frombuffer(r[c]).reshape(len(at), -1) for c in held}

    return packed.rdd.map(read).partitionBy(nb * fine).persist(StorageLevel.MEMORY_AND_DISK)


def _started(x: dict, z: np.ndarray, deg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, V, (A + I) V) of a part whose start vectors are y = S V: z = W y is their first product."""
    s = np.divide(1.0, np.sqrt(np.maximum(deg, 0.0)), out=np.ones(len(deg)), where=deg > 0)[:, None]
    return s, x["y"] / s, s * z + x["y"] / s


def _dense_operator(blocks: RDD, kernel, g: float, degree: float, coef0: float, nb: int, fine: int):
    """(start (part, (scale s, V, (A + I) V)), product with W) of a dense kernel.  The degrees are the product with
    the first of the start vectors, so they take no pass of their own.  Parts travel to the tiles of their block."""
    pairs = [(i, j) for i in range(nb) for j in range(i, nb)]
    number = {p: at for at, p in enumerate(pairs)}

    def send(part: int, x: tuple[dict, np.ndarray]) -> Iterator[tuple[int, tuple]]:
        b = part // fine
        for other in range(nb):
            yield number[min(b, other), max(b, other)], (part, x[0]["features"], x[1])

    def tile(got) -> list[tuple[int, np.ndarray]]:
        sides: dict[int, list] = {}
        for x in sorted(got, key=lambda x: x[0]):
            sides.setdefault(x[0] // fine, []).append(x)
        L, R = min(sides), max(sides)
        F_, Y = ({b: np.vstack([x[c] for x in own]) for b, own in sides.items()} for c in (1, 2))
        out = []
        for b, z in zip((L, R)[: len(sides)], _product(F_[L], F_[R], Y[L], Y[R], L == R, kernel, g, degree, coef0)):
            stop = np.cumsum([len(x[1]) for x in sides[b]])
            out += [(x[0], z[at - len(x[1]) : at]) for x, at in zip(sides[b], stop)]
        return out

    def tiled(it) -> Iterator[tuple[int, np.ndarray]]:
        for (i, j), got in it:
            if i == j or len({x[0] // fine for x in got}) == 2:  # one of the blocks may have no rows
                yield from tile(got)

    def apply(y: RDD) -> RDD:
        sent = blocks.join(y, nb * fine).flatMap(lambda r: send(*r)).groupByKey(len(pairs))
        return sent.map(lambda r: (pairs[r[0]], list(r[1]))).mapPartitions(tiled).reduceByKey(operator.add, nb * fine)

    first = apply(blocks.mapValues(lambda x: x["y"]))
    return blocks.join(first, nb * fine).mapValues(lambda x: _started(*x, x[1][:, 0])), apply


def _knn_operator(rows: DataFrame, blocks: RDD, n_neighbors: int, block_rows, nb: int, fine: int):
    """The same on the sparse symmetric k-NN graph.  Each part keeps the edges of its rows; for a product it is
    sent the rows of every other part that its edges lead to."""
    g = knn_graph(rows, n_neighbors, entity="row", block_rows=block_rows).where(F.col("a") != F.col("b"))

    def pack(table: pa.Table) -> pa.Table:
        flat = {c: pa.array([table[c].to_numpy().tobytes()], pa.binary()) for c in ("a", "b", "to", "w")}
        return pa.table({"part": table["part"][:1]} | flat)

    parts = nb * fine
    edges = g.select(_block_of("a", nb, fine).alias("part"), "a", "b", _block_of("b", nb, fine).alias("to"), "w")
    packed = edges.groupBy("part").applyInArrow(pack, "part int, a binary, b binary, to binary, w binary")
    types = {"a": np.int64, "b": np.int64, "to": np.int32, "w": np.float64}
    edges = packed.rdd.map(lambda r: (r["part"], {c: np.frombuffer(r[c], t) for c, t in types.items()})).partitionBy(parts)

    def local(x: tuple[dict, dict | None]) -> dict:
        """Edges in order of their row, where its rows begin, and the place of the other row among those sent,
        which come in order of part and row."""
        e = x[1] or {c: np.empty(0, t) for c, t in types.items()}
        at = np.searchsorted(x[0]["row"], e["a"])
        order = np.argsort(at, kind="stable")
        at, b, to, w = at[order], e["b"][order], e["to"][order], e["w"][order]
        by = np.lexsort((b, to))
        new = np.r_[True, (np.diff(b[by]) != 0) | (np.diff(to[by]) != 0)][: len(by)]
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(new) - 1
        begin = np.flatnonzero(np.r_[True, np.diff(at) != 0][: len(at)])
        return {"at": at[begin], "begin": begin, "place": place, "w": w, "asks": (to[by][new], b[by][new])}

    graph = blocks.leftOuterJoin(edges, parts).mapValues(local).persist(StorageLevel.MEMORY_AND_DISK)

    def asked(part: int, x: dict) -> Iterator[tuple[int, tuple]]:
        to, b = x["asks"]
        for p in np.unique(to).tolist():
            yield p, (part, b[to == p])

    asks = graph.flatMap(lambda r: asked(*r)).groupByKey(parts)
    sends = blocks.join(asks, parts).mapValues(lambda x: [(p, np.searchsorted(x[0]["row"], b)) for p, b in x[1]]).persist(StorageLevel.MEMORY_AND_DISK)

    def multiply(x: tuple[tuple[dict, np.ndarray], Iterable | None]) -> np.ndarray:
        (own, y), got = x
        z = np.zeros(y.shape)
        if len(own["w"]):
            y = np.vstack([v for _, v in sorted(got, key=lambda m: m[0])])
            stop = np.r_[own["begin"][1:], len(own["w"])]
            for lo in range(0, len(stop), 4096):
                e0, e1 = own["begin"][lo], stop[min(lo + 4096, len(stop)) - 1]
                cells = own["w"][e0:e1, None] * y[own["place"][e0:e1]]
                z[own["at"][lo : lo + 4096]] = np.add.reduceat(cells, own["begin"][lo : lo + 4096] - e0, axis=0)
        return z

    def apply(y: RDD) -> RDD:
        def send(part: int, x: tuple[list, np.ndarray]) -> Iterator[tuple[int, tuple]]:
            for p, at in x[0]:
                yield p, (part, x[1][at])

        sent = sends.join(y, parts).flatMap(lambda r: send(*r)).groupByKey(parts)
        return graph.join(y, parts).leftOuterJoin(sent, parts).mapValues(multiply)

    def begin(x: tuple[dict, np.ndarray]) -> tuple:
        return _started(x[0], x[1], x[1][:, 0])  # the first start vector is all ones

    return blocks.join(apply(blocks.mapValues(lambda x: x["y"])), parts).mapValues(begin), apply


def _kept(S: RDD) -> RDD:
    """Reliable checkpoint of the state (files in the shared checkpoint folder), so that lineage never grows."""
    S = S.persist(StorageLevel.MEMORY_AND_DISK)
    S.checkpoint()
    return S


def _leading(apply, S: RDD, parts: int, k: int, q: int, max_iter: int, tol: float):
    """The k leading eigenpairs of A + I from the start ``S`` (part, (scale s, V, (A + I) V)), V of q
    vectors, by the locally optimal block gradient method: Rayleigh-Ritz
    on the block, its residual and its last step, one product a step.
    Returns (S, C, eigenvalues, steps); the vectors are the rows S.s times C.
    The Ritz values rise towards the eigenvalues, so the steps end; not
    settling within ``max_iter`` steps is an error, never a result."""
    S, m, last, before = _kept(S), q, None, None
    for it in range(1, max_iter + 1):
        theta, C = _ritz(*_grams(S, m), q)
        if last is not None:
            last.unpersist()  # now that S is kept
        if before is not None and np.max(np.abs(theta[:k] - before)) <= tol * max(1.0, np.max(np.abs(theta[:k]))):
            return S, C[:, :k], [float(x) for x in theta[:k]], it
        before = theta[:k]
        step = C * (np.arange(m) >= q)[:, None] if m > q else np.zeros((m, 0))
        last, S = S, _kept(_stepped(apply, S, C, step, theta, parts))
        q = C.shape[1]
        m = 2 * q + step.shape[1]
    raise RuntimeError(f"spectral: eigenvalues not settled to {tol} within {max_iter} steps")


def _stepped(apply, S: RDD, C: np.ndarray, step: np.ndarray, theta: np.ndarray, parts: int) -> RDD:
    """The Ritz vectors, their residuals and the last step, and the products of all of them."""

    def combined(x: tuple) -> tuple:
        s, v, t = x
        x, ax = v @ C, t @ C
        return s, x, ax, ax - x * theta, v @ step, t @ step

    def joined(x: tuple) -> tuple:
        (s, x, ax, r, p, ap), z = x
        return s, np.hstack([x, r, p]), np.hstack([ax, s * z + r, ap])

    X = S.mapValues(combined)
    return X.join(apply(X.mapValues(lambda x: x[0] * x[3])), parts).mapValues(joined)


def _grams(S: RDD, m: int):
    """G = v^T v and B = v^T t (m x m each) of all parts, added in a tree, so that a few of them reach the driver."""

    def part(it):
        total = np.zeros((2, m, m))
        for _, (_, v, t) in it:
            total[0] += v.T @ v
            total[1] += v.T @ t
        yield total

    return S.mapPartitions(part).treeReduce(operator.add)


def _ritz(G: np.ndarray, B: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The q largest Ritz values and their coefficients (m x q) in a basis with
    Gram matrix G; directions that the basis has twice are left out."""
    size = np.sqrt(np.maximum(np.diag(G), 0.0))
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    g, U = np.linalg.eigh(scale[:, None] * (G + G.T) / 2 * scale)
    keep = g > 1e-10 * g.max()
    L = scale[:, None] * U[:, keep] / np.sqrt(g[keep])
    w, Y = np.linalg.eigh(L.T @ ((B + B.T) / 2) @ L)
    top = np.argsort(w)[::-1][:q]
    return w[top], L @ Y[:, top]


def _embed(rows: DataFrame, S: RDD, C: np.ndarray) -> DataFrame:
    """(entity, features): the rows of V C divided by sqrt(degree), each column's sign fixed."""
    k = C.shape[1]

    def vectors(x: tuple) -> np.ndarray:
        s, v, _ = x[1]
        return s * (v @ C)  # s is 1 / sqrt(degree), or 1

    def largest(u: np.ndarray) -> np.ndarray:
        return u[np.abs(u).argmax(axis=0), np.arange(k)]

    # sign of each component: the entry with the largest absolute value is made positive
    far = S.map(lambda r: largest(vectors(r[1]))).treeReduce(lambda a, b: np.where(np.abs(a) >= np.abs(b), a, b))
    sign = np.where(far >= 0, 1.0, -1.0)
    packed = S.map(lambda r: (r[1][0].tobytes(), (vectors(r[1]) * sign).tobytes()))

    def unpack(it):
        for pdf in it:
            for at, u in zip(pdf["row"], pdf["u"]):
                yield pd.DataFrame({"row": np.frombuffer(at, np.int64), "features": list(np.frombuffer(u).reshape(-1, k))})

    flat = rows.sparkSession.createDataFrame(packed, "row binary, u binary").mapInPandas(unpack, "row long, features array<double>")
    return rows.select("row", "entity").join(flat, "row").select("entity", "features")
