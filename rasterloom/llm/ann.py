"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable


# --- a graph over one shard ---------------------------------------------------------------


def _square(a: np.ndarray) -> np.ndarray:
    return np.einsum("...d,...d->...", a, a)


def beam(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: the ``width`` nearest points found, and their squared distances.

    Every step expands the nearest point of each beam that was not yet expanded; a
    beam ends when it has none. Distances are squares of differences, which neither a
    common offset nor tight clusters cancel.
    """
    n, rows = len(x), len(queries)
    width = min(width, n)
    seen = np.zeros((rows, n), dtype=bool)
    ids = np.full((rows, width + graph.shape[1]), -1, dtype=np.int64)
    dist = np.full(ids.shape, np.inf, dtype=x.dtype)
    done = np.ones(ids.shape, dtype=bool)
    m = min(len(entry), width)
    ids[:, :m], done[:, :m], seen[:, entry[:m]] = entry[:m], False, True
    for i, point in enumerate(entry[:m]):
        dist[:, i] = _square(queries - x[point])
    live = np.arange(rows)
    while len(live):
        d = np.where(done[live, :width], np.inf, dist[live, :width])
        pick = d.argmin(axis=1)
        open_ = np.isfinite(d[np.arange(len(live)), pick])
        live, pick = live[open_], pick[open_]
        if not len(live):
            break
        done[live, pick] = True
        near = graph[ids[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        far = np.full(near.shape, np.inf, dtype=x.dtype)
        far[r, c] = _square(x[near[r, c]] - queries[live[r]])
        ids[live, width:] = np.where(fresh, near, -1)
        dist[live, width:] = far
        done[live, width:] = ~fresh
        order = np.argsort(dist[live], axis=1, kind="stable")[:, :width]
        for a in (ids, dist, done):
            a[live, :width] = np.take_along_axis(a[live], order, axis=1)
    return ids[:, :width], dist[:, :width]


def prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: the nearest candidate stays and drops all that are ``alpha`` times nearer to it than to the point."""
    valid = (candidates >= 0) & (candidates != points[:, None])
    safe = np.maximum(candidates, 0)
    v = x[safe]
    d = np.where(valid, _square(v - x[points][:, None, :]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    safe, d, v = np.take_along_axis(safe, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    same = np.zeros(d.shape, dtype=bool)  # a candidate listed twice
    by_id = np.argsort(np.where(np.isfinite(d), safe, -1), axis=1, kind="stable")
    sorted_ids = np.take_along_axis(np.where(np.isfinite(d), safe, -1), by_id, 1)
    np.put_along_axis(same, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
    d = np.where(same, np.inf, d)
    rows, out = np.arange(len(points)), np.full((len(points), degree), -1, dtype=np.int64)
    alive = np.isfinite(d)
    for k in range(degree):
        left = np.where(alive, d, np.inf)
        pick = left.argmin(axis=1)
        has = np.isfinite(left[rows, pick])
        if not has.any():
            break
        out[has, k] = safe[rows, pick][has]
        r, c = np.nonzero(alive)
        between = _square(v[r, c] - v[r, pick[r]])
        alive[r, c] = alpha * alpha * between > d[r, c]
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = 24, width: int = 64, alpha: float = 1.2, batch: int = 256, passes: int = 1, spare: int = 16, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Out-neighbours of each point (-1 where fewer) and the entry points, the medoid first.

    Points enter in random order, a batch at a time: a greedy search proposes
    neighbours, pruning keeps diverse ones, and the edges are returned. A point whose
    returned edges exceed ``spare`` beyond its degree is pruned again.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = np.array([int(_square(x - x.mean(axis=0)).argmin())])
    graph = np.full((n, degree + spare), -1, dtype=np.int64)  # edges from the left, free places behind
    if n > 1:
        fill = min(degree // 2, n - 1)
        graph[:, :fill] = (np.arange(n)[:, None] + rng.integers(1, n, (n, fill))) % n

    def cut(points: np.ndarray, candidates: np.ndarray, a: float) -> None:
        for lo in range(0, len(points), 512):
            part = slice(lo, lo + 512)
            graph[points[part], :degree] = prune(x, points[part], candidates[part], degree, a)
            graph[points[part], degree:] = -1

    for turn in range(passes):
        a = 1.0 if turn < passes - 1 else alpha
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            points = order[lo : lo + batch]
            found, _ = beam(x, graph, entry, x[points], width)
            cut(points, np.concatenate([found, graph[points]], axis=1), a)
            source = np.repeat(points, degree)
            target = graph[points, :degree].ravel()
            source, target = source[target >= 0], target[target >= 0]
            new = ~(graph[target] == source[:, None]).any(axis=1)
            source, target = source[new], target[new]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            touched, first, count = np.unique(target, return_index=True, return_counts=True)
            if not len(touched):
                continue
            used = (graph[touched] >= 0).sum(axis=1)
            roomy = used + count <= degree + spare
            slot = np.arange(len(target)) - np.repeat(first, count)
            easy = np.repeat(roomy, count)
            graph[target[easy], (slot + np.repeat(used, count))[easy]] = source[easy]
            added = np.full((len(touched), int(count.max())), -1, dtype=np.int64)
            added[np.repeat(np.arange(len(touched)), count), slot] = source
            cut(touched[~roomy], np.concatenate([graph[touched[~roomy]], added[~roomy]], axis=1), a)
    over = np.flatnonzero((graph >= 0).sum(axis=1) > degree)
    cut(over, graph[over], alpha)
    return graph[:, :degree], entry


def centred(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The centre and the largest distance of a coordinate from it; vectors less the one by the other are of order one."""
    top = max(float(np.abs(x).max()), np.finfo(float).tiny)
    middle = (x / top).mean(axis=0) * top
    return middle, max(float(np.abs(x / top - middle / top).max() * top), np.finfo(float).tiny)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; of components too large or small to square, by scaling first."""
    with np.errstate(over="ignore", under="ignore"):
        d = a - b
        out = np.sqrt((d**2).sum(axis=-1))
        odd = ~np.isfinite(out) | ((out < 1e-150) & (d != 0).any(axis=-1))
        if odd.any():
            top = np.abs(a[odd] / 2 - b[odd] / 2 if a.shape == b.shape else np.broadcast_to(a, d.shape)[odd] / 2 - np.broadcast_to(b, d.shape)[odd] / 2)
            most = np.maximum(top.max(axis=-1, keepdims=True), np.finfo(float).tiny)
            out[odd] = 2 * most[..., 0] * np.sqrt(((top / most) ** 2).sum(axis=-1))
    return out


# --- on the cluster -----------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return v.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))


def build_index(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 16_384, degree: int = 24, width: int = 64, alpha: float = 1.2) -> DataFrame:
    """One row per shard: its dimension, vectors, graph, entry points, and the ids of each vector.

    Every usable row is indexed. Rows are dealt by hash of the id to shards of about
    ``shard_rows``, so a shard fits a task whatever the data. Equal vectors of a shard
    are one point with all their ids. Rows repeated with one id count once (the least
    vector). The graph is built on the shard's vectors less their mean, in double
    precision, scaled to order one. The index is written to the shared folder.
    """
    rows = vectors(table, id_col, vec_col)
    n = rows.count()
    shards = max(1, -(-n // shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[tuple(v) for v in pdf["v"]]).sort_values(["id", "key"], kind="stable").drop_duplicates("id")
        x64 = np.stack(pdf["v"].to_numpy()).astype(np.float64) + 0.0
        x64, inverse = np.unique(x64, axis=0, return_inverse=True)
        by = np.argsort(inverse.ravel(), kind="stable")
        middle, scale = centred(x64)
        graph, entry = build_graph(x64 / scale - middle / scale, degree, width, alpha)
        out = {"shard": int(pdf["shard"].iloc[0]), "dim": int(pdf["dim"].iloc[0]), "x": x64.tobytes(), "graph": graph.astype(np.int32).tobytes(), "entry": entry.tolist(), "ids": pdf["id"].to_numpy()[by].tolist(), "count": np.bincount(inverse.ravel()).tolist()}
        return pd.DataFrame([out])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    kinds = "shard int, dim int, x binary, graph binary, entry array<long>, ids array<long>, count array<long>"
    return durable(dealt.groupBy("shard", "dim").applyInPandas(run, kinds))


def search(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, width: int = 256, block_rows: int = 4096) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score.

    Queries meet every shard in blocks of ``block_rows``, so a task holds one shard and
    one block. A beam of ``width`` walks each shard's graph; all that it holds is measured
    again in double precision on the original vectors. Nearest first, ties to the
    smaller id; a query never finds its own id; shards of another dimension take no
    part; a repeated query id is asked once.
    """
    asked = vectors(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n = asked.count()
    blocks = max(1, -(-n // block_rows))
    places = index.select("shard", "dim").withColumn("rows", F.lit(1))
    shards = places.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0] + 1
    if not shards or not n:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(graphs) or not len(asked):
            return empty
        g = graphs.iloc[0]
        x64 = np.frombuffer(g["x"], dtype=np.float64).reshape(-1, int(g["dim"]))
        graph = np.frombuffer(g["graph"], dtype=np.int32).reshape(len(x64), -1).astype(np.int64)
        count, ids = np.asarray(g["count"], dtype=np.int64), np.asarray(g["ids"], dtype=np.int64)
        first = np.cumsum(count) - count
        q64 = np.stack(asked["v"].to_numpy()).astype(np.float64)
        qid = asked["id"].to_numpy()
        query, vec, score = [], [], []
        middle, scale = centred(x64)
        near = x64 / scale - middle / scale
        step = max(16, min(128, (1 << 26) // len(x64)))  # bounds the marks of visited points
        for lo in range(0, len(q64), step):
            q = q64[lo : lo + step]
            with np.errstate(over="ignore"):
                asked_at = np.clip(q / scale - middle / scale, -1e150, 1e150)
            found, _ = beam(near, graph, np.asarray(g["entry"], dtype=np.int64), asked_at, width)
            exact = distances(x64[np.maximum(found, 0)], q[:, None, :])
            for i in range(len(q)):
                some = found[i] >= 0
                mine = np.concatenate([ids[first[p] : first[p] + min(count[p], k + 1)] for p in found[i][some]])  # ids ascend, so k + 1 hold the k least others
                dist = np.repeat(exact[i][some], np.minimum(count[found[i][some]], k + 1))
                dist, mine = dist[mine != qid[lo + i]], mine[mine != qid[lo + i]]
                best = np.lexsort((mine, dist))[:k]
                query.append(np.full(len(best), qid[lo + i]))
                vec.append(mine[best])
                score.append(dist[best])
        return pd.DataFrame({"query_id": np.concatenate(query), "vec_id": np.concatenate(vec), "score": np.concatenate(score)})

    found = left.groupBy("shard", "dim", "block").cogroup(right.groupBy("shard", "dim", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
