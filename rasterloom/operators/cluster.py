"""Clustering of pixels: whole image, tile by tile with a registry, a pass for rare phases, and kNN assignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import hdbscan
from .pixels import Cube, cell, sequential_moments, subsample_ids

LABELS = "pixel_id long, row int, col int, label int, prob float"


def _fit_and_label(features: DataFrame, min_cluster_size: int, min_samples: int, subsample_n: int, seed: int) -> DataFrame:
    """Fit on all pixels or a seeded draw of them in one task; a fitted draw labels every pixel, in parallel."""
    n = features.count()
    ids = subsample_ids(n, subsample_n, seed)
    if ids is None:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pixel_id")
            m = hdbscan.fit(np.stack(pdf["f"].to_numpy()), min_cluster_size, min_samples)
            return pdf[["pixel_id", "row", "col"]].assign(label=m.labels.astype("int32"), prob=m.probabilities.astype("float32"))

        return features.withColumn("fit", F.lit(1)).groupBy("fit").applyInPandas(run, LABELS)  # the fit is one task; its size is checked
    spark = features.sparkSession
    drawn = spark.createDataFrame(pd.DataFrame({"pixel_id": np.sort(ids)}))
    sample = features.join(F.broadcast(drawn), "pixel_id", "left_semi").select("pixel_id", "f").toPandas().sort_values("pixel_id")
    shared = spark.sparkContext.broadcast(hdbscan.fit(np.stack(sample["f"].to_numpy()), min_cluster_size, min_samples))

    def label(batches):
        for pdf in batches:
            if len(pdf):
                labels, prob = hdbscan.predict(shared.value, np.stack(pdf["f"].to_numpy()))
                yield pdf[["pixel_id", "row", "col"]].assign(label=labels.astype("int32"), prob=prob.astype("float32"))

    return features.mapInPandas(label, LABELS)


def hdbscan_global(features: DataFrame, min_cluster_size: int = 1000, min_samples: int = 0, subsample_n: int = 0, random_state: int = 42) -> DataFrame:
    return _fit_and_label(features, min_cluster_size, min_samples, subsample_n, random_state)


def tile_grid(pixels: DataFrame, tile_size: int, min_tile_pixels: int) -> DataFrame:
    """(tile_id, tr, tc, n_pixels): tiles with enough pixels, numbered in row-major order."""
    at = [F.floor(F.col(c) / tile_size).cast("int").alias(n) for c, n in (("row", "tr"), ("col", "tc"))]
    tiles = pixels.groupBy(*at).agg(F.count("*").alias("n_pixels"))
    if min_tile_pixels < 1:  # empty tiles count as well, so that numbers do not shift
        rows, cols = tiles.agg(F.coalesce(F.max("tr") + 1, F.lit(0)), F.coalesce(F.max("tc") + 1, F.lit(0))).first()
        grid = pixels.sparkSession.range(rows * cols).select(F.floor(F.col("id") / max(cols, 1)).cast("int").alias("tr"), (F.col("id") % max(cols, 1)).cast("int").alias("tc"))
        tiles = grid.join(tiles, ["tr", "tc"], "left").fillna(0, ["n_pixels"])
    tiles = tiles.filter(F.col("n_pixels") >= min_tile_pixels)
    return tiles.withColumn("tile_id", (F.row_number().over(W.orderBy("tr", "tc")) - 1).cast("int"))  # a row a tile


def deferred_pixels(labels: DataFrame, tile_size: int, least: int) -> DataFrame:
    """Pixels of the tiles that hold fewer than ``least`` clusters; a later pass takes them up."""
    keyed = labels.withColumns({"tr": F.floor(F.col("row") / tile_size), "tc": F.floor(F.col("col") / tile_size)})
    poor = keyed.groupBy("tr", "tc").agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n")).filter(F.col("n") < least)
    return keyed.join(poor.select("tr", "tc"), ["tr", "tc"], "left_semi").drop("tr", "tc")


def fingerprint_means(labels: DataFrame, cube: Cube, keys: list[str], accumulate: str = "float64") -> DataFrame:
    """Mean of every channel by ``keys`` over assigned pixels, and their number; rows without a key are left out of float32 sums."""
    joined = labels.filter("label >= 0").join(cube.df, ["row", "col"])
    if accumulate == "float32":
        found = sequential_moments(joined.dropna(subset=keys), keys, list(cube.channels), spread=False)
        rows = [(*k, n, mean.astype(float).tolist()) for k, n, mean, _ in found]
        return labels.sparkSession.createDataFrame(rows, ", ".join(f"`{k}` int" for k in keys) + ", n_pixels long, mean array<double>")
    return joined.groupBy(*keys).agg(F.count("*").alias("n_pixels"), F.array(*(F.avg(cell(c)) for c in cube.channels)).alias("mean"))


def best_match(mean: np.ndarray, registry: list[dict], threshold: float) -> int | None:
    """The registry entry of largest cosine, if that reaches the threshold; a zero vector matches none."""
    best, place = -np.inf, None
    for i, e in enumerate(registry):
        scale = np.linalg.norm(mean) * np.linalg.norm(e["mean"])
        if scale > 0 and (c := float(mean @ e["mean"]) / scale) > best:
            best, place = c, i
    return place if place is not None and best >= threshold else None


def register(registry: list[dict], prints: list[tuple[int, int, np.ndarray]], threshold: float, tile: int) -> tuple[dict[int, int], list[int]]:
    """Folds one tile's clusters into the registry; all are matched before any is added."""
    found = [(label, n, mean, best_match(mean, registry, threshold)) for label, n, mean in sorted(prints, key=lambda p: p[0])]
    merged, new = {}, []
    for label, n, mean, place in found:
        if place is None:
            registry.append({"global_id": len(registry), "mean": mean.astype(np.float64), "n_pixels": n, "discovered_in_tile": tile, "contributions": {tile: n} if tile >= 0 else {}})
            new.append(len(registry) - 1)
            merged[label] = len(registry) - 1
        else:
            e = registry[place]
            e["mean"] = (e["mean"] * e["n_pixels"] + mean * n) / (e["n_pixels"] + n)
            e["n_pixels"] += n
            if tile >= 0:
                e["contributions"][tile] = n
            merged[label] = e["global_id"]
    return merged, new


def hdbscan_tiled(features: DataFrame, cube: Cube, tile_size: int = 512, min_cluster_size: int = 1000, min_samples: int = 0, subsample_n: int = 0, random_state: int = 42, merge_threshold: float = 0.92, min_tile_pixels: int = 0, min_clusters_per_tile: int = 3, accumulate: str = "float64"):
    """(labels, tiles, registry): a fit for each tile in parallel, then a fold of tile clusters in tile order.

    A tile with too few clusters is deferred: its pixels stay unassigned for the end.
    The fold runs on the driver over one small row for each tile cluster.
    """
    least = min_tile_pixels or 2 * min_cluster_size
    grid = tile_grid(features, tile_size, least)
    tiled = features.withColumn("tr", F.floor(F.col("row") / tile_size)).withColumn("tc", F.floor(F.col("col") / tile_size)).join(F.broadcast(grid), ["tr", "tc"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pixel_id").reset_index(drop=True)
        x = np.stack(pdf["f"].to_numpy())
        if pd.isna(pdf["tile_id"].iloc[0]):
            labels, prob = np.full(len(x), -1), np.zeros(len(x))
        else:
            ids = subsample_ids(len(x), subsample_n, random_state)
            m = hdbscan.fit(x if ids is None else x[np.sort(ids)], min_cluster_size, min_samples)
            labels, prob = (m.labels, m.probabilities) if ids is None else hdbscan.predict(m, x)
        return pdf[["pixel_id", "row", "col", "tile_id"]].assign(label=labels.astype("int32"), prob=prob.astype("float32"))

    local = tiled.groupBy("tr", "tc").applyInPandas(run, "pixel_id long, row int, col int, tile_id int, label int, prob float").persist()
    counts = {r.tile_id: r for r in local.filter("tile_id is not null").groupBy("tile_id").agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n"), F.sum((F.col("label") < 0).cast("long")).alias("noise"), F.count("*").alias("size")).collect()}
    prints: dict[int, list] = {}
    for r in fingerprint_means(local, cube, ["tile_id", "label"], accumulate).filter("tile_id is not null").collect():
        prints.setdefault(r.tile_id, []).append((r.label, r.n_pixels, np.array(r["mean"])))
    registry, tiles, moves = [], [], []
    for t in sorted(counts):
        deferred = counts[t].n < min_clusters_per_tile
        merged, new = ({}, []) if deferred else register(registry, prints.get(t, []), merge_threshold, t)
        tiles.append({"tile_id": t, "n_pixels": counts[t].size, "n_clusters": counts[t].n, "n_noise": counts[t].size if deferred else counts[t].noise, "deferred": deferred, "merge_map": merged, "new_phases": new})
        moves += [(t, a, b) for a, b in merged.items()]
    spark = features.sparkSession
    to = spark.createDataFrame(moves, "tile_id int, label int, phase int")
    labels = local.join(F.broadcast(to), ["tile_id", "label"], "left").select("pixel_id", "row", "col", F.coalesce("phase", F.lit(-1)).alias("label"), F.when(F.col("phase").isNotNull(), F.col("prob")).otherwise(0.0).cast("float").alias("prob"), "tile_id")
    return labels, tiles, registry


def rare_phase(labels: DataFrame, features: DataFrame, cube: Cube, tiles: list[dict], registry: list[dict], min_cluster_size: int = 50, min_samples: int = 0, subsample_n: int = 500_000, merge_threshold: float = 0.92, random_state: int = 42, accumulate: str = "float64"):
    """A second pass over unassigned pixels of tiles that were not deferred; probabilities stay as they are."""
    deferred = [t["tile_id"] for t in tiles if t["deferred"]]
    pool = labels.filter((F.col("label") < 0) & ~F.coalesce(F.col("tile_id").isin(deferred) if deferred else F.lit(False), F.lit(False)))
    chosen = features.join(pool.select("pixel_id"), "pixel_id", "left_semi")
    size = chosen.count()
    if size < min_cluster_size:
        return labels, registry
    if subsample_n < size:
        ranks = chosen.withColumn("old_id", F.col("pixel_id"))
        from .pixels import pixel_ids

        ranks = pixel_ids(ranks.drop("pixel_id")).persist()
        found = _fit_and_label(ranks, min_cluster_size, min_samples, subsample_n, random_state).join(ranks.select("pixel_id", "old_id"), "pixel_id").select(F.col("old_id").alias("pixel_id"), "row", "col", "label", "prob")
    else:
        found = _fit_and_label(chosen, min_cluster_size, min_samples, 0, random_state)
    found = found.persist()
    prints = [(r.label, r.n_pixels, np.array(r["mean"])) for r in fingerprint_means(found, cube, ["label"], accumulate).collect()]
    registry = [{**e, "contributions": dict(e["contributions"])} for e in registry]
    merged, _ = register(registry, prints, merge_threshold, -1)
    to = labels.sparkSession.createDataFrame(list(merged.items()), "local int, phase int")
    moved = found.join(F.broadcast(to), found.label == to.local).select("pixel_id", "phase")
    return labels.join(moved, "pixel_id", "left").withColumn("label", F.coalesce("phase", "label")).drop("phase"), registry


@dataclass(frozen=True)
class Cells:
    """A k-d split of feature space into boxes without gaps; node 0 is all of it, and leaves are the cells."""

    axis: np.ndarray  # -1 in a leaf
    cut: np.ndarray  # coordinates from here on lie to the right
    left: np.ndarray  # the right child is the next node
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, cells: int) -> Cells:
        """About ``cells`` boxes that hold equal shares of ``points``, cut where they spread most."""
        wide = points.shape[1]
        axis, cut, left, low, high = [-1], [0.0], [0], [np.full(wide, -np.inf)], [np.full(wide, np.inf)]
        share, ready = max(1.0, len(points) / max(1, cells)), [(0, np.arange(len(points)))]
        while ready:
            node, who = ready.pop()
            if len(who) < 2 * share:
                continue
            part = points[who]
            along = int(np.ptp(part, axis=0).argmax())
            values = part[:, along]
            at = np.median(values)
            at = at if at > values.min() else min(values[values > at], default=None)
            if at is None:  # all points are equal
                continue
            axis[node], cut[node], left[node] = along, float(at), len(axis)
            for side, mine in ((0, values < at), (1, values >= at)):
                lo, hi = low[node].copy(), high[node].copy()
                (lo if side else hi)[along] = at
                ready.append((len(axis), who[mine]))
                axis, cut, left, low, high = [*axis, -1], [*cut, 0.0], [*left, 0], [*low, lo], [*high, hi]
        return cls(np.array(axis), np.array(cut), np.array(left), np.array(low), np.array(high))

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(x), dtype=np.int64)
        while len(inner := np.flatnonzero(self.axis[at] >= 0)):
            node = at[inner]
            at[inner] = self.left[node] + (x[inner, self.axis[node]] >= self.cut[node])
        return at

    def reached(self, x: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        """For each point the cells that come as near as ``reach``, by descent from the whole."""
        limit, ready = reach * (1 + 1e-9), [(0, np.arange(len(x)))]
        found, of = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while ready:
            node, who = ready.pop()
            gap = np.maximum(np.maximum(self.low[node] - x[who], x[who] - self.high[node]), 0.0)
            who = who[np.sqrt((gap * gap).sum(axis=1)) <= limit[who]]
            if not len(who):
                continue
            if self.axis[node] < 0:
                found.append(np.full(len(who), node))
                of.append(who)
            else:
                ready += [(self.left[node], who), (self.left[node] + 1, who)]
        found, of = np.concatenate(found), np.concatenate(of)
        by = np.argsort(of, kind="stable")
        return np.split(found[by], np.cumsum(np.bincount(of, minlength=len(x)))[:-1])


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``y`` and distances of the ``k`` nearest of each row of ``x``, from differences; ties to the first."""
    d = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d += (x[:, i, None] - y[None, :, i]) ** 2
    k = min(k, len(y))
    pick = np.argpartition(d, k - 1, axis=1)[:, :k]
    tied = np.flatnonzero((d <= np.take_along_axis(d, pick, 1).max(axis=1)[:, None]).sum(axis=1) > k)
    pick[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return pick, np.sqrt(np.take_along_axis(d, pick, 1))


def _meet(asked: DataFrame, there: DataFrame, k: int, block: int) -> DataFrame:
    """(pixel_id, label, d, other): the ``k`` nearest of ``there`` (r_id, r_f, r_label, cell) for ``asked`` (q_id, q_f, cell) in each block.

    A cell of more than ``block`` rows on a side is cut by hash, so that every task holds
    at most about one block of each side; a count a cell is broadcast for that.
    """
    sizes = asked.groupBy("cell").agg(F.count("*").alias("nq")).join(there.groupBy("cell").agg(F.count("*").alias("nr")), "cell")
    sizes = F.broadcast(sizes.select("cell", F.ceil(F.col("nq") / block).cast("int").alias("qs"), F.ceil(F.col("nr") / block).cast("int").alias("rs")))  # a row a cell
    left = asked.join(sizes, "cell").select("cell", "q_id", "q_f", F.pmod(F.xxhash64("q_id"), "qs").cast("int").alias("q_part"), F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("r_part"))
    right = there.join(sizes, "cell").select(F.col("cell").alias("at"), "r_id", "r_f", "r_label", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("of_q"), F.pmod(F.xxhash64("r_id"), "rs").cast("int").alias("of_r"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"pixel_id": pd.Series(dtype="int64"), "label": pd.Series(dtype="int32"), "d": pd.Series(dtype="float64"), "other": pd.Series(dtype="int64")})]
        if len(a) and len(b):
            b = b.sort_values("r_id")
            x, y = np.stack(a["q_f"].to_numpy()).astype(float), np.stack(b["r_f"].to_numpy()).astype(float)
            ids, label, asking = b["r_id"].to_numpy(), b["r_label"].to_numpy(), a["q_id"].to_numpy()
            for lo in range(0, len(x), 256):
                pick, d = _nearest(x[lo : lo + 256], y, k)
                out.append(pd.DataFrame({"pixel_id": np.repeat(asking[lo : lo + 256], pick.shape[1]), "label": label[pick].ravel(), "d": d.ravel(), "other": ids[pick].ravel()}))
        return pd.concat(out[1:] or out)

    return left.groupBy("cell", "q_part", "r_part").cogroup(right.groupBy("at", "of_q", "of_r")).applyInPandas(near, "pixel_id long, label int, d double, other long")


def knn_vote(unassigned: DataFrame, assigned: DataFrame, k: int = 5, block: int = 4096, most_cells: int = 16_384) -> DataFrame:
    """(pixel_id, label): the vote of the ``k`` nearest assigned pixels by 1/distance.

    Neighbours at distance zero alone count where there are any; ties go to the lowest
    pixel, then label; k is clamped to the assigned pixels. Exact: feature space is cut into cells
    of about ``block`` assigned pixels (``most_cells`` at most; fuller cells take more
    tasks), by cuts learned from a bounded draw. A pixel first asks its own cell, then
    those cells that come as near as the k-th neighbour found there. Of equal assigned
    features only the ``k`` lowest pixels are kept, as no more can be among the nearest.
    """
    first = F.row_number().over(W.partitionBy("r_f").orderBy("r_id"))
    # Both sides may come from one frame, so their columns get names of their own.
    there = assigned.select(F.col("pixel_id").alias("r_id"), F.col("f").cast("array<double>").alias("r_f"), F.col("label").alias("r_label")).withColumn("first", first).filter(F.col("first") <= k).drop("first")
    asked = unassigned.select(F.col("pixel_id").alias("q_id"), F.col("f").cast("array<double>").alias("q_f"))
    n = there.count()
    if not n:
        return asked.select(F.col("q_id").alias("pixel_id"), F.lit(0).alias("label")).limit(0)
    cells = min(most_cells, -(-n // block))
    wide = there.select(F.size("r_f")).first()[0]
    drawn = min(32 * cells, (1 << 22) // max(1, wide)) if cells > 1 else 1
    points = np.array([r[0] for r in there.select("r_f").sample(min(1.0, drawn / n), seed=5).limit(2 * drawn).collect()]).reshape(-1, wide)
    tree = unassigned.sparkSession.sparkContext.broadcast(Cells.of(points, cells) if len(points) else Cells.of(np.zeros((1, wide)), 1))

    def homes(df: DataFrame, vector: str) -> DataFrame:
        @F.pandas_udf("long")
        def home(v: pd.Series) -> pd.Series:
            return pd.Series(tree.value.home(np.stack(v.to_numpy())) if len(v) else [], dtype="int64")

        return df.withColumn("cell", home(vector))

    there, asked = homes(there, "r_f"), homes(asked, "q_f")
    here = _best(_meet(asked, there, k, block), k)
    if cells == 1:
        return vote(here)
    reach = here.groupBy("pixel_id").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("reach"))

    @F.pandas_udf("array<long>")
    def others(v: pd.Series, r: pd.Series, own: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        cells = tree.value.reached(np.stack(v.to_numpy()), r.to_numpy(dtype=float))
        return pd.Series([c[c != o] for c, o in zip(cells, own)])

    further = asked.join(reach, F.col("q_id") == F.col("pixel_id"), "left").select("q_id", "q_f", F.explode(others("q_f", F.coalesce("reach", F.lit(float("inf"))), "cell")).alias("cell"))
    return vote(_best(here.unionByName(_meet(further, there, k, block)), k))


def _best(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("pixel_id").orderBy("d", "other"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def vote(near: DataFrame) -> DataFrame:
    """(pixel_id, label) from (pixel_id, label, d): weights 1/d, or zero distances alone; the lowest label of equals."""
    zero = F.max((F.col("d") == 0).cast("int")).over(W.partitionBy("pixel_id"))
    weighed = near.withColumn("zero", zero).withColumn("w", F.when(F.col("zero") == 1, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d")))
    sums = weighed.groupBy("pixel_id", "label").agg(F.sum("w").alias("w"))
    best = F.row_number().over(W.partitionBy("pixel_id").orderBy(F.desc("w"), "label"))
    return sums.withColumn("best", best).filter("best = 1").select("pixel_id", "label")


def noise_assign(labels: DataFrame, features: DataFrame, k: int = 5, when_none: int | None = None) -> DataFrame:
    """Labels with every unassigned pixel voted by its neighbours; probabilities pass through.

    Without any assigned pixel all take ``when_none``, or an error is raised.
    """
    if not labels.filter("label >= 0").head(1):
        if when_none is None:
            from ..errors import FlowError

            raise FlowError("noise_assign: no pixel is assigned")
        return labels.withColumn("label", F.lit(when_none))
    rich = features.select("pixel_id", "f").join(labels.select("pixel_id", "label"), "pixel_id")
    got = knn_vote(rich.filter("label < 0"), rich.filter("label >= 0"), k).withColumnRenamed("label", "voted")
    return labels.join(got, "pixel_id", "left").withColumn("label", F.coalesce("voted", "label")).drop("voted")
