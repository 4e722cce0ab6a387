"""Splits of phases: thresholds, mixtures, and full-resolution ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import FlowError
from ..functions.grammar import feature, rule_column
from .pixels import Cube, subsample_ids


def next_label(labels: DataFrame) -> int:
    return int(labels.agg(F.coalesce(F.max("label"), F.lit(-1))).first()[0]) + 1


def split_threshold(labels: DataFrame, cube: Cube, target: int, rule: str) -> tuple[DataFrame, int]:
    """Pixels of the target that meet the rule take the next label; (labels, -1) where none does."""
    rich = labels.join(cube.df, ["row", "col"], "left").withColumn("hit", (F.col("label") == target) & F.coalesce(rule_column(rule, list(cube.channels)), F.lit(False)))
    new = next_label(labels)
    hits = rich.filter("hit").count()
    return (rich.withColumn("label", F.when(F.col("hit"), F.lit(new)).otherwise(F.col("label"))).select(*labels.columns), new) if hits else (labels, -1)


def fit_mixture(x: np.ndarray, k: int, seed: int = 42, starts: int = 5, rounds: int = 200, tol: float = 1e-5, floor: float = 1e-6):
    """Full-covariance mixture by expectation-maximisation, the best of several seeded starts: weights, means, covariances."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        means = [x[rng.integers(len(x))]]
        while len(means) < k:
            d = np.min([((x - m) ** 2).sum(1) for m in means], axis=0)
            means.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        means, share = np.array(means), np.full(k, 1 / k)
        cov, last = np.array([np.cov(x.T).reshape(x.shape[1], x.shape[1]) + floor * np.eye(x.shape[1])] * k), -np.inf
        for _ in range(rounds):
            log = log_density(x, share, means, cov)
            peak = log.max(1, keepdims=True)
            norm = peak + np.log(np.exp(log - peak).sum(1, keepdims=True))
            r = np.exp(log - norm)
            n = r.sum(0) + 1e-12
            share, means = n / len(x), (r.T @ x) / n[:, None]
            cov = np.array([((r[:, j, None] * (x - means[j])).T @ (x - means[j])) / n[j] + floor * np.eye(x.shape[1]) for j in range(k)])
            if norm.mean() - last < tol:
                break
            last = norm.mean()
        if best is None or norm.mean() > best[0]:
            best = (norm.mean(), share, means, cov)
    return best[1:]


def log_density(x, share, means, cov) -> np.ndarray:
    out = []
    for w, m, c in zip(share, means, cov):
        half = np.linalg.cholesky(c)
        z = np.linalg.solve(half, (x - m).T)
        out.append(np.log(w + 1e-300) - 0.5 * (z * z).sum(0) - np.log(np.diag(half)).sum() - 0.5 * len(m) * np.log(2 * np.pi))
    return np.stack(out, axis=1)


def split_gmm(labels: DataFrame, cube: Cube, target: int, features: list[str], n_components: int = 2, bse_weight: float = 1.0, subsample_n: int = 500_000, seed: int = 42, keep_parent: bool = True, order_by: str = "") -> tuple[DataFrame, dict]:
    """Splits a phase by a mixture on scaled features.

    Features are scaled by population statistics of the phase, in one aggregate; the fit
    runs on a bounded draw, the components of all pixels by Arrow batches. With
    ``keep_parent`` the largest component keeps the label; others take new labels by
    ascending ``order_by`` mean, or by size. A phase of fewer than 10 pixels a component
    is left as it is.
    """
    if order_by and order_by not in features:
        raise FlowError(f"order_by: {order_by!r} is not one of the features")
    channels = [c for c in cube.df.columns if c not in ("row", "col")]
    inside = labels.filter(F.col("label") == target).join(cube.df, ["row", "col"]).select("pixel_id", *(feature(t, channels).alias(f"x{i}") for i, t in enumerate(features)))
    got = inside.agg(F.count("*"), *(f(f"x{i}") for i in range(len(features)) for f in (F.avg, F.stddev_pop))).first()
    n = got[0]
    if n < 10 * n_components:
        return labels, {"skipped": True, "n": n, "new_labels": []}
    scaled = inside.select("pixel_id", F.array(*((F.col(f"x{i}") - F.lit(got[1 + 2 * i])) / F.lit(got[2 + 2 * i] or 1.0) * F.lit(bse_weight if t.upper() == "BSE" else 1.0) for i, t in enumerate(features))).alias("f"))
    drawn = scaled
    if subsample_n and subsample_n < n:
        ordered = [r.pixel_id for r in scaled.select("pixel_id").orderBy("pixel_id").toLocalIterator()]
        ids = subsample_ids(n, subsample_n, seed)
        drawn = scaled.join(labels.sparkSession.createDataFrame([(ordered[i],) for i in ids], "pixel_id long"), "pixel_id", "left_semi")
    share, means, cov = fit_mixture(np.stack(drawn.orderBy("pixel_id").toPandas()["f"].to_numpy()), n_components, seed)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["pixel_id"]].assign(part=log_density(np.stack(pdf["f"].to_numpy()), share, means, cov).argmax(1).astype("int32"))

    parts = scaled.mapInPandas(assign, "pixel_id long, part int").persist()
    sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    order = sorted(sizes, key=(lambda j: means[j][features.index(order_by)]) if order_by else (lambda j: (-sizes[j], j)))
    kept = max(sizes, key=lambda j: (sizes[j], -j)) if keep_parent else None
    new, moves = next_label(labels), {}
    for j in order:
        moves[j] = target if j == kept else new
        new += j != kept
    to = labels.sparkSession.createDataFrame(list(moves.items()), "part int, moved int")
    out = labels.join(parts.join(F.broadcast(to), "part").select("pixel_id", "moved"), "pixel_id", "left").withColumn("label", F.coalesce("moved", "label")).drop("moved")
    return out, {"skipped": False, "n": n, "new_labels": [v for v in moves.values() if v != target], "n_pixels": {moves[j]: s for j, s in sizes.items()}}


def resolution_ratio(small: tuple[int, int], large: tuple[int, int]) -> int:
    """How many fine pixels a working pixel spans on each axis; sizes may differ by less than that."""
    ratio = max(1, round(large[0] / small[0]))
    for a, b in zip(small, large):
        if abs(b - a * ratio) >= ratio:
            raise FlowError(f"sizes {small} and {large} do not fit a whole ratio")
    return ratio


def hires_region(labels: DataFrame, hires: DataFrame, targets: list[int], ratio: int) -> DataFrame:
    """Fine pixels of working pixels in the target phases, with their parent's label."""
    fine = hires.withColumn("wr", F.floor(F.col("row") / ratio).cast("int")).withColumn("wc", F.floor(F.col("col") / ratio).cast("int"))
    own = labels.filter(F.col("label").isin(targets)).select(F.col("row").cast("int").alias("wr"), F.col("col").cast("int").alias("wc"), F.col("label").alias("parent"))
    return fine.join(own, ["wr", "wc"])


def majority(region: DataFrame, ratio: int) -> DataFrame:
    """(wr, wc, label): the most frequent defined label of the fine pixels.

    A tie goes to the label of the top-left fine pixel if that is among the tied, else
    to the smallest. A working pixel without defined fine pixels keeps its parent.
    """
    corner = F.max(F.when((F.col("row") == F.col("wr") * ratio) & (F.col("col") == F.col("wc") * ratio), F.col("label")))
    heads = region.groupBy("wr", "wc").agg(corner.alias("corner"), F.max("parent").alias("parent"))
    votes = region.filter("label >= 0").groupBy("wr", "wc", "label").agg(F.count("*").alias("n"))
    order = W.partitionBy("wr", "wc").orderBy(F.desc("n"), F.desc(F.coalesce(F.col("label") == F.col("corner"), F.lit(False))), "label")
    best = votes.join(heads.select("wr", "wc", "corner"), ["wr", "wc"]).withColumn("k", F.row_number().over(order)).filter("k = 1").select("wr", "wc", "label")
    return heads.join(best, ["wr", "wc"], "left").select("wr", "wc", F.coalesce("label", "parent").alias("label"))


def split_hires(labels: DataFrame, hires: Cube, targets: list[int], token: str, ratio: int, n_components: int = 2, subsample_n: int = 500_000, seed: int = 42):
    """(labels, fine labels): a one-feature mixture over the fine pixels of the targets, then a majority for each working pixel."""
    region = hires_region(labels, hires.df.select("row", "col", feature(token, list(hires.channels), None).alias("x")), targets, ratio).persist()
    known = region.filter("x is not null")
    n = known.count()
    if n < 10 * n_components:
        raise FlowError(f"split_hires: {n} defined fine pixels are too few for {n_components} components")
    rows = known.orderBy("row", "col").select("x")
    if subsample_n and subsample_n < n:
        rows = known.orderBy(F.xxhash64("row", "col", F.lit(seed))).limit(subsample_n).select("x")
    share, means, cov = fit_mixture(rows.toPandas()["x"].to_numpy()[:, None], n_components, seed)
    rank, first = np.argsort(np.argsort(means[:, 0], kind="stable"), kind="stable"), next_label(labels)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                best = log_density(pdf["x"].fillna(0).to_numpy()[:, None], share, means, cov).argmax(1)
                yield pdf[["row", "col", "wr", "wc", "parent"]].assign(label=np.where(pdf["x"].isna(), -1, first + rank[best]).astype("int32"))

    fine = region.select("row", "col", "wr", "wc", "parent", "x").mapInPandas(assign, "row int, col int, wr int, wc int, parent int, label int")
    coarse = majority(fine, ratio).select(F.col("wr").alias("row"), F.col("wc").alias("col"), F.col("label").alias("fine"))
    return labels.join(coarse, ["row", "col"], "left").withColumn("label", F.coalesce("fine", "label")).drop("fine"), fine.select("row", "col", F.col("label").cast("short").alias("label"))
