"""Pixels: dense ids, masks, normalisation, statistics. All plans are declarative."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cube:
    """``df`` has row, col and a column per channel; channels are sorted by name."""

    df: DataFrame
    channels: tuple[str, ...]
    space: str = "raw"
    geometry: dict = field(default_factory=dict)

    def of(self, df: DataFrame, space: str | None = None) -> Cube:
        return replace(self, df=df, space=space or self.space)


def cell(name: str) -> Column:
    return F.col(f"`{name}`")


def stack(long: DataFrame, names: list[str] | None = None) -> Cube:
    """(row, col, channel, value) to a cube, channels in the order of their names."""
    names = sorted(names if names is not None else [r[0] for r in long.select("channel").distinct().collect()])
    return Cube(long.groupBy("row", "col").pivot("channel", names).agg(F.first("value")), tuple(names))


def pixel_ids(df: DataFrame) -> DataFrame:
    """Adds ``pixel_id``: the dense 0-based rank of (row, col).

    Pixels are counted per row, the counts of rows are summed, and only within a row
    are pixels ranked; no window spans the image.
    """
    per_row = df.groupBy("row").agg(F.count("*").alias("n"))
    rows = [(r.row, r.n) for r in per_row.orderBy("row").collect()]  # at most the image's height
    before = np.concatenate([[0], np.cumsum([n for _, n in rows])]) if rows else [0]
    offsets = df.sparkSession.createDataFrame([(r, int(b)) for (r, _), b in zip(rows, before)], "row int, before long")
    rank = F.row_number().over(W.partitionBy("row").orderBy("col"))
    return df.withColumn("row", F.col("row").cast("int")).join(F.broadcast(offsets), "row").withColumn("pixel_id", F.col("before") + rank - 1).drop("before")


def subsample_ids(n: int, size: int, seed: int) -> np.ndarray | None:
    """A seeded draw of pixel ids without replacement; None where all are wanted."""
    return None if not size or size >= n else np.random.default_rng(seed).choice(n, size, replace=False)


def mineral_mask(cube: Cube, valid: DataFrame | None = None) -> DataFrame:
    """(row, col, mineral): not background (all channels zero) and inside the valid area, if one is given."""
    signal = reduce(Column.__or__, (F.coalesce(cell(c), F.lit(0.0)) != 0 for c in cube.channels))
    out = cube.df.select("row", "col", signal.alias("mineral"))
    if valid is not None:
        out = out.join(valid.filter("valid").select("row", "col", F.lit(True).alias("ok")), ["row", "col"], "left").select("row", "col", (F.col("mineral") & F.coalesce("ok", F.lit(False))).alias("mineral"))
    return out


def zscore_stats(cube: Cube, mask: DataFrame) -> DataFrame:
    """(channel, mean, std): population statistics over mineral pixels, in one aggregate."""
    inside = cube.df.join(mask.filter("mineral").select("row", "col"), ["row", "col"], "left_semi")
    row = inside.agg(*(F.avg(cell(c)).alias(f"m{i}") for i, c in enumerate(cube.channels)), *(F.stddev_pop(cell(c)).alias(f"s{i}") for i, c in enumerate(cube.channels)))
    parts = ", ".join(f"'{c}', m{i}, s{i}" for i, c in enumerate(cube.channels))
    return row.selectExpr(f"stack({len(cube.channels)}, {parts}) as (channel, mean, std)")


def zscore(cube: Cube, mask: DataFrame, stats: list | None = None) -> Cube:
    """Centred and scaled mineral pixels, zero elsewhere; a spread below 1e-10 divides by one."""
    found = {r.channel: r for r in (stats or zscore_stats(cube, mask).collect())}
    df = cube.df.join(mask, ["row", "col"], "left")
    values = []
    for c in cube.channels:
        std = found[c].std if found[c].std is not None and found[c].std >= 1e-10 else 1.0
        values.append(F.when(F.col("mineral"), (cell(c) - F.lit(found[c].mean)) / F.lit(std)).otherwise(F.lit(0.0)).alias(c))
    return cube.of(df.select("row", "col", *values), "normalized")


def sequential_moments(rows: DataFrame, keys: list[str], names: list[str], spread: bool = True) -> list[tuple]:
    """[(key, n, mean, std)] by ``keys`` from float32 sums in pixel order, row by row; key is a tuple, std may be None.

    Opt-in, to repeat runs whose sums were accumulated in single precision. Such sums are
    sequential by nature: one task folds the pixels of a key, a batch at a time. A row
    a key comes to the driver, so keys are phases or clusters of tiles.
    """
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    values = [f"x{i}" for i in range(len(names))]
    ordered = dealt.sortWithinPartitions(*keys, "row", "col").select(*keys, *(cell(c).cast("float").alias(v) for c, v in zip(names, values)))

    def sums(means: dict | None) -> dict:
        def fold(batches):
            import pandas as pd

            def row():
                return pd.DataFrame([{**dict(zip(keys, at)), "n": n, "total": total}])

            at, n, total = None, 0, None
            for pdf in batches:
                if not len(pdf):
                    continue
                x, held = pdf[values].to_numpy(np.float32), pdf[keys].to_numpy()
                cuts = np.flatnonzero((held[1:] != held[:-1]).any(axis=1)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
                    key = tuple(int(v) for v in held[lo])
                    if key != at:
                        if at is not None:
                            yield row()
                        at, n, total = key, 0, np.zeros(len(values), dtype=np.float32)
                    part = x[lo:hi] if means is None else (x[lo:hi] - means[key]) ** 2
                    total = np.add.accumulate(np.concatenate([total[None], part]), axis=0, dtype=np.float32)[-1]
                    n += int(hi - lo)
            if at is not None:
                yield row()

        got = ordered.mapInPandas(fold, f"{kinds}n long, total array<float>").collect()
        return {tuple(r[k] for k in keys): (r.n, np.array(r.total, dtype=np.float32)) for r in got}

    first = sums(None)
    means = {k: total / np.float32(n) for k, (n, total) in first.items()}
    stds = {k: np.sqrt(total / np.float32(n)) for k, (n, total) in sums(means).items()} if spread else {}
    return [(k, n, means[k], stds.get(k)) for k, (n, _) in sorted(first.items())]


def sequential_stats(cube: Cube, mask: DataFrame) -> list[tuple[str, float, float]]:
    """(channel, mean, std) of mineral pixels from float32 sums (see ``sequential_moments``); zero without any."""
    names = list(cube.channels)
    inside = cube.df.join(mask.filter("mineral").select("row", "col"), ["row", "col"], "left_semi")
    found = sequential_moments(inside, [], names)
    mean, std = found[0][2:] if found else (np.zeros(len(names)), np.zeros(len(names)))
    return [(c, float(m), float(s)) for c, m, s in zip(names, mean, std)]


def validate_normalized(cube: Cube, mask: DataFrame, tolerance: float = 0.01) -> DataFrame:
    inside = cube.df.join(mask.filter("mineral").select("row", "col"), ["row", "col"], "left_semi")
    row = inside.agg(*(f(cell(c)).alias(f"{k}{i}") for i, c in enumerate(cube.channels) for k, f in (("m", F.avg), ("s", F.stddev_pop), ("l", F.min), ("h", F.max))))
    long = row.selectExpr(f"stack({len(cube.channels)}, " + ", ".join(f"'{c}', m{i}, s{i}, l{i}, h{i}" for i, c in enumerate(cube.channels)) + ") as (channel, mean, std, min, max)")
    return long.withColumn("ok", (F.abs("mean") < tolerance) & (F.abs(F.col("std") - 1) < tolerance))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation as an aggregate; null where a side is constant (``corr`` divides by zero there)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def covariance(cube: Cube, mask: DataFrame, kind: str = "covar_samp") -> DataFrame:
    """(a, b, value) for a <= b, over mineral pixels, in one aggregate; ``corr`` gives correlations, null of constant channels."""
    inside = cube.df.join(mask.filter("mineral").select("row", "col"), ["row", "col"], "left_semi")
    pairs = [(a, b) for i, a in enumerate(cube.channels) for b in cube.channels[i:]]
    found = correlation if kind == "corr" else getattr(F, kind)
    row = inside.agg(*(found(cell(a), cell(b)).alias(f"v{i}") for i, (a, b) in enumerate(pairs)))
    return row.selectExpr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', v{i}" for i, (a, b) in enumerate(pairs)) + ") as (a, b, value)")


def pca(cube: Cube, mask: DataFrame, n_components: int = 0, threshold: float = 0.95, least: int = 5, fraction: float = 0.0, seed: int = 42):
    """(features, explained): (pixel_id, row, col, f) and the shares of variance of all components.

    The covariance comes from one aggregate over all mineral pixels (or a seeded share),
    its eigenvectors from the driver (channels x channels); the projection is an
    expression. Of each component the loading of largest magnitude is positive.
    """
    inside = pixel_ids(cube.df.join(mask.filter("mineral").select("row", "col"), ["row", "col"], "left_semi"))
    fit = inside
    if fraction:
        n = inside.count()
        ids = subsample_ids(n, max(1, int(n * fraction)), seed)
        if ids is not None:
            fit = inside.join(inside.sparkSession.createDataFrame([(int(i),) for i in ids], "pixel_id long"), "pixel_id", "left_semi")
    names = list(cube.channels)
    means = fit.agg(*(F.avg(cell(c)) for c in names)).first()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = fit.agg(*(F.covar_samp(cell(names[i]), cell(names[j])) for i, j in pairs)).first()
    matrix = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, got):
        matrix[i, j] = matrix[j, i] = v or 0.0
    values, loads = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")
    values, loads = np.clip(values[order], 0, None), loads[:, order]
    loads *= np.where(loads[np.abs(loads).argmax(axis=0), np.arange(len(names))] < 0, -1, 1)
    explained = values / values.sum() if values.sum() else values
    k = n_components or min(len(names), auto_components(explained, threshold, least))
    score = [reduce(Column.__add__, ((cell(c) - F.lit(float(means[i] or 0))) * F.lit(float(loads[i, j])) for i, c in enumerate(names))).cast("float") for j in range(k)]
    return inside.select("pixel_id", "row", "col", F.array(*score).alias("f")), [float(x) for x in explained]


def auto_components(explained, threshold: float, least: int) -> int:
    """The first count whose shares sum to the threshold, else all; at least ``least``."""
    reached = np.flatnonzero(np.cumsum(explained) >= threshold)
    return max(int(reached[0]) + 1 if len(reached) else len(explained), least)


def cumulative(explained: DataFrame) -> DataFrame:
    """(component, share) with the running sum."""
    return explained.withColumn("total", F.sum("share").over(W.orderBy("component").rowsBetween(W.unboundedPreceding, 0)))
