"""Bilateral filters and diffusion over tiles with a border, and a relational form of the former."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pixels import Cube, cell

LEVELS = 10_000


def window(sigma: float) -> int:
    return max(5, 2 * math.ceil(3 * sigma) + 1)


def offsets(sigma: float, off_centre: bool = False) -> list[tuple[int, int, float]]:
    """(dr, dc, weight). Off centre: the weights of a table one wider than the window, read with the window's stride."""
    n = window(sigma)
    half, out = n // 2, []
    for i in range(n):
        for j in range(n):
            a, b = (divmod(i * n + j, n + 1)) if off_centre else (i, j)
            shift = half + 1 if off_centre else half
            out.append((i - half, j - half, math.exp(-((a - shift) ** 2 + (b - shift) ** 2) / (2 * sigma * sigma))))
    return out


def filled(cube: Cube, mask: DataFrame) -> tuple[Cube, dict[str, float]]:
    """Non-mineral pixels take the channel's mineral mean."""
    df = cube.df.join(mask, ["row", "col"], "left").withColumn("mineral", F.coalesce("mineral", F.lit(False)))
    row = df.filter("mineral").agg(*(F.avg(cell(c)) for c in cube.channels)).first()
    means = dict(zip(cube.channels, row))
    return cube.of(df.select("row", "col", "mineral", *(F.when(F.col("mineral"), cell(c)).otherwise(F.lit(means[c])).alias(c) for c in cube.channels))), means


def _tiles(df: DataFrame, tile: int, halo: int) -> DataFrame:
    """Every pixel once for each tile whose border it is in; a pixel is in four tiles at most for halo <= tile."""
    at = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    return df.withColumn("tr", F.explode(at("row"))).withColumn("tc", F.explode(at("col")))


def _image(pdf: pd.DataFrame, name: str, tile: int, halo: int, kind=np.float32) -> tuple[np.ndarray, np.ndarray]:
    size = tile + 2 * halo
    r = pdf["row"].to_numpy() - pdf["tr"].iloc[0] * tile + halo
    c = pdf["col"].to_numpy() - pdf["tc"].iloc[0] * tile + halo
    out, inside = np.zeros((size, size), dtype=kind), np.zeros((size, size), dtype=bool)
    out[r, c], inside[r, c] = pdf[name].to_numpy(kind), True
    return out, inside


def _over_tiles(df: DataFrame, names: list[str], tile: int, halo: int, compute) -> DataFrame:
    kinds = "row int, col int, " + ", ".join(f"`{c}` double" for c in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tr"].iloc[0]) * tile, int(pdf["tc"].iloc[0]) * tile
        own = pdf[(pdf["row"] // tile == pdf["tr"]) & (pdf["col"] // tile == pdf["tc"])]
        out = {"row": own["row"].astype("int32"), "col": own["col"].astype("int32")}
        for c in names:
            image = compute(pdf, c)
            out[c] = image[own["row"].to_numpy() - r0 + halo, own["col"].to_numpy() - c0 + halo].astype(float)
        return pd.DataFrame(out)

    return _tiles(df, tile, halo).groupBy("tr", "tc").applyInPandas(run, kinds)


def bilateral(cube: Cube, mask: DataFrame, sigma_spatial: float = 1.0, sigma_color: float | None = None, guide: str | None = None, off_centre: bool = False, tile: int = 256, kind=np.float32) -> Cube:
    """Edge-keeping smoothing; outside the image values and guide are 0 and count.

    ``guide`` names a column of the cube (or ``"total"``, the sum of channels) for the
    joint form. The range weight is tabulated in 10,000 steps. An automatic
    ``sigma_color`` is the population spread of the filled guide. A constant guide
    leaves its own image as it is, and for another image weighs in-image neighbours alone.
    Sums are in the precision ``kind``.
    """
    full, _ = filled(cube, mask)
    df = full.df
    if guide == "total":
        df = df.withColumn("total", sum((cell(c) for c in cube.channels[1:]), cell(cube.channels[0])))
    elif guide is not None and guide not in cube.channels:
        mean = cube.df.join(mask.filter("mineral"), ["row", "col"], "left_semi").agg(F.avg(cell(guide))).first()[0]
        df = df.join(cube.df.select("row", "col", cell(guide).alias("_g")), ["row", "col"]).withColumn(guide, F.when(F.col("mineral"), F.col("_g")).otherwise(F.lit(mean))).drop("_g")
    guides = [guide] if guide else list(cube.channels)
    got = df.agg(*(f(cell(g)) for g in guides for f in (F.min, F.max, F.stddev_pop))).first()
    facts = {g: got[3 * i : 3 * i + 3] for i, g in enumerate(guides)}
    halo = window(sigma_spatial) // 2
    table = offsets(sigma_spatial, off_centre)

    def compute(pdf: pd.DataFrame, c: str) -> np.ndarray:
        g = guide or c
        low, high, std = facts[g]
        image, inside = _image(pdf, c, tile, halo, kind)
        if low == high and g == c:
            return image
        lead = image if g == c else _image(pdf, g, tile, halo, kind)[0]
        span = (high if off_centre else max(high, 0.0) - min(low, 0.0)) or 1.0
        sigma = sigma_color if sigma_color is not None else float(std)
        bins = np.exp(-0.5 * (np.arange(LEVELS) * span / LEVELS / (sigma or 1.0)) ** 2).astype(kind)
        n, total, weight = len(image), np.zeros_like(image), np.zeros_like(image)
        core = slice(halo, n - halo)
        for dr, dc, w in table:
            part = (slice(halo + dr, n - halo + dr), slice(halo + dc, n - halo + dc))
            if sigma:
                step = np.minimum((np.abs(lead[core, core] - lead[part]) * kind(LEVELS / span)).astype(np.int64), LEVELS - 1)
                each = kind(w) * bins[step]
            else:
                each = kind(w) * inside[part]
            total[core, core] += each * image[part]
            weight[core, core] += each
        return total / np.maximum(weight, 1e-30)

    out = _over_tiles(df, list(cube.channels), tile, halo, compute)
    return cube.of(_remasked(out, mask, cube.channels), "denoised")


def _remasked(df: DataFrame, mask: DataFrame, names) -> DataFrame:
    joined = df.join(mask, ["row", "col"], "left")
    return joined.select("row", "col", *(F.when(F.coalesce("mineral", F.lit(False)), cell(c)).otherwise(F.lit(0.0)).alias(c) for c in names))


def diffuse(cube: Cube, mask: DataFrame, niter: int = 10, kappa: float = 50.0, gamma: float = 0.1, option: int = 2, tile: int = 256, kind=np.float32) -> Cube:
    """Perona-Malik diffusion of each channel scaled to [0, 1] by its mineral range; exact in one pass with a border of ``niter``. Images are read in the precision ``kind``."""
    full, _ = filled(cube, mask)
    names = list(cube.channels)
    got = full.df.filter("mineral").agg(*(f(cell(c)) for c in names for f in (F.min, F.max))).first()
    span = {c: got[2 * i : 2 * i + 2] for i, c in enumerate(names)}

    def compute(pdf: pd.DataFrame, c: str) -> np.ndarray:
        image, inside = _image(pdf, c, tile, niter, kind)
        low, high = span[c]
        if not high or high <= low:
            return image
        u = ((image - low) / (high - low)).astype(np.float64)
        for _ in range(niter):
            flow = np.zeros_like(u)
            for axis in (0, 1):
                d = np.diff(u, axis=axis)
                both = np.take(inside, range(1, len(u)), axis) & np.take(inside, range(len(u) - 1), axis)
                g = np.exp(-((d / kappa) ** 2)) if option == 1 else 1 / (1 + (d / kappa) ** 2)
                f = np.where(both, g * d, 0.0)
                pad = [(0, 0), (0, 0)]
                pad[axis] = (0, 1)
                flow += np.pad(f, pad)
                pad[axis] = (1, 0)
                flow -= np.pad(f, pad)
            u += gamma * flow
        return u * (high - low) + low

    out = _over_tiles(full.df, names, tile, niter, compute)
    return cube.of(_remasked(out, mask, names), "denoised")


def bilateral_relational(pixels: DataFrame, sigma_spatial: float, sigma_color: float, span: float, off_centre: bool = False) -> DataFrame:
    """(row, col, out) of (row, col, value, guide) as a band join on neighbour offsets: for small images and checks."""
    p = pixels.withColumn("step", F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(w).alias("w")) for a, b, w in offsets(sigma_spatial, off_centre)))))
    p = p.select("row", "col", "guide", (F.col("row") + F.col("step.dr")).alias("r2"), (F.col("col") + F.col("step.dc")).alias("c2"), F.col("step.w").alias("w"))
    q = pixels.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("value").alias("v2"), F.col("guide").alias("g2"))
    j = p.join(q, ["r2", "c2"], "left").na.fill(0.0, ["v2", "g2"])
    bin_ = F.least(F.floor(F.abs(F.col("guide") - F.col("g2")) * LEVELS / span), F.lit(LEVELS - 1))
    each = F.col("w") * F.exp(-0.5 * F.pow(bin_ * span / LEVELS / sigma_color, 2))
    return j.groupBy("row", "col").agg((F.sum(each * F.col("v2")) / F.sum(each)).alias("out"))
