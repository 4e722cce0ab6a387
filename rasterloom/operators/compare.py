"""How denoisers compare: distance from the raw cube, and edges kept."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stencil
from .pixels import Cube, cell, correlation


def gradients(pixels: DataFrame, names: list[str]) -> DataFrame:
    """(row, col, names): Sobel magnitude of each column; a neighbour that is not there counts as the pixel itself.

    The kernel is separable: one window along image rows, one along columns.
    """
    plain = pixels.select("row", "col", *(cell(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)))

    def sides(value: str, along: str, over) -> tuple[Column, Column]:
        def at(f, step):
            return F.when(f(along).over(over) == F.col(along) + step, f(value).over(over)).otherwise(F.col(value))

        return at(F.lag, -1), at(F.lead, 1)

    across = W.partitionBy("row").orderBy("col")
    down = W.partitionBy("col").orderBy("row")
    steps = []
    for i in range(len(names)):
        a, b = sides(f"v{i}", "col", across)
        steps += [((b - a) / 2).alias(f"d{i}"), ((a + 2 * F.col(f"v{i}") + b) / 4).alias(f"s{i}")]
    half = plain.select("row", "col", *steps)
    out = []
    for i, name in enumerate(names):
        da, db = sides(f"d{i}", "row", down)
        sa, sb = sides(f"s{i}", "row", down)
        x, y = (da + 2 * F.col(f"d{i}") + db) / 4, (sb - sa) / 2
        out.append(F.sqrt((x * x + y * y) / 2).alias(name))
    return half.select("row", "col", *out)


def denoiser_metrics(raw: Cube, denoised: Cube, mask: DataFrame, bse: DataFrame) -> DataFrame:
    """(channel, rmse, edge_preservation) over mineral pixels.

    The root of the mean squared change, and the correlation of the channel's gradient
    magnitude with that of the electron image (row, col, bse); 0 where one of them is constant.
    """
    names = list(raw.channels)
    inside = mask.filter("mineral").select("row", "col")
    before = raw.df.select("row", "col", *(cell(c).alias(f"a{i}") for i, c in enumerate(names)))
    after = denoised.df.select("row", "col", *(cell(c).alias(f"b{i}") for i, c in enumerate(names)))
    edges = gradients(denoised.df, names).select("row", "col", *(cell(c).alias(f"g{i}") for i, c in enumerate(names)))
    light = gradients(bse, ["bse"])
    both = inside.join(before, ["row", "col"]).join(after, ["row", "col"]).join(edges, ["row", "col"]).join(light, ["row", "col"])
    row = both.agg(
        *(F.sqrt(F.avg(F.pow(F.col(f"a{i}") - F.col(f"b{i}"), 2))).alias(f"r{i}") for i in range(len(names))),
        *(F.coalesce(correlation(F.col(f"g{i}"), F.col("bse")), F.lit(0.0)).alias(f"e{i}") for i in range(len(names))),
    )
    return row.selectExpr("stack({}, {}) as (channel, rmse, edge_preservation)".format(len(names), ", ".join(f"'{c}', r{i}, e{i}" for i, c in enumerate(names))))


def compare_denoisers(cube: Cube, mask: DataFrame, bse: DataFrame, sigma_spatial: float = 1.0, sigma_color: float | None = None, niter: int = 10, kappa: float = 50.0, gamma: float = 0.1, option: int = 2, tile: int = 256, kind=np.float32, timed: bool = False) -> DataFrame:
    """(method, channel, rmse, edge_preservation, seconds) of the bilateral filter and of diffusion.

    With ``timed`` each result is computed once on its own to take its seconds, else they are null.
    """
    results = {
        "bilateral": stencil.bilateral(cube, mask, sigma_spatial, sigma_color, None, True, tile, kind),
        "anisotropic": stencil.diffuse(cube, mask, niter, kappa, gamma, option, tile, kind),
    }
    parts = []
    for method, result in results.items():
        began = time.time()
        if timed:
            result.df.write.format("noop").mode("overwrite").save()
        took = F.lit(time.time() - began if timed else None).cast("double").alias("seconds")
        parts.append(denoiser_metrics(cube, result, mask, bse).select(F.lit(method).alias("method"), "channel", "rmse", "edge_preservation", took))
    return parts[0].unionByName(parts[1])
