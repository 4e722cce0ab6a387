"""Polygons, connected components, and statistics of masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def polygon_mask(grid: DataFrame, shapes: DataFrame, factor: int = 1, trim: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(row, col, valid): inside any polygon by the even-odd rule on pixel centres.

    ``shapes`` has index, shape_type, vertex, axis0, axis1 in full-size pixels. Each
    edge crosses a known range of rows, so edges meet pixel rows by an equi-join and
    parity is a count; a pixel on a left edge is inside, on a right edge outside.
    """
    p = shapes.filter(F.col("shape_type") == "polygon").select("index", "vertex", (F.col("axis0") / factor - trim[0] / factor).alias("r"), (F.col("axis1") / factor - trim[1] / factor).alias("c"))
    n = p.groupBy("index").agg(F.max("vertex").alias("last"))
    a, b = p.join(n, "index").alias("a"), p.alias("b")
    edges = a.join(b, (F.col("a.index") == F.col("b.index")) & (F.col("b.vertex") == F.when(F.col("a.vertex") == F.col("a.last"), 0).otherwise(F.col("a.vertex") + 1)))
    edges = edges.select(F.col("a.index").alias("shape"), *(F.col(f"{x}.{y}").alias(f"{x}{y}") for x in "ab" for y in "rc")).filter("ar <> br")
    low, high = F.ceil(F.least("ar", "br")), F.ceil(F.greatest("ar", "br")) - 1
    crossed = edges.filter(high >= low).select("*", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("row"))
    crossed = crossed.select("shape", "row", (F.col("ac") + (F.col("row") - F.col("ar")) / (F.col("br") - F.col("ar")) * (F.col("bc") - F.col("ac"))).alias("x"))
    hits = grid.select(F.col("row").cast("int").alias("row"), "col").join(crossed, "row").filter(F.col("x") <= F.col("col")).groupBy("row", "col", "shape").count().filter("count % 2 = 1").select("row", "col").distinct()
    return grid.select(F.col("row").cast("int").alias("row"), "col").join(hits.withColumn("valid", F.lit(True)), ["row", "col"], "left").na.fill({"valid": False})


def components(mask: DataFrame, connectivity: int = 4, tile: int = 256) -> DataFrame:
    """(row, col, comp): connected pixels of a mask, named by their least (row, col) as row * 2^31 + col.

    Union-find inside tiles, then the pairs that touch across tile borders, which are
    as many as border pixels, are joined by repeated least-name exchange.
    """
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        place = {(a, b): i for i, (a, b) in enumerate(zip(r.tolist(), c.tolist()))}
        up = list(range(len(r)))

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        key = (r << 31) + c
        for (a, b), i in place.items():
            for dr, dc in steps:
                j = place.get((a + dr, b + dc))
                if j is not None:
                    x, y = root(i), root(j)
                    if x != y:
                        up[max(x, y, key=lambda z: key[z])] = min(x, y, key=lambda z: key[z])
        return pd.DataFrame({"row": r, "col": c, "part": [int(key[root(i)]) for i in range(len(r))]})

    inside = mask.filter("mineral").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    tiled = inside.withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))
    parts = tiled.groupBy("tr", "tc").applyInPandas(label, "row long, col long, part long").persist()
    edge = parts.filter((F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1))
    near = edge.select(F.explode(F.array(*(F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in steps))).alias("p"), F.col("part").alias("a")).select("p.row", "p.col", "a")
    pairs = near.join(edge, ["row", "col"]).filter("a <> part").select("a", F.col("part").alias("b")).distinct()
    names = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("part"), F.col("a").alias("comp"))
    both = pairs.union(pairs.select("b", "a")).persist()
    while both.head(1):
        moved = both.join(names, both.b == names.part).groupBy("a").agg(F.min("comp").alias("m"))
        after = names.join(moved, names.part == moved.a, "left").select("part", F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        jump = after.select(F.col("part").alias("comp"), F.col("comp").alias("next"))
        after = after.join(jump, "comp", "left").select("part", F.coalesce("next", "comp").alias("comp"))
        after = after.checkpoint() if after.sparkSession.sparkContext.getCheckpointDir() else after.persist()
        if not after.join(names.withColumnRenamed("comp", "was"), "part").filter("comp <> was").head(1):
            break
        names = after
    return parts.join(names, "part", "left").select("row", "col", F.coalesce("comp", "part").alias("comp"))


def remove_small(mask: DataFrame, least: int, tile: int = 256) -> DataFrame:
    """The mask without 4-connected components of fewer than ``least`` pixels; 0 keeps all."""
    if least <= 0:
        return mask
    comp = components(mask, 4, tile)
    big = comp.groupBy("comp").count().filter(F.col("count") >= least)
    kept = comp.join(big, "comp", "left_semi").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(True).alias("stays"))
    return mask.join(kept, ["row", "col"], "left").withColumn("mineral", F.coalesce("stays", F.lit(False))).drop("stays")


def mask_stats(mask: DataFrame, n_components: int | None = None) -> DataFrame:
    """Counts and coverage in percent, rounded to two digits."""
    valid = F.col("valid") if "valid" in mask.columns else F.lit(True)
    out = mask.agg(F.count("*").alias("n_pixels"), F.sum(valid.cast("long")).alias("n_valid"), F.sum(F.col("mineral").cast("long")).alias("n_mineral"))
    out = out.withColumns({"coverage_pct": F.round(100.0 * F.col("n_mineral") / F.col("n_pixels"), 2), "of_valid_pct": F.when(F.col("n_valid") > 0, F.round(100.0 * F.col("n_mineral") / F.col("n_valid"), 2)).otherwise(0.0)})
    return out if n_components is None else out.withColumn("n_components", F.lit(n_components).cast("long"))
