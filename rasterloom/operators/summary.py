"""Statistics of phases, and the data behind quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pixels import Cube, cell, sequential_moments


def cluster_stats(labels: DataFrame) -> DataFrame:
    """(label, n_pixels, pct, mean_prob) of each phase; percentages are of all pixels."""
    whole = labels.agg(F.count("*").alias("total"))
    return labels.filter("label >= 0").groupBy("label").agg(F.count("*").alias("n_pixels"), F.avg("prob").alias("mean_prob")).join(F.broadcast(whole)).select("label", "n_pixels", (100.0 * F.col("n_pixels") / F.col("total")).alias("pct"), "mean_prob")


def fingerprints(labels: DataFrame, cube: Cube, accumulate: str = "float64") -> DataFrame:
    """(label, element, mean, std, n_pixels, area_pct): one aggregate, then long.

    With ``accumulate="float32"`` sums are sequential, in single precision and pixel order.
    """
    names = cube.channels
    inside = labels.filter("label >= 0").select("row", "col", "label").join(cube.df, ["row", "col"])
    if accumulate == "float32":
        found = sequential_moments(inside, ["label"], list(names))
        whole = sum(n for _, n, _, _ in found)
        rows = [(k[0], c, float(m), float(s), n, 100.0 * n / whole) for k, n, mean, std in found for c, m, s in zip(names, mean, std)]
        return labels.sparkSession.createDataFrame(rows, "label int, element string, mean double, std double, n_pixels long, area_pct double")
    wide = inside.groupBy("label").agg(F.count("*").alias("n_pixels"), *(f(cell(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    wide = wide.withColumn("area_pct", 100.0 * F.col("n_pixels") / F.sum("n_pixels").over(W.partitionBy(F.lit(1))))  # a row a phase
    parts = ", ".join(f"'{c}', m{i}, s{i}" for i, c in enumerate(names))
    return wide.selectExpr("label", "n_pixels", "area_pct", f"stack({len(names)}, {parts}) as (element, mean, std)").select("label", "element", "mean", "std", "n_pixels", "area_pct")


def element_order(prints: DataFrame) -> DataFrame:
    """(element, variance, place): by variance of phase means, largest first, ties by name."""
    return prints.groupBy("element").agg(F.var_pop("mean").alias("variance")).withColumn("place", F.row_number().over(W.orderBy(F.desc("variance"), "element")))


def similar_pairs(prints: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(a, b, similarity): phases a < b whose means have a cosine above the threshold, by an equi-join on elements."""
    p = prints.select("label", "element", "mean")
    both = p.alias("x").join(p.alias("y"), "element").filter("x.label < y.label")
    dots = both.groupBy(F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(F.sum(F.col("x.mean") * F.col("y.mean")).alias("d"), F.sqrt(F.sum(F.col("x.mean") * F.col("x.mean")) * F.sum(F.col("y.mean") * F.col("y.mean"))).alias("n"))
    return dots.filter("n > 0").select("a", "b", (F.col("d") / F.col("n")).alias("similarity")).filter(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "a", "b")


def top_variance(cube: Cube, mask: DataFrame, k: int = 3) -> DataFrame:
    """(place, channel, variance): the channels of largest variance over mineral pixels, ties by name."""
    inside = cube.df.join(mask.filter("mineral").select("row", "col"), ["row", "col"], "left_semi")
    row = inside.agg(*(F.var_pop(cell(c)).alias(f"v{i}") for i, c in enumerate(cube.channels)))
    long = row.selectExpr("stack({}, {}) as (channel, variance)".format(len(cube.channels), ", ".join(f"'{c}', v{i}" for i, c in enumerate(cube.channels))))
    return long.withColumn("place", F.row_number().over(W.orderBy(F.desc("variance"), "channel"))).filter(F.col("place") <= k).select("place", "channel", "variance")  # a row a channel


def top_elements(prints: DataFrame, k: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("mean"), "element"))
    return prints.withColumn("place", rank).filter(F.col("place") <= k).select("label", "place", "element", "mean")


def size_table(labels: DataFrame) -> DataFrame:
    """Phases by size, unassigned last."""
    n = labels.groupBy("label").agg(F.count("*").alias("n_pixels"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.col("label") < 0, F.desc("n_pixels"), "label")))


def histogram(cube: Cube, mask: DataFrame, bins: int = 100) -> DataFrame:
    """(channel, bin, density) between each channel's least and largest mineral value."""
    inside = cube.df.join(mask.filter("mineral").select("row", "col"), ["row", "col"], "left_semi")
    long = inside.selectExpr("stack({}, {}) as (channel, x)".format(len(cube.channels), ", ".join(f"'{c}', cast(`{c}` as double)" for c in cube.channels)))
    edge = long.groupBy("channel").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))
    placed = long.join(F.broadcast(edge), "channel").withColumn("bin", F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)))
    return placed.groupBy("channel", "bin", "low", "high", "n").agg(F.count("*").alias("k")).select("channel", "bin", (F.col("k") / F.col("n") / F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(F.lit(1.0))).alias("density"))


def percentiles(cube: Cube, mask: DataFrame, at=(0.01, 0.02, 0.98, 0.99)) -> DataFrame:
    inside = cube.df.join(mask.filter("mineral").select("row", "col"), ["row", "col"], "left_semi")
    row = inside.agg(*(F.percentile(cell(c), q).alias(f"p{i}_{j}") for i, c in enumerate(cube.channels) for j, q in enumerate(at)))
    pairs = ", ".join(f"'{c}', cast({q} as double), p{i}_{j}" for i, c in enumerate(cube.channels) for j, q in enumerate(at))
    return row.selectExpr(f"stack({len(cube.channels) * len(at)}, {pairs}) as (channel, q, value)")


# The twenty colours of the "tab20" table, and the grey of the background.
TAB20 = (
    "#1f77b4 #aec7e8 #ff7f0e #ffbb78 #2ca02c #98df8a #d62728 #ff9896 #9467bd #c5b0d5 "
    "#8c564b #c49c94 #e377c2 #f7b6d2 #7f7f7f #c7c7c7 #bcbd22 #dbdb8d #17becf #9edae5"
).split()
GREY = "#d9d9d9"


def label_colour(label: Column) -> Column:
    """The colour of a label, by its value alone, so that every figure shows it alike; grey below zero."""
    return F.when(label < 0, F.lit(GREY)).otherwise(F.array(*map(F.lit, TAB20))[label % len(TAB20)])


def gained(cleaned: DataFrame, raw: DataFrame) -> DataFrame:
    """(label, n_pixels, gained): pixels of each phase, and how many of them were unassigned before.

    ``gained`` is null where the two frames do not cover the same pixels.
    """
    both = cleaned.filter("label is not null").select("row", "col", "label").join(raw.select("row", "col", F.col("label").alias("before"), F.lit(True).alias("there")), ["row", "col"], "full")
    phases = both.groupBy("label").agg(F.count("*").alias("n_pixels"), F.sum((F.col("before") < 0).cast("long")).alias("gained"), F.sum((F.col("label").isNull() | F.col("there").isNull()).cast("long")).alias("odd"))
    alike = F.sum("odd").over(W.partitionBy(F.lit(1))) == 0  # a row a phase
    return phases.withColumn("gained", F.when(alike, F.coalesce("gained", F.lit(0)))).filter("label >= 0").select("label", "n_pixels", "gained")


def newest(entries: DataFrame, kind: str = "kind", path: str = "path", time: str = "mtime") -> DataFrame:
    """(kind, path): the newest cache entry of each kind, the last path of equals."""
    return entries.groupBy(kind).agg(F.max(F.struct(time, path))[path].alias(path))


def label_image(labels: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of the image with its label, -1 outside."""
    grid = labels.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return grid.join(labels.select("row", "col", "label"), ["row", "col"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def discovery_curve(registry: DataFrame) -> DataFrame:
    """(tile_id, n_new, total): phases first seen in each tile, summed in tile order; the second pass stands last."""
    n = registry.groupBy(F.when(F.col("discovered_in_tile") < 0, F.lit(1 << 30)).otherwise(F.col("discovered_in_tile")).alias("tile_id")).agg(F.count("*").alias("n_new"))
    return n.withColumn("total", F.sum("n_new").over(W.orderBy("tile_id").rowsBetween(W.unboundedPreceding, 0)))


def zoom(pixels: DataFrame, mask: DataFrame, height: int = 300, width: int = 400) -> DataFrame:
    """A window of the image around the median mineral pixel."""
    r, c = mask.filter("mineral").agg(F.percentile("row", 0.5), F.percentile("col", 0.5)).first()
    r0, c0 = max(0, int(r or 0) - height // 2), max(0, int(c or 0) - width // 2)
    return pixels.filter(F.col("row").between(r0, r0 + height - 1) & F.col("col").between(c0, c0 + width - 1))
