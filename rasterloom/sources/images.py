"""Images, palettes and polygons as DataFrames; results as Parquet groups."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import FlowError
from ..operators.pixels import Cube, stack


def name_pattern(template: str) -> str:
    """``{element}`` becomes a named group, any other ``{x}`` matches something, the rest is literal."""
    parts = re.split(r"(\{\w+\})", template)
    if "{element}" not in parts:
        raise FlowError(f"{template!r} has no {{element}}")
    return "^" + "".join("(?P<element>.+)" if p == "{element}" else ".+?" if re.fullmatch(r"\{\w+\}", p) else re.escape(p) for p in parts) + "$"


def file_name(path: Column) -> Column:
    """The last part of a path or URI; sources differ in how they write the rest."""
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"([^/]+)$", 1)


def legacy_element(stem: Column) -> Column:
    """The third and later parts of a stem cut at hyphens; null where there are fewer than three."""
    parts = F.split(stem, "-")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, 999), "-"))


def pattern_element(name: Column, template: str) -> Column:
    pattern = name_pattern(template).replace("(?P<element>", "(?<element>")
    found = F.regexp_extract(name, pattern, 1)
    return F.when(found != "", found)


def read_images(spark: SparkSession, folder: str | list[str], glob: str = "*.png") -> DataFrame:
    """(origin, row, col, r, g, b) of all images of a folder, or of a list of files; a gray image has equal r, g and b.

    An image is one binary row at first; it is opened strip by strip in Arrow batches.
    """
    reader = spark.read.format("image")
    raw = (reader.option("pathGlobFilter", glob) if isinstance(folder, str) else reader).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for pdf in batches:
            for x in pdf.itertuples():
                a = np.frombuffer(x.data, dtype=np.uint8).reshape(x.height, x.width, x.nChannels)
                for r0 in range(0, x.height, 256):
                    s = a[r0 : r0 + 256]
                    rr, cc = np.indices(s.shape[:2])
                    bgr = [s[:, :, 0]] * 3 if x.nChannels == 1 else [s[:, :, i] for i in range(3)]
                    yield pd.DataFrame({"origin": x.origin, "row": (rr + r0).ravel().astype("int32"), "col": cc.ravel().astype("int32"), **{k: v.ravel().astype("int32") for k, v in zip("bgr", bgr)}})[["origin", "row", "col", "r", "g", "b"]]

    return raw.mapInPandas(run, "origin string, row int, col int, r int, g int, b int")


def palette_table(spark: SparkSession, rgb: np.ndarray) -> DataFrame:
    """(idx, pr, pg, pb, scalar): entries with scalars evenly from 0 to 1."""
    n = max(1, len(rgb) - 1)
    return spark.createDataFrame([(i, int(r), int(g), int(b), i / n) for i, (r, g, b) in enumerate(np.asarray(rgb)[:, :3])], "idx int, pr int, pg int, pb int, scalar double")


def read_palette(spark: SparkSession, spec: str) -> DataFrame:
    """``lut:PATH`` of an .npy file with one colour a row, read through Spark."""
    if not spec.startswith("lut:"):
        raise FlowError(f"colormap {spec!r}: only lut:PATH is available here; supply the palette as a table")
    import io

    blob = spark.read.format("binaryFile").load(spec[4:]).select("content").first()[0]
    return palette_table(spark, np.load(io.BytesIO(bytes(blob)), allow_pickle=False))


def invert_colours(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """(r, g, b, scalar) of the distinct colours: the nearest palette entry, the lowest of equals; black is 0.

    The palette (at most some thousand rows) is one array in every row, so each colour
    is compared in place and no join multiplies rows.
    """
    entries = [r.asDict() for r in palette.orderBy("idx").collect()]
    table = F.array(*(F.struct(F.lit(e["pr"]).alias("r"), F.lit(e["pg"]).alias("g"), F.lit(e["pb"]).alias("b"), F.lit(e["idx"]).alias("i"), F.lit(e["scalar"]).alias("s")) for e in entries))
    d2 = lambda e: (F.col("r") - e["r"]) * (F.col("r") - e["r"]) + (F.col("g") - e["g"]) * (F.col("g") - e["g"]) + (F.col("b") - e["b"]) * (F.col("b") - e["b"])
    best = F.array_min(F.transform(table, lambda e: F.struct(d2(e).alias("d"), e["i"].alias("i"), e["s"].alias("s"))))
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)
    return colours.select("r", "g", "b").distinct().select("r", "g", "b", F.when(black, F.lit(0.0)).otherwise(best["s"]).alias("scalar"))


def invert(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels with ``value``: an equi-join of their colours with the inverted distinct colours."""
    return pixels.join(invert_colours(pixels, palette), ["r", "g", "b"]).withColumnRenamed("scalar", "value").drop("r", "g", "b")


def luminance() -> Column:
    return (0.2125 * F.col("r") + 0.7154 * F.col("g") + 0.0721 * F.col("b")) / 255.0


def downsample(pixels: DataFrame, factor: int, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Block means over factor x factor cells; cells beyond the edge count as zero."""
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return pixels.groupBy(*keys, *block).agg((F.sum(value) / float(factor * factor)).alias(value))


def trim(pixels: DataFrame, height: int, width: int, factor: int = 1, header: int = 0, bottom: int = 0, left: int = 0, right: int = 0) -> DataFrame:
    """Cuts edges given in original pixels off an image already downsampled by ``factor``; ``height`` and ``width`` are its own."""
    t, b, l, r = (x // factor for x in (header, bottom, left, right))
    kept = pixels.filter(F.col("row").between(t, height - b - 1) & F.col("col").between(l, width - r - 1))
    return kept.withColumn("row", (F.col("row") - t).cast("int")).withColumn("col", (F.col("col") - l).cast("int"))


def load_elements(spark: SparkSession, folder: str, palette: DataFrame, glob: str = "*.png", pattern: str | None = None, bse_channel: str = "SEM", exclude: tuple[str, ...] = ("Fe-L",), include: tuple[str, ...] = (), factor: int = 2, header: int = 0, bottom: int = 0, left: int = 0, right: int = 0, bse_filename: str | None = None) -> tuple[Cube, DataFrame]:
    """(cube, bse) of a folder of false-colour maps and one gray electron image.

    Only the wanted files are decoded; the size is that of the source rows. With
    ``bse_filename`` that file of the folder is the electron image, whatever the glob, and is never an
    element map. The cube's geometry says how original pixels map to its own.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    stem = file_name(F.col("path"))
    bare = F.regexp_replace(stem, r"\.[^.]*$", "")
    element = pattern_element(stem, pattern) if pattern else legacy_element(bare)
    files = names.select(stem.alias("path"), element.alias("element")).filter("element is not null").orderBy("path").collect()
    skip = {*exclude, "Phases", bse_channel}
    own = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", bse_filename).load(folder).select(file_name(F.col("path")).alias("path")).collect()] if bse_filename else []
    wanted = {r.path: r.element for r in files if r.element not in skip and (not include or r.element in include) and r.path not in own}
    electron = own if bse_filename else [r.path for r in files if r.element == bse_channel]
    if not wanted or not electron:
        raise FlowError(f"{folder}: " + ("no element map matches" if not wanted else f"no {bse_filename or bse_channel} image"))
    at = lambda names: [f"{folder.rstrip('/')}/{n}" for n in names]
    sizes = {(r.height, r.width) for r in spark.read.format("image").load(at([*wanted, electron[0]])).select("image.height", "image.width").collect()}  # a row a file
    if len(sizes) > 1:
        raise FlowError(f"{folder}: images differ in size: {sorted(sizes)}")
    height, width = sizes.pop()
    maps = spark.createDataFrame(list(wanted.items()), "origin string, channel string")
    h, w = -(-height // factor), -(-width // factor)
    values = invert(read_images(spark, at(wanted)).withColumn("origin", file_name(F.col("origin"))).join(F.broadcast(maps), "origin").drop("origin"), palette)
    cut = dict(height=h, width=w, factor=factor, header=header, bottom=bottom, left=left, right=right)
    cube = stack(trim(downsample(values, factor, ("channel",)), **cut), sorted(set(wanted.values())))
    cube = Cube(cube.df, cube.channels, cube.space, {"factor": factor, "header": header, "left": left})
    bse = read_images(spark, at(electron[:1])).select("row", "col", luminance().alias("value"))
    return cube, trim(downsample(bse, factor), **cut).withColumnRenamed("value", "bse")


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a CSV with index, shape-type, vertex-index, axis-0, axis-1; vertices in file order."""
    raw = spark.read.option("header", True).schema("`index` int, `shape-type` string, `vertex-index` double, `axis-0` double, `axis-1` double").csv(path)
    lines = raw.withColumn("line", F.monotonically_increasing_id())
    vertex = (F.row_number().over(W.partitionBy("index").orderBy("line")) - 1).alias("vertex")
    return lines.select("index", F.col("shape-type").alias("shape_type"), vertex, F.col("axis-0").alias("axis0"), F.col("axis-1").alias("axis1"))


def write_groups(path: str, groups: dict[str, DataFrame], meta: dict, compression: str = "zstd", tile: int = 256) -> None:
    """Each group as Parquet below ``path``, images clustered by tile, and a JSON of what they are."""
    for name, df in groups.items():
        if {"row", "col"} <= set(df.columns):
            df = df.repartitionByRange(F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)).sortWithinPartitions("row", "col")
        df.write.mode("overwrite").option("compression", compression).parquet(f"{path}/{name}")
    spark = next(iter(groups.values())).sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_group(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])
