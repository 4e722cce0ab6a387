"""Every query of the raster engine, with its SQL equivalent where one exists.

The queries run on a small raster built from ``lineitem`` (channels A, B, D), on
``embeddings`` as features, and on ``nation``, ``supplier`` and ``region`` as name tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.grammar import feature
from .operators import cluster, compare, masks, pixels, split, stencil, summary
from .operators.pixels import Cube
from .plans.flow import builtin, lineage, run_catalogue_flow
from .plans.stages import REGISTRY, Labels, named
from .sources import images

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

RASTER = """raster as (
  select cast(l_orderkey % 64 as int) as "row", cast(l_partkey % 64 as int) as "col",
    cast(sum(cast(l_quantity as bigint)) % 256 as int) as a,
    cast(sum(cast(round(l_extendedprice * 100) as bigint)) % 256 as int) as b,
    cast(sum(cast(round(l_discount * 100) as bigint)) % 256 as int) as d
  from lineitem group by 1, 2
), cube as (
  select "row", "col", case when a < 40 then 0.0::double else a / 255.0::double end as "A",
    case when a < 40 then 0.0::double else b / 255.0::double end as "B",
    case when a < 40 then 0.0::double else d / 255.0::double end as "D", a as la, b as lb, d as ld,
    (("row" // 16) + ("col" // 16)) % 3 as phase from raster
), mineral as (
  select *, "A" <> 0 or "B" <> 0 or "D" <> 0 as mineral from cube
), labels as (
  select "row", "col", case when (la + lb) % 5 = 0 then -1 else phase end as label, ld / 255.0::double as prob, "A", "B", "D" from mineral where mineral
)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"with {RASTER}{',' if sql.lstrip().startswith('+') else ''} " + sql.lstrip().removeprefix("+")
        return f

    return add


# --- the raster ---------------------------------------------------------------------------


def levels(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    whole = lambda c: F.pmod(F.sum(c), F.lit(256)).cast("int")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return t.groupBy((F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")).agg(whole(F.col("l_quantity").cast("bigint")).alias("a"), whole(cents("l_extendedprice")).alias("b"), whole(cents("l_discount")).alias("d"))


def with_phase(df: DataFrame) -> DataFrame:
    return df.withColumn("phase", ((F.floor(F.col("row") / 16) + F.floor(F.col("col") / 16)) % 3).cast("int"))


def cube_of(spark: SparkSession, sf: str) -> tuple[Cube, DataFrame, DataFrame]:
    """The cube (pixels with a < 40 are background), its levels, and its mineral mask."""
    lv = levels(spark, sf)
    df = lv.select("row", "col", *(F.when(F.col("a") < 40, F.lit(0.0)).otherwise(F.col(c) / 255.0).alias(c.upper()) for c in "abd"))
    cube = Cube(df, ("A", "B", "D"))
    return cube, lv, pixels.mineral_mask(cube)


def labels_of(spark: SparkSession, sf: str) -> tuple[DataFrame, Cube]:
    cube, lv, mask = cube_of(spark, sf)
    df = with_phase(lv).join(mask.filter("mineral"), ["row", "col"], "left_semi")
    return df.select("row", "col", F.when((F.col("a") + F.col("b")) % 5 == 0, -1).otherwise(F.col("phase")).alias("label"), (F.col("d") / 255.0).alias("prob")), cube


def planted(spark: SparkSession, sf: str) -> tuple[Cube, DataFrame]:
    """A scene with three planted phases under faint noise from the raster."""
    base = {0: (0.8, 0.2, 0.5), 1: (0.2, 0.8, 0.4), 2: (0.5, 0.5, 0.9)}
    lv = with_phase(levels(spark, sf))
    value = lambda i, c: F.element_at(F.create_map(*(F.lit(x) for k, v in base.items() for x in (k, v[i]))), F.col("phase")) + 0.02 * (F.col(c) / 255.0 - 0.5)
    cube = Cube(lv.select("row", "col", *(value(i, c).alias(c.upper()) for i, c in enumerate("abd"))), ("A", "B", "D"))
    return cube, pixels.mineral_mask(cube)


def r6(*names: str):
    return [F.round(F.col(f"`{n}`"), 6).alias(n) for n in names]


@query('select "row", "col", a, b, d from raster')
def fixture_raster(spark, sf):
    return levels(spark, sf)


# --- sources ------------------------------------------------------------------------------

PALETTE = np.array([((i * 37) % 256, (i * 91) % 256, (i * 53 + 17) % 256) for i in range(64)])
_PAL = "pal as (select cast(i as int) as idx, (i * 37) % 256 as pr, (i * 91) % 256 as pg, (i * 53 + 17) % 256 as pb, i / 63.0::double as scalar from range(64) t(i))"
_INV = _PAL + """, colour as (select distinct a as r, b as g, d as b from raster), inv as (
  select r, g, b, case when r = 0 and g = 0 and b = 0 then 0.0 else arg_min(scalar, ((r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb)) * 1000 + idx) end as scalar from colour, pal group by 1, 2, 3)"""


def _rgb(spark, sf):
    return levels(spark, sf).select("row", "col", F.col("a").alias("r"), F.col("b").alias("g"), F.col("d").alias("b"))


@query("+" + _INV + "select r, g, b, round(scalar, 6) as scalar from inv")
def invert_nearest_palette(spark, sf):
    return images.invert_colours(_rgb(spark, sf), images.palette_table(spark, PALETTE)).select("r", "g", "b", *r6("scalar"))


@query("+" + _INV + ' select "row", "col", round(scalar, 6) as value from raster join inv on a = r and raster.b = g and d = inv.b')
def invert_pixels(spark, sf):
    return images.invert(_rgb(spark, sf), images.palette_table(spark, PALETTE)).select("row", "col", *r6("value"))


@query("+" + _PAL + " select 0.0::double as value, count(*) as n from raster where a < 40")
def invert_black_is_zero(spark, sf):
    black = levels(spark, sf).filter("a < 40").select("row", "col", *(F.lit(0).alias(c) for c in "rgb"))
    return images.invert(black, images.palette_table(spark, PALETTE)).groupBy("value").agg(F.count("*").alias("n"))


@query("select n_name as name, case when n_nationkey % 3 > 0 then n_name || '-K' end as element from nation")
def filename_legacy(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    stem = F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("s-01-"), "n_name", F.lit("-K"))).otherwise(F.concat(F.lit("s-"), F.regexp_replace("n_name", "-", "")))
    return n.select(F.col("n_name").alias("name"), images.legacy_element(stem).alias("element"))


@query("select n_name as name, case when n_nationkey % 2 = 0 then n_name end as element from nation")
def filename_pattern(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    file = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("map (7) "), "n_name", F.lit(".png"))).otherwise(F.concat("n_name", F.lit(".tif")))
    return n.select(F.col("n_name").alias("name"), images.pattern_element(file, "map ({no}) {element}.png").alias("element"))


@query('select "row" // 3 as "row", "col" // 3 as "col", round(sum(a) / 9.0::double, 6) as value from raster group by 1, 2')
def downsample_zero_pad(spark, sf):
    return images.downsample(levels(spark, sf).select("row", "col", F.col("a").alias("value")), 3).select("row", "col", *r6("value"))


@query('select cast("row" // 3 - 2 as int) as "row", cast("col" // 3 - 1 as int) as "col", round(sum(a) / 9.0::double, 6) as value from raster where "row" // 3 between 2 and 20 and "col" // 3 between 1 and 19 group by 1, 2')
def trim_after_downsample(spark, sf):
    small = images.downsample(levels(spark, sf).select("row", "col", F.col("a").alias("value")), 3)
    return images.trim(small, 22, 22, factor=3, header=8, bottom=5, left=4, right=6).select("row", "col", *r6("value"))


@query('select "row", "col", a as "Ca", b as "Fe", d as "Mg" from raster')
def cube_pivot(spark, sf):
    long = levels(spark, sf).selectExpr("row", "col", "stack(3, 'Mg', d, 'Ca', a, 'Fe', b) as (channel, value)")
    return images.stack(long).df


@query('select "row", "col", round((0.2125 * a + 0.7154 * b + 0.0721 * d) / 255.0, 6)::double as bse from raster')
def bse_gray(spark, sf):
    return _rgb(spark, sf).select("row", "col", F.round(images.luminance(), 6).alias("bse"))


# --- masks --------------------------------------------------------------------------------


@query('select "row", "col", mineral from mineral')
def mineral_mask(spark, sf):
    return cube_of(spark, sf)[2]


@query('select count(*) as n_pixels, count(*) as n_valid, count(*) filter (where mineral) as n_mineral, round(100.0 * count(*) filter (where mineral) / count(*), 2)::double as coverage_pct, round(100.0 * count(*) filter (where mineral) / count(*), 2)::double as of_valid_pct from mineral')
def mask_stats(spark, sf):
    return masks.mask_stats(cube_of(spark, sf)[2])




def _comp_sql(near: str, tail: str) -> str:
    return f"""cells as (select cast("row" as bigint) * 2147483648 + "col" as k, cast("row" as bigint) as r, cast("col" as bigint) as c from raster where a < 90),
    reach(k, o) as (select k, k from cells union select reach.k, n.k from reach join cells m on m.k = reach.o join cells n on {near}),
    comp as (select k, min(o) as comp from reach group by 1) {tail}"""


def _rec(near: str, tail: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = f"with recursive {RASTER}, " + _comp_sql(near, tail)
        return f

    return add


_N4 = "abs(n.r - m.r) + abs(n.c - m.c) = 1"
_N8 = "greatest(abs(n.r - m.r), abs(n.c - m.c)) = 1"


def _patch(spark, sf):
    return levels(spark, sf).select("row", "col", (F.col("a") < 90).alias("mineral"))


@_rec(_N4, "select k // 2147483648 as \"row\", k % 2147483648 as \"col\", comp from comp")
def mask_components4(spark, sf):
    return masks.components(_patch(spark, sf), 4, tile=16)


@_rec(_N8, "select count(distinct comp) as n_components from comp")
def mask_components8_count(spark, sf):
    return masks.components(_patch(spark, sf), 8, tile=16).agg(F.countDistinct("comp").alias("n_components"))


@_rec(_N4, ", big as (select comp from comp group by 1 having count(*) >= 4) select \"row\", \"col\", coalesce((\"row\" * 2147483648::bigint + \"col\") in (select k from comp where comp in (select comp from big)), false) as mineral from raster")
def remove_small_objects(spark, sf):
    return masks.remove_small(_patch(spark, sf), 4, tile=16)


@query("""select "row", "col", ("row" >= 5 and "row" < 30 and "col" >= 10 and "col" < 40) or ("row" >= 20 and "row" < 60 and "col" >= 20 and "col" < 50) as valid from raster""")
def polygon_mask(spark, sf):
    square = lambda i, r0, c0, r1, c1: [(i, "polygon", k, float(r), float(c)) for k, (r, c) in enumerate(((r0, c0), (r0, c1), (r1, c1), (r1, c0)))]
    shapes = spark.createDataFrame(square(0, 10, 20, 60, 80) + square(1, 40, 40, 120, 100) + [(2, "path", 0, 0.0, 0.0), (2, "path", 1, 9.0, 9.0)], "index int, shape_type string, vertex int, axis0 double, axis1 double")
    return masks.polygon_mask(levels(spark, sf).select("row", "col"), shapes, factor=2)


@query('select "row", "col", round(case when mineral then "A" else (select avg("A") from mineral where mineral) end, 6) as "A" from mineral')
def mask_fill_mean(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return stencil.filled(cube, mask)[0].df.select("row", "col", *r6("A"))


def _bilateral_sql(guide: str, off: bool, source: str = "raster") -> str:
    weight = "exp(-(power((i * 7 + j) // 8 - 4, 2) + power((i * 7 + j) % 8 - 4, 2)) / 2.0)" if off else "exp(-(power(i - 3, 2) + power(j - 3, 2)) / 2.0)"
    return f"""+steps as (select cast(i - 3 as int) as dr, cast(j - 3 as int) as dc, {weight} as w from range(7) x(i), range(7) y(j)),
    p as (select "row", "col", a / 255.0::double as v, {guide} as g from raster),
    q as (select p."row", p."col", w * exp(-0.5 * power(least(floor(abs(p.g - coalesce(n.g, 0)) * 10000 / 4.0), 9999) * 4.0 / 10000 / 0.25, 2)) as e, coalesce(n.v, 0) as v
      from p, steps left join p n on n."row" = p."row" + dr and n."col" = p."col" + dc)
    select "row", "col", round(sum(e * v) / sum(e), 6) as out from q group by 1, 2"""


_BSE = "(0.2125::double * a + 0.7154::double * b + 0.0721::double * d) / 255.0::double"


def _band(spark, sf, guide, off=False):
    p = levels(spark, sf).select("row", "col", (F.col("a") / 255.0).alias("value"), F.expr(guide).alias("guide"))
    return stencil.bilateral_relational(p, 1.0, 0.25, 4.0, off).select("row", "col", *r6("out"))


@query(_bilateral_sql("a / 255.0::double", False))
def bilateral_sym(spark, sf):
    return _band(spark, sf, "a / 255.0D")


@query(_bilateral_sql("a / 255.0::double", True))
def bilateral_offcentre(spark, sf):
    return _band(spark, sf, "a / 255.0D", True)


@query(_bilateral_sql("(a + b + d) / 255.0::double", False))
def joint_total(spark, sf):
    return _band(spark, sf, "(a + b + d) / 255.0D")


@query(_bilateral_sql(_BSE, False))
def joint_bse(spark, sf):
    return _band(spark, sf, "(0.2125D * a + 0.7154D * b + 0.0721D * d) / 255.0D")


_FILLED = "filled as (select \"row\", \"col\", mineral, " + ", ".join(f'case when mineral then "{c}" else (select avg("{c}") from mineral where mineral) end as "{c}"' for c in "ABD") + " from mineral)"


def _smooth_sql(off: bool, guide: str | None = None, out: str = "smooth") -> str:
    """Tables of the bilateral filter over the filled channels, in long form: (row, col, mineral, ch, v)."""
    weight = "exp(-(power((i * 7 + j) // 8 - 4, 2) + power((i * 7 + j) % 8 - 4, 2)) / 2.0)" if off else "exp(-(power(i - 3, 2) + power(j - 3, 2)) / 2.0)"
    channels = " union all ".join(f"""select "row", "col", mineral, '{c}' as ch, "{c}" as v, {guide or f'"{c}"'} as g from filled""" for c in "ABD")
    span = "max(g)" if off else "greatest(max(g), 0) - least(min(g), 0)"
    return f"""chan as materialized ({channels}), facts as (select ch, {span} as span, stddev_pop(g) as sigma from chan group by 1),
    steps as (select cast(i - 3 as int) as dr, cast(j - 3 as int) as dc, {weight} as w from range(7) x(i), range(7) y(j)),
    asked as (select c."row", c."col", c.mineral, c.ch, c.g, span, sigma, c."row" + dr as r2, c."col" + dc as c2, w from chan c join facts using (ch), steps),
    met as (select p."row", p."col", p.mineral, p.ch, w * exp(-0.5 * power(least(floor(abs(p.g - coalesce(n.g, 0)) * (10000 / span)), 9999) * span / 10000 / sigma, 2)) as e, coalesce(n.v, 0) as v
      from asked p left join chan n on n.ch = p.ch and n."row" = p.r2 and n."col" = p.c2),
    {out} as (select "row", "col", mineral, ch, case when mineral then sum(e * v) / sum(e) else 0.0 end as v from met group by 1, 2, 3, 4)"""


def _diffused_sql(rounds: int = 10, out: str = "diffused") -> str:
    """Tables of the diffusion, a round each, in the same long form."""
    channels = " union all ".join(f"""select "row", "col", mineral, '{c}' as ch, ("{c}" - low) / (high - low) as u, low, high from filled, (select min("{c}") as low, max("{c}") as high from mineral where mineral)""" for c in "ABD")
    tables = [f"u0 as materialized ({channels})"]
    flow = lambda a, b: f"coalesce(({a} - {b}) / (1 + power(({a} - {b}) / 50.0, 2)), 0)"
    for i in range(rounds):
        near = " ".join(f'left join u{i} {n} on {n}.ch = p.ch and {n}."row" = p."row" + {dr} and {n}."col" = p."col" + {dc}' for n, dr, dc in (("s", 1, 0), ("n", -1, 0), ("e", 0, 1), ("w", 0, -1)))
        tables.append(f"""u{i + 1} as materialized (select p."row", p."col", p.mineral, p.ch, p.u + 0.1::double * ({flow("s.u", "p.u")} - {flow("p.u", "n.u")} + {flow("e.u", "p.u")} - {flow("p.u", "w.u")}) as u, p.low, p.high from u{i} p {near})""")
    return ", ".join(tables) + f', {out} as (select "row", "col", mineral, ch, case when mineral then u * (high - low) + low else 0.0 end as v from u{rounds})'


def _wide_sql(table: str) -> str:
    return 'select "row", "col", ' + ", ".join(f"round(max(v) filter (where ch = '{c}'), 6) as \"{c}\"" for c in "ABD") + f" from {table} group by 1, 2"


def _smoothed(spark, sf, **options):
    """The tiled filter in double precision, as its SQL computes it."""
    cube, _, mask = cube_of(spark, sf)
    return stencil.bilateral(cube, mask, tile=32, kind=np.float64, **options).df.select("row", "col", *r6(*"ABD"))


@query(f"+{_FILLED}, {_smooth_sql(False)} {_wide_sql('smooth')}")
def bilateral_tiled(spark, sf):
    return _smoothed(spark, sf)


@query(f"+{_FILLED}, {_smooth_sql(True)} {_wide_sql('smooth')}")
def bilateral_tiled_offcentre(spark, sf):
    return _smoothed(spark, sf, off_centre=True)


@query(f"""+{_FILLED}, {_smooth_sql(False, '"A" + "B" + "D"')} {_wide_sql('smooth')}""")
def joint_tiled_total(spark, sf):
    return _smoothed(spark, sf, guide="total")


@query(f"+{_FILLED}, {_diffused_sql()} {_wide_sql('diffused')}")
def anisotropic_diffusion(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return stencil.diffuse(cube, mask, tile=32, kind=np.float64).df.select("row", "col", *r6(*"ABD"))


def _sobel_sql(source: str, out: str) -> str:
    """Sobel magnitudes of (row, col, ch, v) by the nine neighbours; one that is not there counts as the nearest pixel inwards."""
    near = " ".join(f'left join {source} {n} on {n}.ch = p.ch and {n}."row" = p."row" + {dr} and {n}."col" = p."col" + {dc}' for n, dr, dc in (("n", -1, 0), ("s", 1, 0)))
    return f"""{out}_x as materialized (select p.ch, p."row", p."col", (coalesce(e.v, p.v) - coalesce(w.v, p.v)) / 2 as d, (coalesce(w.v, p.v) + 2 * p.v + coalesce(e.v, p.v)) / 4 as s from {source} p
      left join {source} e on e.ch = p.ch and e."row" = p."row" and e."col" = p."col" + 1 left join {source} w on w.ch = p.ch and w."row" = p."row" and w."col" = p."col" - 1),
    {out} as materialized (select p.ch, p."row", p."col", sqrt((power((coalesce(n.d, p.d) + 2 * p.d + coalesce(s.d, p.d)) / 4, 2) + power((coalesce(s.s, p.s) - coalesce(n.s, p.s)) / 2, 2)) / 2) as g from {out}_x p {near.replace(f'join {source} ', f'join {out}_x ')})"""


def _metrics_sql(method: str, table: str) -> str:
    return f"""select '{method}' as method, r.ch as channel, round(sqrt(avg(power(r.v - t.v, 2))), 6) as rmse, round(corr(g.g, l.g), 6) as edge_preservation
      from rawlong r join {table} t using ("row", "col", ch) join {table}_g g using ("row", "col", ch) join light_g l on l."row" = r."row" and l."col" = r."col" where r.mineral group by 2"""


@query(
    f"+{_FILLED}, {_smooth_sql(True)}, {_diffused_sql()}, rawlong as ("
    + " union all ".join(f"""select "row", "col", mineral, '{c}' as ch, "{c}" as v from mineral""" for c in "ABD")
    + f"), light as (select 'bse' as ch, \"row\", \"col\", {_BSE} as v from raster), {_sobel_sql('smooth', 'smooth_g')}, {_sobel_sql('diffused', 'diffused_g')}, {_sobel_sql('light', 'light_g')} "
    + _metrics_sql("bilateral", "smooth") + " union all " + _metrics_sql("anisotropic", "diffused")
)
def compare_denoisers(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    bse = levels(spark, sf).select("row", "col", F.expr("(0.2125D * a + 0.7154D * b + 0.0721D * d) / 255.0D").alias("bse"))
    return compare.compare_denoisers(cube, mask, bse, tile=32, kind=np.float64).select("method", "channel", *r6("rmse", "edge_preservation"))


# --- normalisation and components ---------------------------------------------------------

_LONG = """+long as (select 'A' as channel, "A" as x from mineral where mineral union all select 'B', "B" from mineral where mineral union all select 'D', "D" from mineral where mineral)"""


@query(_LONG + " select channel, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from long group by 1")
def zscore_stats(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return pixels.zscore_stats(cube, mask).select("channel", *r6("mean", "std"))


@query('select "row", "col", ' + ", ".join(f'round(case when mineral then ("{c}" - (select avg("{c}") from mineral where mineral)) / (select stddev_pop("{c}") from mineral where mineral) else 0 end, 5) + 0.0 as "{c}"' for c in "ABD") + " from mineral")
def zscore_cube(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return pixels.zscore(cube, mask).df.select("row", "col", *((F.round(c, 5) + 0.0).alias(c) for c in "ABD"))


@query('select "row", "col", 0.0::double as "K" from mineral')
def zscore_zero_std(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return pixels.zscore(Cube(cube.df.select("row", "col", F.when(F.col("A") != 0, 0.5).otherwise(0.0).alias("K")), ("K",)), pixels.mineral_mask(Cube(cube.df.select("row", "col", "A"), ("A",)))).df


@query('select channel, true as ok from (values (\'A\'), (\'B\'), (\'D\')) t(channel)')
def validate_normalization(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return pixels.validate_normalized(pixels.zscore(cube, mask), mask).select("channel", "ok")


_PAIRS = [(a, b) for i, a in enumerate("ABD") for b in "ABD"[i:]]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(covar_samp(\"{a}\", \"{b}\"), 6) as value from mineral where mineral" for a, b in _PAIRS))
def covariance_matrix(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return pixels.covariance(cube, mask).select("a", "b", *r6("value"))


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr(\"{a}\", \"{b}\"), 6) as value from mineral where mineral" for a, b in _PAIRS))
def correlation_matrix(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return pixels.covariance(cube, mask, "corr").select("a", "b", *r6("value"))


_SHARE = """+s as (select "row" as component, sum(a)::double / (select sum(a) from raster) as share from raster group by 1)"""


def _shares(spark, sf):
    lv = levels(spark, sf)
    return lv.groupBy(F.col("row").alias("component")).agg(F.sum("a").alias("n")).crossJoin(F.broadcast(lv.agg(F.sum("a").alias("all")))).select("component", (F.col("n") / F.col("all")).alias("share"))


@query(_SHARE + " select component, round(share, 6) as share, round(sum(share) over (order by component), 6) as total from s")
def evr_cumulative(spark, sf):
    return pixels.cumulative(_shares(spark, sf)).select("component", *r6("share", "total"))


@query(_SHARE + ", t as (select component, sum(share) over (order by component) as total from s) select greatest(count(*) filter (where total < 0.7) + 1, 5) as k from t")
def auto_components(spark, sf):
    shares = [r.share for r in _shares(spark, sf).orderBy("component").collect()]
    return spark.createDataFrame([(pixels.auto_components(shares, 0.7, 5),)], "k long")


@query()
def pca_features(spark, sf):
    cube, mask = planted(spark, sf)
    return pixels.pca(pixels.zscore(cube, mask), mask)[0]


@query('select cast(row_number() over (order by variance desc, channel) as int) as place, channel, round(variance, 6) as variance from (select \'A\' as channel, var_pop("A") as variance from mineral where mineral union all select \'B\', var_pop("B") from mineral where mineral union all select \'D\', var_pop("D") from mineral where mineral) order by 1 limit 2')
def top_variance(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return summary.top_variance(cube, mask, 2).select("place", "channel", *r6("variance"))


# --- tiles, registry, neighbours ----------------------------------------------------------


@query('+t as (select "row" // 20 as tr, "col" // 20 as tc, count(*) as n_pixels from mineral where mineral group by 1, 2) select tr, tc, n_pixels, cast(row_number() over (order by tr, tc) - 1 as int) as tile_id from t')
def tile_grid(spark, sf):
    _, _, mask = cube_of(spark, sf)
    return cluster.tile_grid(mask.filter("mineral"), 20, 0)


@query('+t as (select "row" // 20 as tr, "col" // 20 as tc, count(*) as n_pixels from mineral where mineral group by 1, 2 having count(*) >= 100) select tr, tc, n_pixels, cast(row_number() over (order by tr, tc) - 1 as int) as tile_id from t')
def tile_min_pixels(spark, sf):
    _, _, mask = cube_of(spark, sf)
    return cluster.tile_grid(mask.filter("mineral"), 20, 100)


@query('select cast("row" // 32 * 2 + "col" // 32 as int) as tile_id, label, count(*) as n_pixels, round(avg("A"), 6) as "A", round(avg("B"), 6) as "B", round(avg("D"), 6) as "D" from labels where label >= 0 group by 1, 2')
def tile_fingerprints(spark, sf):
    labels, cube = labels_of(spark, sf)
    labels = labels.withColumn("tile_id", (F.floor(F.col("row") / 32) * 2 + F.floor(F.col("col") / 32)).cast("int"))
    return cluster.fingerprint_means(labels, cube, ["tile_id", "label"]).select("tile_id", "label", "n_pixels", *(F.round(F.col("mean")[i], 6).alias(c) for i, c in enumerate("ABD")))


@query("""+fp as (select cast("row" // 32 * 2 + "col" // 32 as int) as tile_id, label, avg("A") as x, avg("B") as y, avg("D") as z from labels where label >= 0 group by 1, 2),
  s as (select a.tile_id, a.label, b.label as match, (a.x*b.x + a.y*b.y + a.z*b.z) / sqrt((a.x*a.x + a.y*a.y + a.z*a.z) * (b.x*b.x + b.y*b.y + b.z*b.z)) as c from fp a join fp b on b.tile_id = 0 and a.tile_id > 0)
  select tile_id, label, cast(arg_max(match, c) as int) as match from s group by 1, 2 having max(c) >= 0.5""")
def registry_best_match(spark, sf):
    labels, cube = labels_of(spark, sf)
    labels = labels.withColumn("tile_id", (F.floor(F.col("row") / 32) * 2 + F.floor(F.col("col") / 32)).cast("int"))
    rows = cluster.fingerprint_means(labels, cube, ["tile_id", "label"]).collect()
    registry = [{"label": r.label, "mean": np.array(r["mean"])} for r in sorted(rows, key=lambda r: r.label) if r.tile_id == 0]
    found = [(r.tile_id, r.label, cluster.best_match(np.array(r["mean"]), registry, 0.5)) for r in rows if r.tile_id > 0]
    return spark.createDataFrame([(t, l, registry[m]["label"]) for t, l, m in found if m is not None], "tile_id int, label int, match int")


@query('+t as (select "row" // 16 as tr, "col" // 16 as tc from labels group by 1, 2 having count(distinct case when label >= 0 then label end) < 2) select "row", "col" from labels join t on "row" // 16 = tr and "col" // 16 = tc')
def deferred_pixels(spark, sf):
    return cluster.deferred_pixels(labels_of(spark, sf)[0], 16, 2).select("row", "col")


_KNN = """+e as (select vec_id, label, embedding as v from embeddings),
  d as (select q.vec_id as pixel_id, r.vec_id as other, r.label, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as d2 from e q join e r on q.vec_id % 5 = 0 and r.vec_id % 5 <> 0),
  k as (select *, row_number() over (partition by pixel_id order by d2, other) as n from d), w as (select pixel_id, label, sum(1 / sqrt(d2)) as w from k where n <= 5 group by 1, 2)"""


def _embedded(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("pixel_id"), F.col("embedding").alias("f"), "label")
    return e.filter("pixel_id % 5 = 0"), e.filter("pixel_id % 5 <> 0")


@query(_KNN + " select pixel_id, cast(arg_min(label, -round(w, 9) * 1000 + label * 1e-9) as int) as label from w group by 1")
def knn_vote(spark, sf):
    return cluster.knn_vote(*_embedded(spark, sf), k=5)


@query(_KNN + ", v as (select pixel_id, arg_min(label, -round(w, 9) * 1000 + label * 1e-9) as label from w group by 1) select cast(label as int) as label, count(*) as gained from v group by 1")
def knn_gain_per_phase(spark, sf):
    return cluster.knn_vote(*_embedded(spark, sf), k=5).groupBy("label").agg(F.count("*").alias("gained"))


@query("select n_nationkey::bigint as pixel_id, 1 as label from nation")
def knn_zero_distance(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("pixel_id"))
    return cluster.vote(n.select("pixel_id", F.explode(F.expr("transform(array(0.0D, 0.01D, 0.01D, 0.01D, 0.01D), d -> named_struct('label', cast(d = 0 as int), 'd', d))")).alias("x")).select("pixel_id", "x.*"))


@query("select n_nationkey::bigint as pixel_id, 2 as label from nation")
def knn_tie_lowest(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("pixel_id"))
    return cluster.vote(n.select("pixel_id", F.explode(F.expr("array(named_struct('label', 3, 'd', 0.5D), named_struct('label', 2, 'd', 0.5D))")).alias("x")).select("pixel_id", "x.*"))


# --- summaries ----------------------------------------------------------------------------

_FP = """+prints as (""" + " union all ".join(f"""select label, '{c}' as element, avg("{c}") as mean, stddev_pop("{c}") as std, count(*) as n_pixels, 100.0::double * count(*) / (select count(*) from labels where label >= 0) as area_pct from labels where label >= 0 group by 1""" for c in "ABD") + ")"


def _prints(spark, sf):
    return summary.fingerprints(*labels_of(spark, sf))


@query("select label, count(*) as n_pixels, round(100.0::double * count(*) / (select count(*) from labels), 6) as pct, round(avg(prob), 6) as mean_prob from labels where label >= 0 group by 1")
def cluster_stats(spark, sf):
    return summary.cluster_stats(labels_of(spark, sf)[0]).select("label", "n_pixels", *r6("pct", "mean_prob"))


@query(_FP + " select label, element, round(mean, 6) as mean, round(std, 6) as std, n_pixels, round(area_pct, 6) as area_pct from prints")
def fingerprints(spark, sf):
    return _prints(spark, sf).select("label", "element", *r6("mean", "std"), "n_pixels", *r6("area_pct"))


@query(_FP + ", v as (select element, var_pop(mean) as variance from prints group by 1) select element, round(variance, 9) as variance, cast(row_number() over (order by variance desc, element) as int) as place from v")
def element_order(spark, sf):
    return summary.element_order(_prints(spark, sf)).select("element", F.round("variance", 9).alias("variance"), "place")


@query(_FP + " select a.label as a, b.label as b, round(sum(a.mean * b.mean) / sqrt(sum(a.mean * a.mean) * sum(b.mean * b.mean)), 6) as similarity from prints a join prints b on a.element = b.element and a.label < b.label group by 1, 2 having sum(a.mean * b.mean) / sqrt(sum(a.mean * a.mean) * sum(b.mean * b.mean)) > 0.95")
def similar_pairs(spark, sf):
    return summary.similar_pairs(_prints(spark, sf)).select("a", "b", *r6("similarity"))


@query(_FP + ", r as (select *, cast(row_number() over (partition by label order by mean desc, element) as int) as place from prints) select label, place, element, round(mean, 6) as mean from r where place <= 2")
def top_elements(spark, sf):
    return summary.top_elements(_prints(spark, sf), 2).select("label", "place", "element", *r6("mean"))


@query('select "row", "col", label, n_name as name from labels left join nation on n_nationkey = label')
def name_phases(spark, sf):
    labels = labels_of(spark, sf)[0].select("row", "col", "label")
    there = [r.label for r in labels.filter("label >= 0").select("label").distinct().collect()]  # a row a phase
    given = spark.read.parquet(f"{sf}/nation.parquet").filter(F.col("n_nationkey").isin(there)).select("n_nationkey", "n_name").collect()
    out = REGISTRY["name_phases"].run(spark, {"labels": Labels(labels, "cleaned")}, {"names": "; ".join(f"{r[0]}: {r[1]}" for r in given)})["labels"]
    return named(out.df, out.names).select("row", "col", "label", "name")


@query('select "row", "col", case when label = 2 and "A" > 0.6 and "B" < 0.5 then 3 else label end as label from labels')
def split_threshold(spark, sf):
    labels, cube = labels_of(spark, sf)
    return split.split_threshold(labels.select("row", "col", "label"), cube, 2, "a > 0.6 & B < 0.50")[0]


@query('select "row", "col", round(case when "A" + "B" > 0 then "A" / ("A" + "B") else 0 end, 6) as ratio from mineral')
def ratio_feature(spark, sf):
    cube, _, _ = cube_of(spark, sf)
    return cube.df.select("row", "col", F.round(feature("A/(A+B)", ["A", "B", "D"]), 6).alias("ratio"))


_REGION = """+work as (select "row" // 2 as wr, "col" // 2 as wc, max(label) as parent from labels group by 1, 2),
  region as (select l."row", l."col", l."row" // 2 as wr, l."col" // 2 as wc, parent, l.label from labels l join work on l."row" // 2 = wr and l."col" // 2 = wc where parent in (0, 2))"""


def _coarse(labels):
    """Working labels at half the resolution of the raster, over all of it."""
    half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("row", "col")]
    return labels.groupBy(*half).agg(F.max("label").alias("label"), F.max("prob").alias("prob"))


def _region(spark, sf):
    labels, _ = labels_of(spark, sf)
    return split.hires_region(_coarse(labels), labels.select("row", "col", "label"), [0, 2], 2)


@query(_REGION + ' select "row", "col", wr, wc, parent, label from region')
def hires_region(spark, sf):
    return _region(spark, sf).select("row", "col", "wr", "wc", "parent", "label")


@query(_REGION + """, h as (select wr, wc, max(parent) as parent, max(case when "row" = wr * 2 and "col" = wc * 2 then label end) as corner from region group by 1, 2),
  v as (select wr, wc, label, count(*) as n from region where label >= 0 group by 1, 2, 3), o as (select v.*, row_number() over (partition by v.wr, v.wc order by n desc, coalesce(v.label = corner, false) desc, v.label) as k from v join h using (wr, wc))
  select h.wr, h.wc, coalesce(o.label, parent) as label from h left join o on h.wr = o.wr and h.wc = o.wc and k = 1""")
def hires_majority(spark, sf):
    return split.majority(_region(spark, sf), 2)


@query('select cast(r as int) as "row", cast(c as int) as "col", coalesce(label, -1) as label from range(64) x(r) cross join range(64) y(c) left join labels on "row" = r and "col" = c')
def label_image(spark, sf):
    return summary.label_image(labels_of(spark, sf)[0], 64, 64)


@query("select label, case when label < 0 then '#d9d9d9' else list_extract([" + ", ".join(f"'{c}'" for c in summary.TAB20) + "], label % 20 + 1) end as colour from (select n_nationkey - 1 as label from nation)")
def label_colours(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey") - 1).alias("label"))
    return n.select("label", summary.label_colour(F.col("label")).alias("colour"))


@query("select phase as label, count(*) as n_pixels, count(*) filter (where label < 0) as gained from (select case when (la + lb) % 5 = 0 then -1 else phase end as label, phase from mineral where mineral) group by 1")
def gained_pixels(spark, sf):
    labels, _ = labels_of(spark, sf)
    voted = with_phase(labels.select("row", "col")).select("row", "col", F.col("phase").alias("label"))
    return summary.gained(voted, labels)


@query("select n_regionkey % 3 as kind, arg_max(n_name, n_nationkey) as path from nation group by 1")
def newest_entry(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return summary.newest(n.select((F.col("n_regionkey") % 3).alias("kind"), F.col("n_name").alias("path"), F.col("n_nationkey").alias("mtime")))


@query(_LONG + ", e as (select channel, min(x) as low, max(x) as high, count(*) as n from long group by 1) select channel, cast(least(floor((x - low) / (high - low) * 100), 99) as bigint) as bin, round(count(*) / any_value(n)::double / ((any_value(high) - any_value(low)) / 100), 6) as density from long join e using (channel) group by 1, 2")
def qc_histogram(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return summary.histogram(cube, mask).select("channel", F.col("bin").cast("long").alias("bin"), *r6("density"))


@query(_LONG + " select channel, q, round(quantile_cont(x, q), 6) as value from long, (values (0.01::double), (0.02::double), (0.98::double), (0.99::double)) t(q) group by channel, q".replace("quantile_cont(x, q)", "case q when 0.01 then quantile_cont(x, 0.01) when 0.02 then quantile_cont(x, 0.02) when 0.98 then quantile_cont(x, 0.98) else quantile_cont(x, 0.99) end"))
def qc_percentiles(spark, sf):
    cube, _, mask = cube_of(spark, sf)
    return summary.percentiles(cube, mask).select("channel", "q", *r6("value"))


@query("+n as (select label, count(*) as n_pixels from labels group by 1) select label, n_pixels, cast(row_number() over (order by label < 0, n_pixels desc, label) as int) as place from n")
def qc_cluster_summary(spark, sf):
    return summary.size_table(labels_of(spark, sf)[0])


@query("+n as (select case when n_nationkey % 7 = 6 then 1073741824 else n_nationkey % 7 end as tile_id, count(*) as n_new from nation group by 1) select tile_id, n_new, cast(sum(n_new) over (order by tile_id) as bigint) as total from n")
def phase_discovery_curve(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return summary.discovery_curve(n.select(F.when(F.col("n_nationkey") % 7 == 6, -1).otherwise(F.col("n_nationkey") % 7).alias("discovered_in_tile")))


def _lineage_sql() -> str:
    edges = ", ".join(sorted({f"('{b}', '{a}')" for a, _, b, _ in builtin("tiled-rare").edges}))
    return f"""with recursive edge(node, up) as (values {edges}), walk(node, distance) as (
      select 'knn', 0 union select up, distance + 1 from walk join edge using (node))
      select node, min(distance) as distance from walk group by 1"""


@query()
def lineage_upstream(spark, sf):
    return spark.createDataFrame(list(lineage(builtin("tiled-rare"), "knn").items()), "node string, distance int")


_SQL["lineage_upstream"] = _lineage_sql()


# --- models: no SQL form; held against the planted phases in the tests ---------------------


def _features(spark, sf):
    cube, mask = planted(spark, sf)
    return pixels.pca(pixels.zscore(cube, mask), mask)[0], cube


@query()
def hdbscan_global(spark, sf):
    return cluster.hdbscan_global(_features(spark, sf)[0], 100, 25)


@query()
def hdbscan_subsample_predict(spark, sf):
    return cluster.hdbscan_global(_features(spark, sf)[0], 60, 15, subsample_n=1000)


@query()
def hdbscan_tiled(spark, sf):
    features, cube = _features(spark, sf)
    return cluster.hdbscan_tiled(features, cube, tile_size=32, min_cluster_size=60, min_samples=15, min_clusters_per_tile=2)[0]


@query()
def rare_phase(spark, sf):
    features, cube = _features(spark, sf)
    labels, tiles, registry = cluster.hdbscan_tiled(features, cube, tile_size=32, min_cluster_size=260, min_samples=15, min_clusters_per_tile=1)
    return cluster.rare_phase(labels, features, cube, tiles, registry, 50, 15)[0]


def _numbered(spark, sf):
    labels, cube = labels_of(spark, sf)
    return pixels.pixel_ids(labels), cube


@query()
def gmm_split(spark, sf):
    labels, cube = _numbered(spark, sf)
    return split.split_gmm(labels, cube, 1, ["A", "B/(A+B)"], order_by="A")[0]


@query()
def hires_gmm(spark, sf):
    labels, cube = labels_of(spark, sf)
    return split.split_hires(_coarse(labels), cube, [0, 2], "A/(A+B)", 2)[0]


@query()
def flow_run_stepwise(spark, sf):
    return run_catalogue_flow(spark, planted(spark, sf)[0], tiled=False)


@query()
def flow_run_tiled_rare(spark, sf):
    return run_catalogue_flow(spark, planted(spark, sf)[0], tiled=True)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
