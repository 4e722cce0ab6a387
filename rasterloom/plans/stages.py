"""Stages: typed parameters, typed ports, and the plan each one adds."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FlowError, ParamError
from ..functions import grammar
from ..operators import cluster, masks, pixels, split, stencil, summary
from ..operators.pixels import Cube
from ..sources import images

_WORDS = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}


@dataclass(frozen=True)
class Param:
    kind: str
    template: Any
    choices: tuple = ()
    least: float | None = None
    most: float | None = None

    def coerce(self, name: str, value: Any) -> Any:
        if value is None:
            if self.template is None:
                return None
            raise ParamError(f"{name}: null is allowed only where the template is null")
        try:
            if self.kind == "int":
                if isinstance(value, bool) or float(value) != int(float(value)):
                    raise ValueError
                value = int(float(value))
            elif self.kind == "float":
                if isinstance(value, bool):
                    raise ValueError
                value = float(value)
            elif self.kind == "bool":
                value = value if isinstance(value, bool) else _WORDS[str(value).lower()]
            else:
                if not isinstance(value, (str, int, float)) or isinstance(value, bool):
                    raise ValueError
                value = type(self.choices[0])(value) if self.choices else str(value)
        except (ValueError, KeyError, TypeError):
            raise ParamError(f"{name}: {value!r} is not of type {self.kind}") from None
        if self.choices and value not in self.choices:
            raise ParamError(f"{name}: {value!r} is not one of {', '.join(map(str, self.choices))}")
        if self.least is not None and value < self.least or self.most is not None and value > self.most:
            raise ParamError(f"{name}: {value!r} is outside [{self.least}, {self.most}]")
        return value


@dataclass(frozen=True)
class Stage:
    name: str
    inputs: dict[str, str]  # port -> tag; a trailing ? marks an optional port
    outputs: dict[str, str]
    params: dict[str, Param]
    apply: Callable[..., dict]
    check: Callable[[dict], None] = lambda params: None
    source: bool = False

    @property
    def sink(self) -> bool:
        return not self.outputs

    def template(self) -> dict:
        return {k: p.template for k, p in self.params.items()}

    def coerced(self, params: dict, complete: bool = True) -> dict:
        unknown = sorted(set(params) - set(self.params))
        if unknown:
            raise ParamError(f"{self.name}: no parameter {unknown[0]!r}")
        return {k: p.coerce(f"{self.name}.{k}", params[k] if k in params or not complete else p.template) for k, p in self.params.items()}

    def run(self, spark, inputs: dict, params: dict) -> dict:
        params = self.coerced(params)
        self.check(params)
        for port, tag in self.inputs.items():
            if not tag.endswith("?") and port not in inputs:
                raise FlowError(f"{self.name}: input {port!r} is missing")
            want, got = tag.rstrip("?").partition(":")[2], getattr(inputs.get(port), "space", None)
            if port in inputs and want and got and want != got:
                raise FlowError(f"{self.name}: input {port!r} is {got}, not {want}")
        return self.apply(spark, inputs, params)


@dataclass(frozen=True)
class Labels:
    df: DataFrame
    space: str
    names: dict = field(default_factory=dict)
    history: tuple = ()


@dataclass(frozen=True)
class Tiles:
    tiles: list
    registry: list


@dataclass(frozen=True)
class Features:
    df: DataFrame
    explained: list


REGISTRY: dict[str, Stage] = {}


def stage(name, inputs, outputs, check=None, source=False, **params):
    """Registers a stage; a second one of the same name is an error. Other modules may add their own."""

    def add(f):
        if name in REGISTRY:
            raise FlowError(f"stage {name!r} is registered twice")
        REGISTRY[name] = Stage(name, inputs, outputs, params, f, check or (lambda p: None), source)
        return f

    return add


#: Only the processor is used; other devices are refused.
DEVICE = Param("enum", "cpu", ("cpu",))
#: Sums in single precision depend on the order of pixels; they are sequential and repeat older runs.
SUMS = Param("enum", "float64", ("float64", "float32"))


def num(kind, template, least=None, most=None):
    return Param(kind, template, (), least, most)


@stage("load_elements", {}, {"cube": "cube:raw", "bse": "bse"}, source=True, input_dir=Param("str", "{input}"), file_glob=Param("str", "*.png"), filename_pattern=Param("str", None), bse_filename=Param("str", None), colormap=Param("str", "lut:palette.npy"), exclude_elements=Param("str", "Fe-L"), include_elements=Param("str", None), bse_channel=Param("str", "SEM"), header_trim_px=num("int", 0, 0), bottom_trim_px=num("int", 0, 0), left_trim_px=num("int", 0, 0), right_trim_px=num("int", 0, 0), downsample_factor=num("int", 2, 1))
def _load(spark, x, p):
    cube, bse = images.load_elements(spark, p["input_dir"], images.read_palette(spark, p["colormap"]), p["file_glob"], p["filename_pattern"], p["bse_channel"], tuple(grammar.csv_list(p["exclude_elements"])), tuple(grammar.csv_list(p["include_elements"])), p["downsample_factor"], p["header_trim_px"], p["bottom_trim_px"], p["left_trim_px"], p["right_trim_px"], bse_filename=p["bse_filename"])
    return {"cube": cube, "bse": bse}


@stage("mask", {"cube": "cube:raw"}, {"masks": "masks"}, min_object_size=num("int", 100, 0), valid_mask_path=Param("str", None))
def _mask(spark, x, p):
    cube, valid = x["cube"], None
    if p["valid_mask_path"]:
        g = cube.geometry
        valid = masks.polygon_mask(cube.df.select("row", "col"), images.read_shapes(spark, p["valid_mask_path"]), g.get("factor", 1), (g.get("header", 0), g.get("left", 0)))
    return {"masks": masks.remove_small(pixels.mineral_mask(cube, valid), p["min_object_size"])}


@stage("denoise", {"cube": "cube:raw", "masks": "masks", "bse": "bse?"}, {"cube": "cube:denoised"}, method=Param("enum", "bilateral", ("bilateral", "bilateral_sym", "joint_bilateral_total", "joint_bilateral_bse", "anisotropic_diffusion")), sigma_color=num("float", None, 0.0), sigma_spatial=num("float", 1.0, 0.0), niter=num("int", 10, 1), kappa=num("float", 50.0, 0.0), gamma=num("float", 0.1, 0.0, 0.25), option=Param("enum", 2, (1, 2)), device=DEVICE)
def _denoise(spark, x, p):
    cube, mask, method = x["cube"], x["masks"], p["method"]
    if method == "anisotropic_diffusion":
        return {"cube": stencil.diffuse(cube, mask, p["niter"], p["kappa"], p["gamma"], p["option"])}
    guide = {"joint_bilateral_total": "total", "joint_bilateral_bse": "bse"}.get(method)
    if guide == "bse":
        if "bse" not in x:
            raise FlowError("denoise: method joint_bilateral_bse needs the bse input")
        cube = Cube(cube.df.join(x["bse"], ["row", "col"]), cube.channels, cube.space, cube.geometry)
    return {"cube": stencil.bilateral(cube, mask, p["sigma_spatial"], p["sigma_color"], guide, method == "bilateral")}


@stage("normalize", {"cube": "cube:denoised", "masks": "masks"}, {"cube": "cube:normalized"}, method=Param("enum", "zscore", ("zscore",)), accumulate=SUMS, device=DEVICE)
def _normalize(spark, x, p):
    stats = None
    if p["accumulate"] == "float32":
        from pyspark.sql import Row

        stats = [Row(channel=r[0], mean=r[1], std=r[2]) for r in pixels.sequential_stats(x["cube"], x["masks"])]
    return {"cube": pixels.zscore(x["cube"], x["masks"], stats)}


@stage("pca", {"cube": "cube:normalized", "masks": "masks"}, {"features": "features"}, n_components=num("int", 0, 0), variance_threshold=num("float", 0.95, 0.0, 1.0), min_components=num("int", 5, 1), subsample_fraction=num("float", 0.0, 0.0, 1.0), random_state=num("int", 42), device=DEVICE)
def _pca(spark, x, p):
    if p["n_components"] > len(x["cube"].channels):
        raise FlowError(f"pca: {p['n_components']} components of {len(x['cube'].channels)} channels")
    df, explained = pixels.pca(x["cube"], x["masks"], p["n_components"], p["variance_threshold"], p["min_components"], p["subsample_fraction"], p["random_state"])
    return {"features": Features(df, explained)}


def _plain(p: dict) -> dict:
    return {k: v for k, v in p.items() if k != "device"}


_CLUSTER = dict(min_cluster_size=num("int", 1000, 1), min_samples=num("int", 0, 0), subsample_n=num("int", 0, 0), random_state=num("int", 42), device=DEVICE)


@stage("hdbscan_global", {"features": "features"}, {"labels": "labels:raw"}, **_CLUSTER)
def _global(spark, x, p):
    return {"labels": Labels(cluster.hdbscan_global(x["features"].df, **_plain(p)).withColumn("tile_id", F.lit(None).cast("int")), "raw")}


@stage("hdbscan_tiled", {"features": "features", "cube": "cube:denoised"}, {"labels": "labels:raw", "tiles": "tiles"}, **_CLUSTER, tile_size=num("int", 512, 1), merge_threshold=num("float", 0.92, 0.0, 1.0), min_tile_pixels=num("int", 0, 0), min_clusters_per_tile=num("int", 3, 0), accumulate=SUMS)
def _tiled(spark, x, p):
    labels, tiles, registry = cluster.hdbscan_tiled(x["features"].df, x["cube"], **_plain(p))
    return {"labels": Labels(labels, "raw"), "tiles": Tiles(tiles, registry)}


@stage("rare_phase", {"labels": "labels:raw", "features": "features", "cube": "cube:denoised", "tiles": "tiles"}, {"labels": "labels:raw", "tiles": "tiles"}, min_cluster_size=num("int", 50, 1), min_samples=num("int", 0, 0), subsample_n=num("int", 500_000, 0), merge_threshold=num("float", 0.92, 0.5, 1.0), random_state=num("int", 42), device=DEVICE, accumulate=SUMS)
def _rare(spark, x, p):
    labels, registry = cluster.rare_phase(x["labels"].df, x["features"].df, x["cube"], x["tiles"].tiles, x["tiles"].registry, **_plain(p))
    return {"labels": Labels(labels, "raw"), "tiles": Tiles(x["tiles"].tiles, registry)}


@stage("noise_assign", {"labels": "labels:raw", "features": "features"}, {"labels": "labels:cleaned"}, k=num("int", 5, 1), device=DEVICE)
def _noise(spark, x, p):
    return {"labels": Labels(cluster.noise_assign(x["labels"].df, x["features"].df, p["k"]), "cleaned", x["labels"].names, x["labels"].history)}


@stage("cluster_stats", {"labels": "labels:cleaned"}, {"stats": "stats"})
def _stats(spark, x, p):
    return {"stats": summary.cluster_stats(x["labels"].df)}


@stage("fingerprints", {"labels": "labels:cleaned", "cube": "cube:denoised"}, {"fingerprints": "fingerprints"}, similarity_threshold=num("float", 0.95, 0.0, 1.0), accumulate=SUMS)
def _prints(spark, x, p):
    prints = summary.fingerprints(x["labels"].df, x["cube"], p["accumulate"])
    return {"fingerprints": {"prints": prints, "pairs": summary.similar_pairs(prints, p["similarity_threshold"]), "order": summary.element_order(prints)}}


def _moved(labels: Labels, df, names: dict, gone=(), **record) -> dict:
    """Labels after a step: new names added, those of emptied phases dropped, the step recorded."""
    record = {**record, "new_names": {str(k): v for k, v in names.items()}} if record["stage"] != "name_phases" else {**record, "names": {str(k): v for k, v in names.items()}}
    return {"labels": Labels(df, "cleaned", {k: v for k, v in {**labels.names, **names}.items() if k not in set(gone)}, (*labels.history, record))}


def _emptied(df, parents) -> list[int]:
    """Those of ``parents`` that no pixel has any more."""
    there = {r.label for r in df.filter(F.col("label").isin(list(parents))).select("label").distinct().collect()}
    return [p for p in parents if p not in there]


def _check_names(p):
    grammar.names(p["names"])


@stage("name_phases", {"labels": "labels:cleaned"}, {"labels": "labels:cleaned"}, _check_names, names=Param("str", ""), note=Param("str", ""))
def _name(spark, x, p):
    given = grammar.names(p["names"])
    there = {r.label for r in x["labels"].df.select("label").distinct().collect()}
    missing = sorted(set(given) - there)
    if missing:
        raise FlowError(f"name_phases: there is no label {missing[0]}")
    return _moved(x["labels"], x["labels"].df, given, stage="name_phases", note=p["note"])


def _check_threshold(p):
    grammar.rule(p["rule"])
    if not p["new_name"].strip():
        raise ParamError("split_threshold.new_name: empty")


@stage("split_threshold", {"labels": "labels:cleaned", "cube": "cube:denoised"}, {"labels": "labels:cleaned"}, _check_threshold, target_phase=num("int", 0, 0), rule=Param("str", ""), new_name=Param("str", ""), note=Param("str", ""))
def _threshold(spark, x, p):
    df, new = split.split_threshold(x["labels"].df, x["cube"], p["target_phase"], p["rule"])
    return _moved(x["labels"], df, {new: p["new_name"]} if new >= 0 else {}, _emptied(df, [p["target_phase"]]) if new >= 0 else [], stage="split_threshold", parent=p["target_phase"], new_labels=[new] if new >= 0 else [], note=p["note"])


def _check_gmm(p):
    tokens, given = grammar.csv_list(p["features"]), grammar.name_list(p["new_names"])
    if not tokens:
        raise ParamError("split_gmm.features: at least one is needed")
    if p["order_by"] and p["order_by"] not in tokens:
        raise ParamError(f"split_gmm.order_by: {p['order_by']!r} is not a feature")
    if given and len(given) != p["n_components"] - p["keep_parent"]:
        raise ParamError(f"split_gmm.new_names: {p['n_components'] - p['keep_parent']} are needed")


@stage("split_gmm", {"labels": "labels:cleaned", "cube": "cube:denoised", "bse": "bse?"}, {"labels": "labels:cleaned"}, _check_gmm, target_phase=num("int", 0, 0), features=Param("str", ""), n_components=num("int", 2, 2), bse_weight=num("float", 1.0, 0.0), subsample_n=num("int", 500_000, 0), random_state=num("int", 42), keep_parent=Param("bool", True), order_by=Param("str", ""), new_names=Param("str", ""), note=Param("str", ""))
def _gmm(spark, x, p):
    cube = x["cube"] if "bse" not in x else Cube(x["cube"].df.join(x["bse"].withColumnRenamed("bse", "BSE"), ["row", "col"]), x["cube"].channels, "denoised")
    df, record = split.split_gmm(x["labels"].df, cube, p["target_phase"], grammar.csv_list(p["features"]), p["n_components"], p["bse_weight"], p["subsample_n"], p["random_state"], p["keep_parent"], p["order_by"])
    gone = [] if p["keep_parent"] or not record["new_labels"] else [p["target_phase"]]
    return _moved(x["labels"], df, dict(zip(record["new_labels"], grammar.name_list(p["new_names"]))), gone, stage="split_gmm", parent=p["target_phase"], note=p["note"], **record)


def _check_hires(p):
    targets = grammar.int_list(p["target_phases"], "split_hires.target_phases")
    if not targets or min(targets) < 0:
        raise ParamError("split_hires.target_phases: non-negative labels are needed")
    if p["feature"].strip().upper() == "BSE" or not p["feature"].strip():
        raise ParamError("split_hires.feature: a channel or a ratio is needed")
    given = grammar.name_list(p["new_names"])
    if given and len(given) != p["n_components"]:
        raise ParamError(f"split_hires.new_names: {p['n_components']} are needed")


@stage("split_hires", {"labels": "labels:cleaned", "cube_hires": "cube:raw"}, {"labels": "labels:cleaned", "labels_hires": "labels_hires"}, _check_hires, target_phases=Param("str", ""), feature=Param("str", ""), n_components=num("int", 2, 2), subsample_n=num("int", 500_000, 0), random_state=num("int", 42), new_names=Param("str", ""), note=Param("str", ""))
def _hires(spark, x, p):
    size = lambda df: tuple(int(v) + 1 for v in df.agg(F.max("row"), F.max("col")).first())
    ratio = split.resolution_ratio(size(x["labels"].df), size(x["cube_hires"].df))
    targets, first = grammar.int_list(p["target_phases"]), split.next_label(x["labels"].df)
    df, fine = split.split_hires(x["labels"].df, x["cube_hires"], targets, p["feature"], ratio, p["n_components"], p["subsample_n"], p["random_state"])
    new = list(range(first, first + p["n_components"]))
    out = _moved(x["labels"], df, dict(zip(new, grammar.name_list(p["new_names"]))), _emptied(df, targets), stage="split_hires", parents=targets, new_labels=new, ratio=ratio, note=p["note"])
    return {**out, "labels_hires": fine}


def _tile_groups(spark, tiles: Tiles) -> dict:
    """What each tile held, which of its clusters became which phase, and the registry of phases: a row each."""
    rows = [(t["tile_id"], int(t["n_pixels"]), int(t["n_clusters"]), int(t["n_noise"]), bool(t["deferred"])) for t in tiles.tiles]
    merged = [(t["tile_id"], int(a), int(b)) for t in tiles.tiles for a, b in t["merge_map"].items()]
    phases = [(int(e["global_id"]), int(e["n_pixels"]), int(e["discovered_in_tile"]), [float(v) for v in e["mean"]]) for e in tiles.registry]
    return {
        "tiles": spark.createDataFrame(rows, "tile_id int, n_pixels long, n_clusters long, n_noise long, deferred boolean"),
        "tile_clusters": spark.createDataFrame(merged, "tile_id int, cluster int, phase int"),
        "registry": spark.createDataFrame(phases, "phase int, n_pixels long, discovered_in_tile int, mean array<double>"),
    }


@stage("export", {"cube_raw": "cube:raw?", "bse": "bse?", "masks": "masks?", "cube_denoised": "cube:denoised?", "cube_normalized": "cube:normalized?", "features": "features?", "labels_raw": "labels:raw?", "labels": "labels:cleaned?", "stats": "stats?", "labels_hires": "labels_hires?", "tiles": "tiles?"}, {}, path=Param("str", "{out}/export"), flow_json=Param("str", "{flow}"), compression=Param("enum", "zstd", ("zstd", "snappy", "gzip", "none")))
def _export(spark, x, p):
    groups = {k: getattr(v, "df", v) for k, v in x.items() if k != "tiles"}
    if "tiles" in x:
        groups |= _tile_groups(spark, x["tiles"])
    meta = {"flow": p["flow_json"], "names": {str(k): v for k, v in getattr(x.get("labels"), "names", {}).items()}, "history": list(getattr(x.get("labels"), "history", ()))}
    images.write_groups(p["path"], groups, json.loads(json.dumps(meta, default=str)), p["compression"])
    return {}


def named(df, names: dict[int, str]):
    """``df`` with the name of each label, null where there is none."""
    table = df.sparkSession.createDataFrame([(int(k), v) for k, v in names.items()], "label int, name string")
    return df.join(F.broadcast(table), "label", "left")  # a row a phase


def _named(df, given: str | None, other: dict[int, str] | None = None):
    """As ``named``, of a JSON map of labels to names, or of ``other`` where that is empty."""
    try:
        names = {int(k): str(v) for k, v in json.loads(given or "{}").items()}
    except (ValueError, AttributeError):
        raise ParamError(f"mineral_names: {given!r} is not a JSON map of labels to names") from None
    return named(df, names or other or {})


def _figure(name, inputs, build, **params):
    @stage(name, inputs, {}, figure_dir=Param("str", "{out}/figures"), **params)
    def sink(spark, x, p):
        for key, df in build(x, p).items():
            df.write.mode("overwrite").parquet(f"{p['figure_dir']}/{name}_{key}")
        return {}


_figure("qc_mask", {"bse": "bse", "masks": "masks", "cube_raw": "cube:raw?"}, lambda x, p: {"mask": x["bse"].join(x["masks"], ["row", "col"]), "stats": masks.mask_stats(x["masks"]), **({"reference": images.read_images(x["bse"].sparkSession, [p["tima_path"]]).drop("origin")} if p["tima_path"] else {})}, tima_path=Param("str", None))
_figure("qc_denoise", {"cube_raw": "cube:raw", "cube_denoised": "cube:denoised", "bse": "bse", "masks": "masks"}, lambda x, p: {"before": summary.zoom(x["cube_raw"].df, x["masks"]), "after": summary.zoom(x["cube_denoised"].df, x["masks"]), "range": summary.percentiles(x["cube_raw"], x["masks"], (0.02, 0.98))}, method=Param("str", "bilateral"))
_figure("qc_normalize", {"cube": "cube:normalized", "masks": "masks"}, lambda x, p: {"histogram": summary.histogram(x["cube"], x["masks"]), "correlation": pixels.covariance(x["cube"], x["masks"], "corr")})
_figure("qc_scree", {"features": "features"}, lambda x, p: {"scree": pixels.cumulative(x["features"].df.sparkSession.createDataFrame(list(enumerate(x["features"].explained)), "component int, share double"))})
_figure("qc_phase_map", {"labels_raw": "labels:raw", "labels": "labels:cleaned", "bse": "bse", "stats": "stats"}, lambda x, p: {"raw": x["labels_raw"].df.select("row", "col", "label"), "cleaned": x["labels"].df.select("row", "col", "label")})
_figure("qc_cluster_summary", {"stats": "stats"}, lambda x, p: {"sizes": x["stats"].orderBy(F.desc("n_pixels"), "label")})
_figure("qc_tiled", {"bse": "bse", "tiles": "tiles", "features": "features"}, lambda x, p: {"tiles": x["bse"].sparkSession.createDataFrame([(t["tile_id"], t["n_pixels"], t["n_clusters"], t["deferred"]) for t in x["tiles"].tiles if t["n_pixels"] >= p["min_tile_pixels"]], "tile_id int, n_pixels long, n_clusters long, deferred boolean"), "curve": summary.discovery_curve(x["bse"].sparkSession.createDataFrame([(r["discovered_in_tile"],) for r in x["tiles"].registry], "discovered_in_tile int"))}, min_tile_pixels=num("int", 2000, 1))
_figure("qc_fingerprints", {"fingerprints": "fingerprints"}, lambda x, p: {"prints": _named(x["fingerprints"]["prints"], p["mineral_names"]), "order": x["fingerprints"]["order"]}, mineral_names=Param("str", None))
_figure("qc_named_phase_map", {"labels": "labels:cleaned", "bse": "bse"}, lambda x, p: {"map": _named(x["labels"].df.select("row", "col", "label"), p["mineral_names"], x["labels"].names)}, mineral_names=Param("str", "{}"))
