"""Flows from files and images on disk, end to end."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.errors import FlowError, ParamError
from rasterloom.functions import grammar
from rasterloom.operators import cluster
from rasterloom.plans import flow
from rasterloom.plans.stages import REGISTRY, Labels


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[i].astype(np.uint8).tobytes() for i in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("maps")
    ramp = np.array([(i, 255 - i, 7) for i in range(256)])
    np.save(at / "palette.npy", ramp)
    rng = np.random.default_rng(0)
    for e in ("Ca", "Mg", "Fe-L"):
        png(at / f"s-1-{e}.png", ramp[rng.integers(50, 250, (60, 80))])
    gray = np.repeat(rng.integers(0, 256, (60, 80, 1)), 3, axis=2)
    png(at / "s-1-SEM.png", gray)
    png(at / "electrons.img.png", gray // 2)
    lines = ["index,shape-type,vertex-index,axis-0,axis-1"]
    lines += [f"0,polygon,{k},{r},{c}" for k, (r, c) in enumerate([(20, 10), (20, 50), (50, 50), (50, 10)])]
    (at / "valid.csv").write_text("\n".join(lines))
    return at


def loaded(spark, folder, **more):
    params = {"input_dir": f"file://{folder}", "file_glob": "s-*.png", "colormap": f"lut:file://{folder}/palette.npy", "header_trim_px": 10, "left_trim_px": 4, **more}
    return REGISTRY["load_elements"].run(spark, {}, params)


def test_polygons_follow_downsampling_and_trims(spark, folder):
    got = loaded(spark, folder)
    assert list(got["cube"].channels) == ["Ca", "Mg"] and got["cube"].geometry == {"factor": 2, "header": 10, "left": 4}
    assert got["cube"].df.count() == 25 * 38
    masks = REGISTRY["mask"].run(spark, {"cube": got["cube"]}, {"min_object_size": 0, "valid_mask_path": f"file://{folder}/valid.csv"})["masks"]
    valid = {(r.row, r.col) for r in masks.filter("mineral").collect()}
    rows, cols = {r for r, _ in valid}, {c for _, c in valid}
    assert abs(min(rows) - 5) <= 1 and abs(max(rows) - 20) <= 1  # (20 - 10) / 2 and (50 - 10) / 2
    assert abs(min(cols) - 3) <= 1 and abs(max(cols) - 23) <= 1
    assert abs(len(valid) - 15 * 20) <= 2 * (15 + 20)


def test_a_named_electron_image_takes_the_place_of_the_channel(spark, folder):
    a, b = (loaded(spark, folder, **m)["bse"].agg(F.avg("bse")).first()[0] for m in ({}, {"bse_filename": "electrons.img.png"}))
    assert abs(a / 2 - b) < 0.01
    with pytest.raises(FlowError):
        loaded(spark, folder, bse_filename="absent.png")


FILE = {
    "version": 2,
    "name": "small",
    "nodes": [{"id": "src", "type": "load_elements", "params": REGISTRY["load_elements"].template(), "ui": {"x": 1}}, {"id": "msk", "type": "mask", "params": {"min_object_size": 1, "valid_mask_path": None}}],
    "edges": [{"id": "e1", "from": {"node": "src", "port": "cube"}, "to": {"node": "msk", "port": "cube"}}],
}


def test_flow_files_of_both_forms_read_and_write():
    g = flow.Graph.read(json.dumps(FILE))
    assert g.name == "small" and g.edges == [("src", "cube", "msk", "cube")]
    assert not [i for i in flow.validate(g) if i.kind == "error"]
    again = flow.Graph.read(g.text())
    assert (again.nodes, again.edges, again.name, again.version) == (g.nodes, g.edges, g.name, 2)
    old = flow.Graph.read(json.dumps({"nodes": [{"id": "src", "type": "load_elements"}, {"id": "msk", "type": "mask"}], "edges": [{"from": "src.cube", "to": "msk.cube"}]}))
    assert old.version == 1 and not [i for i in flow.validate(old) if i.kind == "error"] and flow.complete(old).version == 2
    sparse = {**FILE, "nodes": [FILE["nodes"][0], {"id": "msk", "type": "mask", "params": {}}]}
    assert [i for i in flow.validate(flow.Graph.read(json.dumps(sparse))) if i.kind == "error"]
    for bad in ("[]", "{", '{"nodes": [{}]}'):
        with pytest.raises(FlowError):
            flow.Graph.read(bad)


def test_lineage_counts_edges():
    g = flow.builtin("stepwise")
    assert flow.lineage(g, "src") == {"src": 0}
    got = flow.lineage(g, "nrm")
    assert got == {"nrm": 0, "dn": 1, "msk": 1, "src": 2}


def test_name_grammar():
    assert grammar.names("0: Ilmenite (FeTiO3); 1: Silica; -1: none") == {0: "Ilmenite (FeTiO3)", 1: "Silica", -1: "none"}
    assert grammar.names("2=a: b") == {2: "a: b"}
    for bad in ("0: a; 0: b", "x: a", "3:", "3"):
        with pytest.raises(ParamError):
            grammar.names(bad)


def test_names_follow_splits(spark):
    df = spark.createDataFrame([(i, i // 20, i % 20, int(i % 2), 1.0) for i in range(400)], "pixel_id long, row int, col int, label int, prob float")
    x = df.select("row", "col", (F.col("label") + 0.01 * F.col("col")).alias("A"), F.lit(1.0).alias("B"))
    from rasterloom.operators.pixels import Cube

    cube, labels = Cube(x, ["A", "B"], "denoised"), Labels(df, "cleaned", {0: "zero", 1: "one"})
    out = REGISTRY["split_threshold"].run(spark, {"labels": labels, "cube": cube}, {"target_phase": 1, "rule": "A > 0", "new_name": "new"})["labels"]
    assert out.names == {0: "zero", 2: "new"} and out.history[-1]["new_names"] == {"2": "new"}  # phase 1 is empty
    out = REGISTRY["split_threshold"].run(spark, {"labels": labels, "cube": cube}, {"target_phase": 1, "rule": "A > 1.1", "new_name": "new"})["labels"]
    assert out.names == {0: "zero", 1: "one", 2: "new"}
    with pytest.raises(ParamError):
        REGISTRY["split_hires"].check(REGISTRY["split_hires"].coerced({"target_phases": "0", "feature": "A", "n_components": 2, "new_names": "a"}))


def test_other_devices_are_refused(spark):
    with pytest.raises(ParamError):
        REGISTRY["normalize"].coerced({"device": "cuda"})


def test_empty_tiles_keep_their_numbers(spark):
    pixels = spark.createDataFrame([(0, 0), (0, 1), (9, 9)], "row int, col int")
    got = sorted((r.tile_id, r.tr, r.tc, r.n_pixels) for r in cluster.tile_grid(pixels, 5, 0).collect())
    assert got == [(0, 0, 0, 2), (1, 0, 1, 0), (2, 1, 0, 0), (3, 1, 1, 1)]
    assert [(r.tile_id, r.n_pixels) for r in cluster.tile_grid(pixels, 5, 2).collect()] == [(0, 2)]


def test_export_holds_tiles_and_names(spark, tmp_path):
    from rasterloom.plans.stages import Tiles
    from rasterloom.sources import images

    df = spark.createDataFrame([(0, 0, 0, 1, 1.0)], "pixel_id long, row int, col int, label int, prob float")
    tiles = Tiles([{"tile_id": 0, "n_pixels": 9, "n_clusters": 2, "n_noise": 1, "deferred": False, "merge_map": {0: 4, 1: 1}, "new_phases": [4]}], [{"global_id": 4, "n_pixels": 8, "discovered_in_tile": 0, "mean": np.array([0.5, 1.0]), "contributions": {0: 8}}])
    at = f"file://{tmp_path}/export"
    REGISTRY["export"].run(spark, {"labels": Labels(df, "cleaned", {1: "one"}), "tiles": tiles}, {"path": at})
    assert [tuple(r) for r in images.read_group(spark, at, "tiles").collect()] == [(0, 9, 2, 1, False)]
    assert sorted(tuple(r) for r in images.read_group(spark, at, "tile_clusters").collect()) == [(0, 0, 4), (0, 1, 1)]
    assert images.read_group(spark, at, "registry").first()["mean"] == [0.5, 1.0]
    assert images.read_meta(spark, at)["names"] == {"1": "one"}


def test_built_in_flows_are_valid():
    for name in ("stepwise", "global", "tiled", "tiled-rare"):
        assert not [i for i in flow.validate(flow.Graph.read(flow.builtin(name).text())) if i.kind == "error"]
