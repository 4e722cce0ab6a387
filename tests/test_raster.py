"""Raster operators against independent numpy forms and hand cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import catalogue
from rasterloom.errors import FlowError, ParamError
from rasterloom.functions import grammar
from rasterloom.operators import cluster, compare, hdbscan, masks, pixels, split, stencil, summary
from rasterloom.operators.pixels import Cube
from rasterloom.plans import flow
from rasterloom.plans.stages import REGISTRY
from rasterloom.sources import images

SF = "/root/testdata/sf0.001"


def frame(spark, image, name="value"):
    r, c = np.indices(image.shape)
    return spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(r.ravel(), c.ravel(), image.ravel())], f"row int, col int, {name} double")


def grid(df, name, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


def everywhere(spark, shape):
    return frame(spark, np.ones(shape)).select("row", "col", F.lit(True).alias("mineral"))


def test_grammars():
    assert grammar.rule("Fe-K > 0.6 & Ca < 0.10") == [("Fe-K", ">", 0.6), ("Ca", "<", 0.1)]
    for bad in ("", "Fe", "Fe == 1", "Fe > x"):
        with pytest.raises(ParamError):
            grammar.rule(bad)
    assert grammar.names("0=a; 3=b c") == {0: "a", 3: "b c"} and grammar.int_list(" 1, 2") == [1, 2]
    for bad in ("0=a;0=b", "x=a", "0="):
        with pytest.raises(ParamError):
            grammar.names(bad)
    assert grammar.column_of("fe", ["Ca", "Fe"]) == "Fe"


def test_pixel_ids_are_dense_ranks(spark):
    df = spark.createDataFrame([(5, 1), (0, 7), (0, 2), (3, 3)], "row int, col int")
    assert {(r.row, r.col): r.pixel_id for r in pixels.pixel_ids(df).collect()} == {(0, 2): 0, (0, 7): 1, (3, 3): 2, (5, 1): 3}


def test_subsample_is_the_seeded_draw():
    assert (pixels.subsample_ids(1000, 100, 42) == np.random.default_rng(42).choice(1000, 100, replace=False)).all()
    assert pixels.subsample_ids(10, 10, 1) is None


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_across_tiles(spark, connectivity):
    image = np.random.default_rng(1).random((30, 30)) < 0.55
    got = masks.components(frame(spark, image.astype(float)).select("row", "col", (F.col("value") > 0).alias("mineral")), connectivity, tile=7).collect()
    want, steps = {}, [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * (connectivity == 8)
    for r, c in zip(*np.nonzero(image)):
        if (r, c) not in want:
            stack, name = [(r, c)], (int(r) << 31) + int(c)
            while stack:
                p = stack.pop()
                if p not in want and 0 <= p[0] < 30 and 0 <= p[1] < 30 and image[p]:
                    want[p] = name
                    stack += [(p[0] + a, p[1] + b) for a, b in steps]
    assert {(r["row"], r["col"]): r["comp"] for r in got} == {(int(a), int(b)): v for (a, b), v in want.items()}


def test_small_objects_of_exactly_the_size_survive(spark):
    image = np.zeros((6, 8))
    image[0, :4] = image[3, :3] = 1
    mask = frame(spark, image).select("row", "col", (F.col("value") > 0).alias("mineral"))
    assert masks.remove_small(mask, 4).filter("mineral").count() == 4


def test_window_sizes_and_weights():
    assert [stencil.window(s) for s in (1, 0.5, 2)] == [7, 5, 13]
    w = {(a, b): v for a, b, v in stencil.offsets(1.0, True)}
    assert w[2, -2] == 1 and w[0, 0] < 1e-3


def test_tiled_bilateral_equals_the_relational_form(spark):
    image = np.random.default_rng(2).random((20, 23))
    cube = Cube(frame(spark, image, "A"), ("A",))
    got = grid(stencil.bilateral(cube, everywhere(spark, image.shape), sigma_color=0.25, tile=8).df, "A", image.shape)
    p = frame(spark, image).withColumn("guide", F.col("value"))
    want = grid(stencil.bilateral_relational(p, 1.0, 0.25, float(image.max())), "out", image.shape)
    assert np.abs(got - want).max() < 1e-4
    flat = Cube(frame(spark, np.full((9, 9), 0.5), "A"), ("A",))
    assert np.allclose(grid(stencil.bilateral(flat, everywhere(spark, (9, 9)), tile=8).df, "A", (9, 9)), 0.5)


def test_diffusion_keeps_the_sum_and_smooths(spark):
    image = np.random.default_rng(3).random((18, 18))
    cube = Cube(frame(spark, image, "A"), ("A",))
    out = grid(stencil.diffuse(cube, everywhere(spark, image.shape), niter=6, tile=8).df, "A", image.shape)
    whole = grid(stencil.diffuse(cube, everywhere(spark, image.shape), niter=6, tile=64).df, "A", image.shape)
    assert abs(out.sum() - image.sum()) < 1e-3 and out.std() < image.std() and np.allclose(out, whole, atol=1e-6)


def test_pca_is_centred_and_signed(spark):
    cube, mask = catalogue.planted(spark, SF)
    df, explained = pixels.pca(cube, mask, n_components=3)
    f = np.array([r.f for r in df.collect()])
    assert np.abs(f.mean(0)).max() < 1e-4 and abs(sum(explained) - 1) < 1e-9 and explained == sorted(explained, reverse=True)
    assert pixels.auto_components(np.array([0.5, 0.25, 0.12, 0.06, 0.025]), 0.95, 1) == 5


def test_hdbscan_finds_planted_clusters():
    rng = np.random.default_rng(4)
    truth = np.repeat([0, 1, 2], 120)
    x = np.array([[0, 0], [5, 5], [0, 6]])[truth] + rng.normal(0, 0.3, (360, 2))
    m = hdbscan.fit(x, 40, 10)
    assert m.n_clusters == 3
    for k in range(3):
        own = m.labels[truth == k]
        assert (own >= 0).mean() > 0.7 and len(set(own[own >= 0])) == 1
    labels, prob = hdbscan.predict(m, x)
    both = (labels >= 0) & (m.labels >= 0)
    assert (labels[both] == m.labels[both]).mean() > 0.99 and prob.max() <= 1
    assert (hdbscan.fit(x[:120], 100, 10).labels == -1).all() or hdbscan.fit(x[:120], 100, 10).n_clusters == 0
    with pytest.raises(FlowError):
        hdbscan.fit(x, 40, 10, most_points=100)


def test_clustering_of_the_planted_scene(spark):
    truth = {(r["row"], r["col"]): r["phase"] for r in catalogue.with_phase(catalogue.levels(spark, SF)).collect()}
    for name in ("hdbscan_subsample_predict", "flow_run_tiled_rare"):
        seen = {}
        for r in catalogue.queries()[name](spark, SF).filter("label >= 0").collect():
            seen.setdefault(truth[r["row"], r["col"]], []).append(r["label"])
        main = [max(set(v), key=v.count) for v in seen.values()]
        assert len(set(main)) == 3 and all(v.count(m) / len(v) > 0.9 for v, m in zip(seen.values(), main))


def test_registry_fold_matches_before_it_adds():
    registry = []
    a, b = np.array([1.0, 0.0]), np.array([0.99, 0.01])
    assert cluster.register(registry, [(0, 10, a), (1, 5, b)], 0.9, 0) == ({0: 0, 1: 1}, [0, 1])
    merged, new = cluster.register(registry, [(0, 10, a)], 0.9, 1)
    assert merged == {0: 0} and not new and registry[0]["n_pixels"] == 20 and registry[0]["contributions"] == {0: 10, 1: 10}
    assert cluster.best_match(np.zeros(2), registry, 0.0) is None


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 4)), rng.integers(0, 4, 300)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "pixel_id long, f array<double>, label int")
    got = {r.pixel_id: r.label for r in cluster.knn_vote(df.filter("pixel_id < 60"), df.filter("pixel_id >= 60"), 5, block=50).collect()}
    for i in range(60):
        d = np.sqrt(((x[60:] - x[i]) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:5]
        w = np.bincount(y[60:][near], weights=1 / d[near], minlength=4)
        assert got[i] == w.argmax()


@pytest.mark.parametrize("kind, block", [("clusters", 40), ("hot", 60), ("hot", 10**6)])
def test_knn_over_cells_is_exact(spark, kind, block):
    rng = np.random.default_rng(8)
    if kind == "clusters":
        x, q = np.concatenate([rng.normal(c, 0.3, (150, 3)) for c in (0, 5, 9)]), rng.uniform(-2, 11, (90, 3))
    else:  # a third of the rows are equal, many others tie
        x, q = np.concatenate([np.ones((200, 2)), rng.normal(0, 1, (300, 2)).round(1)]), np.concatenate([np.ones((30, 2)), rng.normal(0, 2, (60, 2)).round(1)])
    y = rng.integers(0, 4, len(x))
    both = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [(10_000 + i, v.tolist(), -1) for i, v in enumerate(q)]
    df = spark.createDataFrame(both, "pixel_id long, f array<double>, label int")
    got = {r.pixel_id: r.label for r in cluster.knn_vote(df.filter("label < 0"), df.filter("label >= 0"), 5, block=block).collect()}
    assert len(got) == len(q)
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:5]
        d = d[near]
        w = np.bincount(y[near], weights=(d == 0) if (d == 0).any() else 1 / d, minlength=4)
        assert w[got[10_000 + i]] >= w.max() - 1e-9


def test_knn_without_assigned_pixels_and_with_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], -1), (1, [1.0, 0.0], 3), (2, [5.0, 0.0], 1)], "pixel_id long, f array<double>, label int")
    assert cluster.knn_vote(df.filter("label < 0"), df.filter("label > 9"), 5).count() == 0
    assert [r.label for r in cluster.knn_vote(df.filter("label < 0"), df.filter("label >= 0"), 5, block=1).collect()] == [3]


def test_gradients_of_a_ramp_and_of_a_step(spark):
    ramp = np.tile(np.arange(6.0), (5, 1))
    got = grid(compare.gradients(frame(spark, ramp), ["value"]), "value", ramp.shape)
    assert np.allclose(got[:, 1:-1], 1 / np.sqrt(2)) and np.allclose(got[:, [0, -1]], 0.5 / np.sqrt(2))
    step = np.zeros((5, 6))
    step[:, 3:] = 1
    got = grid(compare.gradients(frame(spark, step), ["value"]), "value", step.shape)
    assert np.allclose(got[:, 2:4], 0.5 / np.sqrt(2)) and not got[:, [0, 1, 4, 5]].any()


def test_an_unchanged_cube_has_no_distance_and_a_flat_one_no_edges(spark):
    image = np.random.default_rng(5).random((9, 9))
    cube, mask = Cube(frame(spark, image, "A"), ("A",)), everywhere(spark, image.shape)
    same = compare.denoiser_metrics(cube, cube, mask, frame(spark, image, "bse")).first()
    assert same.rmse == 0 and abs(same.edge_preservation - 1) < 1e-9
    flat = compare.denoiser_metrics(cube, Cube(frame(spark, np.ones((9, 9)), "A"), ("A",)), mask, frame(spark, image, "bse")).first()
    assert flat.edge_preservation == 0 and abs(flat.rmse - np.sqrt(((image - 1) ** 2).mean())) < 1e-9


def test_correlation_with_a_constant_channel_is_null(spark):
    df = spark.createDataFrame([(0, i, float(i), 1.0) for i in range(5)], "row int, col int, A double, B double")
    got = {(r.a, r.b): r.value for r in pixels.covariance(Cube(df, ("A", "B")), everywhere(spark, (1, 5)), "corr").collect()}
    assert abs(got["A", "A"] - 1) < 1e-12 and got["A", "B"] is None and got["B", "B"] is None


def test_single_precision_sums_run_in_pixel_order(spark):
    rng = np.random.default_rng(6)
    image, label = (rng.random((40, 30, 2)) * 1000).astype(np.float32), rng.integers(-1, 3, (40, 30))
    r, c = (a.ravel() for a in np.indices(label.shape))
    rows = list(zip(r.tolist(), c.tolist(), image[..., 0].ravel().tolist(), image[..., 1].ravel().tolist(), label.ravel().tolist(), (r // 20).tolist()))
    df = spark.createDataFrame(rows, "row int, col int, A double, B double, label int, tile_id int").repartition(5)
    cube = Cube(df.select("row", "col", "A", "B"), ("A", "B"))
    labels = df.select("row", "col", "label", "tile_id")

    def folded(part):
        total = np.zeros(2, dtype=np.float32)
        for v in part:
            total = total + v
        return total / np.float32(len(part))

    got = {(x.label, x.element): x for x in summary.fingerprints(labels, cube, "float32").collect()}
    assert len(got) == 6
    for k in range(3):
        part = image[label == k]
        mean = folded(part)
        std = np.sqrt(folded((part - mean) ** 2))
        for i, e in enumerate("AB"):
            assert got[k, e].mean == float(mean[i]) and got[k, e].std == float(std[i]) and got[k, e].n_pixels == len(part)
    for x in cluster.fingerprint_means(labels, cube, ["tile_id", "label"], "float32").collect():
        own = (label == x.label) & (np.arange(40)[:, None] // 20 == x.tile_id)
        assert x["mean"] == folded(image[own]).astype(float).tolist() and x.n_pixels == own.sum()
    whole = pixels.sequential_stats(cube, everywhere(spark, label.shape))
    assert [m for _, m, _ in whole] == folded(image.reshape(-1, 2)).astype(float).tolist()


def test_gains_need_the_same_pixels(spark):
    rows = lambda *v: spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "row int, col int, label int")
    assert {r.label: (r.n_pixels, r.gained) for r in summary.gained(rows(1, 1, 2), rows(-1, 1, -1)).collect()} == {1: (2, 1), 2: (1, 1)}
    assert {r.label: r.gained for r in summary.gained(rows(1, 1, 2), rows(-1, 1)).collect()} == {1: None, 2: None}
    assert {r.label: r.gained for r in summary.gained(rows(1, 1), rows(-1, 1, 2)).collect()} == {1: None}


def test_a_failed_run_leaves_its_record(spark, tmp_path):
    import json

    from rasterloom.__main__ import main

    args = ["run", "--builtin", "stepwise", "--input", str(tmp_path / "none"), "--out", str(tmp_path / "out")]
    assert main(args) == 1
    runs = tmp_path / "out" / "runs"
    data = json.loads((runs / (runs / "LATEST").read_text().strip() / "run.json").read_text())
    assert data["status"] == "failed" and data["error"] and data["nodes"]["pca"]["status"] == "pending"


def test_gmm_split_parts_two_blobs(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([0.05 + rng.normal(0, 0.004, 30), 0.17 + rng.normal(0, 0.004, 10)])
    df = spark.createDataFrame([(0, i, float(a)) for i, a in enumerate(v)], "row int, col int, Cl double")
    labels = spark.createDataFrame([(i, 0, i, 0) for i in range(40)], "pixel_id long, row int, col int, label int")
    out, rec = split.split_gmm(labels, Cube(df, ("Cl",)), 0, ["Cl"])
    assert rec["new_labels"] == [1] and out.filter("label = 1").count() == 10
    out, rec = split.split_gmm(labels, Cube(df, ("Cl",)), 0, ["Cl"], keep_parent=False, order_by="Cl")
    assert {r.col: r.label for r in out.collect()} == {i: 1 if i < 30 else 2 for i in range(40)}
    assert split.split_gmm(labels.limit(5), Cube(df, ("Cl",)), 0, ["Cl"])[1]["skipped"]


def test_resolution_ratio():
    assert [split.resolution_ratio(a, b) for a, b in (((4, 4), (8, 8)), ((4, 4), (9, 8)), ((4, 5), (7, 9)))] == [2, 2, 2]
    for bad in ((10, 8), (8, 11)):
        with pytest.raises(FlowError):
            split.resolution_ratio((4, 4), bad)


def test_name_patterns():
    assert images.name_pattern("s-{n}-{element}.png") == r"^s\-.+?\-(?P<element>.+)\.png$"
    with pytest.raises(FlowError):
        images.name_pattern("x.png")


def test_builtin_flows_are_valid_and_round_trip():
    for name in ("stepwise", "global", "tiled", "tiled-rare"):
        g = flow.builtin(name)
        assert not [i for i in flow.validate(g) if i.kind == "error"]
        again = flow.Graph.read(flow.complete(g).text())
        assert flow.recipes(again) == flow.recipes(flow.complete(g))
    assert flow.recipes(flow.override(flow.builtin("stepwise"), ["knn.k=7"]))["stats"] != flow.recipes(flow.builtin("stepwise"))["stats"]


@pytest.mark.parametrize(
    "change, text",
    [
        (lambda g: setattr(g, "version", 9), "version"),
        (lambda g: g.nodes.append(g.nodes[0]), "twice"),
        (lambda g: setattr(g.nodes[1], "type", "nope"), "no stage"),
        (lambda g: g.nodes[1].params.pop("min_object_size"), "missing"),
        (lambda g: g.nodes[1].params.update(min_object_size=1.5), "not of type int"),
        (lambda g: g.nodes[1].params.update(min_object_size=-1), "outside"),
        (lambda g: g.edges.pop(0), "no edge leads here"),
        (lambda g: g.edges.append(g.edges[0]), "several edges"),
        (lambda g: g.edges.append(("src", "nope", "msk", "cube")), "no such output"),
        (lambda g: g.edges.append(("src", "cube", "knn", "features")), "takes features"),
        (lambda g: g.edges.append(("ghost", "x", "msk", "cube")), "unknown end"),
    ],
)
def test_each_validation_rule(change, text):
    g = flow.builtin("stepwise")
    change(g)
    assert any(text in i.text for i in flow.validate(g) if i.kind == "error")


def test_a_cycle_is_found():
    n = [flow.Node(i, "name_phases", REGISTRY["name_phases"].template()) for i in "ab"]
    g = flow.Graph(n, [("a", "labels", "b", "labels"), ("b", "labels", "a", "labels")])
    assert any("cycle" in i.text for i in flow.validate(g))


def test_checkpoints_are_reused(spark, tmp_path):
    cube = catalogue.planted(spark, SF)[0]
    g = flow.override(flow.builtin("stepwise"), ["msk.min_object_size=0", "hdb.min_cluster_size=100", "hdb.min_samples=20", "hdb.subsample_n=800"])
    bse = cube.df.select("row", "col", F.col("A").alias("bse"))
    runs = [flow.run(spark, g, provided={"src": {"cube": cube, "bse": bse}}, work=str(tmp_path)) for _ in range(2)]
    rows = [sorted((r.pixel_id, r.label) for r in x["outputs"]["knn"]["labels"].df.collect()) for x in runs]
    assert rows[0] == rows[1] and len(rows[0]) > 1000
    with pytest.raises(FlowError):
        flow.run(spark, flow.Graph([flow.Node("x", "mask", {})], []))


def test_catalogue_has_sql_for_its_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.oracle_sql()) >= 50
