"""Near-dedup of the pipeline against brute force over true similarities."""

import numpy as np
import pytest

from rasterloom.llm import similar_texts


def sets(texts):
    return [set(similar_texts.shingles(t, 5).tolist()) for t in texts]


def survivors(texts):
    """Ids left by brute force: the least of every chain of pairs at 0.8 or more."""
    s, up = sets(texts), list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {root(i) for i in range(len(s))}


def test_near_copies_go_and_others_stay(spark):
    import corpus_pipeline

    rng, texts = np.random.default_rng(3), [None, "", "a b c", "A  b\nc", "a b d"]
    for base in range(30):
        w = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 400))]
        texts += [" ".join(w), " ".join(w).upper()]
        for share in (0.01, 0.02, 0.03, 0.05, 0.1):  # similarities on both sides of 0.8
            v = list(w)
            for at in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
                v[at] = f"new{rng.integers(0, 10**9)}"
            texts.append(" ".join(v))
    w = [f"c{x}" for x in range(300)]  # one large group of near copies, and many that share only a long passage
    texts += [" ".join([*w[:at], "x", *w[at + 1 :]]) for at in range(150)]
    texts += [" ".join([*w[:100], *(f"p{i}y{j}" for j in range(150))]) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == survivors(texts)


@pytest.mark.parametrize("tile", [1024, 8])
def test_no_similar_pair_in_a_crowded_variant_is_left_apart(spark, tile):
    rng, texts = np.random.default_rng(4), []
    for _ in range(40):  # all under one variant; forty pairs alike, nothing between the pairs
        w = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
        texts += [" ".join(w), " ".join([*w[:50], "other", *w[51:]])]
    docs = spark.createDataFrame([(int(i), t, len(s), [7]) for i, (t, s) in enumerate(zip(texts, sets(texts)))], "node long, t string, size long, keys array<long>")
    got = {r.node: r.root for r in similar_texts.linked(docs, tile=tile).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_pairs_across_groups_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    held = [np.unique(rng.integers(0, 12, rng.integers(1, 12))) for _ in range(60)]
    group = rng.integers(0, 9, 60)
    p, q = similar_texts.similar_across(np.concatenate(held), np.array([len(x) for x in held]), group, 80)
    alike = lambda x, y: 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})
    want = {(min(group[i], group[j]), max(group[i], group[j])) for i in range(60) for j in range(i) if group[i] != group[j] and alike(held[i], held[j])}
    assert want and {(min(group[i], group[j]), max(group[i], group[j])) for i, j in zip(p, q)} == want and all(alike(held[i], held[j]) for i, j in zip(p, q))


def test_groups_of_few_edges_are_those_of_the_rounds(spark):
    rng = np.random.default_rng(6)
    path = rng.permutation(400) - 200  # a long chain in no order, a hub that is the largest of its group, loops, repeats
    pairs = [*zip(path, path[1:]), *((9000, x) for x in range(1000, 1100)), (7, 7), (5000, 5000), (6000, 6001), (6001, 6000), (6000, 6001)]
    edges = similar_texts.durable(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long"))
    want = {x: -200 for x in range(-200, 200)} | {x: 1000 for x in [9000, *range(1000, 1100)]} | {6000: 6000, 6001: 6000}
    for most in (1 << 20, 10):
        got = {r.node: r.root for r in similar_texts.grouped(edges, most).collect()}
        assert {x: got[x] for x in want} == want and all(got[x] == x for x in got.keys() - want.keys())
    assert similar_texts.grouped(edges.filter("a > 10000")).count() == 0


def test_grouping_runs_few_jobs(spark):
    rng, texts = np.random.default_rng(8), []
    for _ in range(20):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
        texts += [" ".join(w), " ".join([*w[:50], "other", *w[51:]])]
    docs = spark.createDataFrame([(int(i), t, len(s), [7]) for i, (t, s) in enumerate(zip(texts, sets(texts)))], "node long, t string, size long, keys array<long>")
    spark.sparkContext.setJobGroup("grouping", "grouping")
    try:
        got = {r.node: r.root for r in similar_texts.linked(docs).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("grouping"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert got == {i: i - i % 2 for i in range(40)}
    assert jobs <= 100
