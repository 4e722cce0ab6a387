"""Cases that earlier forms of the operators got wrong."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import ann, bpe, common, hmm, mixing, quality_rules, similar_texts, tokens, toxicity
from rasterloom.llm.entries import vocabulary


@pytest.mark.parametrize("kind", ["offset", "clusters", "huge", "tiny"])
def test_graph_search_on_hard_vectors(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    if kind == "offset":
        x = 1000 + 0.01 * x
    elif kind == "clusters":
        x = 50 * rng.normal(size=(12, 16))[rng.integers(0, 12, 900)] + 0.01 * x
    else:
        x *= 1e200 if kind == "huge" else 1e-200
    t = spark.createDataFrame([(i, v.tolist(), 1, 2, 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, id int, shard int, dim int")
    got = ann.search(ann.build_index(t, shard_rows=600), t.filter("vec_id % 50 = 0"), k=10).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        d = ann.distances(x, x[q][None, :])
        d[q] = np.inf
        assert len(part) == 10 and np.allclose(part["score"], d[part["vec_id"]], rtol=1e-12)
        hits += len(set(np.argsort(d, kind="stable")[:10]) & set(part["vec_id"]))
    assert hits >= 0.95 * 10 * 18


def test_distances_are_those_of_scaled_vectors():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 8)), rng.normal(size=(5, 8))
    for scale in (1.0, 1e200, 1e-200):
        assert np.allclose(ann.distances(a * scale, b * scale) / scale, np.sqrt(((a - b) ** 2).sum(1)), rtol=1e-12)


def test_expected_counts_equal_posteriors_of_all_paths():
    rng = np.random.default_rng(1)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((7, 3)), 0))
    seqs = [rng.integers(0, 7, n) for n in (1, 5, 8, 3, 7, 6, 2)]
    s0, s1, s2 = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for s in seqs:
        p = {}
        for path in np.ndindex(*([3] * len(s))):
            p[path] = m.start[path[0]] * m.emit[s[0], path[0]] * math.prod(m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]] for t in range(1, len(s)))
        for path, x in p.items():
            x /= sum(p.values())
            s0[path[0]] += x
            for t in range(len(s)):
                s2[s[t], path[t]] += x
                if t:
                    s1[path[t - 1], path[t]] += x
    for longest in (1024, 3, 2, 1):  # whole, and carried over stretches
        got = hmm.count_pass(m, np.concatenate(seqs), np.array([len(s) for s in seqs]), longest=longest)
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(got, (s0, s1, s2)))


def test_a_sequence_longer_than_a_stretch_has_one_start():
    rng = np.random.default_rng(2)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    m = hmm.Model(norm(rng.random(4), 0), norm(rng.random((4, 4)), 1), norm(rng.random((50, 4)), 0))
    lengths = np.array([3000, 5, 1024, 1025])
    s, moves, emits = hmm.count_pass(m, rng.integers(0, 50, lengths.sum()), lengths)
    assert np.allclose([s.sum(), moves.sum(), emits.sum()], [4, lengths.sum() - 4, lengths.sum()], rtol=1e-4)


def test_states_differ_without_a_sample():
    none = np.zeros(0, dtype=np.int64)
    m = hmm.first_model(none, none, np.full(20, 0.05), 3)
    assert np.abs(m.emit[:, 0] - m.emit[:, 1]).max() > 0.01


@pytest.mark.parametrize("text", ["x" + " " * 300_000, "\n" * 300_000 + "y", "a b " * 20_000 + "\t" * 30_000 + "z", "u" * 100_000])
def test_counts_of_long_runs_equal_the_library(text):
    path = vocabulary("byte_bpe_50k.json")
    want = len(bpe.library(path).encode(text, add_special_tokens=False).ids)
    assert bpe.byte_encoder(path).count(text) == want == tokens.spliced_count(bpe.byte_encoder(path), text)


NAMES = ["doc_id", "text", "lang", "source", "n_chars", "_source", "_epoch", "_n", "_lang", "_fp", "_toxicity", "a.b", "row", "node", "score", "_kept", "c0"]


def clashing(spark, n=60):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 80)), "en", f"s{i % 3}", 1, *(f"{name}{i}" for name in NAMES[5:])) for i in range(n)]
    rows.append((n, rows[0][1], None, None, None, *(None for _ in NAMES[5:])))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in NAMES))


def test_columns_of_any_name_pass_every_stage(spark, tmp_path):
    import corpus_pipeline as c

    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing(spark)
    before = {r[0]: tuple(r) for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == NAMES, name
        assert all(tuple(r) == before[r[0]] for r in out.collect()), name
    mixed = mixing.mix(docs)
    assert mixed.columns == [*NAMES, "_epoch_", "_block", "_place", "_weight"]
    assert quality_rules.quality_rules(docs).count() == len(before)


def test_a_score_is_the_softmax_of_averaged_vectors():
    rng = np.random.default_rng(5)
    m = toxicity.SubwordModel(rng.normal(size=(64, 3)).astype(np.float32), rng.normal(size=(3, 2)), np.array([0.1, -0.2]))
    for text in ("one two two", "ONE", "", None):
        words = (text or "").lower().split()
        bag = np.zeros(3)
        for w in words:
            keys, _ = common.ngram_hashes(pa.array([w]), toxicity.SIZES, 64)
            bag += m.embedding[keys].mean(axis=0) / len(words)
        z = bag @ m.weights + m.bias
        assert math.isclose(m.score(pa.array([text], pa.string()))[0], math.exp(z[1]) / np.exp(z).sum(), rel_tol=1e-5)


def test_fences_follow_exact_quantiles_and_one_source_alone(spark):
    rng = np.random.default_rng(6)

    def corpus(shift):
        rows = []
        for s in ("a", "b"):
            for i in range(500):
                extra = shift if s == "b" else 0
                w = ["x" * int(rng0.integers(3 + extra, 8 + extra)) + str(j) for j in range(40)]
                rows.append((len(rows), " ".join(w), "en", s))
            rows.append((len(rows), " ".join("y" * 14 + str(j) for j in range(40)), "en", s))
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    out = []
    for shift in (0, 8):
        rng0 = np.random.default_rng(7)
        docs = corpus(shift)
        plain, names = common.plainly(docs)
        m = quality_rules.measured(plain.withColumns({"_lang": F.col(names["lang"]), "_source": F.col(names["source"])}), names["text"])
        bounds = {r._source: r for r in quality_rules.fences(m).collect()}
        for s, part in m.toPandas().groupby("_source"):
            lo, hi = np.quantile(part["_word_length"], [0.25, 0.75], method="inverted_cdf")
            spread = part["_word_length"].quantile(0.77) - part["_word_length"].quantile(0.73) + part["_word_length"].quantile(0.27) - part["_word_length"].quantile(0.23)
            assert abs(bounds[s].word_length_most - (hi + 3 * (hi - lo))) <= 4 * spread
        out.append(({r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}, bounds))
    (first, b0), (second, b1) = out
    assert b0["a"].word_length_most == b1["a"].word_length_most and b1["b"].word_length_most > b0["b"].word_length_most + 5
    assert all(first[i] == second[i] for i in range(501)) and not first[500] and not first[1001] and second[1001]
    assert sum(first.values()) >= 0.95 * len(first)


def test_symbol_fence_stands_in_the_gap(spark):
    rows = [(i, " ".join(f"v{i}x{j}" for j in range(60)) + (" #" if i % 20 == 0 else ""), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(f"q{i}x{j}" + ("|" if j % 2 else "") for j in range(60)), "en", "s") for i in range(25)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(25))


def test_crowded_variants_find_the_similar_pair(spark):
    """Many texts that share half of their words meet under common variants; the two similar ones among them are found."""
    rng = np.random.default_rng(8)
    shared = [f"t{j}" for j in range(150)]
    texts = [" ".join([*shared, *(f"u{i}w{x}" for x in rng.integers(0, 10**9, 60))]) for i in range(300)]
    w = texts[0].split()
    texts.append(" ".join([*w[:190], *(f"z{j}" for j in range(12)), *w[202:]]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(similar_texts.shingles(t, 5).tolist()) for t in texts]
    s = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert s(0, 300) >= 0.8 and max(s(1, i) for i in range(2, 300)) < 0.8
    assert {r.doc_id for r in similar_texts.keep_one(docs).collect()} == set(range(300))
