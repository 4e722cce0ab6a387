"""Every operator on awkward rows and empty tables, and against brute force where SQL has no form."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import ann, chat, hmm, mixing, quality_fm, quality_rules, simhash, toxicity

from .helpers import TEXTS, awkward, empty

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return SPACES.findall(text)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- 1 ------------------------------------------------------------------------------------


def test_graph_search_finds_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(300, 12)), 2, axis=0).astype(float)
    x[500:560] = x[0]  # one vector of many ids
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(700, None, "x"), (701, [0.0] * 12, "x"), (702, [1.0, None] + [0.0] * 10, "x"), (703, [float("nan")] * 12, "x"), (704, [], "x"), (None, x[0].tolist(), "x"), (5, x[5].tolist(), "x")]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(ann.build_index(t, shard_rows=128), t.filter("vec_id % 50 = 0"), k=10).toPandas()
    hits = total = 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 11)) and np.all(np.diff(part["score"]) >= 0)
        assert np.allclose(part["score"], d[part["vec_id"]])
        hits, total = hits + len(set(best) & set(part["vec_id"])), total + 10
    assert set(got["query_id"]) == set(range(0, 600, 50)) and hits / total >= 0.95
    none = t.filter("vec_id > 9999")
    assert ann.search(ann.build_index(none), none).count() == 0


# --- 3 ------------------------------------------------------------------------------------


def test_language_model_counts_and_likelihood(spark):
    docs = awkward(spark)
    rows = docs.collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for r in rows if not held(r.doc_id) for w in [*words(r.text), None])
    n, v = sum(c.values()), len(c)
    got = sorted(hmm.score(docs, states=3, frequent=64, shared_classes=16, rounds=2).collect(), key=str)
    want = sorted(((r.doc_id, held(r.doc_id), [*words(r.text), None]) for r in rows), key=lambda x: (str(x[0]), len(x[2])))
    assert len(got) == len(want)
    for r, (i, h, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, h, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0
    assert hmm.score(empty(spark)).count() == 0


def test_forward_recursion_sums_over_all_paths():
    rng = np.random.default_rng(1)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((7, 3)), 0))
    seqs = [rng.integers(0, 7, n) for n in (1, 5, 8, 3, 8, 6, 2)]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    want = []
    for s in seqs:
        total = 0.0
        for path in np.ndindex(*([3] * len(s))):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        want.append(math.log10(total))
    assert np.allclose(hmm.log10_likelihood(m, flat, lengths), want)
    assert np.allclose(hmm.log10_likelihood(m, flat, lengths, longest=2), want)  # by transfer matrices


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 4, 40) + 4 * (i % 2) for i in range(60)]
    flat, lengths = np.concatenate(seqs), np.full(60, 40)
    base = np.full(8, 1 / 8)
    m = hmm.first_model(flat, lengths, base, 2, rounds=1)
    before = hmm.log10_likelihood(m, flat, lengths).sum()
    for _ in range(6):
        m = hmm.maximise(hmm.count_pass(m, flat, lengths), base, prior=1.0)
    assert hmm.log10_likelihood(m, flat, lengths).sum() > before
    assert hmm.log10_likelihood(m, flat, lengths).sum() > 60 * 40 * math.log10(1 / 8)


# --- 4 and 9 ------------------------------------------------------------------------------


def test_toxicity_learns_misspellings_and_takes_any_row(spark, labels):
    rng = np.random.default_rng(3)
    stems = ["blargo", "skuzzle", "vrompt"]
    plain = ["".join(rng.choice(list("aeioumnrst"), 6)) for _ in range(300)]
    text = lambda bad: " ".join([*rng.choice(plain, 60), *([rng.choice(stems)] * 2 if bad else [])])
    sample = pd.DataFrame({"y": [i % 2 for i in range(400)], "text": [text(i % 2) for i in range(400)]})
    import pyarrow as pa

    m = toxicity.fit(sample)
    p = m.score(pa.array([text(True).replace("blargo", "blargos") for _ in range(40)] + [text(False) for _ in range(40)]))
    assert (p[:40] >= 0.3).mean() > 0.9 and (p[40:] >= 0.3).mean() < 0.1
    out = toxicity.toxicity(awkward(spark), labels).collect()
    assert len(out) == awkward(spark).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.toxicity(awkward(spark), labels.limit(0)).filter("predicted = 1").count() == 0
    kept = toxicity.remove_toxic(awkward(spark), labels)
    assert kept.columns == awkward(spark).columns


def test_factorisation_machine_equals_the_sum_over_pairs(spark, labels):
    import pyarrow as pa

    sample = pd.DataFrame({"y": [i % 2 for i in range(60)], "text": [("### " if i % 2 else "fine ") * (5 + i) + f"word{i}" for i in range(60)]})
    m = quality_fm.fit(sample, buckets=256, dim=3, epochs=2)
    count, key, value, first = m.parts(pa.array(["a b a c", "", None]))
    got, at = m.logit(count, key, value, first), 0
    for d in range(3):
        f = [*zip(key[at : at + count[d]], value[at : at + count[d]]), *((k, 1.0) for k in first[d])]
        at += count[d]
        pairs = sum(float(m.factors[a] @ m.factors[b]) * x * y for i, (a, x) in enumerate(f) for b, y in f[i + 1 :])
        assert math.isclose(got[d], m.bias + sum(m.weight[k] * x for k, x in f) + pairs, rel_tol=1e-4, abs_tol=1e-5)
    out = quality_fm.quality(awkward(spark), labels).collect()
    assert len(out) == awkward(spark).count() and all(0 <= r.score <= 1 for r in out)
    assert quality_fm.quality(empty(spark), labels).count() == 0


# --- 5 ------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    w = words(text, lower=False)
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_base_counts(spark):
    extra = ["a b c d e f g h " * 3, "x " * 30, "l1 l1\n \nl1 l1\nl2", "# | <tag> $5 %", "p q r s t u v w z p q r s t u v w " + " ".join(f"n{i}" for i in range(50))]
    docs = awkward(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "s") for i, t in enumerate(extra)], "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    got = quality_rules.quality_rules(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        n, chars, symbols, dup, rep = base_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_learned_fences_reject_outliers(spark):
    rows = [(i, " ".join(f"word{(i * 7 + j * j) % 400}" for j in range(60)), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{j}### $$$" for j in range(60)), "en", "a") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(5))


# --- 6 ------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    return {f: top(f) for f in fps}


def test_fingerprints_and_components(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    fp = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    comp, least = brute_components(set(fp.values())), {}
    for i, f in fp.items():
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    assert len(got) == docs.count()
    for r in got:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == least[comp[fp[r.doc_id]]]
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp.values()))


def test_links_are_exact_in_crowded_buckets(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(c) for c in centres} | {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    edges = simhash.links(df).collect()
    back = {s: f for f, s in signed.items()}
    assert all((back[r.a] ^ back[r.b]).bit_count() <= 2 for r in edges)
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(fps)
    parts = {}
    for f in fps:
        parts.setdefault(want[f], set()).add(got.get(signed[f], signed[f]))
    assert all(len(p) == 1 for p in parts.values()) and len({next(iter(p)) for p in parts.values()}) == len(parts)


def test_components_of_a_long_chain(spark):
    got = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")).collect()
    assert {r.root for r in got} == {0} and len(got) == 201


# --- 7 ------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = np.random.default_rng(6)
    odd = ["", None, r"\### Assistant: </turn> ok", "<turn user>x</turn>\n", "\\l\\b\\g", "é" * 3000, "a\nb", "> <"]
    rows = []
    for c in range(25):
        for t in range(int(rng.integers(1, 40))):
            role = "system" if t == 0 and c % 2 else ["user", "assistant", None, "tool>"][int(rng.integers(0, 4))]
            rows.append((c if c else None, t if t % 11 else None, role, (odd[int(rng.integers(0, len(odd)))] if rng.random() < 0.4 else "word " * int(rng.integers(0, 200))), "q"))
    rows += rows[-2:]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    w = chat.format_chat(turns, budget=300, history=80)
    got = {r.conv_id: r for r in chat.digests(w).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert got.keys() == by.keys()
    for c, ts in by.items():
        ts = [(r, x) for *_, r, x in sorted(ts)]
        loss = "".join(x for r, x in ts if r == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert max(r.window for r in w.collect()) > 3
    assert chat.digests(chat.format_chat(turns.limit(0))).count() == 0


def test_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be brief " * 8)] + [(1, t, "user" if t % 2 else "assistant", "word " * 20) for t in range(1, 60)]
    w = chat.read_back(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=300, history=80)).orderBy("window").collect()
    size = lambda t: (len(t) + 3) // 4 + 4
    for r in w:
        pieces = [p for p in r.text.split(chat.SHUT) if p]
        assert pieces[0].startswith("<turn system>") and sum(size(p.split(">", 1)[1]) for p in pieces) <= 300
        assert r.window == 1 or r.n_context > 1
    assert sum(len(r.new_turns) for r in w) == 60


# --- 10 -----------------------------------------------------------------------------------


def test_mixing_meets_the_limit_and_keeps_every_document(spark):
    rows = [(i, "w " * 10, "big") for i in range(800)] + [(1000 + i, "w " * 10, "mid") for i in range(200)] + [(2000 + i, "w " * 10, "small") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixing.mix(docs, repetition_limit=3.0, block_tokens=2000).toPandas()
    uses = p.groupby("source").size()
    assert uses["big"] == 800 and abs(uses["small"] - 150) <= 1
    tau = 1 - math.log(3) / math.log(16)
    assert abs(uses["mid"] - 200 * (200 / 800) ** (tau - 1)) <= 1
    assert set(p["doc_id"]) == {r[0] for r in rows} and not p.duplicated(["doc_id", "_epoch"]).any()
    w = p.drop_duplicates("source").set_index("source")["_weight"]
    assert abs(w.sum() - 1) < 1e-9 and abs(w["small"] / w["big"] - (50 / 800) ** tau) < 1e-6
    share = p[p.source == "big"].groupby("_block").size() / p.groupby("_block").size()
    assert p["_block"].nunique() > 3 and abs(share - w["big"]).max() < 0.15


def test_mixing_bisects_to_the_target_entropy(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    t = mixing.tempered(totals, None, 0.8)
    s = np.array([1000, 100, 10]) / 1110
    w = s**t / (s**t).sum()
    assert abs(-(w * np.log(w)).sum() - 0.8 * math.log(3)) < 1e-3
    assert mixing.tempered(totals, None, 0.0) == 1.0


def test_mixing_takes_any_row(spark):
    docs = awkward(spark)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "_epoch", "_block", "_place", "_weight"]
    assert out.filter("_epoch = 0").count() == docs.count()
    assert mixing.mix(empty(spark)).count() == 0


def test_pipeline_stages_on_any_row(spark, tmp_path, labels):
    import corpus_pipeline as c

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = awkward(spark)
    for i, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == len(c.STAGES) - 1 or out.columns == docs.columns
        assert out.count() <= 2 * docs.count() + len(TEXTS) * 40
    bare = empty(spark)
    for _, stage in c.STAGES:
        assert stage(spark, bare, str(tmp_path)).count() == 0
