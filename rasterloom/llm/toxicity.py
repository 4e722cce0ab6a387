"""Toxicity scores from averaged subword embeddings under a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, encode_words, full_text, ngram_hashes, plainly, quoted, ragged_take, remainder, segment_sum, split_words, starts
from .features import labelled_sample

SIZES = (3, 4, 5)


@dataclass
class SubwordModel:
    """Embeddings of hashed n-grams, softmax weights and bias, all trained together."""

    embedding: np.ndarray  # buckets x dim
    weights: np.ndarray  # dim x 2
    bias: np.ndarray  # 2

    def word_logits(self, words: pa.Array) -> np.ndarray:
        """Per word, the mean embedding of its n-grams times the softmax weights (label 1 minus label 0)."""
        direction = (self.weights[:, 1] - self.weights[:, 0]).astype(np.float64)
        per_bucket = self.embedding @ direction
        out = []
        for i in range(0, len(words), 32_768):
            keys, n = ngram_hashes(words.slice(i, 32_768), SIZES, len(self.embedding))
            out.append(segment_sum(per_bucket[keys], n) / np.maximum(n, 1))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text: softmax of the average over its words."""
        flat, n = split_words(texts, lower=True)
        words, code = encode_words(flat)
        logit = segment_sum(self.word_logits(words)[code], n) / np.maximum(n, 1) + (self.bias[1] - self.bias[0])
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))


def fit(sample: pd.DataFrame, buckets: int = 1 << 17, dim: int = 4, epochs: int = 600, rate: float = 0.03, decay: float = 1e-4, least: int = 3, chance: float = 3.5, patience: int = 60, seed: int = 7) -> SubwordModel:
    """Adam on class-balanced cross-entropy over embeddings, softmax weights and bias jointly.

    An n-gram in fewer than ``least`` documents of the sample, or spread over the labels
    as by chance (within ``chance`` standard deviations), keeps a zero vector, so that
    little is learned by heart. The first coordinate starts from the n-gram's log-odds,
    the others from small noise. A fifth of the sample is set aside: training ends once
    its balanced loss has not fallen for ``patience`` steps (of at most ``epochs``), at the
    parameters of the least loss, and it sets the bias. Where the fifth holds fewer than 20 texts of a
    label, all rows train and the steps are ``epochs`` / 3. With no rows, or rows of one
    label, the score is a constant.
    """
    y = sample["y"].to_numpy().astype(int) if len(sample) else np.zeros(0, dtype=int)
    weights = np.stack([np.full(dim, -20.0), np.full(dim, 20.0)], axis=1)
    if len(set(y)) < 2:
        side = 9.2 if len(y) and y[0] == 1 else -9.2
        return SubwordModel(np.zeros((1, dim), dtype=np.float32), weights, np.array([0.0, side]))
    rng = np.random.default_rng(seed)
    n = len(y)
    aside = rng.random(n) < 0.2
    if min(np.bincount(y[aside], minlength=2)) < 20:
        aside = np.zeros(n, dtype=bool)
    flat, n_words = split_words(pa.array(sample["text"]), lower=True)
    words, code = encode_words(flat)
    keys, n_keys = ngram_hashes(words, SIZES, buckets)
    key_at, word_at = starts(n_keys)[:-1], starts(n_words)
    df = np.zeros((2, buckets))
    pairs = []
    for i in range(n):
        used, times = np.unique(code[word_at[i] : word_at[i + 1]], return_counts=True)
        pairs.append((used, times / max(1, n_words[i])))
        if not aside[i]:
            seen = np.zeros(buckets, dtype=bool)
            seen[keys[ragged_take(key_at[used], n_keys[used])]] = True
            df[y[i]] += seen
    size = [max(1, int(((y == c) & ~aside).sum())) for c in (0, 1)]
    share = size[1] / (size[0] + size[1])
    z = (df[1] - df.sum(axis=0) * share) / np.sqrt(np.maximum(df.sum(axis=0), 1) * share * (1 - share))
    odds = np.log((df[1] + 0.5) / (size[1] + 1)) - np.log((df[0] + 0.5) / (size[0] + 1))
    keep = (df.sum(axis=0) >= least) & (np.abs(z) >= chance)
    embedding = np.where(keep[:, None], rng.normal(0, 0.01, (buckets, dim)), 0.0)
    sure = keep & (np.abs(odds) > 1)
    embedding[sure, 0] = odds[sure]
    kept = keep[keys]  # n-grams of the distinct words that have a vector
    word_of = np.repeat(np.arange(len(words)), n_keys)[kept]
    kept_keys, kept_n = keys[kept], np.bincount(word_of, minlength=len(words))
    kept_at = starts(kept_n)[:-1]
    doc = np.concatenate([np.full(int(kept_n[u].sum()), i) for i, (u, _) in enumerate(pairs)])
    bucket = np.concatenate([kept_keys[ragged_take(kept_at[u], kept_n[u])] for u, _ in pairs])
    value = np.concatenate([np.repeat(v / n_keys[u], kept_n[u]) for u, v in pairs])
    slot_of, slot = np.unique(bucket, return_inverse=True)
    by_slot = np.argsort(slot, kind="stable")
    per_doc, per_slot = np.bincount(doc, minlength=n), np.bincount(slot, minlength=len(slot_of))
    e, bias = embedding[slot_of], np.zeros(2)
    balance = np.where(y == 1, 0.5 / size[1], 0.5 / size[0]) * ~aside
    state = [(x, np.zeros_like(x), np.zeros_like(x), r) for x, r in ((e, rate), (weights, rate * 20), (bias, rate))]
    watch = np.where(y == 1, 0.5 / max(1, (aside & (y == 1)).sum()), 0.5 / max(1, (aside & (y == 0)).sum())) * aside
    best, best_at, held = np.inf, 0, None
    for step in range(1, (epochs if aside.any() else epochs // 3) + 1):
        bag = segment_sum(e[slot] * value[:, None], per_doc)
        logits = bag @ weights + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        if aside.any():
            loss = -(watch * np.log(np.maximum(p[np.arange(n), y], 1e-12))).sum()
            if loss < best - 1e-5:
                best, best_at, held = loss, step, [x.copy() for x, *_ in state]
            elif step - best_at >= patience:
                break
        p[np.arange(n), y] -= 1
        p *= balance[:, None]
        d_bag = p @ weights.T
        d_e = segment_sum((d_bag[doc] * value[:, None])[by_slot], per_slot) + decay / max(1, len(e)) * e
        for (x, m, v, r), g in zip(state, (d_e, bag.T @ p, p.sum(axis=0))):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= r * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    if held is not None:
        e, weights, bias = held
    embedding[slot_of] = e
    model = SubwordModel(embedding.astype(np.float32), weights, bias)
    check = aside if aside.any() else np.ones(n, dtype=bool)
    return calibrated(model, sample[check], y[check])


def calibrated(model: SubwordModel, sample: pd.DataFrame, y: np.ndarray, dear: float = 6.0) -> SubwordModel:
    """Moves the bias so that a score of 0.3 parts the labels best.

    ``dear`` is a choice, not learned: a share of 0 taken for 1 costs as much as ``dear``
    shares of 1 missed, as most texts of a corpus are not toxic.
    """
    p = np.clip(model.score(pa.array(sample["text"])), 1e-12, 1 - 1e-12)
    logit = np.log(p / (1 - p))
    order = np.argsort(logit, kind="stable")
    ones, zeros = (y[order] == 1).cumsum() / max(1, (y == 1).sum()), (y[order] == 0).cumsum() / max(1, (y == 0).sum())
    cost = ones + dear * (1 - zeros)  # of a cut just above each place
    best = np.flatnonzero(cost[:-1] <= cost[:-1].min() + 1e-12)
    best = best[np.argmax(np.diff(logit[order])[best])]  # the widest gap among equals
    middle = (logit[order][best] + logit[order][best + 1]) / 2
    model.bias = model.bias + np.array([0.0, np.log(0.3 / 0.7) - middle])
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    """Fits on at most ``per_class`` labelled texts of either label; only texts are features."""
    return fit(labelled_sample(docs, labels, "toxic", modulus, held_out, per_class, id_col, text_col))


def scored(docs: DataFrame, model: SubwordModel, text_at: int) -> DataFrame:
    """``docs`` (columns c0, c1, ...) with a column ``score`` of the text in place ``text_at``, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x dim floats, whatever the input
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))

    def run(batches):
        for b in byte_slices(batches, f"c{text_at}", 8 << 20):
            score = shared.value.score(b.column(text_at).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, f"{kinds}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1000, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    A document is the average of its words, a word the average of its hashed byte
    n-grams within word marks and of the word itself, so an unseen misspelling shares
    most vectors with the word it distorts. Null and empty texts get the score of the
    bias alone; repeated rows and null ids (crc32 of the empty text) get a row each;
    an empty table gives no rows; further columns are not read.
    """
    model = train(docs, labels, per_class, modulus, held_out, id_col, text_col)
    rows = docs.select(F.col(quoted(id_col)).alias("c0"), full_text(F.col(quoted(text_col))).alias("c1"))
    out = scored(rows, model, 1)
    return out.select(F.col("c0").alias(id_col), (remainder(F.col("c0"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1000, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold.

    Rows are scored as by ``toxicity``; columns of any names stay as they are.
    """
    plain, _ = plainly(docs)
    kept = scored(plain, train(docs, labels, per_class, text_col=text_col), docs.columns.index(text_col)).filter(F.col("score") < threshold)
    return kept.select(*plain.columns).toDF(*docs.columns)
