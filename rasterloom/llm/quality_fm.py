"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, encode_words, full_text, ngram_hashes, remainder, segment_sum, split_words, starts
from .features import labelled_sample

# Upper edges of the bins of each statistic; a bin is one feature.
EDGES = {
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "symbols": (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "upper": (0.0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6),
    "digits": (0.0, 0.005, 0.02, 0.05, 0.1, 0.3),
    "marks": (0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4),
    "pipes": (0.0, 0.005, 0.02, 0.05),
    "bangs": (0.0, 0.005, 0.02, 0.05),
    "word_length": (2.0, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 9.0, 15.0),
    "top_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
    "line_words": (2.0, 5.0, 10.0, 20.0, 50.0, 150.0),
    "repeated_lines": (0.0, 0.05, 0.2, 0.5),
    "repeated_pairs": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "chars": (50.0, 150.0, 400.0, 1000.0, 2500.0, 6000.0, 15000.0),
}
STRUCTURE = sum(len(e) + 1 for e in EDGES.values())
_OFFSET = dict(zip(EDGES, starts(np.array([len(e) + 1 for e in EDGES.values()]))))


def structure(texts: pa.Array, flat: pa.Array, code: np.ndarray, words: pa.Array, n: np.ndarray) -> np.ndarray:
    """One feature per statistic and text: documents x statistics, as places among the structure features."""
    texts = texts.cast(pa.large_string()).fill_null("")
    count = len(texts)
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1).astype(float)
    safe = np.maximum(n, 1)
    doc = np.repeat(np.arange(count), n)

    def share(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / chars

    pair, times = np.unique(doc * np.int64(len(words) + 1) + code, return_counts=True)
    owner = pair // (len(words) + 1)
    most = np.zeros(count)
    np.maximum.at(most, owner, times)
    same = doc[1:] == doc[:-1]
    two = np.unique(doc[1:][same] * np.int64(1 << 40) + (code[:-1][same] * np.int64(1_000_003) + code[1:][same]) % np.int64(1 << 40))
    lines = pc.split_pattern(texts, "\n")
    line_owner = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    line_code = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    n_lines = np.bincount(line_owner, minlength=count)
    distinct_lines = np.bincount(np.unique(line_owner * np.int64(len(line_code) + 1) + line_code) // (len(line_code) + 1), minlength=count)
    values = {
        "distinct": np.bincount(owner, minlength=count) / safe,
        "symbols": share(r"[#*$%&<>|]"),
        "upper": share(r"[A-ZÀ-ÖØ-Þ]"),
        "digits": share(r"[0-9]"),
        "marks": share(r"[.,;:!?'\"()\[\]{}]"),
        "pipes": share(r"\|"),
        "bangs": share(r"!"),
        "word_length": segment_sum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(float)[code], n) / safe,
        "top_share": most / safe,
        "line_words": n / np.maximum(n_lines, 1),
        "repeated_lines": 1 - distinct_lines / np.maximum(n_lines, 1),
        "repeated_pairs": 1 - np.bincount(two >> 40, minlength=count) / np.maximum(n - 1, 1) * (n > 1) - (n <= 1),
        "chars": chars,
    }
    return np.stack([_OFFSET[k] + np.searchsorted(e, values[k]) for k, e in EDGES.items()], axis=1)


@dataclass
class Machine:
    """bias + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2); words first, then structure."""

    bias: float
    weight: np.ndarray
    factors: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.weight) - STRUCTURE

    def parts(self, texts: pa.Array):
        """Features of the texts in order: how many each text has, which, and their values.

        A hashed word has its share of the document's Euclidean norm of counts; a
        structure feature has 1.
        """
        flat, n = split_words(texts, lower=False)
        words, code = encode_words(flat)
        first = structure(texts, flat, code, words, n)
        keys, per = ngram_hashes(words, (), self.buckets)  # without n-grams: the words alone
        doc = np.repeat(np.arange(len(n)), n)
        cell, times = np.unique(doc * np.int64(self.buckets) + keys[code].astype(np.int64), return_counts=True)
        doc, key = np.divmod(cell, self.buckets)
        norm = np.sqrt(np.bincount(doc, weights=times.astype(float) ** 2, minlength=len(n)))
        value = times / norm[doc]
        count = np.bincount(doc, minlength=len(n))
        return count, key, value, first + self.buckets

    def logit(self, count, key, value, first) -> np.ndarray:
        """In time linear in the features, by the sum-of-squares identity."""
        linear = segment_sum(self.weight[key] * value, count) + self.weight[first].sum(axis=1)
        vx = self.factors[key] * value[:, None]
        total = segment_sum(vx, count) + self.factors[first].sum(axis=1)
        squares = segment_sum(vx**2, count) + (self.factors[first] ** 2).sum(axis=1)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(*self.parts(texts)), -60, 60)))


def fit(sample: pd.DataFrame, buckets: int = 1 << 16, dim: int = 6, epochs: int = 8, rate: float = 0.05, decay: float = 1e-4, batch: int = 128, seed: int = 11) -> Machine:
    """Minibatch AdaGrad on class-balanced log loss. Without rows of both labels the score is a constant."""
    y = sample["y"].to_numpy().astype(float) if len(sample) else np.zeros(0)
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(buckets + STRUCTURE), rng.normal(0, 0.02, (buckets + STRUCTURE, dim)))
    if len(set(y)) < 2:
        m.bias, m.factors = 4.6 if len(y) == 0 or y[0] == 1 else -4.6, m.factors * 0
        return m
    count, key, value, first = m.parts(pa.array(sample["text"]))
    at = starts(count)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    g_w, g_v, g_b = np.full(len(m.weight), 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            k = np.concatenate([np.concatenate([key[at[r] : at[r + 1]], first[r]]) for r in rows])
            x = np.concatenate([np.concatenate([value[at[r] : at[r + 1]], np.ones(first.shape[1])]) for r in rows])
            n = count[rows] + first.shape[1]
            owner = np.repeat(np.arange(len(rows)), n)
            v = m.factors[k]
            total = segment_sum(v * x[:, None], n)
            z = m.bias + segment_sum(m.weight[k] * x, n) + 0.5 * (total**2 - segment_sum((v * x[:, None]) ** 2, n)).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * balance[rows] / len(rows)
            used, slot = np.unique(k, return_inverse=True)
            d_w = np.bincount(slot, weights=slope[owner] * x) + decay * m.weight[used]
            d_each = (slope[owner] * x)[:, None] * (total[owner] - v * x[:, None])
            d_v = np.stack([np.bincount(slot, weights=d_each[:, f]) for f in range(d_each.shape[1])], axis=1) + decay * m.factors[used]
            g_w[used] += d_w**2
            g_v[used] += d_v**2
            g_b += slope.sum() ** 2
            m.weight[used] -= rate * d_w / np.sqrt(g_w[used])
            m.factors[used] -= rate * d_v / np.sqrt(g_v[used])
            m.bias -= rate * slope.sum() / np.sqrt(g_b)
    m.weight, m.factors = m.weight.astype(np.float32), m.factors.astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits on at most ``per_class`` labelled texts of either label."""
    return fit(labelled_sample(docs, labels, "quality", modulus, held_out, per_class, id_col, text_col))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = 1500, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Features are hashed words, binned statistics of the text's structure and its
    length; labels, language, source and id are never among them. Null and empty
    texts are scored by their structure alone; repeated rows and null ids (crc32 of
    the empty text) get a row each; an empty table gives no rows; without labels of
    both kinds the score is a constant; further columns are not read. No shuffle of
    texts takes place; the model has a fixed size and is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class, modulus, held_out, id_col, text_col))

    def run(batches):
        for b in byte_slices(batches, "text", 8 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(model.value.score(b.column(1)), pa.float64())], names=["id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), full_text(F.col(text_col)).alias("text"), (remainder(F.col(id_col), modulus) == held_out).alias("held_out"))
    out = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
