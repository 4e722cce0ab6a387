"""Hidden Markov language model over word classes, trained by distributed Baum-Welch."""

from __future__ import annotations

import io
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, durable, encode_words, full_text, ngram_hashes, ragged_take, remainder, segment_sum, split_words, starts

END = ""  # no word is empty; the end token stands first in every block's dictionary


# --- word classes -------------------------------------------------------------------------


@dataclass
class Classes:
    """Frequent words (the end token first) have a class each; the others share ``shared`` classes by their edges."""

    frequent: list[str]
    shared: int

    @property
    def size(self) -> int:
        return len(self.frequent) + self.shared

    def of(self, words: pa.Array) -> np.ndarray:
        words = words.cast(pa.large_string())
        own = pc.index_in(words, value_set=pa.array(self.frequent, pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = words.cast(pa.large_binary())
        offset = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.concatenate([np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8), np.zeros(4, dtype=np.uint8)]).astype(np.uint64)
        first, last = offset[:-1], np.maximum(offset[1:], 1)
        key = data[first] * np.uint64(256) + data[np.minimum(first + 1, last - 1)]
        for back in (1, 2, 3):
            key = key * np.uint64(257) + data[np.maximum(last - back, np.minimum(first, last - 1))]
        key = (key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        shared = len(self.frequent) + ((key >> np.uint64(33)) % np.uint64(self.shared)).astype(np.int64)
        return np.where(own >= 0, own, shared)


# --- the model ----------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def count_pass(model: Model, flat: np.ndarray, lengths: np.ndarray, longest: int = 1024, cells: int = 1 << 18) -> list[np.ndarray]:
    """Expected starts, moves and emissions of one Baum-Welch step over whole sequences.

    Sequences advance together. One longer than ``longest`` is worked in stretches: what
    the states know from all that lies before a stretch, and from all that lies after it, is
    carried over by the products of the stretches' transfer matrices, and the move into
    a stretch is counted with it, so the counts are those of the whole sequence.
    """
    k, classes = len(model.start), len(model.emit)
    starts_, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k))
    cuts = -(-lengths // longest)
    place = np.arange(cuts.sum()) - np.repeat(starts(cuts)[:-1], cuts)
    begin = np.repeat(starts(lengths)[:-1], cuts) + place * longest
    size = np.minimum(longest, np.repeat(starts(lengths)[1:], cuts) - begin)
    before, after = _context(model, flat, cuts, place, begin, size)
    order = np.argsort(-size, kind="stable")
    emit = np.vstack([model.emit, np.ones(k)]).astype(np.float32)  # the last row fills ends
    move = model.move.astype(np.float32)
    padded = np.append(flat, classes)
    lo = 0
    while lo < len(order):
        rows = order[lo : lo + max(1, cells // int(size[order[lo]]))]
        lo += len(rows)
        b, n, head = begin[rows], size[rows], place[rows] == 0
        steps = int(n[0])
        live = np.searchsorted(-n, -np.arange(steps), side="left")  # rows longer than t stand first
        at = b[None, :] + np.arange(steps)[:, None]
        real = np.arange(steps)[:, None] < n[None, :]
        obs = padded[np.where(real, at, len(flat))]
        alpha, scale = np.zeros((steps, len(rows), k), dtype=np.float32), np.ones((steps, len(rows), 1), dtype=np.float32)
        prior = before[rows].astype(np.float32)
        a = np.where(head[:, None], model.start.astype(np.float32), prior @ move)
        for t in range(steps):
            m = live[t]
            x = (a[:m] @ move if t else a) * emit[obs[t, :m]]
            np.maximum(x.sum(axis=1, keepdims=True), 1e-30, out=scale[t, :m])
            np.divide(x, scale[t, :m], out=alpha[t, :m])
            a[:m] = alpha[t, :m]
        beta = after[rows].astype(np.float32)
        beta /= np.maximum((a * beta).sum(axis=1, keepdims=True), 1e-30)
        xi = np.zeros((k, k), dtype=np.float64)
        for t in range(steps - 1, 0, -1):
            m = live[t]
            g = emit[obs[t, :m]] * beta[:m]
            g /= scale[t, :m]
            xi += alpha[t - 1, :m].T @ g
            alpha[t, :m] *= beta[:m]
            np.matmul(g, move.T, out=beta[:m])
        g = emit[obs[0]] * beta / scale[0]
        xi += (prior * ~head[:, None]).T @ g
        alpha[0] *= beta
        moves += xi * model.move
        starts_ += alpha[0][head].sum(axis=0)
        seen, share = obs[real], alpha[real]
        for s in range(k):
            emits[:, s] += np.bincount(seen, weights=share[:, s], minlength=classes)
    return [starts_, moves, emits]


def _context(model: Model, flat: np.ndarray, cuts: np.ndarray, place: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per stretch: the states' shares at the token before it, and the (scaled) likelihood of what follows it, by state."""
    k = len(model.start)
    before, after = np.ones((len(size), k)), np.ones((len(size), k))
    doc = np.repeat(np.arange(len(cuts)), cuts)
    several = np.flatnonzero(cuts[doc] > 1)
    if not len(several):
        return before, after
    matrix = np.empty((len(size), k, k))
    order = several[np.argsort(-size[several], kind="stable")]
    for lo in range(0, len(order), 512):
        rows = order[lo : lo + 512]
        n, m3, head = size[rows], np.tile(np.eye(k), (len(rows), 1, 1)), place[rows] == 0
        for t in range(int(n[0])):
            m = int(np.searchsorted(-n, -t, side="left"))
            x = m3[:m] @ model.move if t else np.where(head[:, None, None], m3, m3 @ model.move)  # a first stretch begins without a move
            x = x * model.emit[flat[begin[rows[:m]] + t]][:, None, :]
            m3[:m] = x / x.max(axis=(1, 2), keepdims=True)
        matrix[rows] = m3
    first, last = np.flatnonzero(place == 0), np.flatnonzero(place == cuts[doc] - 1)
    for d in np.flatnonzero(cuts > 1):
        a = model.start @ matrix[first[d]]
        for i in range(first[d] + 1, last[d] + 1):
            before[i] = a = a / a.sum()
            a = a @ matrix[i]  # the last is not needed further
        b = np.ones(k)
        for i in range(last[d] - 1, first[d] - 1, -1):
            b = matrix[i + 1] @ b
            after[i] = b = b / b.max()
    return before, after


def maximise(counts: list[np.ndarray], base: np.ndarray, prior: float = 200.0) -> Model:
    """New parameters; emissions are smoothed towards the overall class shares ``base``."""
    start = (counts[0] + 1.0) / (counts[0].sum() + len(counts[0]))
    move = (counts[1] + 0.1) / (counts[1].sum(axis=1, keepdims=True) + 0.1 * len(start))
    emit = (counts[2] + prior * base[:, None]) / (counts[2].sum(axis=0) + prior)
    return Model(start, move, emit)


def first_model(flat: np.ndarray, lengths: np.ndarray, base: np.ndarray, states: int, rounds: int = 12, seed: int = 5) -> Model:
    """Starting parameters from a bounded sample: sticky moves, emissions of random thirds of documents, a few rounds."""
    rng = np.random.default_rng(seed)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    side = rng.integers(0, states, len(lengths))[doc] if len(lengths) else np.zeros(0, dtype=int)
    counts = np.bincount(flat * states + side, minlength=len(base) * states).reshape(len(base), states).astype(float) if len(flat) else np.tile(1000.0 * base[:, None], (1, states))
    model = maximise([np.ones(states), np.eye(states) * 50 + 1, counts * rng.uniform(0.5, 1.5, counts.shape)], base, prior=20.0)
    for _ in range(rounds if len(flat) else 0):
        model = maximise(count_pass(model, flat, lengths), base, prior=50.0)
    return model


def log10_likelihood(model: Model, flat: np.ndarray, lengths: np.ndarray, longest: int = 1024) -> np.ndarray:
    """Exact log10 likelihood of each whole sequence by the scaled forward recursion.

    Sequences advance together. One longer than ``longest`` is carried as the products
    of its stretches' transfer matrices, which gives the same sum.
    """
    k, out, at = len(model.start), np.zeros(len(lengths)), starts(lengths)[:-1]
    short = np.flatnonzero((lengths <= longest) & (lengths > 0))
    short = short[np.argsort(-lengths[short], kind="stable")]
    n, begin = lengths[short], at[short]
    a, total = np.tile(model.start, (len(short), 1)), np.zeros(len(short))
    for t in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -t, side="left"))  # those longer than t
        x = (a[:m] if not t else a[:m] @ model.move) * model.emit[flat[begin[:m] + t]]
        s = x.sum(axis=1)
        total[:m] += np.log10(s)
        a[:m] = x / s[:, None]
    out[short] = total
    long = np.flatnonzero(lengths > longest)
    if not len(long):
        return out
    cuts = -(-lengths[long] // longest)
    owner = np.repeat(np.arange(len(long)), cuts)
    inner = np.arange(cuts.sum()) - np.repeat(starts(cuts)[:-1], cuts)
    begin = at[long][owner] + inner * longest
    size = np.minimum(longest, (at + lengths)[long][owner] - begin)
    order = np.argsort(-size, kind="stable")
    matrix, shift = np.empty((len(order), k, k)), np.zeros(len(order))
    for lo in range(0, len(order), 512):
        rows = order[lo : lo + 512]
        n, b = size[rows], begin[rows]
        m3 = np.tile(np.eye(k), (len(rows), 1, 1))
        logs = np.zeros(len(rows))
        head = inner[rows] == 0
        for t in range(int(n[0])):
            m = int(np.searchsorted(-n, -t, side="left"))
            x = m3[:m] if not t else m3[:m] @ model.move
            if not t:
                x = np.where(head[:, None, None], x, x @ model.move)  # a later stretch starts with a move
            x = x * model.emit[flat[b[:m] + t]][:, None, :]
            s = x.max(axis=(1, 2))
            logs[:m] += np.log10(s)
            m3[:m] = x / s[:, None, None]
        matrix[rows], shift[rows] = m3, logs
    first = starts(cuts)
    for i, doc in enumerate(long):
        v, total = model.start, 0.0
        for j in range(first[i], first[i + 1]):
            v = v @ matrix[j]
            s = v.sum()
            total, v = total + np.log10(s) + shift[j], v / s
        out[doc] = total
    return out


# --- on the cluster -----------------------------------------------------------------------

#: Bytes of text in a block, and of rows that meet in one batch between Spark and a Python worker.
MOST = 4 << 20

#: A block is a row group of its own. By default Parquet looks at sizes every hundred rows, so up to a hundred
#: blocks met in one page, and in the heap of each task that wrote them and then of each that read them.
BY_BLOCK = {"parquet.block.row.count.limit": 1}


def in_small_batches(operator):
    """``operator`` with its result written at once, and all its plans run in batches that end once they hold ``MOST`` bytes.

    So blocks go to a Python worker one by one. By default Spark gathers 64 MB of rows in each
    task, outside its heap and again in the worker. The session's setting is put back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    @wraps(operator)
    def run(docs: DataFrame, *args, **settings) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(key)
        conf.set(key, f"{MOST}b")
        try:
            return durable(operator(docs, *args, **settings))
        finally:
            conf.set(key, before)

    return run


def _dump(arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _load(blob: bytes) -> list[np.ndarray]:
    got = np.load(io.BytesIO(blob))
    return [got[k] for k in got.files]


def blocks_of(docs: DataFrame, modulus: int, held_out: int, id_col: str, text_col: str, most: int = MOST) -> DataFrame:
    """Documents as bounded blocks: a dictionary, its training counts, and the texts as places in it."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), full_text(F.col(text_col)).alias("text"), (remainder(F.col(id_col), modulus) == held_out).alias("held_out"))

    def run(batches):
        part = TaskContext.get().partitionId()
        for i, b in enumerate(byte_slices(batches, "text", most)):
            flat, n = split_words(b.column(1), lower=True)
            words, code = encode_words(flat)
            codes = np.zeros(int(n.sum()) + len(n), dtype="<i4")  # the end token is 0
            first = starts(n + 1)[:-1]
            codes[ragged_take(first, n)] = code + 1
            learn = ~b.column(2).to_numpy(zero_copy_only=False)
            counts = np.bincount(codes[np.repeat(learn, n + 1)], minlength=len(words) + 1)
            listed = pa.concat_arrays([pa.array([END], pa.large_string()), words.cast(pa.large_string())])
            one = lambda x, t: pa.array([x], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) | i], pa.int64()), pa.ListArray.from_arrays([0, len(b)], b.column(0)), one(b.column(2), pa.bool_()), one(n + 1, pa.int64()), pa.ListArray.from_arrays([0, len(listed)], listed.cast(pa.string())), one(counts, pa.int64()), pa.array([codes.tobytes()], pa.binary())],
                names=["block", "ids", "held_out", "lengths", "words", "counts", "codes"],
            )

    return rows.mapInArrow(run, f"block long, ids array<{kind}>, held_out array<boolean>, lengths array<long>, words array<string>, counts array<long>, codes binary")


def _sequences(batch: pa.RecordBatch, row: int, classes: Classes, train_only: bool):
    """Class codes, lengths, word classes and dictionary codes of one block."""
    lengths = batch.column("lengths")[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer(batch.column("codes")[row].as_buffer(), dtype="<i4")
    klass = classes.of(batch.column("words")[row].values).astype(np.int32)
    if train_only:
        learn = ~batch.column("held_out")[row].values.to_numpy(zero_copy_only=False)
        code, lengths = code[np.repeat(learn, lengths)], lengths[learn]
    return klass[code], lengths, klass, code


def vocabulary_of(blocks: DataFrame, parts: int, frequent: int, shared: int) -> DataFrame:
    """The exact training counts of all words, found and sent back part by part of the vocabulary.

    A block sends each part its words as one row, not a row a word. Kinds of rows:
    0: ``counts`` of the words of ``part`` that ``block`` lists, in its order;
    1: ``n`` tokens and ``v`` distinct words of a shared class ``at`` (-1: the end token);
    2: a ``word`` that may be among the ``frequent`` most frequent, with its count ``n``.
    """

    def send(batches):
        for b in batches:
            for r in range(b.num_rows):
                words = b.column(1)[r].values.cast(pa.large_string())
                part = ngram_hashes(words, (), parts)[0]
                order = np.argsort(part, kind="stable")
                found, first = np.unique(part[order], return_index=True)
                offsets = pa.array([*first, len(order)], pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(order))), pa.scalar(" ", pa.large_string()))
                counts = pa.ListArray.from_arrays(offsets, b.column(2)[r].values.cast(pa.int32()).take(pa.array(order)))
                block = pa.array(np.full(len(found), b.column(0)[r].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), block, joined.cast(pa.string()), counts], names=["part", "block", "words", "counts"])

    def count(key, rows):
        listed = pc.split_pattern(rows["words"].combine_chunks().cast(pa.large_string()), " ")
        words, code = encode_words(listed.flatten())
        counts = rows["counts"].combine_chunks()
        total = np.bincount(code, weights=counts.flatten().to_numpy(zero_copy_only=False), minlength=len(words)).astype(np.int64)
        n = len(rows)
        back = pa.ListArray.from_arrays(pa.array(starts(pc.list_value_length(counts).to_numpy(zero_copy_only=False)), pa.int32()), pa.array(total[code], pa.int64()))
        seen = np.flatnonzero(total > 0)
        words, total = words.take(pa.array(seen)), total[seen]
        size = pc.binary_length(words).to_numpy(zero_copy_only=False)
        klass = np.where(size == 0, -1, Classes([], shared).of(words))
        held, place = np.unique(klass, return_inverse=True)
        few = pa.table({"n": total, "word": words}).filter(pa.array((size > 0) & (size <= 64)))
        few = few.take(pc.sort_indices(few, [("n", "descending"), ("word", "ascending")])[: frequent - 1])
        shape = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("counts", pa.list_(pa.int64())), ("at", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("word", pa.string())])
        part = lambda k: pa.array(np.full(k, key[0].as_py()), pa.int64())
        rows_of = lambda kind, k, **x: pa.table([x[f.name] if f.name in x else pa.array(np.full(k, kind), f.type) if f.name == "kind" else part(k) if f.name == "part" else pa.nulls(k, f.type) for f in shape], schema=shape)
        return pa.concat_tables(
            [
                rows_of(0, n, block=rows["block"].combine_chunks(), counts=back),
                rows_of(1, len(held), at=pa.array(held, pa.int64()), n=pa.array(np.bincount(place, weights=total, minlength=len(held)).astype(np.int64)), v=pa.array(np.bincount(place, minlength=len(held)).astype(np.int64))),
                rows_of(2, len(few), n=few["n"], word=few["word"].cast(pa.string())),
            ]
        )

    sent = blocks.select("block", "words", "counts").mapInArrow(send, "part long, block long, words string, counts array<int>")
    return sent.groupBy("part").applyInArrow(count, "kind int, part long, block long, counts array<long>, at long, n long, v long, word string")


def gathered_counts(blocks: DataFrame, shared, fan: int = 16) -> list[np.ndarray]:
    """One Baum-Welch pass over every training document; counts are summed as a tree, ``fan`` at a time."""

    def run(batches):
        total = None
        for b in batches:
            for r in range(b.num_rows):
                model, classes = shared.value
                flat, lengths, *_ = _sequences(b, r, classes, True)
                part = count_pass(model, flat, lengths)
                total = part if total is None else [x + y for x, y in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_dump(total)], pa.binary())], names=["part", "blob"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for blob in pdf["blob"]:
            part = _load(blob)
            total = part if total is None else [x + y for x, y in zip(total, part)]
        return pd.DataFrame({"part": [int(pdf["slot"].iloc[0])], "blob": [_dump(total)]})

    found = blocks.select("held_out", "lengths", "words", "codes").mapInArrow(run, "part long, blob binary")
    n = found.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        found = found.withColumn("slot", F.pmod("part", F.lit(n))).groupBy("slot").applyInPandas(join, "part long, blob binary")
    parts = [_load(r.blob) for r in found.select("blob").collect()]  # at most ``fan`` rows of fixed size
    return [sum(x) for x in zip(*parts)]


@in_small_batches
def score(
    docs: DataFrame,
    states: int = 8,
    frequent: int = 2048,
    shared_classes: int = 1024,
    rounds: int = 3,
    modulus: int = 5,
    held_out: int = 1,
    sample_blocks: int = 2,
    sample_tokens: int = 400_000,
    window: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, states.

    A token is emitted by a hidden state as its class and within its class by its
    training count, so P(text) = forward likelihood of the classes x product of
    (c + 0.5) / (N_class + 0.5 (V_class + 1)) over tokens of shared classes; the
    probabilities of all tokens sum to one, with one unknown word a class. Counts of
    every training word are exact and stay distributed; starting parameters come from
    windows of ``window`` tokens drawn at random from ``sample_blocks`` blocks, at most
    ``sample_tokens`` tokens, after which every round counts over all training
    documents, each as one whole sequence. Words of more than 64 bytes always share a class. Null, empty and blank texts are the end
    token alone; repeated rows and null ids (crc32 of the empty text) get a row each;
    with no training document all counts are zero; an empty table gives no rows;
    further columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = durable(blocks_of(docs, modulus, held_out, id_col, text_col), **BY_BLOCK)
    entries = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = 16 + entries // 200_000  # a part is counted in one task, whatever the input
    vocabulary = durable(vocabulary_of(blocks, parts, frequent, shared_classes))
    sums = vocabulary.filter("kind = 1").groupBy("at").agg(F.sum("n"), F.sum("v")).collect()  # a row a class
    top = vocabulary.filter("kind = 2").orderBy(F.desc("n"), "word").limit(frequent - 1).select("word", "n").collect()
    n_all, v_all = sum(r[1] for r in sums), sum(r[2] for r in sums)
    classes = Classes([END, *(r.word for r in top)], shared_classes)
    lead, n_class, v_class = len(classes.frequent), np.zeros(classes.size), np.zeros(classes.size)
    for at, n, v in sums:
        place = 0 if at < 0 else lead + at
        n_class[place], v_class[place] = n, v
    if top:
        n_class[1:lead], v_class[1:lead] = [r.n for r in top], 1
        shared = lead + Classes([], shared_classes).of(pa.array(classes.frequent[1:], pa.large_string()))
        np.subtract.at(n_class, shared, n_class[1:lead])
        np.subtract.at(v_class, shared, 1)
    base = (n_class + 0.5) / (n_class.sum() + 0.5 * classes.size)

    chosen = [r.block for r in blocks.select("block").orderBy(F.xxhash64("block")).limit(sample_blocks).collect()]
    drawn = blocks.select("block", "held_out", "lengths", "words", "codes").filter(F.col("block").isin(chosen))

    def begin(batches):
        flats, lengths = [], []
        for b in batches:
            for r in range(b.num_rows):
                flat, size, *_ = _sequences(b, r, classes, True)
                run = np.concatenate([np.full(x // window + 1, window) for x in size] or [size])
                run[np.cumsum(size // window + 1) - 1] = size % window  # texts in windows of at most ``window`` tokens
                run = run[run > 0] if len(size) else run
                drawn_runs = np.random.default_rng(5).permutation(len(run))
                drawn_runs = np.sort(drawn_runs[np.cumsum(run[drawn_runs]) <= sample_tokens // sample_blocks])
                flats.append(flat[ragged_take(starts(run)[:-1][drawn_runs], run[drawn_runs])])
                lengths.append(run[drawn_runs])
        model = first_model(np.concatenate([*flats, np.zeros(0, dtype=np.int64)]).astype(np.int64), np.concatenate([*lengths, np.zeros(0, dtype=np.int64)]).astype(np.int64), base, states)
        yield pa.RecordBatch.from_arrays([pa.array([_dump([model.start, model.move, model.emit])], pa.binary())], names=["blob"])

    none = np.zeros(0, dtype=np.int64)
    model = Model(*_load(drawn.coalesce(1).mapInArrow(begin, "blob binary").first()[0])) if chosen else first_model(none, none, base, states)
    for _ in range(rounds):
        counts = gathered_counts(blocks, spark.sparkContext.broadcast((model, classes)))
        if not counts:
            break
        model = maximise(counts, base)

    inside = np.log10(n_class + 0.5 * (v_class + 1))
    inside[: len(classes.frequent)] = 0.0
    shared = spark.sparkContext.broadcast((model, classes, inside))  # states x classes, whatever the input
    whole = np.log10(n_all + 0.5 * (v_all + 1))

    by_block = vocabulary.filter("kind = 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("known"))  # bounded by the block's dictionary
    ready = blocks.drop("counts").join(by_block, "block").select("ids", "held_out", "lengths", "words", "codes", F.flatten("known.counts").alias("c"))

    def run(batches):
        model, classes, inside = shared.value
        for b in batches:
            for r in range(b.num_rows):
                flat, lengths, klass, code = _sequences(b, r, classes, False)
                c = np.zeros(len(klass), dtype=np.int64)
                part = ngram_hashes(b.column("words")[r].values.cast(pa.large_string()), (), parts)[0]
                c[np.argsort(part, kind="stable")] = b.column("c")[r].values.to_numpy(zero_copy_only=False)
                log_c = np.log10(c + 0.5)
                base_score = segment_sum((log_c - whole)[code], lengths)
                within = np.where(klass < len(classes.frequent), 0.0, log_c - inside[klass])
                total = segment_sum(within[code], lengths) + log10_likelihood(model, flat, lengths)
                n_known = segment_sum((c > 0)[code], lengths).astype(np.int64)
                columns = [b.column("ids")[r].values, b.column("held_out")[r].values, pa.array(lengths), pa.array(n_known), pa.array(np.full(len(lengths), n_all), pa.int64()), pa.array(base_score), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = ready.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col).withColumn("states", F.lit(states))
