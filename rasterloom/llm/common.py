"""Helpers that the text operators share: durable intermediates and word blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are maximal runs of anything else.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local session may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def durable(df: DataFrame, **options) -> DataFrame:
    """``df`` written as Parquet in the shared folder, with further ``options`` of the writer, and read again.

    This cuts the lineage: an executor lost later costs a re-read, not a
    recomputation, and a plan that uses the rows twice computes them once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rasterloom-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    spark.sparkContext._jvm.System.gc()  # the shuffle files behind a finished intermediate are removed once its plan is collected
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*frames: DataFrame) -> None:
    """Removes what ``durable`` wrote for frames that no later plan reads."""
    for df in frames:
        jvm, path = df.sparkSession.sparkContext._jvm, df.written_to
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` column names, made longer where ``taken`` holds them (in any case of letters)."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def plainly(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., and the plain name of each column.

    Whatever names the columns have (dots, or those of a working column), they cannot
    meet the working columns of an operator; ``toDF(*docs.columns)`` gives them back.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def met(big: DataFrame, small: DataFrame, on: list[str], rows: int, most_hot: int = 4096) -> DataFrame:
    """Inner join of ``big`` with one row a key of ``small``, whose column ``n`` counts the key's rows in ``big``.

    Of ``rows`` rows, at most ``most_hot`` keys can hold more than one in ``most_hot``;
    those keys, and only those, are broadcast, so that their rows stay where they are.
    All others are sorted and merged, no task getting more of a key than that share.
    """
    limit = max(1000, -(-rows // most_hot))
    hot, cold = small.filter(F.col("n") > limit), small.filter(F.col("n") <= limit).hint("merge")
    if hot.isEmpty():
        return big.join(cold, on)
    there = big.join(F.broadcast(hot), on)
    return there.unionByName(big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def looked_up(big: DataFrame, small: DataFrame, on: list[str], most: int = 100_000) -> DataFrame:
    """``big`` with the columns of its key's row of ``small``; no row is lost where there is none.

    ``small`` has a row a key and a column ``n``, the key's rows in ``big``. Up to ``most``
    keys are broadcast, after counting them; of more, only the hot ones are (see ``met``).
    """
    found, rows = small.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if found <= most:
        return big.join(F.broadcast(small.drop("n")), on, "left")
    hot = small.filter(F.col("n") > max(1000, -(-rows // 4096)))
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.join(F.broadcast(hot.select(*on)), on, "left_anti").hint("merge"), on, "left")
    return big.join(F.broadcast(hot), on).unionByName(rest).drop("n")


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for ``F.col`` and ``select``."""
    return "`" + name.replace("`", "``") + "`"


def remainder(column, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def full_text(column):
    """The text, with null read as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def byte_slices(batches, column: str, most: int = 16 << 20):
    """Record batches cut so that each holds about ``most`` bytes of ``column`` and no row is divided."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column).cast(pa.string())).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - 1) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text. Nulls have none."""
    # The copy matters: some Arrow kernels misread a large string array that is a slice.
    texts = texts.cast(pa.large_string()).fill_null("").take(pa.array(np.arange(len(texts))))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten()
    keep = pc.not_equal(flat, "")
    owner = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    mask = keep.to_numpy(zero_copy_only=False)
    counts = np.bincount(owner[mask], minlength=len(texts)) if len(owner) else np.zeros(len(texts), dtype=np.int64)
    return flat.filter(keep), counts.astype(np.int64)


def encode_words(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and for each word its place among them."""
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def starts(counts: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums with the total at the end."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged_take(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of the concatenated ranges begin[i] .. begin[i]+length[i]."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(length) - length
    return np.repeat(begin - first, length) + np.arange(total, dtype=np.int64)


def segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` (1-D or 2-D) of the given lengths; empty runs give zero."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=np.float64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts(counts)[:-1][some], axis=0, dtype=np.float64)
    return out


def ngram_hashes(words: pa.Array, sizes: tuple[int, ...], buckets: int, at_once: int = 32_768) -> tuple[np.ndarray, np.ndarray]:
    """``_ngrams`` of many words, some at a time, so that its working arrays stay small."""
    parts = [_ngrams(words.slice(i, at_once), sizes, buckets) for i in range(0, len(words), at_once)]
    if not parts:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])


def _ngrams(words: pa.Array, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of each word inside boundary marks, and the whole word.

    Returns the buckets of all words one after another, and how many each word has
    (at least one: the word itself).
    """
    words = words.cast(pa.large_binary())
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(size)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    offset = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + n + 1]
    size2 = size + 2
    first = starts(size2)
    buffer = np.zeros(first[-1], dtype=np.uint64)
    buffer[first[:-1]] = ord("<")
    buffer[first[1:] - 1] = ord(">")
    buffer[ragged_take(first[:-1] + 1, size)] = data[ragged_take(offset[:-1], size)]
    owner = np.repeat(np.arange(n), size2)
    left = first[1:][owner] - np.arange(first[-1])  # bytes from here to the end of the word
    keys, owners = [], []
    mix = np.uint64(0x9E3779B97F4A7C15)
    rolling = np.zeros(first[-1], dtype=np.uint64)
    for k in range(1, max(sizes, default=0) + 1):
        shifted = np.zeros_like(buffer)
        shifted[: first[-1] - k + 1] = buffer[k - 1 :]
        rolling = (rolling ^ shifted) * mix
        rolling ^= rolling >> np.uint64(29)
        if k in sizes:
            ok = left >= k
            keys.append((rolling[ok] + np.uint64(k)) % np.uint64(buckets))
            owners.append(owner[ok])
    weight = np.arange(first[-1], dtype=np.uint64) - np.repeat(first[:-1], size2).astype(np.uint64)
    spread = (buffer + np.uint64(1)) * (weight * np.uint64(2) + np.uint64(1)) * mix
    spread ^= spread >> np.uint64(31)
    whole = np.add.reduceat(spread * mix, first[:-1])
    whole ^= whole >> np.uint64(32)
    keys.append(whole % np.uint64(buckets))
    owners.append(np.arange(n))
    key, own = np.concatenate(keys).astype(np.int64), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return key[order].astype(np.int32), np.bincount(own, minlength=n)
