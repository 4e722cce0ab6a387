"""Packing of tokenised documents into near-equal windows by multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import word_encoder
from .common import byte_slices, durable, encode_words, full_text, ragged_take, split_words, starts


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp differencing into ``k`` groups; returns the group of each item.

    A partial partition is k sums in descending order with the items behind each.
    The two partial partitions with the widest spread are merged, the largest sums
    of one with the smallest of the other, until one is left.
    """
    if k <= 1:
        return np.zeros(len(sizes), dtype=np.int64)
    # While a partial partition holds one item its other sums are zero; it is kept as (size, item).
    heap = [(-int(s), i, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    parts: dict[int, tuple[np.ndarray, list]] = {}
    fresh = len(sizes)

    def opened(key):
        if key in parts:
            return parts.pop(key)
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = sizes[key]
        return sums, [key] + [None] * (k - 1)

    while len(heap) > 1:
        a, b = opened(heapq.heappop(heap)[1]), opened(heapq.heappop(heap)[1])
        sums = a[0] + b[0][::-1]
        items = [y if x is None else x if y is None else (x, y) for x, y in zip(a[1], reversed(b[1]))]
        order = np.argsort(-sums, kind="stable")
        parts[fresh] = sums[order], [items[i] for i in order]
        heapq.heappush(heap, (int(sums.min() - sums.max()), fresh, None))
        fresh += 1
    group = np.zeros(len(sizes), dtype=np.int64)
    for g, tree in enumerate(opened(heap[0][1])[1]):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x is not None:
                group[x] = g
    return group


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Groups of items whose sums stay within ``capacity``; the group count rises until they do."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        group = difference(sizes, k)
        worst = np.bincount(group, weights=sizes, minlength=k).max()
        if worst <= capacity:
            return group
        k += max(1, k // 200)


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after another, and the number of each.

    For a tokenizer that drops white space and never joins words across it: each
    distinct word of the batch is encoded once. A-Z are lower-cased first, as the
    tokenizer itself would.
    """
    flat, per_text = split_words(texts, lower=True)
    words, code = encode_words(flat)
    pool, size = word_encoder(path).encode(words)
    length = size[code]
    ids = pool[ragged_take(starts(size)[:-1][code], length)]
    total = starts(length)
    edge = total[starts(per_text)]
    return ids, edge[1:] - edge[:-1]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces documents are cut into: whole windows first, then the rest; ``keep_ids`` adds the ids.

    ``copy`` tells repeated rows of one id apart.
    """

    def run(batches):
        for batch in byte_slices(batches, "text", 16 << 20):
            ids, n = encode_texts(batch.column(1), tokenizer_path)
            n1 = n + 1
            first = starts(n1)
            full = np.full(first[-1], end_id, dtype=np.uint32)
            full[ragged_take(first[:-1], n)] = ids
            cuts = -(-n1 // capacity)
            doc = np.repeat(np.arange(len(n)), cuts)
            start = (np.arange(cuts.sum()) - np.repeat(starts(cuts)[:-1], cuts)) * capacity
            length = np.minimum(capacity, n1[doc] - start)
            at = first[:-1][doc] + start
            raw = full.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(doc)), batch.column(2).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n1[doc]))]
            names = ["id", "copy", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(starts(length), pa.int32()), pa.array(full.astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), full_text(F.col(text_col)).alias("text"), F.monotonically_increasing_id().alias("copy"))
    return rows.mapInArrow(run, f"id {kind}, copy long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    block_tokens: int = 524_288,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Packs every document into windows of at most ``capacity`` tokens.

    A document's ids and ``end_id`` are cut into whole windows and a rest. Whole
    windows stand alone. Rests are dealt by hash to blocks of about ``block_tokens``
    tokens, and each block is divided by Karmarkar-Karp differencing into near-equal
    windows; their number rises while one exceeds the capacity.

    Returns a row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_tokens (tokens in the sequence). Null and empty texts are a piece
    of ``end_id`` alone; repeated rows are packed each; null ids stay null; an empty
    table gives no rows; further columns are not read. Only piece lengths are
    shuffled, a block is bounded, and ties are ordered by id and start.
    """
    cut = durable(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids))
    whole = cut.filter(F.col("length") == capacity)
    rest = cut.filter(F.col("length") < capacity)
    total = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_tokens))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "start", "copy"], ascending=[False, True, True, True], kind="stable")
        size = pdf["length"].to_numpy()
        group = windows(size, capacity)
        order = np.argsort(group, kind="stable")
        pdf, group, size = pdf.iloc[order].reset_index(drop=True), group[order], size[order]
        used = np.bincount(group, weights=size).astype(np.int64)
        before = np.cumsum(size) - size
        pdf["offset"] = before - starts(used)[:-1][group]
        pdf["sequence_tokens"] = used[group]
        pdf["sequence_id"] = (pdf["block"].to_numpy().astype("int64") << 32) | np.unique(group, return_inverse=True)[1]
        return pdf[[*names, "sequence_id", "offset", "sequence_tokens"]]

    names = [c for c in cut.columns if c != "ids"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "ids")
    tail = "sequence_id long, offset long, sequence_tokens long"
    light = rest.select(*names).withColumn("block", F.pmod(F.xxhash64("id", "copy", "start"), F.lit(blocks)))
    packed = light.groupBy("block").applyInPandas(run, f"{kinds}, {tail}")
    # Whole windows are numbered beyond every block; the rows are on disk, so the numbers stay when a task is repeated.
    alone = whole.select(*names, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("sequence_tokens"))
    out = packed.unionByName(alone)
    if keep_ids:
        out = out.join(cut.select("copy", "start", "ids"), ["copy", "start"])
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", *(["ids"] if keep_ids else []))
