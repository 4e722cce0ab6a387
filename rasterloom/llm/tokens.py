"""Token counts of whole texts, with huge documents encoded in overlapping chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_encoder
from .common import byte_slices, full_text


def spliced_count(encoder, text: str, chunk: int = 16_384, overlap: int = 256) -> int:
    """Tokens of ``text`` from overlapping chunks, spliced where both encodings agree.

    A splice point is a space or line end after a character other than white space,
    inside the overlap and off its edges, at which both encodings start a token,
    with the same token before and after it. The pre-tokenizer reads from left to
    right and carries nothing across such a place, so what lies on either side is
    final. Without such a point the overlap and the chunk double until one is found
    or the overlap holds all that is not yet counted. Sizes are in bytes.
    """
    data = text.encode()

    def fit(at: int) -> int:  # to the start of a character
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def begins(a: int, b: int) -> np.ndarray:
        """The first byte of each token of data[a:b], and b."""
        return np.concatenate([[0], np.cumsum(encoder.lengths(data[a:b].decode()))]) + a

    n, counted, total = len(data), 0, 0
    end = fit(min(n, chunk))
    left = begins(0, end)
    while end < n:
        wide, size = overlap, max(chunk, overlap * 4)
        while True:
            a = max(counted, fit(end - wide))
            b = fit(min(n, max(a + size, end + 4)))
            right = begins(a, b)
            cut = _meeting(data, left, right, a, end, counted)
            if cut is not None or a == counted:
                break
            wide, size = wide * 2, size * 2
        if cut is not None:
            total += int(np.searchsorted(left, cut) - np.searchsorted(left, counted))
            counted = cut
        left, end = right, b
    return total + len(left) - 1 - int(np.searchsorted(left, counted))


def _meeting(data: bytes, left: np.ndarray, right: np.ndarray, a: int, b: int, counted: int) -> int | None:
    """The last place in (a, b) where both encodings provably meet."""
    mine = left[left > a]
    both = np.intersect1d(mine, right[1:-1], assume_unique=False)
    both = both[(both > counted) & (both < b)]
    for p in both[::-1].tolist():
        if data[p] not in b" \n" or data[max(0, p - 4) : p].decode(errors="ignore")[-1:].isspace():
            continue
        i, j = np.searchsorted(left, p), np.searchsorted(right, p)
        if i + 1 < len(left) - 1 and j > 1 and left[i - 1] == right[j - 1] and left[i + 1] == right[j + 1]:
            return p
    return None


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    huge_chars: int = 32_768,
    chunk_bytes: int = 16_384,
    overlap_bytes: int = 256,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Texts of at most ``huge_chars`` characters are encoded whole; longer ones in
    chunks of ``chunk_bytes`` that overlap by ``overlap_bytes`` and are spliced at
    common boundaries. Null and empty texts have 0 bytes and 0 tokens; repeated rows
    and null ids give a row each; an empty table gives no rows; further columns of
    the input, whatever their names, are not read. No shuffle takes place.
    """

    def run(batches):
        encoder = byte_encoder(tokenizer_path)
        for batch in byte_slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            n = [encoder.count(t) if len(t) <= huge_chars else spliced_count(encoder, t, chunk_bytes, overlap_bytes) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), full_text(F.col(text_col)).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
