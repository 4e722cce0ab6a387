import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rasterloom.llm.packing import difference, pack, windows
from rasterloom.llm.bpe import byte_encoder, word_encoder
from rasterloom.llm.tokens import count_tokens, spliced_count

from .helpers import LONG, awkward, empty

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_tok():
    return Tokenizer.from_file(BYTE)


def noise(seed, n):
    r = random.Random(seed)
    pool = ["word", " ", " ", "  ", "\n", "\n ", "'s", "é", "中文", "12", "!?", " ", "\t", "<|endoftext|>", " ", "ing", "\x1c", "\x85"]
    return "".join(r.choice(pool) for _ in range(n))


def test_counts_equal_the_library(spark, byte_tok):
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(awkward(spark), BYTE, huge_chars=2000, chunk_bytes=500, overlap_bytes=16).collect()]
    want = []
    for r in awkward(spark).collect():
        t = r.text or ""
        n = len(byte_tok.encode(t, add_special_tokens=False).ids)
        want.append((r.doc_id, len(t.encode()), n, n > 1024))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert count_tokens(empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_counts_and_splices_equal_whole_encoding(byte_tok, seed):
    text = noise(seed, 700)
    n = len(byte_tok.encode(text, add_special_tokens=False).ids)
    fast = byte_encoder(BYTE)
    assert fast.fast and fast.count(text) == n == len(fast.lengths(text))
    assert fast.lengths(text).sum() == len(text.encode())
    for chunk, overlap in ((64, 4), (150, 20), (40, 39)):
        assert spliced_count(fast, text, chunk, overlap) == n


def test_rare_characters_go_through_the_library(byte_tok):
    text = "".join(chr(c) + " x" for c in (*range(0x250, 0x3000, 7), *range(0x1F300, 0x1F400, 3))) * 2
    n = len(byte_tok.encode(text, add_special_tokens=False).ids)
    assert byte_encoder(BYTE).count(text) == n
    assert spliced_count(byte_encoder(BYTE), text, 1000, 50) == n


def test_splice_without_any_boundary(byte_tok):
    text = "ab" * 5000
    assert spliced_count(byte_encoder(BYTE), text, 300, 10) == len(byte_tok.encode(text).ids)


def test_words_equal_the_library():
    tok, fast = Tokenizer.from_file(WORD), word_encoder(WORD)
    words = [w for seed in range(30) for w in noise(seed, 400).split()]
    words += [chr(c) + "a" + chr(c) for c in range(33, 0x500)] + ["don't", "we'll.'s", "a\x00b", "__x__", "ÀÇÉ", "İI", "ß", "123abc!!??"]
    words = [w for w in words if w.split() == [w] and w]
    ids, size = fast.encode(pa.array([w.lower() if w.isascii() else w for w in words]))
    assert fast.fast
    at = 0
    for w, n in zip(words, size):
        assert list(ids[at : at + n]) == tok.encode(w, add_special_tokens=False).ids, w
        at += n


def test_packing_is_a_partition_of_the_ids(spark):
    tok = Tokenizer.from_file(WORD)
    docs = awkward(spark)
    rows = pack(docs, WORD, capacity=256, block_tokens=4096).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    copies = {}
    for r in docs.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for k, text in texts.items():
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        cover = np.zeros(len(ids), dtype=int)
        for r in by_doc[k]:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids) and len(part) == r.length
            cover[r.start : r.start + r.length] += 1
        assert (cover == copies[k]).all()
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == seq[0].sequence_tokens <= 256
    assert pack(empty(spark), WORD).count() == 0


def test_kept_ids_are_those_of_the_piece(spark):
    for r in pack(awkward(spark), WORD, capacity=128, block_tokens=2048, keep_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32


def test_differencing_is_near_equal():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 900, 600)
    group = difference(sizes, 40)
    sums = np.bincount(group, weights=sizes, minlength=40)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 8


def test_window_count_rises_when_capacity_is_exceeded():
    group = windows(np.array([60, 60, 60]), 100)  # two windows would hold 180, but not these items
    assert len(set(group)) == 3


def test_long_text_is_long():
    assert len(LONG) > 200_000
