import numpy as np
import pyarrow as pa

from rasterloom.llm.common import byte_slices, ngram_hashes, split_words


def test_words_of_slices_are_those_of_the_texts():
    texts = [f"Wörd{i} ÀB\tx{i % 7} " * (i % 5) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    got, at = [], 0
    for part in byte_slices([batch], "t", 20_000):
        flat, n = split_words(part.column(0), lower=True)
        flat.validate(full=True)
        assert list(n) == [len(t.split()) for t in texts[at : at + part.num_rows]]
        got += flat.to_pylist()
        at += part.num_rows
    lower = "".join(map(chr, range(128))).lower()
    assert got == [w for t in texts for w in t.translate(str.maketrans("".join(map(chr, range(128))), lower)).split()]


def test_ngrams_do_not_depend_on_neighbours():
    words = ["abc", "x", "é", "abcd" * 9]
    keys, n = ngram_hashes(pa.array(words), (3, 4), 1 << 20)
    at = np.cumsum(n) - n
    for i, w in enumerate(words):
        one, _ = ngram_hashes(pa.array([w]), (3, 4), 1 << 20)
        assert sorted(one) == sorted(keys[at[i] : at[i] + n[i]])
