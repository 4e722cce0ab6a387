"""Fast exact forms of two kinds of BPE tokenizer, read from their own .json files.

Merging by rank gives the ids of the ``tokenizers`` library where every merge result
has one rank; texts or words with characters outside the ranges below, for which
Unicode tables may differ between libraries, go through the library itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import starts

# The public pre-tokenisation pattern of byte-level BPE, and the characters taken on the fast way.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RARE = re.compile("[^\\u0000-\\u024f\\u0391-\\u03c9\\u0410-\\u044f\\u2010-\\u2027\\u20ac\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3]")
# The pattern engine holds a stack frame a character for runs of white space; longer runs go through the library.
LONG_SPACE = re.compile(r"\s{10000}")
_LATIN = "a-zß-öø-ÿĀ-įı-ſ"
PLAIN_WORD = "^[!-~À-įı-ſ]+$"
WORD_PIECES = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\\s0-9{_LATIN}]+)"

_LOADED: dict[tuple[str, str], object] = {}


def library(path: str):
    """The tokenizer at ``path``, loaded once in each Python worker."""
    if ("library", path) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED["library", path] = tok
    return _LOADED["library", path]


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _encoding(pattern: str, ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class ByteEncoder:
    """Tokens of a text under a byte-level BPE without normalisation, as byte lengths."""

    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        self.fast = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex")
            and not pre.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(x[k] for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and len({a + b for a, b in merges}) == len(merges)
            and len(vocab) == len(merges) + 256
        )
        if self.fast:
            byte = _byte_of()
            order = {a + b: 256 + i for i, (a, b) in enumerate(merges)}
            ranks = {bytes(byte[c] for c in t): order.get(t, byte[t] if len(t) == 1 else -1) for t in vocab}
            self.size = np.zeros(256 + len(merges), dtype=np.int64)
            for t, r in ranks.items():
                self.size[r] = len(t)
            self.encoding = _encoding(PIECES, ranks)
            self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def count(self, text: str) -> int:
        if not self.fast or RARE.search(text) or LONG_SPACE.search(text):
            return len(library(self.path).encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(len(self.encoding.encode_ordinary(p)) for p in parts if p)

    def lengths(self, text: str) -> np.ndarray:
        """The number of bytes of each token."""
        if not self.fast or RARE.search(text) or LONG_SPACE.search(text):
            spans = library(self.path).encode(text, add_special_tokens=False).offsets
            width = starts(np.array([len(c.encode()) for c in text], dtype=np.int64))
            ends = np.maximum.accumulate(width[np.array([e for _, e in spans], dtype=np.int64)]) if spans else np.zeros(0, dtype=np.int64)
            return np.diff(ends, prepend=0)
        out, at = [], 0
        for found in [*(self.special.finditer(text) if self.special else ()), None]:
            part = text[at : found.start() if found else len(text)]
            if part:
                out.append(self.size[self.encoding.encode_ordinary(part)])
            if found:
                out.append(np.array([len(found[0].encode())]))
                at = found.end()
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


class WordEncoder:
    """Ids of single words under a BPE with word ends that lower-cases and drops white space."""

    END = "</w>"

    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        model, byte = spec["model"], _byte_of()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab, self.added = model["vocab"], [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = model.get("end_of_word_suffix") == self.END and len({a + b for a, b in merges}) == len(merges) and not model.get("unk_token")

        def raw(token: str) -> bytes:  # a zero byte stands for the word's end
            body, end = (token[: -len(self.END)], b"\0") if token.endswith(self.END) else (token, b"")
            return bytes(byte[c] for c in body) + end

        if self.fast:
            ranks, self.id_of, self.size = {}, np.zeros(512 + len(merges), dtype=np.int64), np.zeros(512 + len(merges), dtype=np.int64)
            tokens = [*sorted(byte, key=byte.get), *(c + self.END for c in sorted(byte, key=byte.get)), *(a + b for a, b in merges)]
            for rank, token in enumerate(tokens):
                data = raw(token)
                ranks.setdefault(data, rank)
                self.id_of[rank], self.size[rank] = vocab[token], len(data)
            self.encoding = _encoding(r"[^\x00]+\x00", ranks)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        n = len(words)
        size, ids = np.zeros(n, dtype=np.int64), None
        plain = np.zeros(n, dtype=bool)
        if self.fast and n:
            plain = pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False)
            for token in self.added:
                plain &= ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
            marked = pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(plain))).cast(pa.large_string()), WORD_PIECES, "\\1\0")
            got = np.array(self.encoding.encode_ordinary("".join(marked.to_pylist())), dtype=np.int64)
            ends = np.cumsum(self.size[got])
            edge = np.searchsorted(ends, np.cumsum(pc.binary_length(marked).to_numpy(zero_copy_only=False)), side="right")
            size[plain], ids = np.diff(edge, prepend=0), self.id_of[got]
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return (np.zeros(0, dtype=np.uint32) if ids is None else ids.astype(np.uint32)), size
        by_library = [e.ids for e in library(self.path).encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
        size[rest] = [len(x) for x in by_library]
        out = np.zeros(int(size.sum()), dtype=np.uint32)
        mine = np.repeat(plain, size)
        if ids is not None:
            out[mine] = ids
        out[~mine] = [i for x in by_library for i in x]
        return out, size


def byte_encoder(path: str) -> ByteEncoder:
    if ("byte", path) not in _LOADED:
        _LOADED["byte", path] = ByteEncoder(path)
    return _LOADED["byte", path]


def word_encoder(path: str) -> WordEncoder:
    if ("word", path) not in _LOADED:
        _LOADED["word", path] = WordEncoder(path)
    return _LOADED["word", path]
