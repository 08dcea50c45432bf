"""Python kernels on single texts, used inside Arrow batches: words, lines, shingles and token ids."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle

SHINGLE = 5
_WORD = re.compile(r"[^ \t-\r]+")
# White space to str.split() that does not separate words here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def split_words(text: str | None) -> list[str]:
    """Words separated by the ASCII white space 0x20 and 0x09 to 0x0D; none for null."""
    if not text:
        return []
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def has_word(line: str) -> bool:
    return bool(line.strip(" \t\n\r\x0b\x0c"))


def trim() -> None:
    """Gives free memory of this process back to the system, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (give := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        give(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory that the ones before (and the task before) no longer need goes back to the system, since workers live on."""
    trim()
    pool = pa.default_memory_pool()
    for b in batches:
        yield b
        del b
        pool.release_unused()
    trim()


class WordHashes(dict):
    """64-bit hashes of words, kept up to a fixed number of words and then begun anew."""

    MOST = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(hashed: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text with words is one shingle."""
    if not len(hashed):
        return hashed
    n = min(n, len(hashed))
    h = np.full(len(hashed) - n + 1, n, np.uint64)
    for k in range(n):
        h = stir(h * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(hashed) - n + 1 + k])
    return sorted_distinct(h)


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ragged(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of runs of ``counts`` elements that begin at ``starts``, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, hashes): of each word its text and its place among the distinct words, and those words' hashes.

    The hash of a word is computed from its bytes and their places, for all distinct words at once.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.filter(pa.array(full)).dictionary_encode()
    known = coded.dictionary
    cuts = np.frombuffer(known.buffers()[1], np.int32)[known.offset : known.offset + len(known) + 1].astype(np.int64) if len(known) else np.zeros(1, np.int64)
    raw = np.frombuffer(known.buffers()[2], np.uint8)[cuts[0] : cuts[-1]] if len(known) else np.zeros(0, np.uint8)
    # Eight bytes at a time; bytes beyond a word's end count as none.
    size = np.diff(cuts)
    blocks = (size + 7) >> 3
    at = ragged(blocks, np.zeros(len(blocks), np.int64))
    left = np.repeat(size, blocks) - 8 * at
    eight = np.ndarray(len(raw), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))[np.repeat(cuts[:-1] - cuts[0], blocks) + 8 * at]
    eight = eight & (~np.uint64(0) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64))
    mixed = stir(stir((eight + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    hashes = stir(stir(np.add.reduceat(mixed, np.cumsum(blocks) - blocks) + size.astype(np.uint64))) if len(known) else np.zeros(0, np.uint64)
    return owner[full], coded.indices.to_numpy(zero_copy_only=False), hashes


# Texts of these characters give the same ids by both libraries.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
_PAIRS: dict[str, list] = {}


def tokenizer(path: str | None = None):
    """A function from texts to lists of ids, for the byte-level BPE vocabulary at ``path`` (a tokenizers file).

    Where the same vocabulary lies beside it as ranks, texts in the Latin range are encoded from those,
    which gives the same ids several times faster; all others, and those that hold the name of a special
    token, go through the tokenizers library. Loaded once per Python process.
    """
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _PAIRS:
        with open(path, encoding="utf-8") as file:
            written = file.read()
        at = re.search(r'"added_tokens"\s*:\s*', written)
        special = [t["content"] for t in json.JSONDecoder().raw_decode(written, at.end())[0]] if at else []
        fast, ranks = None, path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as lines:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
        _PAIRS[path] = [None, fast, special]
    _, fast, special = _PAIRS[path]

    def encode(texts: list[str | None]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            t = t or ""
            if fast is not None and _PLAIN.fullmatch(t) and not any(s in t for s in special):
                out[i] = fast.encode_ordinary(t)
            else:
                slow.append(i)
        if slow and _PAIRS[path][0] is None:  # most processes never need it
            _PAIRS[path][0] = Tokenizer.from_file(path)
        whole = _PAIRS[path][0]
        for at in range(0, len(slow), 64):
            part = slow[at : at + 64]
            for i, e in zip(part, whole.encode_batch([texts[i] or "" for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    return encode


cloudpickle.register_pickle_by_value(sys.modules[__name__])
