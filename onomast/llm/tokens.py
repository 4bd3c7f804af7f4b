"""Byte-level BPE ids of whole texts, in batches.

The vocabulary file (a ``tokenizers`` JSON of kind byte-level BPE) is a parameter. Its
merges are ranks by id, so tiktoken's encoder gives the same ids several times faster;
tests hold them against the ``tokenizers`` library. Strings of special tokens inside a
text are ordinary text. Null counts as empty.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: The pre-tokenisation pattern of byte-level BPE, as published with GPT-2.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same without the look-ahead, which only matters within two or more white spaces.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_RUN = re.compile(r"\s\s")


def _printable() -> dict[str, int]:
    """Byte-level BPE writes a byte as itself if printable, else as the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def _encoders(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte = _printable()
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return [tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) for name, pattern in (("exact", PATTERN), ("plain", PLAIN))]


@functools.lru_cache(maxsize=2)
def byte_lengths(path: str) -> np.ndarray:
    """How many bytes each id stands for."""
    exact, _ = _encoders(path)
    out = np.zeros(exact.n_vocab, np.int64)
    for word, i in exact._mergeable_ranks.items():
        out[i] = len(word)
    return out


def encode(path: str, texts: list[str | None]) -> list[list[int]]:
    exact, plain = _encoders(path)
    run, quick, full = _RUN.search, plain._core_bpe.encode_ordinary, exact.encode_ordinary
    return [[] if not x else full(x) if run(x) else quick(x) for x in texts]


def counts(path: str, texts: list[str | None]) -> np.ndarray:
    exact, plain = _encoders(path)
    run, quick, full = _RUN.search, plain._core_bpe.encode_ordinary, exact.encode_ordinary
    return np.fromiter((0 if not x else len(full(x) if run(x) else quick(x)) for x in texts), np.int64, len(texts))
