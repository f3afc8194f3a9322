"""Byte-level BPE token ids from a tokenizer file that a path names.

The file is the ``tokenizers`` JSON, and the ids are those of its ``encode`` with
``add_special_tokens=False``. Most texts go through the several times faster
``tiktoken`` engine, which gets the vocabulary as ranks; merges of a byte-level BPE
are applied in order of rank, so the ids are the same (tests hold them against each
other). Texts in which the engines would differ, that is those which hold one of
the file's added tokens or so long a run of white space that the engine's
backtracking gives up, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: GPT-2's split pattern (fixed value): what the byte-level pre-tokenizer uses.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Runs of white space from this length on are left to ``tokenizers``.
LONG_BLANK = 1 << 15

_engines: dict[str, Engine] = {}


def _byte_names() -> dict[str, int]:
    """Printable characters that stand for the 256 bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    names |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return names


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Engine:
    """The encoder of one file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        added = sorted(t["content"] for t in spec.get("added_tokens", []))
        ranks = {bytes(names[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.n_vocab = max(spec["model"]["vocab"].values(), default=0) + 1
        self.n_vocab = max([self.n_vocab, *(t["id"] + 1 for t in spec.get("added_tokens", []))])
        self._fast = tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._exact = Tokenizer.from_file(path)
        self._added = added
        self._blank = re.compile(rf"\s{{{LONG_BLANK}}}")

    def ids(self, text: str | None) -> np.ndarray:
        """The text's ids as 32-bit numbers; a null text has none."""
        if not text:
            return np.zeros(0, np.uint32)
        if any(t in text for t in self._added) or (len(text) >= LONG_BLANK and self._blank.search(text)):
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast.encode_ordinary(text), np.uint32)


def engine(path: str) -> Engine:
    """The encoder for a file, made once per process."""
    if path not in _engines:
        _engines[path] = Engine(path)
    return _engines[path]


def token_ids(texts, path: str):
    """Yield each text's ids as an array of 32-bit numbers; a null text has none."""
    enc = engine(path)
    for t in texts:
        yield enc.ids(t)


def pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but the first, which takes what is left over."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    cuts = ([0] if head else []) + list(range(head, length, capacity))
    return [(a, min(b, length) - a) for a, b in zip(cuts, cuts[1:] + [length])]
