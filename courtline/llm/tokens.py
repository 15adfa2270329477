"""Byte-level BPE for use inside tasks: the ids and texts of the tokenizers library for the same
vocabulary file (the tests compare both), several times as fast: the file's vocabulary is its rank
order, so tiktoken merges by it. Strings of added tokens are cut out first.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_symbol() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_of_symbol()
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*ranks.values(), *self.added.values()]))
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        ranks = {token: i for token, i in ranks.items() if token.decode("utf-8", "replace") not in self.added}
        self.narrow = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"
        self.length_of = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self._encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._cut is None or not any(t in text for t in self.added):
            return array("I", self._encode(text)).tobytes()
        return b"".join(array("I", [self.added[x]] if x in self.added else self._encode(x)).tobytes()
                        for x in self._cut.split(text) if x)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.asarray(ids).tolist()]).decode("utf-8", "replace")


_OPEN: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, opened once per worker process."""
    if path not in _OPEN:
        _OPEN[path] = Codec(path)
    return _OPEN[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
