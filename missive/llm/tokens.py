"""Whole texts as ids of a public byte-level BPE tokenizer, with remembered pieces.

The tokenizer's own rule never joins characters over the borders of ``_CHUNK``, so a text's ids are those of its chunks
in order. Chunks repeat, and are encoded once per worker as long as the bounded memory holds.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import cached_property
from pathlib import Path

import numpy as np

from .common import remembered

#: A word with the space before it, or white space.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space for Python's re but not for the tokenizer: such texts, and those with a special token, are encoded in one piece.
_ODD = re.compile("[\x1c-\x1f]")


class _Pieces(dict):
    """Piece -> its ids as bytes; two generations, so that memory is bounded and common pieces stay."""

    MOST = 100_000
    #: Longer pieces are encoded but not remembered.
    LONGEST = 64

    def __init__(self, encode, before: str):
        self._encode, self._before, self._old = encode, before, {}

    def __missing__(self, piece: str) -> bytes:
        found = self._old.get(piece)
        if found is None:
            found = array("I", self._encode(self._before + piece)).tobytes()
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self._old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Ids:
    """The ids of a text, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self._path = path
        self._whole = [x["content"] for x in json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens") or ()]
        self._lengths: np.ndarray | None = None
        encode = self._ranked(Path(path).with_suffix(".tiktoken")) or (lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids)
        self._spaced, self._bare = _Pieces(encode, " "), _Pieces(encode, "")

    @cached_property
    def tokenizer(self):
        """Of the library itself, only where it is needed: it takes tens of MB of each worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    @staticmethod
    def _ranked(ranks: Path):
        """The same vocabulary by the quicker of the two libraries, where its file lies beside the other."""
        if not ranks.exists():
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        found = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.read_bytes().splitlines())}
        return tiktoken.Encoding(ranks.stem, pat_str=PATTERN, mergeable_ranks=found, special_tokens={}).encode_ordinary

    def of(self, text: str) -> bytes:
        if _ODD.search(text) or any(x in text for x in self._whole):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.split()
        gaps = len(words) - 1
        if gaps < 0 or sum(map(len, words)) + gaps != len(text) or text.count(" ") + text.count("\n") != gaps:
            return b"".join(map(self._bare.__getitem__, _CHUNK.findall(text)))
        spaced, bare = self._spaced.__getitem__, self._bare.__getitem__  # here single spaces and newlines part the words
        lines = []
        for line in text.split("\n"):
            first, _, rest = line.partition(" ")
            lines.append(bare(first) + b"".join(map(spaced, rest.split(" "))) if rest else bare(first))
        return bare("\n").join(lines)

    @property
    def byte_lengths(self) -> np.ndarray:
        """The number of text bytes of each id (byte-level tokens have one character a byte)."""
        if self._lengths is None:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self._lengths = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self._lengths[i] = len(token)
        return self._lengths


def loaded(path: str) -> Ids:
    return remembered(f"ids of {path}", lambda: Ids(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
