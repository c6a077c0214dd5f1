"""Encoding of whole texts with the ``tokenizers`` library, one library call for each new word.

A tokenizer that lower-cases and drops white space before it cuts a text gives a text the ids of its blank-separated
pieces put together (``PROBES`` tell; any other gets whole texts).  A worker keeps the ids of
the pieces it has seen (a bounded table) and asks the library for new ones only.
"""

from __future__ import annotations

import os
from array import array

from .common import worker_cache

#: Pieces kept by a worker before its table is emptied, and the longest piece kept.
MAX_WORDS, MAX_WORD_BYTES = 900_000, 64

#: Names of the tokenizer used where a query's contract fixes it.
WORD_BPE = "word_bpe_49k.json"


#: Texts that tell whether a tokenizer lower-cases ASCII and cuts at white space: their ids are those of their lower-cased pieces, and a mark after a word is its own.
PROBES = ["Hello World, the END.", " a  b\tc\nd", "x.y Éa ß, OK", "The the\vTHE\fthe.", "don't re-do 3,000 words."]


class _Pieces(dict):
    """Piece (UTF-8, ASCII letters lower-cased) -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str, most: int):
        super().__init__()
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_piece = all(self.ids(x.encode()) == b"".join(map(self.__getitem__, x.encode().lower().split())) for x in PROBES)
        self.clear()

    def ids(self, piece: bytes) -> bytes:
        return array("I", self.library.encode(piece.decode("utf-8"), add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        # A full stop or comma after ASCII letters is always a token of its own.
        if len(piece) > 1 and piece[-1] in b".," and piece[:-1].isalpha() and piece.isascii():
            out = self[piece[:-1]] + self[piece[-1:]]
        else:
            out = self.ids(piece)
        if len(piece) <= MAX_WORD_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out


def encoder(path: str, keep: int = MAX_WORDS):
    """A function from a text's UTF-8 bytes (None: empty) to its ids as uint32 bytes; a worker keeps ``keep`` pieces at most."""
    pieces = worker_cache(("tokens", path, keep), lambda: _Pieces(path, keep))

    def encode(text: bytes | None) -> bytes:
        if not text:
            return b""
        if not pieces.by_piece:  # another kind of tokenizer: the library gets the whole text
            return pieces.ids(text)
        low = text.lower()
        if b"<|" in low:  # may hold the name of a special token, whose letters' case matters
            return b"".join([pieces.ids(x) for x in text.split()])
        return b"".join(map(pieces.__getitem__, low.split()))

    return encode
