"""Byte-pair encoding and decoding of whole texts (operator 10).

A text is cut at ASCII white space, which the tokenizer drops anyway.  A piece is
cut further as the tokenizer's pattern says, and each cut is merged with a
contiguous rank array: the boundaries of its parts and the rank of each pair of
neighbours lie in two short lists; the smallest rank is found by scanning, its
boundary deleted and the two ranks beside it looked up anew.  Words beyond
``SHORT`` symbols take the same merges from a heap over a linked list, so that a
text without a blank stays n log n.

A worker keeps the result of the pieces it has seen, in a bounded table.

Results for odd input: a null text is an empty one: no ids, and the decoded text is
empty; equal texts give equal rows; an empty table gives no row; other columns are
left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import worker_cache

#: Pieces kept by a worker, the longest piece kept (bytes), and the longest word merged by scanning.
MAX_PIECES, MAX_PIECE, SHORT = 800_000, 64, 64

NONE = 1 << 60


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next letter from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Bpe:
    """The model in a ``tokenizer.json`` of word BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.names = {i: t for t, i in (vocab | self.special).items()}
        suffix = model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + suffix) for c in letters]
        #: (left id, right id) -> rank and id of the merged token
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        split = whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.path = path
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.cut_ascii = re.compile(split.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.at_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.seen: dict[bytes, tuple[int, str, str]] = {}

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        return self.scan(ids) if len(ids) <= SHORT else self.heap(ids)

    def scan(self, ids: list[int]) -> list[int]:
        pairs, miss = self.pairs, (NONE, 0)
        ranks = [pairs.get(p, miss) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is miss or best[0] == NONE:
                break
            i = ranks.index(best)
            ids[i] = best[1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get((ids[i - 1], ids[i]), miss)
            if i < len(ranks):
                ranks[i] = pairs.get((ids[i], ids[i + 1]), miss)
        return ids

    def heap(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        gone = bytearray(n)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = merged, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := pairs.get((ids[k], ids[after[k]]))):
                    heapq.heappush(queue, (m[0], k, ids[k], ids[after[k]], m[1]))
        return [x for x, g in zip(ids, gone, strict=True) if not g]

    def piece(self, raw: bytes) -> list[int]:
        """Ids of a piece without ASCII white space; special tokens in it are single ids."""
        text, out, at = raw.decode("utf-8"), [], 0
        for m in self.at_special.finditer(text) if self.at_special and "<|" in text else ():
            out += self.plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[int]:
        if text.isascii():
            words = [w.encode() for w in self.cut_ascii.findall(text.lower())]
        else:  # beyond ASCII, normal forms, letter case and classes are those of the library's own Unicode tables
            cut = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
            words = [bytes([self.byte_of[c] for c in w]) for w, _ in cut]
        return [i for w in words for i in self.word(w)]

    @cached_property
    def rules(self):
        """The library's normaliser and cutter of the same file; the merges are this module's."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, raw: bytes) -> tuple[int, str, str]:
        """Number of ids, the decimal ids and the token names of a piece, each joined by a blank; kept for later."""
        found = self.seen.get(raw)
        if found is None:
            if raw[-1] in b".," and raw[:-1].isalpha():  # ASCII letters and a sign that is always a token of its own
                (n, ids, names), (_, mark, name) = self(raw[:-1]), self(raw[-1:])
                return n + 1, f"{ids} {mark}", f"{names} {name}"
            ids = self.piece(raw)
            found = len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])
            if len(raw) <= MAX_PIECE:
                if len(self.seen) >= MAX_PIECES:
                    self.seen.clear()
                self.seen[raw] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        return [i for x in pieces((text or "").encode()) for i in self.piece(x)]

    def decode(self, ids: list[int]) -> str:
        """The names of the tokens joined by a blank; the model states no decoder. Unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])


def load(path: str) -> Bpe:
    return worker_cache(("bpe", path), lambda: Bpe(path))


def pieces(text: bytes | None) -> list[bytes]:
    """A text cut at ASCII white space, its ASCII letters in lower case unless it may name a special token."""
    if not text:
        return []
    low = text.lower()
    return (text if b"<|" in low else low).split()


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, SHA-256 of its decimal ids joined by a blank and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for b in batches:
            n, ids, decoded = [], [], []
            for x in b["text"].to_pylist():
                parts = [p for p in map(model, pieces(x)) if p[0]]
                n.append(sum([p[0] for p in parts]))
                ids.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([model.encode(x) for x in b["text"].to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([model.decode(x or []) for x in b["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
