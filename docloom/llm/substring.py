"""Removal of repeated passages with Aho-Corasick automata (operator 4).

A window is ``window`` consecutive words of one document.  A word is removed if a window over
it has the same words as a window that starts earlier: in a document with a smaller id, or
earlier in the same one.

1. Each document gives its phrases: of the ``window // 2`` -word runs in each window the one with the
   least hash, so that equal windows have a phrase in common.  Documents with equal words are one;
   all but the first lose every word and take no further part.
2. Phrases that occur twice or more are confirmed by a count.
3. The documents that hold any are dealt to blocks of about ``BLOCK_BYTES``.  The confirmed phrases
   found in a block are compiled to Aho-Corasick automata of at most ``SHARD_PHRASES`` each, and the whole texts of
   the block are streamed through them: every occurrence is located, by its characters.
4. Windows that cover an occurrence are counted by 128-bit hash; the first of each stays, and words under any other
   are removed.

The automata only ever hold phrases of their own block, so memory and time grow with the
input and not with its square; counts are aggregated before they are shuffled.

A document is named by its id and a hash of its text, so rows that share an id, or have none, are documents of their own.

Results for odd input: a null or blank text has no words; documents of fewer than
``window`` words lose none; a repeated row (same id and text) is kept like the first; documents with null ids
come before all others; those of one id (or of none) are in order of their texts' hashes; an empty table gives no row; other columns are
left out or, in :func:`without_repeats`, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import attach_groups, forget, fresh, possibly_in, save
from .words import mix, run_hashes, spans, word_hashes

#: Text in a block, phrases in one automaton, rows or ranges that are broadcast at most.
BLOCK_BYTES, SHARD_PHRASES, BROADCAST_ROWS = 1 << 20, 20_000, 1_000_000

FIRST_ID = -(1 << 63)


#: What names a document: its id, and a hash of its text to tell documents of one id apart.
NAME = ["doc_id", "tie"]


def _name(doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST_ID)).alias("doc_id"), F.xxhash64(text).alias("tie")]


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(*_name(doc_id, text), F.col(text).cast("binary").alias("text"))


def phrases(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a document's phrases: in each window, the first of the least runs of ``window // 2`` words."""
    length = window // 2
    runs = run_hashes(words, length, 3)
    span = window - length + 1
    if len(runs) < span:
        return runs[:0], np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(runs, span)
    at = np.unique(views.argmin(1) + np.arange(len(views)))
    return runs[at], at


def _described(docs: DataFrame, window: int, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2_000):
                b = whole.slice(first, 2_000)
                n, size, f1, f2, keys, places = [], [], [], [], [], []
                for raw in b["text"].to_pylist():
                    raw = raw or b""
                    words = word_hashes(raw.split())
                    h, at = phrases(words, window)
                    order = np.arange(len(words), dtype=np.uint64)
                    n.append(len(words))
                    size.append(len(raw))
                    f1.append(int(mix(words + mix(order)).sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(mix(words ^ mix(order + np.uint64(1 << 40))).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(h.view(np.int64))
                    places.append(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], b["tie"], pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                    ["doc_id", "tie", "n", "bytes", "f1", "f2", "keys", "at"],
                )

    return _texts(docs, doc_id, text).mapInArrow(run, "doc_id long, tie long, n long, bytes long, f1 long, f2 long, keys array<long>, at array<int>")


def occurrences(texts: list[bytes], patterns: list[bytes]) -> list[np.ndarray]:
    """For each text (words joined by one blank), the word positions at which any of the patterns (equally many words, joined by one blank) begins."""
    found: list[list[int]] = [[] for _ in texts]
    padded = [f" {x.decode()} " for x in texts]
    for shard in range(0, len(patterns), SHARD_PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in patterns[shard : shard + SHARD_PHRASES]:
            automaton.add_word(f" {p.decode()} ")
        automaton.make_automaton()
        for hits, text in zip(found, padded, strict=True):
            hits += [end - length + 1 for end, length in automaton.iter(text)]
        del automaton
    out = []
    for hits, text in zip(found, padded, strict=True):
        if not hits:
            out.append(np.empty(0, np.int64))
            continue
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0x20)
        out.append(np.unique(np.searchsorted(blanks, hits)))
    return out


def _locate(window: int):
    length = window // 2

    def run(docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        docs = docs.reset_index(drop=True)
        split = [x.split() for x in docs.text]
        row = {name: i for i, name in enumerate(zip(docs.doc_id, docs.tie, strict=True))}
        patterns = [b" ".join(split[row[d, t]][a : a + length]) for d, t, a in zip(wanted.doc_id, wanted.tie, wanted["at"], strict=True)]
        out = []
        for doc, tie, words, hits in zip(docs.doc_id, docs.tie, split, occurrences([b" ".join(w) for w in split], patterns), strict=True):
            last = len(words) - window
            covered = np.zeros(last + 2, np.int64)
            np.add.at(covered, np.maximum(hits - (window - length), 0), 1)
            ends = hits + 1
            np.add.at(covered, np.minimum(ends, last + 1), -1)
            at = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
            hashes = word_hashes(words)
            h1, h2 = (run_hashes(hashes, window, seed).view(np.int64)[at] for seed in (0, 1))
            out.append((doc, tie, at.astype(np.int32), h1, h2))
        return pd.DataFrame(out, columns=[*NAME, "at", "h1", "h2"])

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def removals(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For documents that lose words: doc_id (the least long for null), tie, whole (all words go), and the word ranges [starts, ends) that go."""
    if window < 4:
        raise ValueError("a window has at least 4 words")
    described = save(_described(docs, window, doc_id, text), "phrases")
    total = described.count()
    name = F.struct(*NAME)
    long_enough = described.where(F.col("n") >= window)
    classes = long_enough.groupBy("f1", "f2").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").select(F.struct("f1", "f2").alias("sum"), "first", "members")
    classes = save(classes, "word-classes")
    copies = save(attach_groups(long_enough.select(*NAME, F.struct("f1", "f2").alias("sum")), classes, "sum", "members", total).where(name > F.col("first")).select(*NAME).distinct(), "word-copies")
    n_copies = copies.count()

    # A row that repeats another in id and text, too, is the same document and takes part once.
    repeated = save(described.groupBy(*NAME).count().where("count > 1").select(*NAME), "repeated-rows")
    n_repeated = repeated.count()

    def once(rows: DataFrame) -> DataFrame:
        if not n_repeated:
            return rows
        again = rows.join(_small(repeated, n_repeated), NAME, "left_semi").dropDuplicates(NAME)
        return rows.join(_small(repeated, n_repeated), NAME, "left_anti").unionByName(again)

    own = once(long_enough.join(_small(copies, n_copies), NAME, "left_anti"))
    emitted = own.select(*NAME, "bytes", F.explode(F.arrays_zip("keys", "at")).alias("p")).select(*NAME, "bytes", F.col("p.keys").alias("key"), F.col("p.at").alias("at"))
    recurring = save(emitted.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "recurring")
    n_phrases = own.agg(F.sum(F.size("keys"))).first()[0] or 0
    possible = possibly_in(emitted, recurring, "key", recurring.count())
    held = save(attach_groups(possible, recurring, "key", "members", n_phrases).select(*NAME, "bytes", "key", "at"), "held")
    forget(recurring)
    holders = save(held.groupBy(*NAME).agg(F.max("bytes").alias("bytes")), "holders")
    n_holders, held_bytes = holders.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    block = F.pmod(F.xxhash64(*NAME), F.lit(max(1, (held_bytes or 0) // BLOCK_BYTES))).cast("int").alias("block")
    wanted = held.select(block, *NAME, "key", "at").groupBy("block", "key").agg(F.min(F.struct(*NAME, "at")).alias("p")).select("block", "p.doc_id", "p.tie", "p.at")
    texts = once(_texts(docs, doc_id, text).join(_small(holders.select(*NAME), n_holders), NAME, "left_semi"))
    located = texts.select(block, *NAME, "text").groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(_locate(window), "doc_id long, tie long, at array<int>, h1 array<long>, h2 array<long>")
    windows = save(located, "windows")
    forget(described, held, holders)

    each = windows.select(*NAME, F.explode(F.arrays_zip("at", "h1", "h2")).alias("w")).select(*NAME, F.col("w.at").alias("at"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    firsts = each.groupBy("h1", "h2").agg(F.min(F.struct(*NAME, "at")).alias("w")).select("w.doc_id", "w.tie", "w.at")
    firsts = save(firsts.groupBy(*NAME).agg(F.collect_list("at").alias("firsts")), "firsts")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, ends = [], [], []
            for i, (at, kept) in enumerate(zip(b["at"], b["firsts"], strict=True)):
                at = at.values.to_numpy() if at.is_valid else np.empty(0, np.int32)
                gone = np.setdiff1d(at, kept.values.to_numpy()) if kept.is_valid else at
                if len(gone):
                    cut = np.flatnonzero(np.diff(gone) > window)
                    rows.append(i)
                    starts.append(gone[np.concatenate([[0], cut + 1])].tolist())
                    ends.append((gone[np.concatenate([cut, [len(gone) - 1]])] + window).tolist())
            names = [b[c].take(pa.array(rows, pa.int32())) for c in NAME]
            yield pa.RecordBatch.from_arrays([*names, pa.array([False] * len(rows), pa.bool_()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], [*NAME, "whole", "starts", "ends"])

    parts = windows.select(*NAME, "at").join(firsts, NAME, "left").mapInArrow(ranges, "doc_id long, tie long, whole boolean, starts array<int>, ends array<int>")
    none = F.array().cast("array<int>")
    out = save(parts.unionByName(copies.select(*NAME, F.lit(True).alias("whole"), none.alias("starts"), none.alias("ends"))), "removals")
    forget(windows, firsts, copies, classes)
    return out


def _cut(raw: bytes | None, whole: bool | None, starts, ends) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Words, words removed, where the words begin and end, and whether each stays."""
    begin, end = spans(raw or b"")
    stays = np.ones(len(begin), bool)
    if whole:
        stays[:] = False
    for a, b in zip(() if starts is None else starts, () if ends is None else ends, strict=True):
        stays[a:b] = False
    return len(begin), int((~stays).sum()), begin, end, stays


def _with_removals(docs: DataFrame, found: DataFrame) -> DataFrame:
    rows = found.agg(F.count(F.lit(1)) + F.sum(F.size("starts"))).first()[0] or 0
    return docs.join(_small(found, rows), NAME, "left")


def report(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sums = [], [], []
            for raw, whole, starts, ends in zip(*(b[c].to_pylist() for c in ("text", "whole", "starts", "ends")), strict=True):
                if whole is None:
                    words = (raw or b"").split()
                    n.append(len(words))
                    gone.append(0)
                else:
                    count, removed, _, _, stays = _cut(raw, whole, starts, ends)
                    words = [w for w, s in zip((raw or b"").split(), stays.tolist(), strict=True) if s]
                    n.append(count)
                    gone.append(removed)
                sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = removals(docs, window, doc_id, text)
    named = docs.select(F.col(doc_id).cast("long").alias("id"), *_name(doc_id, text), F.col(text).cast("binary").alias("text"))
    return _with_removals(named, found).select("id", "text", "whole", "starts", "ends").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text; texts that lose none, and all other columns, stay as they are."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, whole, starts, ends in batches:
            out = []
            for text, w, a, b in zip(texts, whole, starts, ends, strict=True):
                raw = (text or "").encode()
                _, gone, begin, _, stays = (0, 0, None, None, None) if w is None else _cut(raw, w, a, b)
                if not gone:
                    out.append(text)
                    continue
                after = np.append(begin[1:], len(raw))  # a word goes with the blanks behind it
                out.append(b"".join([raw[x:y] for x, y, s in zip(begin.tolist(), after.tolist(), stays.tolist(), strict=True) if s]).decode().rstrip())
            yield pd.Series(out, dtype=object)

    found = removals(docs, window, doc_id, text)
    row = fresh(docs, "row")
    named = docs.select(F.struct("*").alias(row), *_name(doc_id, text))
    joined = _with_removals(named, found).select(row, cut(F.col(row)[text], F.col("whole"), F.col("starts"), F.col("ends")).alias("text"))
    return joined.select(*(F.col("text").alias(c) if c == text else F.col(row)[c].alias(c) for c in docs.columns))
