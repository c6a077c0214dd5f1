"""Periodic runs of words in documents (operator 11).

A run is a stretch of consecutive words with smallest period q (words q apart are the same) that no neighbouring word
extends, of at least ``min_length`` words and ``min_exponent`` periods.

In a run that begins at s, the suffixes at s and s + q have the rest of the run as their longest common prefix (LCP).
So runs are read off the suffix array of a document's words:

1. Suffixes whose first words are repeated in the document (as many words as any run makes two suffixes share) are
   ranked by prefix doubling; all others can't begin a run.  Neighbours in rank get their LCP by Kasai's pass.
2. As in Kruskal's algorithm, classes of suffixes are united by decreasing LCP with union-find.  A class keeps its
   positions in order, the smaller set is merged into the larger.
3. Two positions that become neighbours by a union have exactly that union's LCP.  If their distance is within it
   (``min_exponent - 1`` distances or more), they seed a run: from the first position, over distance and LCP.
   The pair that no equal words precede is the run itself, and its distance is the smallest period: had the
   stretch a smaller one, a position in between would have joined the class at a greater LCP.

Documents are independent of each other: one pass over the rows, no shuffle; memory grows with the longest document only.

Results for odd input: a null or blank text has no words and no runs; repeated rows and rows with null or equal ids
are handled each by itself; an empty table gives no row; other columns are left out or, in :func:`collapsed`, kept.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import mix, run_hashes, spans

#: Words in a run and periods in a run at least.
MIN_LENGTH, MIN_EXPONENT = 6, 4


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The fewest words that two suffixes a period apart share at the start of any run."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def _block_ranks(ids: np.ndarray, length: int) -> np.ndarray:
    """For each position from 0 to n, the rank of its next ``length`` words in their order; the document's end comes before all words."""
    one = np.concatenate([ids + 1, np.zeros(length, np.int64)])

    def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        n = min(len(left), len(right))
        return np.unique(left[:n] * (right.max() + 1) + right[:n], return_inverse=True)[1]

    rank, have = one, 1
    for bit in f"{length:b}"[1:]:
        rank, have = ranked(rank, rank[have:]), 2 * have
        if bit == "1":
            rank, have = ranked(rank, one[have:]), have + 1
    return rank


def suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose first ``least`` words occur elsewhere, too, in suffix order, and each one's LCP with the one before it (0 where under ``least``)."""
    none = np.empty(0, np.int64)
    seen = np.sort(run_hashes(mix(ids.astype(np.uint64)), least, 11))
    if not (seen[1:] == seen[:-1]).any():
        return none, none
    first = _block_ranks(ids, least)
    order = np.argsort(first, kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(first[order])) + 1])
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    rank = np.empty(len(first), np.int64)
    rank[order] = np.repeat(starts, sizes)  # a class's rank is the place of its first member
    open_ = order[np.repeat(sizes > 1, sizes)]
    at, length = open_, least
    while len(open_):
        behind = rank[open_ + length]
        by = np.lexsort((behind, rank[open_]))
        open_, behind = open_[by], behind[by]
        group = rank[open_]
        other = np.concatenate([[True], group[1:] != group[:-1]])
        cut = other | np.concatenate([[True], behind[1:] != behind[:-1]])
        place = np.arange(len(open_))
        begin = np.maximum.accumulate(np.where(cut, place, 0))
        rank[open_] = group + begin - np.maximum.accumulate(np.where(other, place, 0))
        single = cut & np.concatenate([cut[1:], [True]])
        open_, length = open_[~single], 2 * length
    at = at[np.argsort(rank[at])]
    return at, _lcps(ids.tolist(), at, first, least)


def _lcps(ids: list[int], at: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Kasai's pass in order of position: from one position to the next a longest common prefix shrinks by one word at most."""
    slots = np.argsort(at, kind="stable")
    before = np.full(len(at), -1)
    before[1:] = np.where(first[at[1:]] == first[at[:-1]], at[:-1], -1)
    out, n, last, h = [0] * len(at), len(ids), -2, 0
    for slot, i, j in zip(slots.tolist(), at[slots].tolist(), before[slots].tolist(), strict=True):
        h = max(h - 1, 0) if i == last + 1 else 0
        if j < 0:
            last, h = i, 0
            continue
        end = n - max(i, j)
        while h < end and ids[i + h] == ids[j + h]:
            h += 1
        out[slot], last = h if h >= least else 0, i
    return np.array(out, np.int64)


def _merge(into: list[int], more: list[int]) -> list[int]:
    """Two ordered sets as one."""
    if 16 * len(more) < len(into):
        for x in more:
            insort(into, x)
        return into
    into += more
    into.sort()
    return into


def _new_neighbours(large: list[int], small: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs, one of each ordered set, that are neighbours in their union."""
    gaps = [bisect_left(large, x) for x in small]
    for k, (x, gap) in enumerate(zip(small, gaps, strict=True)):
        if gap and (k == 0 or gaps[k - 1] != gap):
            yield large[gap - 1], x
        if gap < len(large) and (k + 1 == len(gaps) or gaps[k + 1] != gap):
            yield x, large[gap]


def find_runs(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of a document as (start, length, period), in order of start, then period."""
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    least, n = least_lcp(min_length, min_exponent), len(words)
    if n <= least:
        return []
    number = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    at, lcp = suffixes(ids, least)
    edges = np.flatnonzero(lcp)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    position, same, found = at.tolist(), ids.tolist(), []
    parent = list(range(len(position)))
    members: list[list[int] | None] = [[p] for p in position]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for edge, shared in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = root(edge - 1), root(edge)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        for x, y in _new_neighbours(members[a], members[b]):
            d = y - x
            if (min_exponent - 1) * d <= shared and d + shared >= min_length and (x == 0 or same[x - 1] != same[y - 1]):
                found.append((x, d + shared, d))
        members[a], members[b], parent[b] = _merge(members[a], members[b]), None, a
    return sorted(found, key=lambda r: (r[0], r[2]))


def stays(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: a run keeps its first period only."""
    out = np.ones(n, bool)
    for start, length, period in runs:
        out[start + period : start + length] = False
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each run: doc_id, start (number of its first word), length (words), period."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in find_runs((raw.as_py() or b"").split(), min_length, min_exponent)] for raw in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, _RUNS)], ["doc_id", "runs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(each, "doc_id long, runs array<struct<start: long, length: long, period: long>>")
    return found.select("doc_id", F.explode("runs").alias("run")).select("doc_id", "run.*")


def report(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_runs; start, length, period and exponent_milli of the longest run (ties: the first, then
    the smallest period; null without runs); runs_sha256 of all runs as lines ``start,length,period``; collapsed_sha256 of the words that stay, joined by a blank."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b["text"]:
                words = (raw.as_py() or b"").split()
                found = find_runs(words, min_length, min_exponent)
                kept = [w for w, s in zip(words, stays(len(words), found).tolist(), strict=True) if s] if found else words
                start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                rows.append((len(words), len(found), start, length, period, 1000 * length // period if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(8)]
            arrays = [pa.array(c, pa.int64() if i < 6 else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *arrays], ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def collapsed(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, text: str = "text") -> DataFrame:
    """``docs`` with each run cut down to its first period; texts without runs, and all other columns, stay as they are."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                raw = (t or "").encode()
                found = find_runs(raw.split(), min_length, min_exponent)
                if not found:
                    out.append(t)
                    continue
                begin, _ = spans(raw)
                kept = stays(len(begin), found).tolist()
                after = np.append(begin[1:], len(raw))  # a word goes with the blanks behind it
                out.append(b"".join([raw[x:y] for x, y, s in zip(begin.tolist(), after.tolist(), kept, strict=True) if s]).decode().rstrip())
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, cut(F.col(text)))
