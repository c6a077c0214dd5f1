"""Quality classifier on supervised subword embeddings (operator 5).

A word's vector is the mean of learned vectors in a hashed table: one for the word
and one for each character n-gram of it.  A document's vector is the mean of its
words' vectors; a word that repeats the one before it adds the vector of the hashed
mark ``SAME``.  A linear layer and a softmax give the probability of label 1.
Training is numpy stochastic gradient descent in one task over at most
``SAMPLE`` labelled documents, whole texts, chosen by hash of their id, of which
that task gets the distinct words and their counts.

As all after the table is linear, scoring needs one number for each bucket: a
word's logit is a mean of those, kept by the worker, and a document's logit a mean
over its words.  Every word of every text is read.

Results for odd input: a null or empty text scores by the model's bias alone; equal
texts score equally; labels that are null are not learned from; without labels of
both kinds the score is the labels' mean (0.5 without any); an empty table gives no
row; other columns are left out.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import worker_cache

#: Labelled documents to fit on at most.
SAMPLE = 2_000

#: Buckets of the table, dimensions, character n-grams, epochs, documents a step, learning rate, seed.
BUCKETS, DIMS, GRAMS, EPOCHS, BATCH, RATE, SEED = 1 << 18, 8, (1, 2, 3, 4), 5, 32, 0.05, 11

#: Words whose logit a worker keeps; longest word kept.
MAX_WORDS, MAX_WORD = 400_000, 64

SAME = b"\x00same"


def held_out(doc_id: str):
    """Whether a document is kept from learning: the crc32 of its id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def features(word: bytes) -> list[int]:
    """Buckets of a word: its own and those of its character n-grams, with < and > at the ends."""
    mask, crc = BUCKETS - 1, zlib.crc32
    w = b"<" + word + b">"
    out = [crc(w) & mask]
    for n in GRAMS:
        out += [crc(w[i : i + n], n) & mask for i in range(len(w) - n + 1)]
    return out


def count_words(text: bytes | None) -> tuple[Counter, int]:
    """Counts of a text's words and of ``SAME``, and the sum of all counts."""
    words = (text or b"").split()
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    if same:
        counts[SAME] += same
    return counts, len(words) + same


@dataclass
class Model:
    """logits: what each bucket adds to a document's logit; bias: the logit of an empty text."""

    logits: np.ndarray
    bias: float


def train(texts: Iterable[dict[bytes, int]], labels: list[int]) -> Model:
    """Fit on documents given as counts of words."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    table = ((rng.random((BUCKETS, DIMS)) - 0.5) / DIMS).astype(np.float32)
    layer = (rng.standard_normal((DIMS, 2)) / np.sqrt(DIMS)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    vocabulary: dict[bytes, int] = {}
    flat, ends = array("i"), array("q", [0])  # the buckets of all words in one stretch, and where each word's end
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for counts in texts:
        for w in counts:
            if w not in vocabulary:
                vocabulary[w] = len(ends) - 1
                flat.extend([zlib.crc32(SAME) & (BUCKETS - 1)] if w == SAME else features(w))
                ends.append(len(flat))
        rows.append((np.asarray([vocabulary[w] for w in counts], np.int32), np.asarray([*counts.values()], np.float32)))
    vocabulary.clear()
    buckets, ends = np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32), np.asarray(ends)
    usable = np.asarray([i for i, r in enumerate(rows) if len(r[0])])
    n_steps, step = EPOCHS * (len(usable) // BATCH + 1), 0
    for _ in range(EPOCHS):
        order = rng.permutation(usable)
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            rate = RATE * (1 - step / n_steps)
            step += 1
            sizes = [len(rows[d][0]) for d in docs]
            words, place = np.unique(np.concatenate([rows[d][0] for d in docs]), return_inverse=True)
            weight = np.concatenate([rows[d][1] / rows[d][1].sum() for d in docs])
            gram_sizes = ends[words + 1] - ends[words]
            first = np.cumsum(gram_sizes) - gram_sizes
            ids = buckets[np.repeat(ends[words] - first, gram_sizes) + np.arange(gram_sizes.sum())]
            vectors = np.add.reduceat(table[ids], first, axis=0) / gram_sizes[:, None]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(vectors[place] * weight[:, None], starts, axis=0)
            z = hidden @ layer + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1  # gradient of the softmax's loss
            back = p @ layer.T
            # Steps are scaled so that a document moves its mean by about the rate, whatever its length.
            layer -= (rate * 4 / len(docs)) * (hidden.T @ p)
            bias -= (rate / len(docs)) * p.sum(0)
            pushed = np.repeat(back, sizes, axis=0) * weight[:, None]
            by_word = np.stack([np.bincount(place, pushed[:, k], len(words)) for k in range(DIMS)], 1) / gram_sizes[:, None]
            spread = np.repeat(by_word, gram_sizes, axis=0)
            touched, slot = np.unique(ids, return_inverse=True)
            total = np.stack([np.bincount(slot, spread[:, k], len(touched)) for k in range(DIMS)], 1)
            table[touched] -= (rate * 60 * total).astype(np.float32)
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learn ``label`` (0 or 1) from at most ``sample`` rows of ``labels`` and their whole texts."""
    wanted = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows: safe to broadcast

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [count_words(x)[0] for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))], ["doc_id", "label", "words", "counts"])

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("train", dict)  # other operators' tables go
        rows = pa.Table.from_batches([*batches], schema=_COUNTS).sort_by([("doc_id", "ascending"), ("label", "ascending")])
        counted = (dict(zip(w.as_py(), c.as_py(), strict=True)) for w, c in zip(rows["words"], rows["counts"], strict=True))
        model = train(counted, rows["label"].to_pylist())
        yield pa.RecordBatch.from_pydict({"logits": pa.array([model.logits.tobytes()], pa.binary()), "bias": [model.bias]})

    # Of rows that share an id, the text with the least hash is learned from, so that there are no more rows than labels.
    learned = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    counts = learned.mapInArrow(reduce, "doc_id long, label int, words array<binary>, counts array<int>")
    fitted = counts.repartition(1).mapInArrow(learn, "logits binary, bias double").collect()  # one row
    if not fitted:
        return train([], [])
    return Model(np.frombuffer(bytes(fitted[0].logits), np.float32), fitted[0].bias)


_COUNTS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32()))])


def _word_logits(model: Model) -> tuple[dict, list[float]]:
    """Words' logits known so far, and the buckets' as a list."""
    return worker_cache(("quality", zlib.crc32(model.logits.tobytes())), lambda: ({}, model.logits.tolist()))


def scorer(spark, model: Model):
    """A function from a text column (binary) to the probability of label 1."""
    sent = spark.sparkContext.broadcast(model)  # one number for each bucket

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        known, logits = _word_logits(model)

        def logit(word: bytes) -> float:
            f = [zlib.crc32(SAME) & (BUCKETS - 1)] if word == SAME else features(word)
            x = sum([logits[i] for i in f]) / len(f)
            if len(word) <= MAX_WORD:
                if len(known) >= MAX_WORDS:
                    known.clear()
                known[word] = x
            return x

        same = logit(SAME)
        for texts in batches:
            out = []
            for x in texts:
                words = (x or b"").split()
                total = sum([known[w] if w in known else logit(w) for w in words])
                n = len(words) + (again := sum(map(bytes.__eq__, words, words[1:])))
                out.append(model.bias + ((total + again * same) / n if n else 0.0))
            yield pd.Series(1 / (1 + np.exp(-np.asarray(out, np.float64))))

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (probability of label 1) of every document."""
    return docs.select(F.col(doc_id).alias("doc_id"), scorer(docs.sparkSession, model)(F.col(text).cast("binary")).alias("score"))


def keep_good(docs: DataFrame, model: Model, at_least: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` without those that score under ``at_least``; all columns as they are."""
    return docs.where(scorer(docs.sparkSession, model)(F.col(text).cast("binary")) >= at_least)
