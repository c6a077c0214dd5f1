"""Near duplicates by MinHash with odd sketches (operator 12).

A document's set holds the hashes of its distinct runs of ``shingle`` words.  ``SAMPLES`` MinHash samples are
taken of it: of the elements' products with as many odd numbers, the least.  Two sets agree in a sample as often as
their Jaccard similarity J says, so they agree in all r samples of one of b bands, and are candidates, with
probability 1 - (1 - J^r)^b.  Bands are as long as they can be for all but ``MISSED`` of the pairs of exactly the asked
similarity: for 0.85 they are 36 of 5 samples, with which 7 pairs in 10^10 are missed, and of those with J = 0.5 two in three are candidates.

The samples are folded to an odd sketch, too: each sample and its number are hashed to one of ``64 * WORDS`` bits, which
holds the parity of its hits.  Where two sets agree in a sample, the two hits cancel out; the m samples in which they differ
leave 2m hits, so the XOR's population count c estimates m as -(N / 4) ln(1 - 2c / N) for N bits; that is the more precise, the fewer samples
differ.  Candidates go on to the exact comparison of their whole sets unless the estimate is further off than a pair of the asked
similarity is in all but ``MISSED`` cases: c is at most 2m, and m is binomial.  So many samples can't tell 0.8 from 0.85, so what is left is held
against a parity bitmap of the sets' own elements, too, which never turns a similar pair away (``near.close_enough``).

How candidates become groups is in ``near``: every link is confirmed on the whole sets, and classes of equal sets need no samples.

Results for odd input: a null or blank text has an empty set and is linked with nothing; fewer words than ``shingle`` make one
element; rows that share an id but not a text are documents of their own; a null id takes part in nothing and gives a null
component; an empty table gives no row; other columns are left out or, in :func:`one_of_each`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import near
from .common import attach_groups, forget, possibly_in, save, tidy, without_rows
from .jaccard import elements, set_sums
from .words import mix

#: Samples of a set, and 64-bit words of its odd sketch.
SAMPLES, WORDS = 180, 8

#: Part of the pairs of exactly the asked similarity that the bands, and the odd sketch, may miss.
MISSED = 1e-9

#: Elements whose samples are taken at once.
BLOCK = 4096

_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_NUMBERS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(20))


def samples(own: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(own), BLOCK):
        part = own[at : at + BLOCK]
        np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(1), out=least)
    return least


def rows_of(at_least: Fraction) -> int:
    """The most samples in a band with which ``MISSED`` of the pairs of this similarity at most agree in no band."""
    fits = [r for r in range(1, 20) if (1 - float(at_least) ** r) ** (SAMPLES // r) <= MISSED]
    return max(fits, default=1)


def band_keys(sample: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of so many samples: their hash, with the band's number."""
    bands = SAMPLES // rows
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for row in sample[: bands * rows].reshape(bands, rows).T:
        out = mix(out ^ row)
    return out


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity of the samples, each with its number, in each of 64 * WORDS bits."""
    odd = np.bincount((mix(sample ^ _NUMBERS) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_apart(at_least: Fraction) -> int:
    """The greatest population count of two odd sketches' XOR at this similarity, in all but ``MISSED`` cases: twice the samples that differ."""
    k, differs, left = SAMPLES, float(1 - at_least), 1.0
    for m in range(k + 1):
        left -= comb(k, m) * differs**m * (1 - differs) ** (k - m)
        if left <= MISSED:
            return 2 * m
    return 2 * k


def _sketches(texts: DataFrame, shingle: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                n, f1, f2, parity, keys = [], [], [], [], []
                for raw in b["text"]:
                    own = elements(raw.as_py(), shingle)
                    n.append(len(own))
                    for sums, s in zip((f1, f2), set_sums(own), strict=True):
                        sums.append(s)
                    if len(own):
                        sample = samples(own)
                        parity.append(np.concatenate([odd_sketch(sample), near.folded(own)]))
                        keys.append(band_keys(sample, rows).view(np.int64))
                    else:
                        parity.append([])
                        keys.append([])
                arrays = [pa.array(x, pa.int64()) for x in (n, f1, f2)] + [pa.array(x, near.LONGS) for x in (parity, keys)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["tie"], *arrays], ["doc_id", "tie", "n", "f1", "f2", "parity", "keys"])

    return texts.mapInArrow(run, "doc_id long, tie long, n long, f1 long, f2 long, parity array<long>, keys array<long>")


def _candidates(one: DataFrame) -> DataFrame:
    """key, id for every band key that two nodes or more have."""
    emitted = one.select(F.col("node").alias("id"), F.explode("keys").alias("key"))
    groups = save(emitted.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "groups")
    tidy(one.sparkSession)
    n_keys = one.agg(F.sum(F.size("keys"))).first()[0] or 0
    repeated = possibly_in(emitted, groups, "key", groups.count())
    out = save(attach_groups(repeated, groups, "key", "members", n_keys).select("key", "id"), "shared-keys")
    forget(groups)
    return out


def _groups(docs: DataFrame, shingle: int, t: Fraction, doc_id: str, text: str) -> DataFrame:
    texts, most = near.named_texts(docs, doc_id, text), most_apart(t)

    def test(a: Column, bits_a: list[Column], b: Column, bits_b: list[Column]) -> Column:
        return (near.bits_apart(bits_a[:WORDS], bits_b[:WORDS]) <= most) & near.close_enough(a, bits_a[WORDS:], b, bits_b[WORDS:], t)

    return near.Groups(texts, _sketches(texts, shingle, rows_of(t)), _candidates, test, lambda raw: elements(raw, shingle), t, WORDS + near.FOLDED).found()


def similar(docs: DataFrame, shingle: int = 5, at_least: Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles and component_id, the least id that links of at least this Jaccard similarity lead to."""
    return near.report(_groups(docs, shingle, at_least, doc_id, text))


def one_of_each(docs: DataFrame, shingle: int = 5, at_least: Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that with the least id (of one id: with the least hash of its text); all columns. Rows that
    repeat that document, id and text, stay with it; so do rows with a null id."""
    gone = near.others(_groups(docs, shingle, at_least, doc_id, text))
    return without_rows(docs, gone, [F.col(doc_id).cast("long"), F.xxhash64(text)])
