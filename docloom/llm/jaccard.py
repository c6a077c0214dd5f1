"""Similar documents by a parity-sketch join on word n-grams (operator 7).

A document's set holds the hashes of its distinct runs of ``shingle`` words.  Two sets of
sizes a and b whose Jaccard similarity is at least t differ in at most
(a + b)(1 - t)/(1 + t) elements.  Sizes are cut into bands; within a band (and from those
below, for partners across its edge) that is at most D elements, and every document's
bit sketch has G > D segments of 2**20 bits: an element is XORed into one bit of one
segment, so the Hamming distance of two sketches is at most the number of elements in which the
sets differ, and at least G - D segments are equal (pigeonhole).  A segment's key is the XOR of
hashes of its set bits.

Keys are counted over all documents.  Two similar documents have at least G - D keys of a band in
common, so a document with fewer repeated keys than that has no partner in the band, and any other
may leave out its G - D - 1 most frequent keys (empty segments first): with one order of keys for
all, by count, one common key still remains.  So keys of widely shared passages are the first to go,
and documents that have only a passage in common don't meet at all.  Documents that share a key that
is left are candidates.

How candidates become groups is in ``near``.  Before the exact check, pairs must pass the sizes' ratio and the
Hamming distance of a folded sketch.

Results for odd input: a null or blank text has an empty set and is linked with nothing;
fewer words than ``shingle`` make one element; rows that share an id but not a text are documents of their own;
a null id takes part in nothing and gives a null component; an empty table gives no row; other
columns are left out or, in :func:`one_of_each`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import near
from .common import attach_groups, forget, possibly_in, save, tidy, without_rows
from .words import mix, run_hashes, word_hashes

def elements(raw: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word runs, A-Z in lower case."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(shingle, len(words))))


class Bands:
    """Size bands for similarity at least ``t``: [least[j], least[j + 1]), sketch segments and differences allowed."""

    def __init__(self, t: Fraction, largest: int = 1 << 40):
        self.t = t
        self.least = [1]
        while self.least[-1] <= largest:
            self.least.append(max(self.least[-1] + 1, int(self.least[-1] * 1.35)))

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.least, n, side="right")) - 1

    def differ(self, band: int) -> int:
        """Elements in which two sets differ at most if the greater is in this band."""
        return int(2 * (self.least[band + 1] - 1) * (1 - self.t) / (1 + self.t))

    def segments(self, band: int) -> int:
        d = self.differ(band)
        return d + 3 + d // SLACK

    def joins(self, n: int) -> list[int]:
        """The own band of a set of size n, and those of partners that are larger."""
        return [*range(self.of(n), self.of(int(n / self.t)) + 1)]


#: A sketch has a segment more for each so many differences allowed: more keys, of which more can be left out.
SLACK = 4


def keys(own: np.ndarray, bands: Bands) -> list[tuple[int, int, np.ndarray]]:
    """For each band that a set takes part in: band, how many of its most frequent keys it may leave out, and its keys."""
    out = []
    for band in bands.joins(len(own)):
        d, g = bands.differ(band), bands.segments(band)
        if d == 0:
            continue  # only equal sets, which are one class
        segment = ((own >> np.uint64(32)) * np.uint64(g)) >> np.uint64(32)
        bit = (segment << np.uint64(20)) | (own & np.uint64(0xFFFFF))
        hashed = mix(bit + (np.uint64(band) << np.uint64(44)))
        order = np.argsort(segment, kind="stable")
        segment, hashed = segment[order], hashed[order]
        first = np.flatnonzero(np.diff(segment, prepend=np.uint64(g + 1)))
        held = segment[first]
        tag = np.uint64((band << 40) + 1)
        found = mix(np.bitwise_xor.reduceat(hashed, first) ^ mix(held + tag))
        spare = g - d - 1
        if (empty := g - len(first)) <= spare:
            out.append((band, spare - empty, found))
        else:  # some empty segments are keys as well, the same first ones for all
            missing = np.setdiff1d(np.arange(g, dtype=np.uint64), held)[: empty - spare]
            out.append((band, 0, np.concatenate([found, mix(mix(missing + tag))])))
    return out


def set_sums(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(mix(own).sum(dtype=np.uint64).view(np.int64)), int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


_OFFERS = pa.list_(pa.struct([("band", pa.int32()), ("spare", pa.int32()), ("keys", near.LONGS)]))


def _sketches(texts: DataFrame, shingle: int, t: Fraction) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(t)
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                n, f1, f2, parity, offers = [], [], [], [], []
                for x in b["text"].to_pylist():
                    own = elements(x, shingle)
                    n.append(len(own))
                    for sums, s in zip((f1, f2), set_sums(own), strict=True):
                        sums.append(s)
                    parity.append(near.folded(own))
                    offers.append([{"band": band, "spare": spare, "keys": k.view(np.int64)} for band, spare, k in keys(own, bands)] if len(own) else [])
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["tie"], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(parity, near.LONGS), pa.array(offers, _OFFERS)], ["doc_id", "tie", "n", "f1", "f2", "parity", "offers"])

    return texts.mapInArrow(run, "doc_id long, tie long, n long, f1 long, f2 long, parity array<long>, offers array<struct<band: int, spare: int, keys: array<long>>>")


def _candidates(one: DataFrame) -> DataFrame:
    """key, id: the keys that documents are compared by (see the module's text)."""
    emitted = one.select(F.col("node").alias("id"), F.explode("offers").alias("o")).select("id", "o.band", "o.spare", F.explode("o.keys").alias("key"))
    n_keys = one.agg(F.sum(F.aggregate("offers", F.lit(0).cast("long"), lambda s, o: s + F.size(o["keys"])))).first()[0] or 0
    groups = save(emitted.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "groups")
    tidy(one.sparkSession)
    repeated = possibly_in(emitted, groups, "key", groups.count())
    shared = attach_groups(repeated, groups, "key", "members", n_keys)
    own = Window.partitionBy("id", "band")
    placed = shared.select("key", "id", "spare", F.row_number().over(own.orderBy("members", "key")).alias("place"), F.count(F.lit(1)).over(own).alias("repeated"))
    out = save(placed.where("place <= repeated - spare").select("key", "id"), "shared-keys")
    forget(groups)
    return out


def _groups(docs: DataFrame, shingle: int, t: Fraction, doc_id: str, text: str) -> DataFrame:
    texts = near.named_texts(docs, doc_id, text)
    test = lambda a, bits_a, b, bits_b: near.close_enough(a, bits_a, b, bits_b, t)
    return near.Groups(texts, _sketches(texts, shingle, t), _candidates, test, lambda raw: elements(raw, shingle), t, near.FOLDED).found()


def similar(docs: DataFrame, shingle: int = 5, at_least: Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles and component_id, the least id that links of at least this Jaccard similarity lead to."""
    return near.report(_groups(docs, shingle, at_least, doc_id, text))


def one_of_each(docs: DataFrame, shingle: int = 5, at_least: Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of similar ones, that with the least id (of one id: with the least hash of its text); all columns. Rows that
    repeat that document, id and text, stay with it; so do rows with a null id."""
    gone = near.others(_groups(docs, shingle, at_least, doc_id, text))
    return without_rows(docs, gone, [F.col(doc_id).cast("long"), F.xxhash64(text)])
