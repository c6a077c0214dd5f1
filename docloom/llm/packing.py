"""Packing of documents into training sequences along a space-filling curve (operator 3).

Each document's token ids are counted in hashed buckets; the normalised counts are
projected to a few dimensions with a fixed random matrix, and the point's place on
a Hilbert curve is the sorting key.  Sorted by it, documents form one stream of
tokens that is cut every ``capacity`` tokens, so neighbours on the curve share a
sequence and only the last sequence of all is padded.

The text is encoded once.  Keys and lengths, without tokens, are range-sorted; each
range counts its own tokens, and the sums of the ranges (one row for each) give
every document its place in the stream.

Results for odd input: null or empty text is the end id alone, at the centre of the
curve; equal documents and repeated rows lie side by side, by doc_id; an empty table
gives no piece; other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import partitions, running_base, save
from .tokens import MAX_WORDS, encoder

#: Hashed buckets of a document's vector, dimensions of the curve, bits for each, seed of the projection.
BUCKETS, DIMS, BITS, SEED = 1024, 4, 15, 7


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points`` (n x dims, integers under 2**bits), as int64."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of the larger cells
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def _points(counts: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows of bucket counts -> cells of the curve's grid."""
    v = np.sqrt(counts)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
    squeezed = np.tanh(v @ matrix)  # a normalised vector's projections are mostly within (-2, 2)
    return np.minimum(((squeezed + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", keep: int = MAX_WORDS) -> DataFrame:
    """row (unique), doc_id, key, n_tokens and the ids (zstd of uint32 bytes, end id included)."""
    end = struct.pack("<I", end_id)

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, matrix, zstd = encoder(tokenizer, keep), _projection(), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                ids, counts = [], np.zeros((b.num_rows, BUCKETS), np.float32)
                n_tokens = []
                for i, x in enumerate(b["text"].to_pylist()):
                    raw = encode(x)
                    hashed = (np.frombuffer(raw, "<u4") * np.uint32(2654435761)) >> np.uint32(22)
                    counts[i] = np.bincount(hashed, minlength=BUCKETS)
                    ids.append(zstd.compress(raw + end))
                    n_tokens.append(len(raw) // 4 + 1)
                yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], pa.array(hilbert_keys(_points(counts, matrix))), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.binary())], ["row", "doc_id", "key", "n_tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(encode_rows, "row long, doc_id long, key long, n_tokens long, ids binary")


def _count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        ends = np.cumsum(b["n_tokens"].to_numpy()) + at
        starts = ends - b["n_tokens"].to_numpy()
        at = int(ends[-1]) if len(ends) else at
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(np.full(b.num_rows, part, np.int32)), pa.array(starts, pa.int64()), b["n_tokens"]], ["row", "part", "start", "n_tokens"])


def stream_places(lengths: DataFrame) -> DataFrame:
    """row, at: where each document (row, doc_id, key, n_tokens) begins in the stream sorted by key and doc_id."""
    spark = lengths.sparkSession
    dealt = lengths.repartitionByRange(partitions(spark), "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    local = save(dealt.mapInArrow(_count_up, "row long, part int, start long, n_tokens long"), "places")
    sums = running_base(local.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n")
    return local.join(F.broadcast(sums.select("part", "base")), "part").select("row", (F.col("base") + F.col("start")).alias("at"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, keep: int = MAX_WORDS) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as uint32 bytes).

    ``keep`` bounds the pieces whose ids a Python worker remembers; it changes memory and time, not results.
    """
    tokens = save(encoded(docs, tokenizer, end_id, doc_id, text, keep), "encoded")
    places = stream_places(tokens.select("row", "doc_id", "key", "n_tokens"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[tuple] = []
            for doc, n, at, packed in zip(b["doc_id"].to_pylist(), b["n_tokens"].to_pylist(), b["at"].to_pylist(), b["ids"].to_pylist(), strict=True):
                raw, start = unzip.decompress(packed), 0
                while start < n:
                    sequence, offset = divmod(at + start, capacity)
                    length = min(capacity - offset, n - start)
                    piece = raw[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(piece), n, sequence, offset, piece))
                    start += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = [pa.array(c, pa.int64()) for c in zip(*(x[:7] for x in out), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x[7] for x in out], pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.select("row", "doc_id", "n_tokens", "ids").join(places, "row").select("doc_id", "n_tokens", "at", "ids").mapInArrow(cut, schema + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces with ids: sequence_id, ids (uint32 bytes), n_tokens.

    A sequence is padded to ``capacity`` with ``pad_id`` unless its length is a power of two.
    """
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    hexed = F.concat_ws("", F.transform("p", lambda p: F.hex(p["ids"])))
    power = F.bit_count("n_tokens") == 1
    pad = F.when(power, F.lit("")).otherwise(F.repeat(F.lit(struct.pack("<I", pad_id).hex()), (F.lit(capacity) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", F.unhex(F.concat(hexed, pad)).alias("ids"), "n_tokens")
