"""Token ids in binary shards (operator 1).

Documents are range-partitioned by id; each partition is one shard file::

    magic "DLTOKS01"
    one zstd frame for each document, compressed with the shared dictionary
    index: Arrow stream with doc_id, offset, size, n_tokens of each document
    footer: index offset, index size (uint64), id width (uint64), SHA-256 of the dictionary, magic

The dictionary is trained once on serialized id arrays and lies beside the
shards as ``dictionary-<sha256>.zdict``.  A document is read from the footer,
its index row and its own frame.  The manifest (one row for each shard) names the
files that count, so that files of failed task attempts are never read.

Results for odd input: null or empty text gives the end id alone; a null doc_id
sorts first; repeated rows are separate documents in an undefined order among
themselves; an empty table gives no document; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import partitions, running_base
from .tokens import encoder

MAGIC = b"DLTOKS01"
FOOTER = "<QQQ32s8s"

#: Documents that the dictionary is trained on, taken by hash of their id; its size in bytes; zstd level.
DICTIONARY_DOCS, DICTIONARY_BYTES, LEVEL = 2_000, 64 * 1024, 3

_MANIFEST = "shard int, file string, n_docs long, n_tokens long, n_bytes long"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))


def _put(path: str, data: bytes) -> None:
    fs, inside = _at(path)
    fs.create_dir(inside.rpartition("/")[0])
    with fs.open_output_stream(inside) as out:
        out.write(data)


def _get(path: str) -> bytes:
    fs, inside = _at(path)
    with fs.open_input_stream(inside) as f:
        return f.read()


def _pack(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _unpack(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """A zstd dictionary from the id arrays of at most ``DICTIONARY_DOCS`` documents.

    It only affects the size of the frames; every document is compressed whole.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCS)  # ids alone: no text is sent on
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")
    end = struct.pack("<I", end_id)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([_pack(encode(x) + end, width) for x in b["text"].to_pylist()], pa.binary())})

    samples = [bytes(r.ids) for r in sample.mapInArrow(ids, "ids binary").limit(DICTIONARY_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards in ascending order of ``doc_id``; returns the manifest."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id)
    width = 2 if largest < 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, end_id, width, doc_id, text)
    digest = hashlib.sha256(dictionary).digest()
    _put(f"{path}/dictionary-{digest.hex()}.zdict", dictionary)
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        file, out, at, index = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.tok", None, len(MAGIC), []
        n_docs = n_tokens = 0
        for b in batches:
            if out is None:
                fs, inside = _at(file)
                out = fs.open_output_stream(inside)
                out.write(MAGIC)
            sizes, counts = [], []
            for x in b["text"].to_pylist():
                ids = encode(x) + end
                frame = zstd.compress(_pack(ids, width))
                out.write(frame)
                sizes.append(len(frame))
                counts.append(len(ids) // 4)
            offsets = np.cumsum([at, *sizes])
            index.append(pa.RecordBatch.from_arrays([b["doc_id"], pa.array(offsets[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "offset", "size", "n_tokens"]))
            at, n_docs, n_tokens = int(offsets[-1]), n_docs + len(sizes), n_tokens + sum(counts)
        if out is not None:
            raw = io.BytesIO()
            with pa.ipc.new_stream(raw, index[0].schema) as w:
                for x in index:
                    w.write_batch(x)
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw.getvalue())
            out.write(packed + struct.pack(FOOTER, at, len(packed), width, digest, MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [file], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [at + len(packed) + struct.calcsize(FOOTER)]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    dealt = rows.repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(write, _MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


class Shard:
    """One shard file; :meth:`get` reads a single document without the others."""

    def __init__(self, file: str):
        self.fs, self.inside = _at(file)
        self.f = self.fs.open_input_file(self.inside)
        size = self.f.size()
        at, n, self.width, digest, magic = struct.unpack(FOOTER, self.f.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{file} is no token shard")
        self.index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self.f.read_at(n, at))).read_all()
        dictionary = _get(f"{file.rpartition('/')[0]}/dictionary-{digest.hex()}.zdict")
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{file}: the dictionary does not have the recorded hash")
        self.zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, row: int) -> bytes:
        """The ids of the document in this row of the index, as uint32 bytes."""
        return _unpack(self.zstd.decompress(self.f.read_at(self.index["size"][row].as_py(), self.index["offset"][row].as_py())), self.width)

    def get(self, doc_id) -> list[int] | None:
        row = pa.compute.index(self.index["doc_id"], doc_id).as_py()
        return None if row < 0 else np.frombuffer(self.ids(row), "<u4").tolist()

    def all(self, rows: int = 2_000) -> Iterator[tuple[list, list[bytes]]]:
        """All documents in order, in blocks: their ids and their token ids."""
        for at in range(0, self.index.num_rows, rows):
            part = self.index.slice(at, rows)
            offsets, sizes = part["offset"].to_numpy(), part["size"].to_numpy()
            raw, first = self.f.read_at(int(offsets[-1] + sizes[-1] - offsets[0]), int(offsets[0])), int(offsets[0])
            yield part["doc_id"].to_pylist(), [_unpack(self.zstd.decompress(raw[o - first : o - first + n]), self.width) for o, n in zip(offsets.tolist(), sizes.tolist(), strict=True)]


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Read the shards that the manifest names: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (uint32 bytes)."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    placed = running_base(manifest, "shard", "n_tokens")
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b["file"].to_pylist(), b["base"].to_pylist(), strict=True):
                for docs, arrays in Shard(file).all():
                    counts = [len(x) // 4 for x in arrays]
                    starts = np.cumsum([base, *counts])
                    base = int(starts[-1])
                    columns = {"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts[:-1], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in arrays], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(arrays, pa.binary())} if ids else {}))

    return placed.select("file", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
