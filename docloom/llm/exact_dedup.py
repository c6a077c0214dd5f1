"""Exact duplicates by two-pass Bloom filtering (operator 2), with DataFrame functions only.

The texts are read once, to a table of ids and SHA-256 sums.  Pass one hashes each
sum to a 64-bit word of a blocked Bloom filter and to two bits in it, and keeps the
bits that two rows or more have set.  Pass two probes every row: one with a bit
unset is the only row of its text and goes straight to the result.  The others may
be repeated; they alone are shuffled by sum, counted with partial aggregation and
joined with their group.

The filter has at most ``BITS`` bits for each row, in words that are joined by
broadcast up to ``BROADCAST_WORDS`` of them and by a shuffle of the narrow rows
beyond.  Groups of over a thousandth of all rows are at most a thousand; these are
broadcast, so that no group of copies meets in one task.

Results for odd input: a null text is an empty one; equal rows with the same id are
all reported and all kept, since their id is the group's largest; null ids count as
the smallest; an empty table gives no row; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, attach_groups, save, without_rows

#: Bits of the filter for each row; words that are broadcast at most (about 40 bytes each).
BITS, BROADCAST_WORDS = 16, 1_000_000


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id (of the row that stays: the largest), group_size, kept, text_sha256."""
    sums = save(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(ascii_lower(F.col(text)), 256)).alias("sum")), "sums")
    rows = sums.count()
    words = 1 << max(4, (rows * BITS // 64).bit_length())

    h = F.xxhash64("sum")
    bit = lambda by: F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int")
    sums = sums.withColumn("word", h.bitwiseAND(F.lit(words - 1))).withColumn("b1", bit(58)).withColumn("b2", bit(52))
    one = F.lit(1).cast("long")

    slots = sums.select(F.explode(F.array_distinct(F.array(F.col("word") * 64 + F.col("b1"), F.col("word") * 64 + F.col("b2")))).alias("slot"))
    repeated = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    filled = repeated.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    bloom = save(filled, "bloom")
    if min(words, rows) <= BROADCAST_WORDS:
        bloom = F.broadcast(bloom)

    mask = F.call_function("shiftleft", one, F.col("b1")).bitwiseOR(F.call_function("shiftleft", one, F.col("b2")))
    probed = sums.join(bloom, "word", "left").select("doc_id", "sum", (F.coalesce(F.col("bits"), F.lit(0).cast("long")).bitwiseAND(mask) == mask).alias("maybe"))
    alone = probed.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sum")

    maybe = probed.where("maybe").drop("maybe")
    groups = save(maybe.groupBy("sum").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    found = attach_groups(maybe, groups, "sum", "group_size", rows)
    return alone.unionByName(found.select(alone.columns)).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sum")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one id for each text, the largest; all columns. A row goes by its id and text, so that other texts of its id stay; rows with a null id stay."""
    gone = copies(docs, text, doc_id).where("NOT kept").select("doc_id", "text_sha256")
    return without_rows(docs, gone, [F.col(doc_id), F.sha2(ascii_lower(F.col(text)), 256)])
