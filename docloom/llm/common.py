"""Shared folder, intermediate tables and row helpers of the operators in this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space between words, as a pattern: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own (as in
    tests); a cluster session is refused, because no local folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: work done so
    far survives a lost executor and isn't done twice."""
    spark = df.sparkSession
    df.write.parquet(path := workspace(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete intermediate tables made by :func:`save` that nothing reads any more,
    and let Spark drop the shuffle files of finished jobs."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tidy(tables[0].sparkSession)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text):
    """``text`` (null: empty) with A-Z in lower case and all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def running_base(parts: DataFrame, key: str, amount: str, name: str = "base") -> DataFrame:
    """``parts`` (one row for each partition or file) with the sum of ``amount`` over the rows before it in order of ``key``."""
    from pyspark.sql import Window

    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long"))


#: A group is hot if it has over this part of all rows.
HOT = 1 / 1000


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row for each ``key`` in ``groups``, without a task that holds a hot group.

    Of groups with over ``HOT`` of ``total`` rows there are fewer than ``1 / HOT``, so these
    are broadcast; the others are joined as the planner likes. ``groups`` is best a saved table.
    """
    many = F.col(size) > max(1, int(total * HOT))
    hot = groups.where(many)
    if hot.isEmpty():
        return rows.join(groups, key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(~many), key)
    return rows.join(F.broadcast(hot), key).select(others.columns).unionByName(others)


#: Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame, names: list[Column]) -> DataFrame:
    """``docs`` without the rows whose ``names`` (columns of ``docs``) are a row of ``gone``; broadcast up to ``BROADCAST_IDS`` rows, shuffled beyond.
    A row with a null among its names stays."""
    gone = save(gone.toDF(*(fresh(docs, f"gone{i}") for i in range(len(names)))), "gone")
    same = [n == F.col(c) for n, c in zip(names, gone.columns, strict=True)]
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, same, "left_anti").select(docs.columns)


#: Words of a Bloom filter that are broadcast at most (about 40 bytes each), and its bits for each key.
BLOOM_WORDS, BLOOM_BITS = 1_000_000, 16


def possibly_in(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """``rows`` whose ``key`` (a long) is in ``keys``, and few others, by a broadcast Bloom filter; all rows if the filter would be too large."""
    words = 1 << max(4, (n_keys * BLOOM_BITS // 64).bit_length())
    if words > BLOOM_WORDS:
        return rows
    h, one = F.xxhash64(key), F.lit(1).cast("long")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int"))
    word, mask = h.bitwiseAND(F.lit(words - 1)), bit(58).bitwiseOR(bit(52))
    filled = keys.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    probed = rows.join(F.broadcast(filled), word == F.col("_word"))
    return probed.where(F.col("_bits").bitwiseAND(mask) == mask).select(rows.columns)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that are done."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


_HELD: dict = {}


def worker_cache(key, make):
    """What ``make`` gives, kept by this Python worker until another table is asked for; a worker outlives an operator."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
