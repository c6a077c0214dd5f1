"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster session is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder_has(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that loops keep short plans and survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``df`` with the number of each row from 1 in an order that tells all rows apart, without a task that holds them all.

    Rows are range-sorted and written; a row's number is its place in its part of the table behind the sizes of the parts before.
    """
    spark = df.sparkSession
    own = next(c for c in (f"row{k}" for k in count()) if c not in df.columns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id()), "numbered")
    sizes = table.groupBy(F.shiftrightunsigned(own, 33).alias("nth")).agg(F.count(F.lit(1)).alias("size"))  # one row for each part
    before = F.coalesce(F.sum("size").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("nth", before.alias("base"))
    place = F.col("base") + F.col(own).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return table.join(F.broadcast(bases), F.shiftrightunsigned(own, 33) == F.col("nth")).select(*df.columns, place.alias(name))


#: A key is hot if it has over this part of all rows.
HOT = 1 / 1000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with one row for each ``key`` in ``groups``, of which ``size`` is the number of rows: the few hot ones are broadcast (fewer
    than ``1 / HOT``), so that none meets in one task. Both are best saved tables."""
    many = F.col(size) > max(1000, int(rows.count() * HOT))
    hot = groups.where(many)
    if hot.isEmpty():
        return rows.join(groups, key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(~many), key)
    return rows.join(F.broadcast(hot), key).select(others.columns).unionByName(others)
