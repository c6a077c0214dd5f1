"""Bounded keyed tables of dear results: looked up by key, the oldest entries going first, and those past their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import numbered


def put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """key, value, seq of a cache with ``fresh`` (key, value, seq) put in: an entry of its key is replaced and goes to the end of the line.

    seq is the order of insertion; of several new entries of a key the last holds.  Null keys are never held.
    """
    last = fresh.where("key IS NOT NULL").groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return last.unionByName(cache.join(last.select("key"), "key", "left_anti").select("key", "value", "seq"))


def evict(cache: DataFrame, at_most: int) -> DataFrame:
    """``cache`` without its oldest entries, those put in first, as far as there are more than ``at_most``; entries of one seq go in order of their keys."""
    rows = cache.count()
    if rows <= at_most:
        return cache
    return numbered(cache, ["seq", "key"], "place_in_line").where(F.col("place_in_line") > rows - at_most).drop("place_in_line")


def alive(cache: DataFrame, now: Column, seconds: float, at: str = "at") -> DataFrame:
    """Entries at most ``seconds`` old; those without a time are past theirs."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return cache.where(F.coalesce(age <= seconds, F.lit(False)))


def unchanged(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Entries (key, stamp) of files (key, stamp; such as the time of change and size) that are as they were; all others are to be read again."""
    return cache.join(files.select("key", "stamp"), ["key", "stamp"], "left_semi")


def through(cache: DataFrame, asked: DataFrame, make, at_most: int) -> tuple[DataFrame, DataFrame]:
    """Values for ``asked`` (key, what, seq) by way of a cache: (key, value of what is asked, each row), and the cache afterwards.

    make: (key, what; one row a key) -> key, value.  It gets only what the cache doesn't hold.
    """
    missing = asked.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by("what", "seq").alias("what"), F.min("seq").alias("seq"))
    made = make(missing.select("key", "what")).join(missing.select("key", "seq"), "key")
    held = cache.select("key", "value").unionByName(made.select("key", "value"))
    return asked.select("key").join(held, "key", "left"), evict(put(cache, made.select("key", "value", "seq")), at_most)
