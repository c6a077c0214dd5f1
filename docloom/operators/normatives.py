"""References to norms, held against a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T


def check(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """n, pos, ref, outcome of every reference in texts (n, text).

    The registry has (ord, id, status): an exact key gives its status; else the first entry in order that agrees up to the last
    characters of either number is another edition; else the reference is unknown.
    """
    found = texts.select("n", F.posexplode(T.references("text")).alias("pos", "ref")).withColumn("key", T.reference_key(F.col("ref")))
    entries = registry.select("ord", T.reference_key(F.col("id")).alias("rk"), F.lower(F.coalesce("status", F.lit("actual"))).alias("state"))
    # Many texts name one document: each spelling is looked up once.
    keys = found.select("key").distinct()
    exact = keys.join(entries, F.col("key") == F.col("rk")).groupBy("key").agg(F.max_by("state", "ord").alias("state"))
    rest = keys.join(exact, "key", "left_anti")
    # One number begins like the other but for its last characters: both by equality of beginnings.
    cut = lambda c: F.left(F.col(c), F.greatest(F.lit(6), F.length(c) - 4))
    beginnings = lambda c: F.explode(F.transform(F.sequence(F.least(F.lit(6), F.length(c)), F.length(c)), lambda n: F.left(F.col(c), n)))
    named = entries.select("ord", "rk", cut("rk").alias("own"))
    by_entry = rest.select("key", beginnings("key").alias("own")).join(named, "own").select("key", "ord", "rk")
    by_reference = rest.select("key", cut("key").alias("own")).join(entries.select("ord", "rk", beginnings("rk").alias("own")), "own").select("key", "ord", "rk")
    near = by_entry.unionByName(by_reference).groupBy("key").agg(F.min_by("rk", "ord").alias("edition"))
    out = found.join(exact, "key", "left").join(near, "key", "left")
    return out.select("n", "pos", "ref", F.when(F.col("edition").isNotNull(), "edition_mismatch").otherwise(F.coalesce("state", F.lit("unknown"))).alias("outcome"))
