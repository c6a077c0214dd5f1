"""Similarities of arrays, sketches and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeated elements, whose union needn't be made."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    """Share of equal bits; 0 if both are 0, as those of empty texts are."""
    return F.when((a == 0) & (b == 0), 0.0).otherwise(1 - hamming(a, b).cast("double") / bits)


def minhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal places; two signatures of empty texts are equal."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / n)
