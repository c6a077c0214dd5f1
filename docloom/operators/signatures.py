"""Signatures of contents that are stored and never taken twice, and the pairs that they say are alike.

Two contents are compared by their MinHash if both have one, else by their SimHash; equal sums are alike without either.  A MinHash of
texts without any run of words says nothing and is null.

Pairs are found by keys that two signatures of the asked similarity have in common for certain: of n places, at most d may differ, so of
d + 1 bands of neighbouring places one is equal (pigeonhole).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrow as A, text as T, vectors as V
from .search import small
from .tables import attach, saved

PLACES, BITS = 64, 64


def content_sum(text: Column | str) -> Column:
    return F.sha2(T.text(text), 256)


def signed(docs: DataFrame, store: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", with_simhash: bool = True) -> tuple[DataFrame, DataFrame]:
    """(content, simhash, minhash, n_chars of each content that the store doesn't hold; doc_id, content of every document).

    The first goes into the store (a table of the same columns), so that contents that are known are never sketched again. Without ``with_simhash`` it is null.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), content_sum(text).alias("content"))
    whole = docs.select(content_sum(text).alias("content"), T.text(text).alias("t"))
    if store is not None:
        whole = whole.join(store.select("content"), "content", "left_anti")
    one = whole.groupBy("content").agg(F.first("t").alias("t"))
    minhash = A.minhash_udf(n=PLACES)("t")
    simhash = A.simhash_udf()("t") if with_simhash else F.lit(None).cast("long")
    sketched = one.select("content", simhash.alias("simhash"), minhash.alias("m"), F.length("t").alias("n_chars"))
    return sketched.select("content", "simhash", F.when(F.exists("m", lambda x: x != 0), F.col("m")).alias("minhash"), "n_chars"), named


def similarity(a: str, b: str) -> Column:
    """How alike two signatures (structs content, simhash, minhash) are, from 0 to 1."""
    x, y = (lambda c, s=s: F.col(f"{s}.{c}") for s in (a, b))
    by_minhash = F.when(x("minhash").isNotNull() & y("minhash").isNotNull(), V.minhash_similarity(x("minhash"), y("minhash")))
    by_simhash = F.when(x("simhash").isNotNull() & y("simhash").isNotNull(), V.simhash_similarity(x("simhash"), y("simhash"), BITS))
    return F.when(x("content") == y("content"), 1.0).otherwise(F.coalesce(by_minhash, by_simhash, F.lit(0.0)))


def bands(n: int, at_least: float) -> list[tuple[int, int]]:
    """Beginnings and lengths of d + 1 bands of n places, of which d may differ at this similarity."""
    d = _differ(n, at_least)
    ends = [round(n * k / (d + 1)) for k in range(d + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _differ(n: int, at_least: float) -> int:
    """Places of n that may differ at this similarity."""
    return int(n * (1 - at_least) + 1e-9)


def _minhash_keys(at_least: float) -> Column:
    return F.array(*(F.xxhash64(F.lit(k), *(F.get("minhash", F.lit(start + i)) for i in range(n))) for k, (start, n) in enumerate(bands(PLACES, at_least))))


def _simhash_keys(at_least: float) -> Column:
    return F.array(*(F.xxhash64(F.lit(-1 - k), F.shiftrightunsigned("simhash", start).bitwiseAND(F.lit((1 << n) - 1))) for k, (start, n) in enumerate(bands(BITS, at_least))))


#: Bits of each place of a MinHash that candidates are tested by.
PLANES = 4


def _planes() -> list[Column]:
    """``PLANES`` longs of a MinHash: the lowest bits of all its places, the next ones, and so on."""
    bit = lambda i, k: F.shiftleft(F.shiftright(F.get("minhash", F.lit(i)), k).bitwiseAND(F.lit(1).cast("long")), i)
    return [sum((bit(i, k) for i in range(1, PLACES)), bit(0, k)).alias(f"p{k}") for k in range(PLANES)]


def pairs(store: DataFrame, at_least: float = 0.85) -> DataFrame:
    """a, b, similarity of contents (a < b) of a store that are at least this alike. Contents are distinct, so copies of one aren't paired.

    Contents meet as numbers with a few bits of each place: places that are equal have equal bits, so whoever differs in too many bits
    isn't alike. Keys of one content only don't enter the join, and whole signatures are looked up for the pairs that are left.
    """
    numbered = saved(store.select(F.monotonically_increasing_id().alias("n"), "content", "simhash", "minhash"), "numbered")
    by_minhash = saved(numbered.where("minhash IS NOT NULL").select("n", *_planes(), _minhash_keys(at_least).alias("keys")), "planes")
    by_simhash = numbered.where("simhash <> 0").select("n", F.col("simhash").alias("p0"), F.col("minhash").isNull().alias("bare"), _simhash_keys(at_least).alias("keys"))

    def joined(keyed: DataFrame, planes: int, left: Column, once: Column) -> DataFrame:
        each = saved(keyed.withColumn("key", F.explode("keys")).drop("keys"), "keyed")
        several = each.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
        met = saved(each.join(several.select("key"), "key", "left_semi"), "met")
        # All conditions are the join's own, so that only pairs become rows.
        test = (F.col("x.key") == F.col("y.key")) & once
        for k in range(planes):
            test &= F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) <= _differ(PLACES, at_least)
        return met.where(left).alias("x").join(met.alias("y"), test).select(F.col("x.n").alias("x"), F.col("y.n").alias("y"))

    less, every = F.col("x.n") < F.col("y.n"), F.lit(True)
    apart = (F.col("x.n") != F.col("y.n")) & (~F.col("y.bare") | less)
    both = joined(by_minhash, PLANES, every, less).unionByName(joined(by_simhash, 1, F.col("bare"), apart)).distinct()
    side = lambda c, s: numbered.select(F.col("n").alias(c), F.struct("content", "simhash", "minhash").alias(s))
    alike = saved(both, "candidates").join(side("x", "p"), "x").join(side("y", "q"), "y").where(similarity("p", "q") >= at_least)
    return alike.select(F.least("p.content", "q.content").alias("a"), F.greatest("p.content", "q.content").alias("b"), F.round(similarity("p", "q"), 6).alias("similarity"))


def confirmed(found: DataFrame, docs: DataFrame, at_least: float = 0.85, k: int = 5, text: str = "text") -> DataFrame:
    """a, b, similarity of pairs of contents (a, b) whose sets of k-word runs have at least this exact Jaccard similarity.

    Estimates from ``PLACES`` places are off by 0.05 or so; pairs that are found at an estimate of 0.1 less and confirmed here miss few.
    """
    asked = found.select(F.explode(F.array("a", "b")).alias("content")).distinct()
    sets = docs.select(content_sum(text).alias("content"), T.text(text).alias("t")).join(small(asked), "content", "left_semi").dropDuplicates(["content"])
    sets = saved(sets.select("content", A.run_hashes_udf(k)(T.words("t")).alias("s")), "asked-sets")
    side = lambda c: sets.select(F.col("content").alias(c), F.col("s").alias(f"s{c}"))
    exact = found.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(V.jaccard_of_sets(F.col("sa"), F.col("sb")), 6).alias("similarity"))
    return exact.where(F.col("similarity") >= at_least)


def members(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, doc_id, copies: the least document of each content; a_id, b_id, copies: each other document beside its least one)."""
    named = saved(named, "named")
    first = saved(named.groupBy("content").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "contents")
    others = attach(named, first.where("copies > 1"), "content", "copies").where("doc_id <> first")
    return first.withColumnRenamed("first", "doc_id"), others.select(F.col("first").alias("a_id"), F.col("doc_id").alias("b_id"), "copies")
