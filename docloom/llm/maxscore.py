"""Exact top-k search by inner product with MaxScore (operator 9).

Vectors lie in shards of ``SHARD_ROWS`` or more, as one posting list for each
dimension (term) with its least and greatest value.  For a query, a term adds between
a lower and an upper bound in the shard; measured from the lower bounds, all
contributions are at least 0.  Terms are sorted by the width of their bounds.  Those
whose widths together cannot lift a candidate to the k-th best score so far are
non-essential: only essential postings are traversed, then the others are probed, widest
first, for the candidates that can still compete.  Shards' results are merged by score.

Queries go in blocks of ``QUERY_ROWS`` to every shard; a task holds one shard and one
block.  A candidate is passed over only if it can't reach the k-th best score, so
that ties are resolved by id.

Scores are exact: a shard and a block whose products may pass 2**53, where doubles would round them, are worked
off in Python's integers; a score beyond 64 bits is ranked as it is and returned as the nearest long.

Results for odd input: a vector that is null or holds a null, NaN or infinite component
takes no part, as a query or as a candidate; missing components of a shorter vector count
as 0; an empty vector scores 0; a query with fewer candidates than k gets all; rows
with the query's own id are no candidates, and repeated candidate rows each count; rows
with a null id take no part; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import partitions, save

#: Vectors in a shard: between these, with the input. Queries in a block.
SHARD_ROWS, MOST_ROWS, QUERY_ROWS = 4096, 65536, 16384

LARGEST = (1 << 63) - 1

#: Candidates that are scored in full to begin with.
START = 64


def finite_components(vector: str) -> Column:
    """The components as doubles; null where the vector takes no part."""
    c = F.col(vector)
    x = lambda v: v.cast("double")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    return F.when(c.isNotNull() & ~bad, F.transform(c, x))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, ties by id."""
    by_id = np.argsort(ids, kind="stable")
    return by_id[np.argsort(-scores[by_id], kind="stable")][:k]


def search_shard(ids: np.ndarray, postings: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one shard for one query. postings: a row for each term, a column for each vector."""
    ends = query[:, None] * np.stack([postings.min(1), postings.max(1)], 1)
    low, width = ends.min(1), np.abs(ends[:, 1] - ends[:, 0])
    order = np.argsort(width, kind="stable")
    sums = np.cumsum(width[order])  # what the first terms add at most, over their lower bounds
    allowed = np.flatnonzero(ids != own)
    first, rest = allowed[:START], allowed[START:]
    top_ids, top = ids[first], query @ postings[:, first]
    keep = _best(top_ids, top, k)
    top_ids, top = top_ids[keep], top[keep]
    if not len(rest):
        return top_ids, top
    bound = top[-1] if len(top) == k else -np.inf
    cut = int((low.sum() + sums < bound).sum())  # terms before it are non-essential
    essential, probes = order[cut:], order[:cut][::-1]
    reached = low[order[:cut]].sum() + query[essential] @ postings[np.ix_(essential, rest)]
    left = sums[cut - 1] if cut else 0
    for at, term in enumerate(probes):
        alive = reached + left >= bound
        if not alive.all():
            rest, reached = rest[alive], reached[alive]
        reached = reached - low[term] + query[term] * postings[term, rest]
        left = sums[cut - at - 2] if cut - at >= 2 else 0
    all_ids, all_scores = np.concatenate([top_ids, ids[rest]]), np.concatenate([top, reached])
    keep = _best(all_ids, all_scores, k)
    return all_ids[keep], all_scores[keep]


def whole_components(rows: pd.Series, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, with zeros up to ``dims``: as longs, or as Python integers where a double beyond 2**53 is among them."""
    out = np.zeros((len(rows), dims))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    if np.abs(out).max(initial=0) * scale < 1 << 53:
        return np.floor(out * scale).astype(np.int64)
    return np.array([[int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in row] for row in out.tolist()], object)


def in_order(score: int) -> bytes:
    """Bytes that sort like whole numbers of any size: those below zero first, then by length, then by value."""
    raw = abs(score).to_bytes(-(-abs(score).bit_length() // 8), "big")
    out = len(raw).to_bytes(2, "big") + raw
    return b"\1" + out if score >= 0 else b"\0" + bytes(255 - x for x in out)


def _exact(postings: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles, or as Python integers where a sum of products might not be a whole double."""
    most = lambda m: max(abs(int(m.min())), abs(int(m.max())), 1)
    kind = np.float64 if 2 * len(postings) * most(postings) * most(queries) < 1 << 53 else object
    return postings.astype(kind), queries.astype(kind)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other rows for each row where ``queries`` holds."""
    clean = save(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), finite_components(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND v IS NOT NULL"), "vectors")
    rows, asked = clean.count(), clean.where("asks").count()
    held_rows = min(MOST_ROWS, max(SHARD_ROWS, rows // (2 * partitions(vectors.sparkSession))))
    shards, blocks = max(1, -(-rows // held_rows)), max(1, -(-asked // QUERY_ROWS))
    h = F.xxhash64("vec_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = clean.select("vec_id", "v", F.pmod(h, F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    asking = clean.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            dims = max(1, *map(len, vectors.v), *map(len, queries.q))
            ids = vectors.vec_id.to_numpy()
            postings, asked = _exact(np.ascontiguousarray(whole_components(vectors.v, dims, scale).T), whole_components(queries.q, dims, scale))
            for own, q in zip(queries.query_id.tolist(), asked, strict=True):
                found, scores = search_shard(ids, postings, own, q, k)
                out += [(own, int(i), min(max(int(s), -LARGEST - 1), LARGEST), in_order(int(s))) for i, s in zip(found, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "whole"])

    found = held.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long, whole binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("whole"), F.asc("vec_id"))  # bytes sort like the scores
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
