"""Retrieval: BM25, exact dense search, rank fusion, neighbour expansion, reranking.

Statistics cover the whole corpus; section filters act on candidates afterwards.
Query-side tables are sent to tasks in blocks of ``SMALL`` rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from .tables import saved

#: Rows that are broadcast at most; vectors in a shard of dense search; documents that are scored at once.
SMALL, SHARD_ROWS, SCORED_ROWS = 200_000, 8192, 500

# Fixed values of the BM25 formula, and of rank fusion.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def small(df: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= (SMALL if most is None else most) else df


def term_stats(df: DataFrame, totals: DataFrame) -> DataFrame:
    """term, df, idf of terms with their frequencies; negative idf becomes ``EPSILON`` times the average of all raw ones."""
    raw = df.crossJoin(F.broadcast(totals)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # totals: one row
    mean = raw.agg(F.round(F.avg("raw"), 9).alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def vocabulary(docs: DataFrame, text: str = "text", tokens: Callable[[str], Column] = T.search_tokens) -> DataFrame:
    """term, df, length: of each term, and under the null term the number of documents and of all their tokens; one pass, counted before it is shuffled."""
    t = docs.select(tokens(text).alias("t"))
    each = t.select(F.size("t").cast("long").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length"))


def _scorer(asked: list, query_type: pa.DataType, k: int, avgdl: float):
    """Scores batches of documents (id, part, t) for the queries of ``asked`` (query_id, part, term, qtf, idf); the ``k`` best of each batch for each query go on.
    A query with a part is for documents of that part only."""
    terms = sorted({r.term for r in asked})
    at = {t: i for i, t in enumerate(terms)}
    names = sorted({r.query_id for r in asked}, key=str)
    query = {q: i for i, q in enumerate(names)}
    rows = sorted((at[r.term], query[r.query_id], float(r.qtf), r.idf) for r in asked)
    own_term, own_query, qtf, own_idf = (np.array(c) for c in zip(*rows, strict=True))
    wanted = {r.query_id: r.part for r in asked}
    parts = {p: i for i, p in enumerate(sorted({p for p in wanted.values() if p is not None}))}
    own_part = np.array([parts.get(wanted[q], -1) for q in names])
    first = np.searchsorted(own_term, np.arange(len(terms) + 1))
    idf = own_idf[first[:-1]]

    def best(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column("t")
        dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        code = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(terms, pa.string())), -1).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(dl)), dl)[code >= 0]
        pair, tf = np.unique(doc * len(terms) + code[code >= 0], return_counts=True)
        doc, term = pair // len(terms), pair % len(terms)
        gain = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
        times = first[term + 1] - first[term]
        place = np.repeat(first[term], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        doc, gain = np.repeat(doc, times), np.repeat(gain, times)
        if parts:
            lies = pc.fill_null(pc.index_in(b.column("part"), value_set=pa.array([*parts], pa.string())), -2).to_numpy(zero_copy_only=False)
            fits = (own_part[own_query[place]] == -1) | (own_part[own_query[place]] == lies[doc])
            doc, gain, place = doc[fits], gain[fits], place[fits]
        key, back = np.unique(doc * len(names) + own_query[place], return_inverse=True)
        score = np.round(np.bincount(back, gain * qtf[place], len(key)), 6)
        key, score = key[score > 0], score[score > 0]
        doc, asker = key // len(names), key % len(names)
        order = np.lexsort((b.column("id").to_numpy(zero_copy_only=False)[doc], -score, asker))
        asker, doc, score = asker[order], doc[order], score[order]
        rank = np.arange(len(asker)) - np.searchsorted(asker, asker)
        keep = rank < k
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in asker[keep]], query_type), b.column("id").take(pa.array(doc[keep])), pa.array(score[keep], pa.float64())], ["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, SCORED_ROWS):
                yield best(b.slice(start, SCORED_ROWS))

    return run


def bm25(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", query: str = "text", doc_id: str = "doc_id", text: str = "text", where: Column | None = None, within: tuple[str, str] | None = None) -> DataFrame:
    """query_id, id, score, rank of the ``k`` best documents with a positive score.

    ``where`` filters documents as candidates; ``within`` names a column of the queries and one of the documents (strings) that must agree, for queries that have
    a value there.  The statistics stay those of all documents.  Documents are scored where they are read, for blocks of
    queries with at most ``SMALL`` terms, and only the best of each batch are shuffled; one pass before that counts terms.
    Null ids are no documents or queries.
    """
    counted = saved(vocabulary(docs, text), "vocabulary")
    totals = counted.where("term IS NULL").select(F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    total = totals.first()
    kinds = dict(queries.select(F.col(query_id).alias("query_id")).dtypes)["query_id"], dict(docs.select(F.col(doc_id).alias("id")).dtypes)["id"]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if total is None:
        return ranked(docs.sparkSession.createDataFrame([], schema), k)
    part = lambda at: F.lit(None).cast("string") if within is None else F.col(within[at]).cast("string")
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), part(0).alias("part"), F.explode(T.search_tokens(query)).alias("term")).groupBy("query_id", "part", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = saved(asked.join(term_stats(counted.where("term IS NOT NULL").select("term", "df"), totals), "term").select("query_id", "part", "term", "qtf", "idf"), "asked")
    blocks = -(-asked.count() // SMALL)
    candidates = F.col(doc_id).isNotNull() if where is None else F.col(doc_id).isNotNull() & where
    query_type = to_arrow_type(asked.schema["query_id"].dataType)
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if rows:
            parts = {r.part for r in rows}
            own = candidates if None in parts else candidates & part(1).isin(*parts)  # so that the scan reads the asked parts only
            held = docs.where(own).select(F.col(doc_id).alias("id"), part(1).alias("part"), T.search_tokens(text).alias("t"))
            best = held.mapInArrow(_scorer(rows, query_type, k, total.avgdl), schema)
            found = best if found is None else found.unionByName(best)
    return ranked(docs.sparkSession.createDataFrame([], schema) if found is None else found, k)


def ranked(scored: DataFrame, k: int | None = None, by: str = "score") -> DataFrame:
    """Ranks from 1 by falling score, then by id; at most ``k`` for each query."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), F.asc("id"))))
    return out if k is None else out.where(F.col("rank") <= k)


def dense(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query: str = "vector", vec_id: str = "id", vector: str = "vector", own: bool = False, unlike: Sequence[str] = ()) -> DataFrame:
    """query_id, id, score (cosine), rank of the ``k`` nearest vectors, exactly; without ``own`` a query's own id is left out.

    ``unlike`` are columns of both tables; vectors that equal a query in one of them, or lack it, are left out before the nearest are kept.

    Vectors lie in shards of about ``SHARD_ROWS``; every query goes to every shard, whose best are merged.
    """
    held = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"), *unlike).where(F.col("v").isNotNull())
    shards = max(1, -(-held.count() // SHARD_ROWS))
    held = held.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("q"), *unlike).where(F.col("q").isNotNull()).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        unit = lambda rows: (m := np.stack(rows.to_numpy()).astype(np.float64)) / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
        ids, v, out = a["id"].to_numpy(), unit(a.v), []
        held, known = [a[c].to_numpy() for c in unlike], [a[c].notna().to_numpy() for c in unlike]
        for q, x, *not_these in zip(b.query_id, unit(b.q), *[b[c] for c in unlike], strict=True):
            s = np.round(v @ x, 6)
            allowed = np.full(len(ids), True) if own else ids != q
            for values, has, value in zip(held, known, not_these, strict=True):
                allowed &= has & (values != value) & pd.notna(value)
            places = np.flatnonzero(allowed)
            keep = places[np.lexsort((ids[places], -s[places]))[:k]]
            out.append(pd.DataFrame({"query_id": q, "id": ids[keep], "score": s[keep]}))
        return pd.concat(out)

    found = held.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(search, "query_id long, id long, score double")
    return ranked(found, k)


def rrf(lists: DataFrame, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Fuse ranked lists (query_id, list, is_dense, weight, rank, id): lexical lists add their shares, dense ones their mean over those that hold the id."""
    share = F.col("weight") / (k + F.col("rank"))
    fused = lists.groupBy("query_id", "id").agg(F.round(F.coalesce(F.sum(F.when(~F.col("is_dense"), share)), F.lit(0.0)) + F.coalesce(F.avg(F.when(F.col("is_dense"), share)), F.lit(0.0)), 9).alias("score"))
    return ranked(fused, top)


def neighbours(hits: DataFrame, chunks: DataFrame, n: int = 1, tables: bool = True) -> DataFrame:
    """Expand hits (query_id, rank, id) with the chunks (id, file, chunk_index, is_table, text) around them.

    A hit gets its file's chunks within ``n`` places and, if it is a table, its whole run of
    table chunks; a chunk goes to the first hit that reaches it, and a hit left with none keeps itself.
    """
    runs = table_runs(chunks)
    at = hits.select("query_id", "rank", F.col("id").alias("hit")).join(runs.withColumnRenamed("id", "hit").select("hit", "file", F.col("chunk_index").alias("at"), F.col("run").alias("hit_run")), "hit")
    near = at.withColumn("chunk_index", F.explode(F.sequence(F.col("at") - n, F.col("at") + n))).join(runs.select("file", "chunk_index", "id"), ["file", "chunk_index"]).select("query_id", "rank", "hit", "id")
    if tables:
        same = at.where("hit_run IS NOT NULL").join(runs.select("file", F.col("run").alias("hit_run"), "id"), ["file", "hit_run"]).select("query_id", "rank", "hit", "id")
        near = near.unionByName(same).distinct()
    first = near.withColumn("claim", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank"))).where("claim = 1").drop("claim")
    left_out = at.select("query_id", "rank", "hit").join(first, ["query_id", "rank", "hit"], "left_anti").withColumn("id", F.col("hit"))
    both = first.unionByName(left_out).join(chunks.select("id", "chunk_index", "text"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text")))
    return both.groupBy("query_id", "rank", "hit").agg(ordered.alias("c")).select("query_id", "rank", F.col("hit").alias("id"), F.array_join(F.transform("c", lambda c: c["text"]), "\n…\n").alias("text"), F.transform("c", lambda c: c["id"]).alias("expanded_from"))


def table_runs(chunks: DataFrame) -> DataFrame:
    """``chunks`` with run: a number for each unbroken run of table chunks in a file, null for others."""
    along = Window.partitionBy("file", "is_table").orderBy("chunk_index")
    return chunks.withColumn("run", F.when(F.col("is_table"), F.col("chunk_index") - F.row_number().over(along)))


def near_duplicates(pool: DataFrame, at_least: float = 0.9, k: int = 5) -> DataFrame:
    """Thin out a query's pool (query_id, rank, id, version_rank, text) greedily, in rank order.

    A hit that is similar to one already kept is absorbed; if its version is newer it takes the kept one's place.
    """

    def greedy(pool: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for row in pool.sort_values("rank").itertuples():
            own = set(row.s)
            for i, (other, old) in enumerate(kept):
                if own and other and len(own & other) / len(own | other) >= at_least:
                    if row.version_rank > old.version_rank:
                        kept[i] = (own, row)
                    break
            else:
                kept.append((own, row))
        return pd.DataFrame({"query_id": [r.query_id for _, r in kept], "rank": range(1, len(kept) + 1), "id": [r.id for _, r in kept]})

    return pool.select("query_id", "rank", "id", "version_rank", T.shingles("text", k).alias("s")).groupBy("query_id").applyInPandas(greedy, "query_id long, rank int, id long")


def rerank(candidates: DataFrame, top: int, scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None) -> DataFrame:
    """Order candidates (query_id, rank, id, query, text) by a scorer of (query, text) pairs, ties by rank; without one the first ``top`` stay as they are."""
    if scorer is None:
        return candidates.where(F.col("rank") <= top)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            yield pd.Series(scorer([*zip(queries, texts, strict=True)]), dtype="float64")

    scored = candidates.withColumn("rerank_score", score("query", "text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("rank"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def token_overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """A deterministic scorer: the share of a query's words that a text has."""
    out = []
    for q, t in pairs:
        a, b = set((q or "").lower().split()), set((t or "").lower().split())
        out.append(round(len(a & b) / len(a), 6) if a else 0.0)
    return out


def expand_queries(queries: DataFrame, n: int = 3, paraphrase: Callable[[list[str]], list[list[str]]] | None = None) -> DataFrame:
    """query_id, n, text: each query and at most ``n`` paraphrases, without those that differ in letter case only; without a model the query alone."""
    if paraphrase is None:
        return queries.select("query_id", F.lit(0).alias("n"), "text")

    @F.pandas_udf("array<string>")
    def write(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(x) for x in paraphrase(texts.tolist())])

    every = F.concat(F.array("text"), write("text"))
    distinct = T.let(every, lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, F.lower), F.lower(x)) == i + 1))
    return queries.withColumn("every", F.slice(distinct, 1, n + 1)).select("query_id", F.posexplode("every").alias("n", "text"))


def context(hits: DataFrame, limit: int = 8, width: int = 3000, match: str | None = None) -> DataFrame:
    """Numbered context of each query from hits (query_id, rank, file, loc, score, text).

    Long texts are cut around the place that the column ``match`` names; without it their start is taken.
    """
    part = F.left(T.text("text"), F.lit(width)) if match is None else T.snippet("text", T.text(match), width)
    top = hits.where(F.col("rank") <= limit)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("file"), F.lit(", "), F.col("loc"), F.lit("\n"), part)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n_sources"))
