"""A keyed memory of questions and answers across projects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Memory (project, number, remark, answer, retracted) with incoming records (project, number, remark, answer), and changed.

    A retracted record stays retracted under the same answer and comes back under another; new keys are added.
    """
    key = ["project", "number"]
    both = stored.select(*key, F.struct("remark", "answer", "retracted").alias("old")).join(incoming.select(*key, F.struct("remark", "answer").alias("new")), key, "full_outer")
    same = F.coalesce(F.col("old.retracted"), F.lit(False)) & (F.col("old.answer") == F.col("new.answer"))
    write = F.col("new").isNotNull() & ~F.coalesce(same, F.lit(False))
    pick = lambda c: F.when(write, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return both.select(*key, pick("remark"), pick("answer"), F.when(write, False).otherwise(F.coalesce("old.retracted", F.lit(False))).alias("retracted"), write.alias("changed"))


def retract(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Memory with the records of ``keys`` (project, number) retracted."""
    hit = keys.select("project", "number").distinct().withColumn("_hit", F.lit(True))
    return stored.join(hit, ["project", "number"], "left").withColumn("retracted", F.coalesce("_hit", "retracted", F.lit(False))).drop("_hit")


#: Rows and words in a shard of a similarity search at most, on average; pairs that are counted at once.
SHARD_ROWS, SHARD_WORDS, COUNTED = 16_384, 1 << 20, 1 << 20


def _nearest(k: int, at_least: float):
    """The ``k`` best memories of a shard for each query of a shard, by counts of common words in blocks of ``COUNTED`` pairs."""

    def search(q: pa.Table, m: pa.Table) -> pa.Table:
        nq, nm = (pc.list_value_length(t["t"]).to_numpy().astype(np.int64) for t in (q, m))
        words = pa.chunked_array([*pc.list_flatten(q["t"]).chunks, *pc.list_flatten(m["t"]).chunks], pa.string()).combine_chunks().dictionary_encode()
        code = words.indices.to_numpy()
        asked, held = code[: nq.sum()], code[nq.sum() :]
        # Memories by word, and where each word's begin; queries' words in order of query.
        by_word = np.repeat(np.arange(len(nm)), nm)[np.argsort(held, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=len(words.dictionary)))])
        upto = np.concatenate([[0], np.cumsum(nq)])
        both = lambda c: pa.chunked_array([*q[c].chunks, *m[c].chunks], q[c].type).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        project, remark = both("project"), both("remark")
        order = np.empty(len(nm), np.int64)
        order[pc.sort_indices(m["id"]).to_numpy()] = np.arange(len(nm))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        step = max(1, COUNTED // max(1, len(nm)))
        for low in range(0, len(nq), step):
            n = min(step, len(nq) - low)
            w = asked[upto[low] : upto[low + n]]
            each = begin[w + 1] - begin[w]
            at = np.repeat(begin[w] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            row = np.repeat(np.repeat(np.arange(n), nq[low : low + n]), each)
            counts = np.bincount(row * len(nm) + by_word[at], minlength=n * len(nm))
            pair = np.flatnonzero(counts)
            c, i, j = counts[pair], low + pair // len(nm), pair % len(nm)
            union = nq[i] + nm[j] - c
            score = (2_000_000 * c + union) // (2 * union)  # millionths, half up
            pi, pj, ri, rj = project[i], project[len(nq) + j], remark[i], remark[len(nq) + j]
            fit = (score / 1e6 >= at_least) & (pi != pj) & (pi >= 0) & (pj >= 0) & (ri != rj)
            i, j, score = i[fit], j[fit], score[fit]
            best = np.lexsort((order[j], -score, i))
            i, j, score = i[best], j[best], score[best]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[top], j[top], score[top]))
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": q["query_id"].take(pa.array(i)), "id": m["id"].take(pa.array(j)), "score": score / 1e6})

    return search


def similar(queries: DataFrame, memory: DataFrame, k: int = 3, at_least: float = 0.12) -> DataFrame:
    """query_id, id, score, rank of the ``k`` memories most like a query's words.

    Queries are (query_id, project, remark), memories (id, project, remark, retracted).  Retracted memories, those of the query's own
    project and those of the same remark are left out.  Both lie in shards; every shard of queries meets every shard of memories in a task, which
    counts words in common and hands on the best, so that no pair is ever a row but the ``k`` best of each two shards.
    """
    side = lambda df, name: df.select(name, "project", F.sha2(F.lower("remark"), 256).alias("remark"), T.memory_tokens("remark").alias("t")).where(F.size("t") > 0)
    q, m = side(queries, "query_id"), side(memory.where(~F.coalesce("retracted", F.lit(False))), "id")

    def shards(df: DataFrame) -> int:
        n = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("words")).first()
        return max(1, -(-n.rows // SHARD_ROWS), -(-n.words // SHARD_WORDS))

    nq, nm = shards(q), shards(m)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = lambda df: df.repartition(nq * nm, "qs", "ms").groupBy("qs", "ms")
    tiles = met(q.withColumn("qs", part("query_id", nq)).withColumn("ms", every(nm))).cogroup(met(m.withColumn("ms", part("id", nm)).withColumn("qs", every(nq))))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    scored = tiles.applyInArrow(_nearest(k, at_least), f"query_id {kind(q, 'query_id')}, id {kind(m, 'id')}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def similar_by_vector(queries: DataFrame, memory: DataFrame, k: int = 3, at_least: float = 0.45) -> DataFrame:
    """As :func:`similar`, by the cosine of vectors (queries and memories with a column vector)."""
    from .search import dense

    m = memory.where(~F.coalesce("retracted", F.lit(False))).withColumn("remark", F.lower("remark"))
    return dense(queries.withColumn("remark", F.lower("remark")), m, k, own=True, unlike=("project", "remark")).where(F.col("score") >= at_least)


def few_shot(hits: DataFrame, remark: int = 300, answer: int = 500) -> DataFrame:
    """query_id, block: past pairs (query_id, rank, remark, answer) as one text."""
    line = F.concat(F.lit("Замечание: "), F.left(T.text("remark"), F.lit(remark)), F.lit("\nОтвет: "), F.left(T.text("answer"), F.lit(answer)))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("block"))


def decide(answers: DataFrame, decisions: DataFrame) -> DataFrame:
    """Answers (number, status, user_answer) after decisions (number, ts, status, user_answer): the latest of each number counts."""
    last = decisions.groupBy("number").agg(F.max_by(F.struct("status", "user_answer"), "ts").alias("d"))
    return answers.join(last, "number", "left").select("number", F.coalesce("d.status", "status").alias("status"), F.coalesce("d.user_answer", "user_answer").alias("user_answer"))


