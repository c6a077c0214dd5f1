"""Evaluation of retrieval, and training data drawn from answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .search import small
from .tables import numbered, saved


def verbatim(queries: DataFrame, docs: DataFrame, words: int = 6) -> DataFrame:
    """query_id, id of the documents whose text holds a query's text.

    Candidates share the run of whole words behind a query's first word; queries with too few words are compared with every
    document, being a stated set that is held in one broadcast table.
    """
    asked = queries.select("query_id", F.col("text").alias("q"), F.split("text", r"\s+").alias("w"))
    own = F.xxhash64(*(F.get("w", F.lit(1 + j)) for j in range(words)))
    keyed = asked.where(F.size("w") >= words + 2).select("query_id", "q", own.alias("key"))
    runs = F.array_distinct(T.let(F.split("text", r"\s+"), lambda w: T.runs(w, words, F.xxhash64, first=1)))
    found = docs.select(F.col("doc_id").alias("id"), F.explode(runs).alias("key")).join(small(keyed), "key").select("query_id", "id", "q").distinct()
    long = found.join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")), "id").where(F.contains("t", "q")).select("query_id", "id")
    short = asked.where(F.size("w") < words + 2).select("query_id", "q")
    return long.unionByName(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(small(short), F.contains("t", "q")).select("query_id", "id"))


def metrics(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: n queries with a truth, recall_at_k, mrr, misses."""
    best = truth.join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("rank").isNull()).alias("misses"))


def judged(scores: DataFrame, low: int = 5) -> DataFrame:
    """One row from a judge's scores (0 to 10): n, mean, low (scores of at most ``low``)."""
    return scores.agg(F.count("score").alias("n"), F.round(F.avg("score"), 3).alias("mean"), F.count_if(F.col("score") <= low).alias("low"))


def _steps_to_other(placed: DataFrame, column: str, name: str) -> DataFrame:
    """``placed`` (project, i, n, ...) with how many steps around its circle lead to the next answer that differs in a column; n if none does.

    Answers that equal the next one take over its steps, which doubles what is known in each round.
    """
    step = lambda by: F.pmod(F.col("i") + by, F.col("n")).alias("i2")
    behind = placed.select("project", F.col("i").alias("i2"), F.col(column).alias("other"))
    known = placed.select("project", "i", "n", column, step(F.lit(1))).join(behind, ["project", "i2"])
    known = saved(known.select("project", "i", "n", F.lit(1).cast("long").alias("steps"), (~F.col(column).eqNullSafe(F.col("other"))).alias("found")), "steps")
    while not (left := known.where("NOT found AND steps < n")).isEmpty():
        to = known.select("project", F.col("i").alias("i2"), F.col("steps").alias("more"), F.col("found").alias("there"))
        further = left.select("project", "i", "n", "steps", step(F.col("steps"))).join(to, ["project", "i2"]).select("project", "i", "n", (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("found"))
        known = saved(known.where("found OR steps >= n").unionByName(further), "steps")
    return placed.join(known.select("project", "i", F.when(F.col("found") & (F.col("steps") < F.col("n")), F.col("steps")).otherwise(F.col("n")).alias(name)), ["project", "i"])


def triples(answers: DataFrame) -> DataFrame:
    """project, pos, anchor, positive, negative from answers (project, pos, remark, snippet, file; one row for each project and pos).

    The negative is the snippet of the nearest answer behind, around the circle of the project's
    answers with a snippet, that has another snippet and another file; answers without such a one have no row.

    Answers are numbered without a task that holds a project.  A search goes from an answer over whole runs of equal files or equal snippets.
    """
    usable = answers.where((T.strip(T.text("snippet")) != "") & F.col("project").isNotNull()).select("project", F.col("pos").cast("long").alias("pos"), "remark", "snippet", "file")
    usable = numbered(usable, ["project", "pos", "snippet", "file", "remark"])
    circles = usable.groupBy("project").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = saved(usable.join(small(circles), "project").withColumn("i", F.col("place") - F.col("first")).drop("place", "first"), "answers")
    placed = saved(_steps_to_other(_steps_to_other(placed, "snippet", "to_snippet"), "file", "to_file"), "answers")
    own = placed.select("project", "i", "n", "snippet", "file", F.greatest("to_snippet", "to_file").alias("steps"))
    there = placed.select("project", F.col("i").alias("j"), F.col("snippet").alias("negative"), F.col("file").alias("other"), F.col("to_snippet").alias("over_snippet"), F.col("to_file").alias("over_file"))
    chosen = None
    open_ = saved(own.where("steps < n"), "open")
    while not open_.isEmpty():
        met = saved(open_.withColumn("j", F.pmod(F.col("i") + F.col("steps"), F.col("n"))).join(there, ["project", "j"]), "met")
        same_file, same_snippet = F.col("other").eqNullSafe(F.col("file")), F.col("negative") == F.col("snippet")
        found = met.where(~same_file & ~same_snippet).select("project", "i", "negative")
        chosen = found if chosen is None else chosen.unionByName(found)
        over = F.greatest(F.when(same_file, F.col("over_file")).otherwise(0), F.when(same_snippet, F.col("over_snippet")).otherwise(0))
        open_ = saved(met.where(same_file | same_snippet).select("project", "i", "n", "snippet", "file", (F.col("steps") + over).alias("steps")).where("steps < n"), "open")
    if chosen is None:
        return placed.select("project", "pos", F.col("remark").alias("anchor"), F.col("snippet").alias("positive"), F.col("snippet").alias("negative")).where(F.lit(False))
    return placed.join(chosen, ["project", "i"]).select("project", "pos", F.col("remark").alias("anchor"), F.col("snippet").alias("positive"), "negative")
