"""Files and documents: duplicates, versions, sections, inventory, similar contents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrow as A, text as T, vectors as V
from .search import small
from .tables import attach, saved


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, owner (the least id with the same fingerprint), copies, status (done or skipped).

    Owners are aggregated where the documents are, and those of large groups of copies are broadcast (there are few), so that no group meets in one task.
    """
    marked = saved(docs.select(F.col(doc_id).alias("doc_id"), T.fingerprint(text).alias("fingerprint")), "fingerprints")
    owners = saved(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("copies")), "owners")
    return attach(marked, owners, "fingerprint", "copies").select("doc_id", "owner", "copies", F.when(F.col("doc_id") == F.col("owner"), "done").otherwise("skipped").alias("status"))


def unseen(docs: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of the first document of each content that ``index`` (fingerprint) does not hold yet."""
    marked = docs.select(F.col(doc_id).alias("doc_id"), T.fingerprint(text).alias("fingerprint"))
    fresh = marked.join(index.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return fresh.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint")


#: One document in so many is asked which elements are common; elements at most that are held to be so.
ASKED, COMMON = 16, 100_000


def _rarest(common: list, least: float):
    """Batches of sets (id, s) -> id, n, key: of each set's n elements the first ``n - ceil(least * n) + 1`` by the number of documents asked that hold them, then by hash."""
    known = np.array(sorted((r.key, r.holders) for r in common), np.int64).reshape(-1, 2)

    def rarest(b: pa.RecordBatch) -> pa.RecordBatch:
        n = pc.list_value_length(b["s"]).to_numpy(zero_copy_only=False).astype(np.int64)
        row, key = np.repeat(np.arange(len(n)), n), b["s"].flatten().to_numpy(zero_copy_only=False)
        holders = np.zeros(len(key), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known[:, 0], key), len(known) - 1)
            holders = np.where(known[at, 0] == key, known[at, 1], 0)
        order = np.argsort(row * (holders.max(initial=0) + 1) + holders, kind="stable")  # elements of a set are sorted already
        reach = n - np.ceil(n * least).astype(np.int64) + 1
        row, key, place = row[order], key[order], np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
        keep = place < reach[row]
        return pa.RecordBatch.from_arrays([b["id"].take(pa.array(row[keep])), pa.array(n[row[keep]], pa.int32()), pa.array(key[keep])], ["id", "n", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                yield rarest(b.slice(start, 1000))

    return run


def similar_contents(docs: DataFrame, at_least: float = 0.85, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b (a < b), similarity of documents whose k-word shingles have at least this Jaccard similarity.

    Documents with equal sets are one class, by its least id.  Of two similar sets of n elements, the first ``n - ceil(t * n) + 1`` have one in common, in
    any one order for all.  In this order elements that many documents share (notices, headings) come last, so that they are hardly ever asked
    for; which these are is told by one document in ``ASKED``.  Only the first elements are shuffled, and only those of several documents joined on.
    """
    least = at_least - 1e-6  # similarities are rounded
    sets = docs.select(F.col(doc_id).alias("id"), A.run_hashes_udf(k)(T.words(text)).alias("s"))
    # Filtered where it is read again: a filter before would ask for each set twice.
    sets = saved(sets.groupBy("s").agg(F.min("id").alias("id")).select("id", "s"), "sets").where(F.size("s") > 0)
    asked = sets.where(F.pmod(F.xxhash64("id"), F.lit(ASKED)) == 0).select(F.explode("s").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    common = asked.orderBy(F.desc("holders"), "key").limit(COMMON).collect()
    each = saved(sets.mapInArrow(_rarest(common, least), f"id {dict(sets.dtypes)['id']}, n int, key long"), "rarest")
    several = each.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    keyed = saved(each.join(several.select("key"), "key", "left_semi"), "shared")
    a, b = keyed.select(F.col("id").alias("a"), F.col("n").alias("na"), "key"), keyed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("key").alias("key2"))
    close = (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))
    pairs = saved(a.join(b, close).select("a", "b").distinct(), "pairs")
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return full.select("a", "b", F.round(V.jaccard_of_sets(F.col("sa"), F.col("sb")), 6).alias("similarity")).where(F.col("similarity") >= at_least)


def current_versions(files: DataFrame) -> DataFrame:
    """Files (file, section, rank, label, date, base) with group_key, is_current, and the label of the group's current file made current.

    The current file has the greatest rank, then date, then name.
    """
    newest = Window.partitionBy("group_key").orderBy(F.desc("rank"), F.desc(F.coalesce("date", F.lit(""))), F.desc("file"))
    marked = files.withColumn("group_key", F.concat_ws("::", "section", "base")).withColumn("is_current", F.row_number().over(newest) == 1)
    return marked.withColumn("label", F.when(F.col("is_current") & (F.col("label") == "исходная"), "актуальная").otherwise(F.col("label")))


def timeline(files: DataFrame) -> DataFrame:
    """Files in order of date, then name, with their place and the label before them in their section; of files of one name the current one is last."""
    before = Window.partitionBy("section").orderBy(F.coalesce("date", F.lit("")), "file", F.desc("label"))
    return files.select("section", "file", "date", "label", F.lag("label").over(before).alias("previous"), F.row_number().over(before).alias("place"))


def classify(files: DataFrame, keywords: DataFrame, numbers: DataFrame, top: int = 3) -> DataFrame:
    """file, code, score, rank of a file's likely sections.

    ``keywords`` has (code, kind, word): a token scores 5 and half its length, a group of parts that all occur scores 3.
    ``numbers`` has (code, num): the exact number in a "section N.M" adds 6, a parent's 4.  Ties keep the order of ``ord``.
    """
    norm = F.regexp_replace(F.lower(T.text("file")), r"[._\-]+", " ")
    t = F.regexp_extract_all(norm, F.lit("[а-яёa-z0-9]+"), 0)
    bare = F.filter(F.transform(t, lambda x: F.regexp_replace(x, r"\d+$", "")), lambda x: F.length(x) >= 2)
    number = F.nullif(F.regexp_extract(F.lower(T.text("file")), r"(?:под)?раздел[аы]?\s*(?:пд\s*)?(?:№|no|n)?\s*(\d+(?:\.\d+)*)", 1), F.lit(""))
    named = files.select("file", norm.alias("norm"), F.array_distinct(F.concat(t, bare)).alias("t"), number.alias("num"))
    token = F.when((F.col("kind") == "tok") & F.array_contains("t", F.col("word")), 5.0 + 0.5 * F.length("word"))
    part = F.when((F.col("kind") == "sub") & F.forall(F.split("word", " "), lambda p: F.contains("norm", p)), 3.0)
    hits = named.crossJoin(F.broadcast(keywords)).select("file", "code", F.coalesce(token, part).alias("score")).where("score IS NOT NULL")  # keywords: a fixed dimension
    pieces = F.split("num", r"\.")
    probes = named.where("num IS NOT NULL").select("file", F.posexplode(F.transform(F.sequence(F.size(pieces), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(pieces, 1, n), "."))).alias("step", "num"))
    found = probes.join(F.broadcast(numbers), "num").groupBy("file").agg(F.min_by("code", "step").alias("code"), F.min("step").alias("step"))
    scored = hits.unionByName(found.select("file", "code", F.when(F.col("step") == 0, 6.0).otherwise(4.0).alias("score"))).groupBy("file", "code").agg(F.sum("score").alias("score"))
    best = Window.partitionBy("file").orderBy(F.desc("score"), "code")
    return scored.select("file", "code", F.round("score", 1).alias("score"), F.row_number().over(best).alias("rank")).where(F.col("rank") <= top)


def object_type(files: DataFrame, signals: list[str]) -> DataFrame:
    """One row: linear if at least two of the signals occur in the names, else areal."""
    hit = [F.max(F.contains(F.lower("file"), F.lit(s)).cast("int")) for s in signals]
    total = hit[0]
    for h in hit[1:]:
        total = total + h
    return files.agg(F.when(F.coalesce(total, F.lit(0)) >= 2, "линейный").otherwise("площадной").alias("object_type"))


def overview(files: DataFrame, required: DataFrame) -> DataFrame:
    """code, n_files, names, status (present, missing, extra) of required and found sections; files (file, section) of unknown section are left out."""
    present = files.where(F.col("section") != "UNKNOWN").groupBy(F.col("section").alias("code")).agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.array_sort(F.collect_list("file")), "|").alias("names"))
    both = required.select("code", F.lit(True).alias("required")).join(present, "code", "full_outer")
    status = F.when(F.col("n_files").isNull(), "missing").when(F.col("required").isNull(), "extra").otherwise("present")
    return both.select("code", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("names", F.lit("")).alias("names"), status.alias("status"))


def with_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Files (file, section) with a section of their own in ``overrides`` (file, override); UNKNOWN there removes nothing."""
    chosen = F.coalesce(F.nullif(F.col("override"), F.lit("UNKNOWN")), F.col("section"), F.lit("UNKNOWN"))
    return files.join(small(overrides), "file", "left").select("file", chosen.alias("section"))


def source_sections(required: DataFrame, surveys: DataFrame, extra: DataFrame, target: str) -> DataFrame:
    """Codes that answers on ``target`` may draw on: sources of both lists, the target's extras and itself, as far as the lists know them."""
    known = required.select("code").unionByName(surveys.select("code")).distinct()
    wanted = required.where("is_source").select("code").unionByName(surveys.where("is_source").select("code")).unionByName(extra.where(F.col("target") == target).select("code")).unionByName(known.sparkSession.createDataFrame([(target,)], "code string")).distinct()
    return wanted.join(known, "code", "left_semi")


def measure(files: DataFrame, size: Column) -> DataFrame:
    """One row: files, bytes."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those with the same key."""
    return incoming.unionByName(existing.join(incoming.select(key).distinct(), key, "left_anti").select(incoming.columns))


def without_file(chunks: DataFrame, file: str) -> DataFrame:
    return chunks.where(~F.col("file").eqNullSafe(F.lit(file)))
