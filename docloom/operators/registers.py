"""Registers drawn from reviewed answers: gaps, changes, reviews, merges, contradictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .tables import numbered

PROPOSED, ACCEPTED, EDITED, REJECTED = "proposed", "accepted", "edited", "rejected"


def natural_order(number: str = "number") -> list[Column]:
    """Numbers that are strings, by length and then by value."""
    return [F.length(number), F.col(number)]


def renumber(remarks: DataFrame) -> DataFrame:
    """The k-th remark with the same number (k from 2, in order of ``pos``) becomes ``number.k``."""
    k = F.row_number().over(Window.partitionBy("number").orderBy("pos"))
    return remarks.withColumn("k", k).withColumn("number", F.when(F.col("k") > 1, F.concat_ws(".", "number", F.col("k").cast("string"))).otherwise(F.col("number"))).drop("k")


def pending(remarks: DataFrame, answers: DataFrame) -> DataFrame:
    """Remarks (number, text) that have no answer to keep.

    An answer is kept if its remark is unchanged (white space and letter case aside, or empty before) and it is
    accepted or edited, or not rejected and not empty.
    """
    same = (F.lower(T.squeeze("remark")) == F.lower(T.squeeze("text"))) | (T.strip(T.text("remark")) == "")
    good = F.col("status").isin(ACCEPTED, EDITED) | ((F.col("status") != REJECTED) & (T.strip(T.text("answer")) != ""))
    return remarks.join(answers.select("number", "remark", "status", "answer"), "number", "left").where(~F.coalesce(same & good, F.lit(False))).select("number", "text")


def merge(remarks: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """number, answer, status, origin of stored and fresh answers put together, in order of the remarks and leftovers behind.

    Stored accepted or edited answers win; a stored rejected one stays only without a fresh one; else the fresh one does.
    """
    both = stored.select("number", F.struct("answer", "status").alias("old")).join(fresh.select("number", F.struct("answer", "status").alias("new")), "number", "full_outer")
    keep_old = F.col("new").isNull() | F.coalesce(F.col("old.status").isin(ACCEPTED, EDITED), F.lit(False))
    one = both.select("number", F.when(keep_old, F.col("old")).otherwise(F.col("new")).alias("a"), F.when(keep_old, "stored").otherwise("fresh").alias("origin"))
    placed = one.join(remarks.select("number", "pos"), "number", "left")
    out = placed.select("number", "a.answer", "a.status", "origin", "pos")
    order = [F.col("pos").asc_nulls_last(), *natural_order(), "origin", "answer", "status"]
    return numbered(out, order).select("number", "answer", "status", "origin", F.col("place").cast("int").alias("place"))


def gaps(answers: DataFrame) -> DataFrame:
    """number, kind, human, need, volume of each thing an answer lacks; an unsupported answer without any needs a source."""
    stated = F.when(T.strip(T.text("missing_data")) != "", F.array(T.strip(T.text("missing_data")))).otherwise(F.array().cast("array<string>"))
    listed = F.filter(F.transform(F.coalesce("attachments", F.array().cast("array<string>")), T.strip), lambda x: x != "")
    need = F.concat(stated, listed)
    need = F.when((F.size(need) == 0) & F.coalesce("low_support", F.lit(False)), T.array_of("Ответ не подтверждён источниками")).otherwise(need)
    each = answers.select("number", F.coalesce("oos_volume", F.lit("")).alias("volume"), F.explode(need).alias("need"))
    return each.select("number", T.gap_kind("need").alias("kind"), T.gap_kind("need", human=True).alias("human"), "need", "volume")


def gaps_by_kind(rows: DataFrame, numbers: int = 14, volumes: int = 3) -> DataFrame:
    """kind, human, n, n_remarks, numbers (the first ``numbers`` in natural order), volumes, example; ``n`` falling."""
    listed = F.transform(F.slice(F.array_sort(F.collect_set(F.struct(F.length("number").alias("l"), F.col("number").alias("v")))), 1, numbers), lambda x: x["v"])
    in_volumes = F.slice(F.array_sort(F.filter(F.collect_set("volume"), lambda v: v != "")), 1, volumes)
    example = F.min_by("need", F.struct(F.length("number"), "number", "need"))
    out = rows.groupBy("kind", "human").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("number").alias("n_remarks"), F.array_join(listed, ", ").alias("numbers"), F.array_join(in_volumes, ", ").alias("volumes"), example.alias("example"))
    return out


def changes(answers: DataFrame) -> DataFrame:
    """number, location, was, shall, status of each answer that is not rejected and changes something."""
    filled = lambda *cs: reduce(lambda a, b: F.coalesce(a, b), [F.nullif(T.strip(T.text(c)), F.lit("")) for c in cs])
    shall = filled("edit_shall", "correction")
    rows = answers.where((F.col("status") != REJECTED) & (filled("edit_shall", "correction", "edit_was").isNotNull()))
    return rows.select("number", F.coalesce(filled("edit_location", "oos_volume"), F.lit("—")).alias("location"), F.coalesce(filled("edit_was"), F.lit("—")).alias("was"), F.coalesce(shall, F.lit("—")).alias("shall"), "status")


def review_stats(answers: DataFrame) -> DataFrame:
    """status, n, flagged (answers without support) of each status, and a total (null)."""
    return answers.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("low_support", F.lit(False))).alias("flagged"))


def to_export(answers: DataFrame) -> DataFrame:
    """Accepted and edited answers; all that are not rejected if there are none."""
    reviewed = answers.where(F.col("status").isin(ACCEPTED, EDITED))
    return answers.where(F.col("status") != REJECTED) if reviewed.isEmpty() else reviewed


def answer_rows(answers: DataFrame) -> DataFrame:
    """number, remark, answer, marks of each answer as a report shows it."""
    marks = F.concat_ws(" ", F.when(F.col("status") == PROPOSED, "⚠НЕ ПРОВЕРЕН"), F.when(F.col("status") == REJECTED, "✗ОТКЛОНЁН"), F.when(F.coalesce("low_support", F.lit(False)), "⚠БЕЗ ОПОРЫ"))
    return answers.select("number", "remark", T.final_answer("user_answer", "answer").alias("answer"), marks.alias("marks"))


def used_sources(answers: DataFrame) -> DataFrame:
    """number, n_matched, unverified, confidence: sources an answer names among those it was given; without any, confidence is low if nothing was found or claims are unsupported."""
    matched = F.size(F.filter("sources", lambda s: F.array_contains("used", s)))
    low = (F.size("sources") == 0) | F.coalesce("unsupported", F.lit(False))
    return answers.select("number", matched.alias("n_matched"), (matched == 0).alias("unverified"), F.when(low, "low").otherwise(F.col("confidence")).alias("confidence"))


def contradictions(values: DataFrame, more_than: int = 3) -> DataFrame:
    """unit, n_values, values of units with over ``more_than`` different values; values (unit, value), commas as points and units in lower case."""
    v = values.select(F.lower("unit").alias("unit"), F.replace("value", F.lit(","), F.lit(".")).alias("value")).distinct()
    return v.groupBy("unit").agg(F.count(F.lit(1)).alias("n_values"), F.array_join(F.array_sort(F.collect_list("value")), "|").alias("values")).where(F.col("n_values") > more_than)


def unsupported(pairs: DataFrame, extract, at_most: int = 8) -> DataFrame:
    """Pairs (id, source, answer) whose answer has extracted values that the source lacks, with at most ``at_most`` of them."""
    only = F.array_except(extract("answer"), extract("source"))
    return pairs.select("id", only.alias("o")).where(F.size("o") > 0).select("id", F.size("o").cast("long").alias("n"), F.array_join(F.slice(F.array_sort("o"), 1, at_most), "|").alias("values"))


def indicator_variants(found: DataFrame, prefer: DataFrame, sources: int = 8) -> DataFrame:
    """key, value, n, sources, place, conflict of values (key, value, section, file) found for indicators.

    Variants are ordered by the best place of their sections in ``prefer`` (key, section, ord), then by count; several are a conflict.
    """
    ranked = found.join(F.broadcast(prefer), ["key", "section"], "left")  # prefer: a fixed dimension
    v = ranked.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("file")), 1, sources), "|").alias("sources"), F.coalesce(F.min("ord"), F.lit(99)).alias("best"))
    by = Window.partitionBy("key")
    return v.select("key", "value", "n", "sources", F.row_number().over(by.orderBy("best", F.desc("n"), "value")).alias("place"), (F.count(F.lit(1)).over(by) > 1).alias("conflict"))


def dispersion_max(lines: DataFrame) -> DataFrame:
    """code, name, share of lines (n, line) of a dispersion report: for each code the greatest of the lines' first non-integer shares of (0, 100]."""
    code = F.regexp_extract(F.concat(F.lit(" "), T.text("line")), r"[^\d](\d{4})(?:[^\d]|$)", 1)
    tail = F.regexp_replace(T.text("line"), r"^.*?(?:^|[^\d])\d{4}(?=[^\d]|$)", "")
    name = F.trim(F.regexp_extract(tail, r"[А-Яа-яЁёA-Za-z][А-Яа-яЁёA-Za-z \-]*", 0))
    numbers = F.transform(F.regexp_extract_all(tail, F.lit(r"\d+(?:[.,]\d+)?"), 0), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    share = F.get(F.filter(numbers, lambda x: (x > 0) & (x <= 100) & (x != F.floor(x))), F.lit(0))
    rows = lines.select("n", code.alias("code"), name.alias("name"), share.alias("share")).where("code <> '' AND NOT coalesce(try_cast(code AS int) BETWEEN 1900 AND 2100, false) AND share IS NOT NULL")
    return rows.groupBy("code").agg(F.max_by("name", F.struct("share", -F.col("n"))).alias("name"), F.max("share").alias("share"), (F.max("share") > 1).alias("exceeds"))


def validate_codes(rows: DataFrame) -> DataFrame:
    """n, status of rows (n, code): no code, bad format, duplicate, or ok."""
    code = T.strip(T.text("code"))
    repeated = F.count(F.lit(1)).over(Window.partitionBy("code")) > 1
    return rows.select("n", F.when(code == "", "no code").when(~code.rlike(r"^\d{4}$"), "format").when(repeated, "duplicate").otherwise("ok").alias("status"))


def best_chapter(edits: DataFrame, chapters: DataFrame) -> DataFrame:
    """number, chapter: for each edit (number, words) the chapter (chapter, stems) with most of its six-letter stems among the words' beginnings; the first on ties, null without any."""
    stems = chapters.select("chapter", F.explode("stems").alias("stem"))
    words = edits.select("number", F.explode(F.array_distinct(F.transform(F.filter("words", lambda w: F.length(w) >= 6), lambda w: F.left(w, F.lit(6))))).alias("stem"))
    score = words.join(F.broadcast(stems), "stem").groupBy("number", "chapter").agg(F.count(F.lit(1)).alias("score"))  # stems: titles of one outline
    best = score.groupBy("number").agg(F.min_by("chapter", F.struct(-F.col("score"), "chapter")).alias("chapter"))
    return edits.select("number").join(best, "number", "left")
