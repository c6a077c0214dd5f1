"""Entities in texts: terms of dictionaries by an inverted index, and the kinds of things an answer must not make up.

A term is a run of words with fixed separators.  Texts give a row for each run of as many words as some term has, so that texts
and dictionary meet by equality of whole runs in one pass over the texts, and a word that many terms share is no hot key.
No text is sent along with its words, and a dictionary of any size is joined, not looped over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .search import small
from .tables import saved

NOT_WORD = r"[^\p{L}\p{N}_]"

#: Separators are shorter than this in any term; it leaves room for them between the places of two words.
ROOM = 1 << 12


#: Rows of the index that are broadcast at most; a larger one is joined by shuffling the texts' runs of words. Rows of one whose first words are looked for first.
INDEXED, FEW = 1_000_000, 1_000


def term_index(terms: DataFrame) -> DataFrame:
    """The index of terms (alias, code): core (from the first word to the last), size (words), code, t_gap and t_after (the term's own separators before
    and behind). Of terms spelled alike the last code in order of ``ord`` holds, or the greatest without such a column."""
    order = "ord" if "ord" in terms.columns else "code"
    one = terms.select(F.lower("alias").alias("alias"), "code", F.col(order).alias("o")).groupBy("alias").agg(F.max_by("code", "o").alias("code"))
    size = F.size(F.regexp_extract_all("alias", F.lit(rf"{T.WORD}+"), 0))
    cut = one.select("alias", "code", size.alias("size"), F.regexp_extract("alias", rf"^{NOT_WORD}*", 0).alias("t_gap"), F.regexp_extract("alias", rf"{NOT_WORD}*$", 0).alias("t_after")).where("size > 0")
    core = F.substring("alias", F.length("t_gap") + 1, F.length("alias") - F.length("t_gap") - F.length("t_after"))
    return cut.select(core.alias("core"), "size", "code", "t_gap", "t_after")


def placed_runs(texts: DataFrame, sizes: list[int], first: list[str] | None = None) -> DataFrame:
    """n, pos, size, core, gap, after, left of texts (n, text): each run of so many words in lower case with the separators between them, those
    before and behind it, and how many words follow; with ``first``, of runs that begin with one of these words."""
    low = F.lower(T.text("text"))
    found = texts.select("n", F.regexp_extract_all(low, F.lit(rf"{T.WORD}+"), 0).alias("w"), F.split(low, rf"{T.WORD}+", -1).alias("g")).where(F.size("w") > 0)
    ahead = lambda c, k: F.slice(c, k + 1, F.size("w"))
    zipped = F.arrays_zip(*[x for k in range(max(sizes)) for x in (ahead("g", k).alias(f"g{k}"), ahead("w", k).alias(f"w{k}"))], ahead("g", max(sizes)).alias(f"g{max(sizes)}"))
    rows = found.select("n", F.size("w").alias("m"), F.posexplode(zipped).alias("pos", "x"))
    rows = rows if first is None else rows.where(F.col("x.w0").isin(first))
    run = lambda size: F.concat(*[F.col(f"x.{c}{k}") for k in range(size) for c in ("g", "w")][1:])
    each = [F.when(F.col("pos") + size <= F.col("m"), F.struct(F.lit(size).alias("size"), run(size).alias("core"), F.col(f"x.g{size}").alias("after"))) for size in sizes]
    out = rows.select("n", "pos", "m", F.col("x.g0").alias("gap"), F.explode(F.array(*each)).alias("r")).where("r IS NOT NULL")
    return out.select("n", "pos", "r.size", "r.core", "gap", "r.after", (F.col("m") - F.col("pos") - F.col("r.size")).alias("left"))


def _fits() -> Column:
    """Whether the separators around a run of words in a text hold the term's own as their ends, with no word touching them."""
    free = lambda whole, part: (part == "") | (F.length(whole) > F.length(part))
    before = F.endswith("gap", "t_gap") & (free(F.col("gap"), F.col("t_gap")) | (F.col("pos") == 0))
    return before & F.startswith("after", "t_after") & (free(F.col("after"), F.col("t_after")) | (F.col("left") == 0))


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """n, alias, code, begin, end of all terms (alias, code) that stand in texts (n, text) as whole words; begin and end are in order of the text."""
    index = saved(term_index(terms), "terms")
    held = index.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each number of words in a term
    total = sum(r.n for r in held)
    first = [r.w for r in index.select(F.regexp_extract("core", rf"^{T.WORD}+", 0).alias("w")).distinct().collect()] if total <= FEW else None
    runs = placed_runs(texts, sorted(r["size"] for r in held) or [1], first)
    dictionary = small(index.drop("size"), total, INDEXED)
    place = lambda c: c.cast("long") * ROOM
    begin, end = place(F.col("pos")) - F.length("t_gap"), place(F.col("pos") + F.col("size") - 1) + F.length("t_after")
    return runs.join(dictionary, "core").where(_fits()).select("n", F.concat("t_gap", "core", "t_after").alias("alias"), "code", begin.alias("begin"), end.alias("end"))


def outer_spans(spans: DataFrame) -> DataFrame:
    """Spans (n, begin, end) that no longer span of their text covers: in order of begin, the longest first, none reaches as far as one before it."""
    before = Window.partitionBy("n").orderBy("begin", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.struct(*spans.columns)
    marked = spans.select(reach.alias("s"), "n", "begin", "end", F.max("end").over(before).alias("far"))
    return marked.where("far IS NULL OR far < end").select("s.*")


def match_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """n, code of dictionary terms (alias, code; ord, if there is one, settles aliases that occur twice) found as whole words in texts (n, text); a span inside a longer term's span does not count.

    A null text holds none; a null n is a text of its own only if no other n is null; terms without a word are never found.
    """
    return outer_spans(term_spans(texts, terms)).select("n", "code").distinct()


# Patterns of hazard classes, waste codes, norms and references to calculations.
HAZARD_CLASS = rf"(?iu)(?<!{T.WORD})([IVX]{{1,3}}|[1-5])\s*класс{T.WORD}*\s*опасн"
WASTE_CODE = rf"(?<!{T.WORD})\d{{11}}(?!{T.WORD})"
NORM = rf"(?iu)(?<!{T.WORD})(?:СП|СНиП|ГОСТ(?:\s?Р)?|СанПиН|ГН|МУ|РД|ВСН|ОНД|приказ{T.WORD}*|постановлени{T.WORD}*\s*правительства|ПП\s*РФ|№)\s*[\d\.\-–/]+{T.WORD}*"
CALCULATION = rf"(?iu)(?<!{T.WORD})(?:расч[её]т|таблиц{T.WORD}*|приложени{T.WORD}*)\s*[№N]?\s*[\d\.\-]+"
# Kinds that are compared, and their names in a report.
COMPARED = {"techniques": "техника", "waste_classes": "класс опасности отходов", "pollutants": "загрязняющие вещества", "normatives": "нормативы", "quantities": "числовые величины"}


def _every(pattern: str, then=lambda x: x) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(T.text("text"), F.lit(pattern), 0), then))


def machine_pattern(aliases: list[str]) -> str:
    """Mentions of machines: an alias, the longest first, with whatever ends its word, and a model number."""
    body = "|".join("\\Q" + a.replace("\\E", "\\E\\\\E\\Q") + "\\E" for a in sorted({a.lower() for a in aliases}, key=lambda a: (-len(a), a)))
    return rf"(?iu)(?<!{T.WORD})(?:{body})[\p{{L}}\p{{N}}_\-]*(?:\s*[-–]?\s*\d{{2,4}}[\p{{L}}\p{{N}}_\-]*)?"


#: Aliases of machines that make up one pattern at most.
PATTERN_ALIASES = 2_000


def mentions_of_machines(texts: DataFrame, machines: DataFrame) -> DataFrame:
    """n, value of machines (alias, name) in texts (n, text): the name of the longest alias that stands in the mention as whole words, else the mention as it is written.

    The aliases make one pattern, so there are ``PATTERN_ALIASES`` of them at most; more are refused.
    """
    aliases = [r.alias for r in machines.select("alias").where("alias <> ''").distinct().limit(PATTERN_ALIASES + 1).collect()]
    if len(aliases) > PATTERN_ALIASES:
        raise ValueError(f"over {PATTERN_ALIASES} aliases of machines")
    if not aliases:
        return texts.select("n", F.lit("").alias("value")).where(F.lit(False))
    found = texts.select("n", F.explode(_every(machine_pattern(aliases))).alias("mention"))
    spelled = found.select("mention").distinct()
    names = term_spans(spelled.select(F.col("mention").alias("n"), F.col("mention").alias("text")), machines.select("alias", F.col("name").alias("code"), *(["ord"] if "ord" in machines.columns else [])))
    best = names.groupBy(F.col("n").alias("mention")).agg(F.min_by("code", F.struct(-F.length("alias"), "alias")).alias("name"))
    return found.join(best, "mention", "left").select("n", F.coalesce("name", "mention").alias("value")).distinct()


def entities(texts: DataFrame, substances: DataFrame, machines: DataFrame) -> DataFrame:
    """n, kind, value of the entities in texts (n, text; one row for each n): techniques, waste_classes, fkko, pollutants, quantities, normatives, calcs.

    substances: alias, code, name (and ord); machines: alias, name (and ord). Each value of a kind once for each n; null texts have none.
    """
    flat = lambda r: F.lower(T.squeeze(r))
    in_text = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), values.alias("values"))
            for kind, values in {
                "waste_classes": F.array_distinct(F.transform(F.regexp_extract_all(T.text("text"), F.lit(HAZARD_CLASS), 0), T.waste_class)),
                "fkko": _every(WASTE_CODE),
                "quantities": _every(QUANTITY, flat),
                "normatives": _every(NORM, flat),
                "calcs": _every(CALCULATION, flat),
            }.items()
        ]
    )
    plain = texts.select("n", F.explode(in_text).alias("x")).select("n", "x.kind", F.explode("x.values").alias("value"))
    columns = ["alias", F.col("name").alias("code"), *(["ord"] if "ord" in substances.columns else [])]
    found = match_terms(texts, substances.select(*columns)).select("n", F.lit("pollutants").alias("kind"), F.col("code").alias("value"))
    driven = mentions_of_machines(texts, machines).select("n", F.lit("techniques").alias("kind"), "value")
    return plain.unionByName(found).unionByName(driven)


# Units of quantities.
UNITS = ["г/с", "т/год", "мг/м3", "мг/м³", "мкг/м3", "дБА", "дБ", "ПДК", "м3/сут", "м³/сут", "м3", "м³", "га", "км", "кВт", "л/с", "кг", "т", "%"]
# A unit ends where a word ends, so one that is no word itself (%, ³) ends only before a word.
_END = rf"(?:(?<={T.WORD})(?!{T.WORD})|(?<!{T.WORD})(?={T.WORD}))"
QUANTITY = rf"(?iu)\d+[.,]?\d*\s*(?:{'|'.join(map(re.escape, UNITS))}){_END}"


def made_up(answers: DataFrame, sources: DataFrame, pairs: DataFrame, at_most: int = 8) -> DataFrame:
    """id, kind, n, values: for each pair (id, answer, source; each the n of its side's entities) and kind that is compared, how many of the answer's entities the source lacks,
    and the first ``at_most`` of them in order. Pairs without any are in order and have no row."""
    kinds = F.col("kind").isin(*COMPARED)
    own = pairs.join(answers.where(kinds).select(F.col("n").alias("answer"), "kind", "value"), "answer")
    known = sources.where(kinds).select(F.col("n").alias("source"), "kind", "value")
    only = own.join(known, ["source", "kind", "value"], "left_anti")
    listed = F.array_join(F.slice(F.array_sort(F.collect_set("value")), 1, at_most), "|")
    return only.groupBy("id", "kind").agg(F.countDistinct("value").alias("n"), listed.alias("values"))
