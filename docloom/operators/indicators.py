"""Indicators of a project, found in its texts by proximity, and the values that people set or chose (RT22, RT23).

Mentions, values with units and ends of sentences are places in a text.  In order of place, the first value behind a mention in
its own unit is the mention's, if it ends within ``REACH`` characters of it and before the sentence does: an as-of join forwards, by one
window over the places of each text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .tables import saved

#: Characters behind a mention within which its value ends; portions in which a value's files are gathered.
REACH, PORTIONS = 160, 64

# Indicators with their unit, the plausible range, the sections that own them (the first most), and how they are mentioned.
INDICATORS = [
    ("area_build", "м²", 1, 5_000_000, ["PZU", "PZ", "POS"], [r"площад\w* застройки"]),
    ("area_plot", "м²", 1, 50_000_000, ["PPO", "PZU", "PZ"], [r"площад\w* (?:земельного )?участка", r"площад\w* землеотвода", r"площад\w* полосы отвода"]),
    ("length_route", "км", 0.01, 2_000, ["PPO", "TKR", "PZ"], [r"протяж[её]нност\w*", r"длина трассы"]),
    ("duration", "мес.", 0.5, 120, ["POS"], [r"продолжительност\w* строительства", r"срок строительства"]),
    ("workers", "чел.", 1, 5_000, ["POS"], [r"численност\w* работающих", r"количество (?:рабочих|строителей|работающих)", r"общая численност\w*"]),
    ("emission_year", "т/год", 0.0001, 100_000, ["OOS"], [r"валов\w* выброс\w*", r"суммарн\w* выброс\w*", r"всего выброс\w*", r"итого .{0,25}выброс\w*", r"выброс\w* .{0,30}т/год", r"масса выброс\w*"]),
    ("emission_sec", "г/с", 0.000001, 10_000, ["OOS"], [r"максимальн\w*[- ]разов\w* выброс\w*", r"выброс\w* .{0,30}г/с", r"итого .{0,25}г/с", r"всего .{0,20}г/с"]),
    ("sources_count", "шт.", 1, 10_000, ["OOS"], [r"количество источников выброс\w*", r"источник\w* выброс\w* .{0,20}шт", r"всего источник\w*"]),
    ("waste_year", "т/год", 0.0001, 1_000_000, ["OOS"], [r"количество отходов", r"образован\w* отходов", r"объ[её]м отходов", r"итого .{0,20}отход\w*", r"всего отход\w*", r"масса отход\w*"]),
    ("water_use", "м³/сут", 0.001, 100_000, ["OOS", "IOS_VK", "POS"], [r"водопотреблени\w*", r"потребность в воде", r"расход воды"]),
    ("water_drain", "м³/сут", 0.001, 100_000, ["OOS", "IOS_VK", "POS"], [r"водоотведени\w*", r"сброс сточных вод", r"объ[её]м сточных вод"]),
    ("szz", "м", 5, 3_000, ["OOS", "IEI"], [r"санитарно[- ]защитн\w* зон\w*", r"размер сзз", r"санитарн\w* разрыв"]),
    ("noise", "дБА", 20, 140, ["OOS"], [r"уровен\w* шума", r"шумов\w* воздействи\w*", r"эквивалентн\w* уровен\w*"]),
]
# How units are written.
UNIT_SPELLINGS = {
    "м²": [r"м2", r"м²", r"кв\.?\s*м"], "км": [r"км"], "мес.": [r"мес\w*"], "чел.": [r"чел\w*"], "т/год": [r"т/год", r"тонн\w*/год"], "г/с": [r"г/с"],
    "шт.": [r"шт\w*", r"ед\w*"], "м³/сут": [r"м3/сут\w*", r"м³/сут\w*", r"куб\.?\s*м/сут\w*"], "м": [r"м(?![²³2-9а-яё])"], "дБА": [r"дба", r"дб"],
}
NUMBER = "\\d[\\d  ]{0,12}(?:[.,]\\d+)?"
SENTENCE_END = r"[.;]\s"


def _java(pattern: str) -> str:
    """A pattern whose word characters are those of any script."""
    return "(?iu)" + pattern.replace(r"\w", T.WORD)


def value_pattern(unit: str) -> str:
    """A number with a spelling of its unit, which a word's edge must follow."""
    edge = rf"(?:(?<={T.WORD})(?!{T.WORD})|(?<!{T.WORD})(?={T.WORD}))"
    return _java(rf"{NUMBER}\s*(?:{'|'.join(UNIT_SPELLINGS[unit])})") + edge


def literal(pattern: str) -> str:
    """The plain letters that every match of a pattern begins with."""
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    plain = re.match(r"[а-яёa-z ]*", pattern)[0]
    return plain[:-1] if pattern[len(plain) :][:1] in ("?", "*", "{") and plain else plain


def places(texts: DataFrame, patterns: list[tuple[str, str, str, list[str]]]) -> DataFrame:
    """n, kind, name, start, end, found of the matches of patterns (kind, name, pattern, stems) in texts (n, t), in characters from 0.

    A pattern is looked for in texts that hold one of its stems as it is written.

    A text is cut at each pattern's matches; places are running sums of the lengths of matches and of what lies between.
    """
    # One look finds whether a pattern occurs at all, so that most texts are never cut; one for a stem is cheaper still.
    holds = lambda stems: reduce(lambda a, b: a | b, [F.contains("t", F.lit(x)) for x in dict.fromkeys(stems)])
    cut = [F.when(holds(stems) & F.col("t").rlike(p), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.regexp_extract_all("t", F.lit(p), 0).alias("found"), F.split("t", p, -1).alias("between"))) for kind, name, p, stems in patterns]
    each = texts.select("n", F.explode(F.array_compact(F.array(*cut))).alias("x")).select("n", "x.*")
    rows = each.select("n", "kind", "name", F.posexplode(F.arrays_zip("found", F.slice("between", 1, F.size("found")).alias("before"))).alias("i", "x"))
    to_here = Window.partitionBy("n", "kind", "name").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("x.before") + F.length("x.found")).over(to_here)
    return rows.select("n", "kind", "name", (end - F.length("x.found")).alias("start"), end.alias("end"), F.col("x.found").alias("found"))


def scan(texts: DataFrame, indicators: list[tuple] = INDICATORS) -> DataFrame:
    """n, key, unit, value, start of every mention of an indicator in texts (n, text; one row for each n) that a plausible value follows; values as numbers without blanks, with a point."""
    low = texts.select("n", F.lower(T.text("text")).alias("t"))
    units = sorted({i[1] for i in indicators})
    # Texts are in lower case, and so are mentions.
    mentions = [("mention", f"{key}|{k}", m.replace(r"\w", T.WORD), [literal(m)]) for key, _, _, _, _, spellings in indicators for k, m in enumerate(spellings)]
    stems = lambda unit: [literal(m) for _, u, _, _, _, spellings in indicators if unit in (u, "") for m in spellings]
    values = [("value", unit, value_pattern(unit), stems(unit)) for unit in units]
    found = saved(places(low, [*mentions, *values, ("stop", "", SENTENCE_END, stems(""))]), "places")
    by_key = F.create_map(*[F.lit(x) for i in indicators for x in (i[0], i[1])])
    key = F.split_part("name", F.lit("|"), F.lit(1))
    found = found.select("*", F.when(F.col("kind") == "mention", F.element_at(by_key, key)).otherwise(F.col("name")).alias("unit"))
    # A value is ahead of a mention that ends before its last digit: of a number that a mention's last word runs into, the rest is read.
    mentioned, stops = found.where("kind = 'mention'"), found.where("kind = 'stop'").select("n", "kind", "start", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("long").alias("end"))
    # What is ahead is kept while rows are read backwards, each looked at once.
    ahead = lambda *by: Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    rank = (F.col("kind") != "mention").cast("int").alias("rank")
    ended = mentioned.select("n", "kind", "start", "name", "unit", "end").unionByName(stops).select("*", F.coalesce("end", "start").alias("at"), rank)
    stopped = ended.select("n", "kind", "name", "unit", "start", "end", F.last(F.when(F.col("kind") == "stop", F.struct("start")), ignorenulls=True).over(ahead("n")).alias("stop")).where("kind = 'mention'")
    last_digit = F.col("start") + F.length(F.rtrim(F.regexp_extract("found", NUMBER, 0))) - 1
    read = found.where("kind = 'value'").select("n", "kind", "unit", last_digit.alias("at"), rank, F.struct("start", "end", "found").alias("own"))
    placed = stopped.select("*", F.col("end").alias("at"), rank).unionByName(read, allowMissingColumns=True)
    seen = placed.select("n", "kind", "name", "unit", "start", "end", "stop", F.last("own", ignorenulls=True).over(ahead("n", "unit")).alias("value")).where("kind = 'mention'")
    inside = (F.col("value.end") <= F.col("end") + REACH) & (F.col("stop").isNull() | (F.col("stop.start") >= F.col("value.end")) | (F.col("stop.start") >= F.col("end") + REACH - 1))
    rest = F.expr("substring(value.found, greatest(1, CAST(end - value.start + 1 AS INT)))")
    number = F.rtrim(F.replace(F.regexp_replace(F.regexp_extract(rest, NUMBER, 0), "[  ]", ""), F.lit(","), F.lit(".")), F.lit("."))
    read = seen.where(inside).select("n", F.split_part("name", F.lit("|"), F.lit(1)).alias("key"), "unit", number.alias("value"), "start")
    plausible = reduce(lambda a, b: a | b, [(F.col("key") == key) & F.col("value").cast("double").between(low, high) for key, _, low, high, _, _ in indicators])
    return read.where(plausible)


def owners(spark, indicators: list[tuple] = INDICATORS) -> DataFrame:
    """key, section, ord: the sections that own an indicator, the first most."""
    return spark.createDataFrame([(i[0], s, k) for i in indicators for k, s in enumerate(i[4])], "key string, section string, ord int")


def registry(found: DataFrame, prefer: DataFrame, settled: DataFrame, sources: int = 8) -> DataFrame:
    """One row for each indicator that is found or settled: key, value, source, conflict, n_variants, variants (values joined by |, the best first), files (of the best variant, ``sources`` at most).

    found: key, value, section, file of each mention.  prefer: key, section, ord.  settled: key, value, source of what people set (manual) or chose (chosen), a
    row for each key at most: it holds against whatever is found, and ends the conflict.  Else the best variant is the value: by the best owner
    among its sections, then by count, then by value.
    """
    # Files of one value and section are gathered in portions, so that no set holds all of them.
    by_section = found.groupBy("key", "value", "section", F.pmod(F.xxhash64("file"), F.lit(PORTIONS))).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("file")), 1, sources).alias("files"))
    ranked = by_section.join(prefer, ["key", "section"], "left")
    v = ranked.groupBy("key", "value").agg(F.sum("n").alias("n"), F.min(F.coalesce("ord", F.lit(99))).alias("best"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))), 1, sources).alias("files"))
    order = F.struct(F.col("best"), (-F.col("n")).alias("minus"), "value")
    per = v.groupBy("key").agg(F.min_by("value", order).alias("auto"), F.min_by("files", order).alias("files"), F.count(F.lit(1)).alias("n_variants"), F.array_sort(F.collect_list(order)).alias("all"))
    out = per.join(settled.select("key", F.col("value").alias("own"), "source"), "key", "full_outer")
    held = F.col("source").isNotNull()
    variants = F.array_join(F.transform("all", lambda x: x["value"]), "|")
    return out.select(
        "key", F.when(held, F.col("own")).otherwise(F.col("auto")).alias("value"), F.coalesce("source", F.lit("auto")).alias("source"),
        (~held & (F.coalesce("n_variants", F.lit(0)) > 1)).alias("conflict"), F.coalesce("n_variants", F.lit(0)).cast("long").alias("n_variants"),
        F.coalesce(variants, F.lit("")).alias("variants"), F.coalesce(F.array_join("files", "|"), F.lit("")).alias("files"),
    )


def settled_as_of(log: DataFrame, at: Column | None = None) -> DataFrame:
    """key, value, source of an append-only log (key, value, source, ts, seq) of decisions, as of a time (all of it without one).

    The strongest source that is in force holds: manual before chosen before found; of one source the last entry.  An entry
    without a value takes its source's earlier ones back.
    """
    known = log if at is None else log.where(F.col("ts") <= at)
    last = known.groupBy("key", "source").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"), F.max(F.struct("ts", "seq")).alias("when"))
    rank = F.when(F.col("source") == "manual", 0).when(F.col("source") == "chosen", 1).otherwise(2)
    held = last.where(F.col("value").isNotNull())
    return held.groupBy("key").agg(F.min_by("value", F.struct(rank, "source")).alias("value"), F.min_by("source", F.struct(rank, "source")).alias("source"))
