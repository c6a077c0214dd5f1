"""Queries of entities, indicators and decisions over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import entities as E, indicators as I
from .registry import Literal, query, table
from .texts import QUANTITY_SQL, squeeze

W, NW = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"

SUBSTANCES = Literal(
    "ord int, alias string, code string, name string",
    [
        (1, "азота диоксид", "0301", "Азота диоксид"), (2, "диоксид азота", "0301", "Азота диоксид"), (3, "азота оксид", "0304", "Азота оксид"), (4, "no", "0304", "Азота оксид"),
        (5, "сажа", "0328", "Сажа"), (6, "углерод (сажа)", "0328", "Углерод (Сажа)"), (7, "углеводороды", "0401", "Углеводороды"), (8, "непредельные углеводороды", "0501", "Непредельные углеводороды"),
    ],
)
MACHINES = Literal("ord int, alias string, name string", [(1, "экскаватор", "Экскаватор"), (2, "cat", "Экскаватор"), (3, "камаз", "Автосамосвал"), (4, "самосвал", "Автосамосвал"), (5, "б-10", "Бульдозер"), (6, "кран", "Автокран"), (7, "автокран", "Автокран")])


def _stated(n: str, text: str) -> str:
    """A text with statements of every kind that depend on a number, the same in both dialects."""
    s = lambda x: f"CAST({x} AS STRING)"
    pick = lambda *xs: "CASE " + f"{n} % {len(xs)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"
    return (
        f"concat(coalesce({text}, ''), ' Работает ', {pick('экскаватор CAT ', 'КАМАЗ-65', 'экскаватора ', 'кран Б-10 ', 'самосвал ')}, {s(f'100 + {n} % 40')}, '; отходы ', {s(f'1 + {n} % 7')}, ' класса опасности, код ', {s(f'47110101520 + {n} % 3')},"
        f" '. Выброс: ', {pick('диоксид азота', 'углерод (сажа)', 'углеводороды', 'непредельные углеводороды', 'ничего', 'NO, сажа')}, ' 0,', {s(f'{n} % 9')}, ' г/с и ', {s(f'{n} % 11')}, ' т/год. По СП ', {s(f'{n} % 5')}, '.13330.2016, расчёт № ', {s(f'{n} % 6')}, '.')"
    )


ANSWERS = f"SELECT doc_id AS n, {_stated('doc_id', 'text')} AS text FROM documents"
SOURCES = f"SELECT item_id AS n, {_stated('item_id * 3', 'text')} AS text FROM benchmark"


def _rows(spark: SparkSession, sf: str, select: str, name: str) -> DataFrame:
    return spark.sql(select.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf, name)})


def _aliases_sql(names: list[str]) -> str:
    return "|".join(re.escape(a).replace("\\-", "-") for a in sorted(set(names), key=lambda a: (-len(a), a)))


_MACHINES = [r[1] for r in MACHINES.rows]
_MENTION = rf"(?i)(?:^|{NW})((?:{_aliases_sql(_MACHINES)})[\p{{L}}\p{{N}}_\-]*(?:\s*[-–]?\s*\d{{2,4}}[\p{{L}}\p{{N}}_\-]*)?)"
_KNOWN = " ".join(f"WHEN regexp_matches(lower(m), '(^|{NW}){re.escape(a).replace(chr(92) + '-', '-')}({NW}|$)') THEN '{name}'" for _, a, name in sorted(MACHINES.rows, key=lambda r: (-len(r[1]), r[1])))


def _substances_sql() -> str:
    """Each alias is looked for where those that hold it are blotted out."""
    out = []
    for _, alias, _, name in SUBSTANCES.rows:
        t = "lower(t)"
        for longer in sorted((r[1] for r in SUBSTANCES.rows if alias in r[1] and r[1] != alias), key=len, reverse=True):
            t = f"regexp_replace({t}, '(^|{NW}){re.escape(longer).replace(chr(92) + ' ', ' ')}($|{NW})', '\\1#\\2', 'g')"
        out.append(f"CASE WHEN regexp_matches({t}, '(^|{NW}){re.escape(alias).replace(chr(92) + ' ', ' ')}($|{NW})') THEN '{name}' END")
    return "list_filter([" + ", ".join(out) + "], lambda x: x IS NOT NULL)"


_NORM_SQL = E.NORM.replace("(?iu)", "(?i)").replace(rf"(?<!{W})", rf"(?:^|{NW})").replace("(?:СП|", "((?:СП|") + ")"
_CALC_SQL = E.CALCULATION.replace("(?iu)", "(?i)").replace(rf"(?<!{W})", rf"(?:^|{NW})").replace("(?:расч", "((?:расч") + ")"
_CLASS_SQL = rf"(?i)(?:^|{NW})(?:[IVX]{{1,3}}|[1-5])\s*класс{W}*\s*опасн"
_ROMAN = "CASE upper(regexp_extract(x, '(?i)([IVX]{1,3}|[1-5])', 1)) WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III' WHEN '4' THEN 'IV' WHEN '5' THEN 'V' ELSE upper(regexp_extract(x, '(?i)([IVX]{1,3}|[1-5])', 1)) END || ' класс опасности'"
_FLAT = f"lower({squeeze('x')})"


def _entities_sql(select: str) -> str:
    kinds = {
        "techniques": f"list_transform(regexp_extract_all(t, '{_MENTION}', 1), lambda m: CASE {_KNOWN} ELSE m END)",
        "waste_classes": f"list_transform(regexp_extract_all(t, '{_CLASS_SQL}'), lambda x: {_ROMAN})",
        "fkko": rf"regexp_extract_all(t, '(?:^|{NW})(\d{{11}})(?:$|{NW})', 1)",
        "pollutants": _substances_sql(),
        "quantities": f"list_transform(regexp_extract_all(t, '{QUANTITY_SQL}', 1), lambda x: {_FLAT})",
        "normatives": f"list_transform(regexp_extract_all(t, '{_NORM_SQL}', 1), lambda x: {_FLAT})",
        "calcs": f"list_transform(regexp_extract_all(t, '{_CALC_SQL}', 1), lambda x: {_FLAT})",
    }
    return " UNION ".join(f"SELECT n, '{kind}' AS kind, unnest({values}) AS value FROM (SELECT n, text AS t FROM ({select}))" for kind, values in kinds.items())


@query(_entities_sql(ANSWERS))
def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Seven kinds of entities of every document, with statements of each kind at its end."""
    return E.entities(_rows(spark, sf, ANSWERS, "documents"), SUBSTANCES.df(spark), MACHINES.df(spark))


_COMPARED = ", ".join(f"'{k}'" for k in E.COMPARED)


@query(f"""WITH a AS ({_entities_sql(ANSWERS)}), s AS ({_entities_sql(SOURCES)}), k AS (SELECT count(*) AS k FROM benchmark),
 o AS (SELECT a.n AS id, a.kind, a.value FROM a, k WHERE a.kind IN ({_COMPARED}) AND NOT EXISTS (SELECT 1 FROM s WHERE s.n = a.n % k AND s.kind = a.kind AND s.value = a.value))
 SELECT id, kind, count(*) AS n, array_to_string(list_sort(list(value))[1:8], '|') AS values FROM o GROUP BY id, kind""")
def consistency_entities(spark: SparkSession, sf: str) -> DataFrame:
    """What each document states that its passage of the benchmark doesn't, by kind."""
    answers, sources = _rows(spark, sf, ANSWERS, "documents"), _rows(spark, sf, SOURCES, "benchmark")
    found = [E.entities(x, SUBSTANCES.df(spark), MACHINES.df(spark)) for x in (answers, sources)]
    items = table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("items"))
    pairs = table(spark, sf, "documents").select("doc_id").join(F.broadcast(items)).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("answer"), F.pmod("doc_id", "items").alias("source"))
    return E.made_up(found[0], found[1], pairs)


_PHRASES = "SELECT DISTINCT lower(x.a) AS alias, 'd' || x.n AS code FROM (SELECT unnest([{'a': w[1] || ' ' || w[2] || ' ' || w[3], 'n': doc_id}, {'a': w[4] || ', ' || w[5], 'n': doc_id}, {'a': w[2], 'n': doc_id}]) AS x FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE doc_id % 10 = 0) WHERE len(w) >= 5)"


@query(rf"""WITH d AS ({_PHRASES}), t AS (SELECT alias, max(code) AS code FROM d GROUP BY alias),
 p AS (SELECT doc_id AS n, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w, regexp_split_to_array(lower(text), '[\p{{L}}\p{{N}}_]+') AS g FROM documents),
 e AS (SELECT n, unnest(generate_series(1, len(w))) AS i, w, g FROM p WHERE len(w) > 0),
 k AS (SELECT n, i, i AS j, w[i] AS alias FROM e UNION ALL SELECT n, i, i + 1, w[i] || ', ' || w[i + 1] FROM e WHERE g[i + 1] = ', ' UNION ALL SELECT n, i, i + 2, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM e WHERE g[i + 1] = ' ' AND g[i + 2] = ' '),
 m AS (SELECT n, i, j, code FROM k JOIN t USING (alias))
 SELECT DISTINCT n, code FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.n = a.n AND b.i <= a.i AND b.j >= a.j AND b.j - b.i > a.j - a.i)""")
def entity_dictionary_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of one, two and three words, drawn from a tenth of the documents, in all of them: a dictionary that grows with the texts."""
    d = table(spark, sf, "documents")
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0)
    drawn = lambda w: F.when(F.size(w) >= 5, F.array(F.concat_ws(" ", w[0], w[1], w[2]), F.concat_ws(", ", w[3], w[4]), w[1]))
    terms = d.where("doc_id % 10 = 0").select(F.explode(T.let(w, drawn)).alias("alias"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("code"))
    return E.match_terms(d.select(F.col("doc_id").alias("n"), "text"), terms)


_MEASURED = (
    "SELECT doc_id AS n, source, concat(coalesce(text, ''), '. Площадь застройки участка ', CAST(n_chars AS STRING), ',5 м2, валовый выброс ЗВ — 1 ', CAST(100 + doc_id % 7 AS STRING), ' т/год. Уровень шума. ', CAST(doc_id % 200 AS STRING),"
    " ' дБА; шумовое воздействие ', CAST(doc_id % 200 AS STRING), ' дБА, водопотребление: нет данных; водоотведение ', CAST(doc_id % 3 AS STRING), '.25 м3/сутки') AS text FROM documents"
)


def _scan_sql(select: str) -> str:
    """Every mention with the text behind it, cut at the end of its sentence."""
    sub = lambda p: p.replace(r"\w", W).replace("'", "''")
    units = {u: rf"(?i)({I.NUMBER})\s*(?:{sub('|'.join(x)).replace('м(?![²³2-9а-яё])', 'м')})(?:$|{NW})" for u, x in I.UNIT_SPELLINGS.items()}
    one = lambda key, unit, low, high, m: rf"""SELECT n, '{key}' AS key, '{unit}' AS unit, value, start FROM (
 SELECT n, rtrim(replace(regexp_replace(regexp_extract(cut, '{units[unit]}', 1), '[  ]', '', 'g'), ',', '.'), '.') AS value, start FROM (
  SELECT n, regexp_replace(substr(t, upto + 1, 160), '[.;]\s.*$', '', 's') AS cut, (upto - length(m))::BIGINT AS start FROM (
   SELECT n, t, list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(f[1:i], lambda x: length(x)))::BIGINT AS upto, f[i] AS m FROM (
    SELECT n, t, f, b, unnest(generate_series(1, len(f))) AS i FROM (SELECT n, t, regexp_extract_all(t, '{sub(m)}') AS f, regexp_split_to_array(t, '{sub(m)}') AS b FROM texts WHERE regexp_matches(t, '{sub(m)}')))))
  WHERE regexp_matches(cut, '{units[unit]}')) WHERE value::DOUBLE BETWEEN {low} AND {high}"""  # noqa: E731
    every = " UNION ALL ".join(one(key, unit, low, high, m) for key, unit, low, high, _, spellings in I.INDICATORS for m in spellings)
    return f"WITH texts AS MATERIALIZED (SELECT n, lower(text) AS t FROM ({select})) {every}"


@query(_scan_sql(_MEASURED))
def indicator_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Values of indicators in all documents, with measures of the table at their ends."""
    return I.scan(_rows(spark, sf, _MEASURED, "documents").select("n", "text"))


_SETTLED = "SELECT 'noise' AS key, '55' AS value, 'manual' AS source UNION ALL SELECT 'szz', '300', 'chosen'"
_PREFER_SQL = ", ".join(f"('{i[0]}', 'src{k + 3}', {k})" for i in I.INDICATORS for k in range(len(i[4])))


@query(f"""WITH f AS (SELECT key, value, d.source AS section, 'doc' || n AS file FROM ({_scan_sql(_MEASURED)}) s JOIN documents d ON d.doc_id = s.n), p(key, section, ord) AS (VALUES {_PREFER_SQL}),
 v AS (SELECT f.key, value, count(*) AS n, coalesce(min(ord), 99) AS best, list_sort(list_distinct(list(file)))[1:8] AS files FROM f LEFT JOIN p ON p.key = f.key AND p.section = f.section GROUP BY f.key, value),
 g AS (SELECT key, arg_min(value, {{'b': best, 'm': -n, 'v': value}}) AS auto, arg_min(files, {{'b': best, 'm': -n, 'v': value}}) AS files, count(*) AS k, string_agg(value, '|' ORDER BY best, n DESC, value) AS variants FROM v GROUP BY key)
 SELECT coalesce(g.key, s.key) AS key, coalesce(s.value, auto) AS value, coalesce(s.source, 'auto') AS source, s.source IS NULL AND k > 1 AS conflict, coalesce(k, 0) AS n_variants, coalesce(variants, '') AS variants, coalesce(array_to_string(files, '|'), '') AS files
 FROM g FULL JOIN ({_SETTLED}) s ON s.key = g.key""")
def indicator_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The register of indicators of all documents, with one value set by hand and one chosen."""
    d = table(spark, sf, "documents")
    found = I.scan(_rows(spark, sf, _MEASURED, "documents").select("n", "text")).join(d.select(F.col("doc_id").alias("n"), F.col("source").alias("section")), "n")
    prefer = spark.createDataFrame([(i[0], f"src{k + 3}", k) for i in I.INDICATORS for k in range(len(i[4]))], "key string, section string, ord int")
    return I.registry(found.select("key", "value", "section", F.concat(F.lit("doc"), F.col("n").cast("string")).alias("file")), prefer, spark.sql(_SETTLED))


_LOG = "SELECT concat('user', CAST(user_id AS STRING)) AS key, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS value, CASE event_type WHEN 'purchase' THEN 'manual' WHEN 'signup' THEN 'chosen' ELSE 'found' END AS source, ts, event_id AS seq FROM events"


def _as_of_sql(until: str) -> str:
    return f"""SELECT key, arg_min(value, r) AS value, arg_min(source, r) AS source FROM (
 SELECT key, source, CASE source WHEN 'manual' THEN 0 WHEN 'chosen' THEN 1 ELSE 2 END AS r, arg_max({{'v': value}}, {{'t': ts, 's': seq}}).v AS value FROM ({_LOG}) WHERE {until} GROUP BY key, source) WHERE value IS NOT NULL GROUP BY key"""


@query(f"""SELECT coalesce(a.key, b.key) AS key, a.value AS value_then, a.source AS source_then, b.value AS value_now, b.source AS source_now
 FROM ({_as_of_sql("ts <= TIMESTAMP '2024-01-03 12:00:00'")}) a FULL JOIN ({_as_of_sql('true')}) b ON a.key = b.key""")
def decisions_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The value in force for each key of the log of events, at a time and now: set by hand before chosen before found."""
    log = _rows(spark, sf, _LOG, "events")
    then = I.settled_as_of(log, F.lit("2024-01-03 12:00:00").cast(dict(log.dtypes)["ts"])).toDF("key", "value_then", "source_then")
    return then.join(I.settled_as_of(log).toDF("key", "value_now", "source_now"), "key", "full_outer")
