"""Queries of text, name, identifier and classification functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from .registry import Literal, query, table

#: Patterns as SQL strings.
S = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '{S}+', ' ', 'g'))"


_NORMAL = strip(r"regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, sha256(n) AS text_sha256, length(n)::INT AS n FROM (SELECT doc_id, {_NORMAL} AS n FROM documents)")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", T.normalize_text("text").alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").alias("n"))


FINGERPRINT = rf"sha256(lower({squeeze('text')}))"


@query(f"SELECT doc_id, {FINGERPRINT} AS fingerprint FROM documents")
def normalize_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.fingerprint("text").alias("fingerprint"))


_ID = "sha1(concat_ws('||', source, lang, doc_id::VARCHAR, coalesce(text, '')))"


@query(f"SELECT doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS id FROM (SELECT doc_id, {_ID} AS h FROM documents)")
def deterministic_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.stable_id("source", "lang", "doc_id", "text").alias("id"))


@query(r"SELECT doc_id, sha256(encode('bge-m3') || '\x00'::BLOB || encode(coalesce(text, ''))) AS k FROM documents")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.cache_key("bge-m3", "text").alias("k"))


@query(r"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, t[1] AS first_token FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_\-]+') AS t FROM documents)")
def tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", T.tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"SELECT doc_id, sha256(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 4 AND NOT list_contains([{_STOP}], t)))), ' ')) AS tokens_sha256 FROM documents")
def memory_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.array_join(T.memory_tokens("text"), " "), 256).alias("tokens_sha256"))


W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
SHINGLES = "CASE WHEN len(w) < 5 THEN []::VARCHAR[] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END"


@query(f"SELECT doc_id, len({SHINGLES})::INT AS n_shingles FROM (SELECT doc_id, {W} AS w FROM documents)")
def shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.shingles("text")).alias("n_shingles"))


GARBLED = Literal("n int, text string", [(1, "(cid:20)(cid:25)(cid:3) " + "x" * 80), (2, "717/14/15-ɉ-1/ɈɈɋ Ʌɢɫɬ " * 6), (3, "Лист согласования тома охраны окружающей среды " * 4), (4, "ɉɈɈɋ"), (5, None), (6, "")], more="SELECT CAST(doc_id + 100 AS INT) AS n, text FROM documents")


@query(rf"""WITH t AS (SELECT n, {strip("coalesce(text, '')")} AS t FROM {GARBLED.sql}),
 c AS (SELECT n, t, length(regexp_replace(t, '[^ƀ-ɏʰ-˿]', '', 'g')) AS e, length(regexp_replace(t, '[^а-яА-ЯёЁ]', '', 'g')) AS cyr, greatest(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')), 1) AS l FROM t)
 SELECT n, length(t) >= 80 AND ((length(t) - length(replace(t, '(cid:', ''))) / 5 >= 3 OR (e::DOUBLE / l > 0.08 AND e > cyr * 0.5)) AS garbled FROM c""")
def garbled_text(spark: SparkSession, sf: str) -> DataFrame:
    return GARBLED.df(spark, sf).select("n", T.is_garbled("text").alias("garbled"))


@query(rf"SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace({strip('url')}, '[<>:\"/\\\\|?*]+', '_', 'g'), '{S}+', '_', 'g'), 120), ''), 'project') AS slug FROM pages")
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.slug("url").alias("slug"))


@query(f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, t, greatest(0, greatest(strpos(t, 'tion') - 1, 0) - 100) AS s FROM a), c AS (SELECT *, least(length(t), s + 300) AS e FROM b)
 SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE concat(CASE WHEN s > 0 THEN '…' ELSE '' END, substr(t, s + 1, e - s), CASE WHEN e < length(t) THEN '…' ELSE '' END) END AS snippet FROM c""")
def center_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.snippet("text", F.lit("tion"), 300).alias("snippet"))


LOCATIONS = Literal("n int, loc string", [(1, "стр. 12"), (2, "лист 3, стр. 4"), (3, "файл"), (4, None), (5, "Таблица 4.1")], more="SELECT CAST(doc_id + 100 AS INT) AS n, CASE WHEN doc_id % 3 = 0 THEN concat('лист ', CAST(n_chars AS STRING)) ELSE text END AS loc FROM documents")


@query(rf"SELECT n, try_cast(nullif(regexp_extract(coalesce(loc, ''), '\d+'), '') AS INTEGER) AS page FROM {LOCATIONS.sql}")
def page_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return LOCATIONS.df(spark, sf).select("n", T.page_number("loc").alias("page"))


REFERENCES = Literal(
    "n int, text string",
    [(1, "Согласно СП 47.13330.2016 и сп 47.13330.2016, а также ГОСТ Р 56062-2014."), (2, "СанПиН 2.2.1/2.1.1.1200-03; ОНД-86, ГН 2.1.6.3492-17"), (3, "Нормы не указаны"), (4, None), (5, "Приказ Минприроды России № 273, постановление Правительства РФ № 87, ПП РФ 87")],
    more="SELECT CAST(doc_id + 100 AS INT) AS n, concat(coalesce(text, ''), ' по СП ', CAST(44 + doc_id % 5 AS STRING), '.13330.2016 и ГОСТ Р ', CAST(56000 + doc_id AS STRING), '-2014') AS text FROM documents",
)
_REF_SQL = T.REFERENCE.replace("(?iu)", "(?i)")
_REF_LIST = rf"list_transform(regexp_extract_all(coalesce(text, ''), '{_REF_SQL}', 0), lambda r: regexp_replace({squeeze('r')}, '[.,;:)]+$', ''))"


def reference_key_sql(x: str) -> str:
    return rf"replace(regexp_replace(lower({x}), '{S}+', '', 'g'), '№', '')"


REFERENCES_SQL = f"list_filter(l, lambda r, i: list_position(list_transform(l, lambda x: {reference_key_sql('x')}), {reference_key_sql('r')}) = i)"


@query(f"SELECT n, array_to_string({REFERENCES_SQL}, '|') AS refs FROM (SELECT n, {_REF_LIST} AS l FROM {REFERENCES.sql})")
def normative_references(spark: SparkSession, sf: str) -> DataFrame:
    return REFERENCES.df(spark, sf).select("n", F.array_join(T.references("text"), "|").alias("refs"))


REMARKS = Literal(
    "n int, text string",
    [(1, "Выполнить перерасчёт валовых выбросов"), (2, "Уточнить расчёт рассеивания"), (3, "Привести в соответствие с ГОСТ 17.2.3.02"), (4, "Приложить договор на вывоз отходов"), (5, "Указать класс опасности"), (6, "Откорректировать том 6"), (7, None), (8, "Запросить справку ЦГМС"), (9, "Нет результатов изысканий"), (10, "Протокол лаборатории"), (11, "Обоснован объём воды")],
    more="SELECT CAST(doc_id + 100 AS INT) AS n, concat(CASE doc_id % 6 WHEN 0 THEN 'Выполнить перерасчёт ' WHEN 1 THEN 'Уточнить расчёт ' WHEN 2 THEN 'По ГОСТ ' WHEN 3 THEN 'Приложить договор ' WHEN 4 THEN 'Указать ' ELSE '' END, coalesce(text, '')) AS text FROM documents",
)


def _has(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def category_sql(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    return f"CASE WHEN {_has(t, T.RECALCULATE)} OR ({_has(t, T.CALCULATION)} AND {_has(t, T.CALCULATION_VERBS)}) THEN 'Перерасчёт' WHEN {_has(t, T.NORMS)} THEN 'Нормативы' WHEN {_has(t, T.PAPERS)} THEN 'Доп. документы' WHEN {_has(t, T.DATA)} THEN 'Ввести данные' ELSE 'Правка по источникам' END"


@query(f"SELECT n, {category_sql('text')} AS category FROM {REMARKS.sql}")
def remark_category(spark: SparkSession, sf: str) -> DataFrame:
    return REMARKS.df(spark, sf).select("n", T.remark_category("text").alias("category"))


def kind_sql(x: str, at: int = 0) -> str:
    t = f"lower(coalesce({x}, ''))"
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{k[1]}') THEN '{k[at]}'" for k in T.GAP_KINDS) + f" ELSE '{T.OTHER_GAP[1 if at else 0]}' END"


@query(f"SELECT n, {kind_sql('text')} AS kind, {kind_sql('text', 2)} AS human FROM {REMARKS.sql}")
def gap_kind(spark: SparkSession, sf: str) -> DataFrame:
    return REMARKS.df(spark, sf).select("n", T.gap_kind("text").alias("kind"), T.gap_kind("text", human=True).alias("human"))


RAW_ANSWERS = Literal(
    "n int, answer string, confidence string, attachments string, used array<string>",
    [(1, "  Да. ", "Высокая", "a; b ;", ["1", "[3]", "х"]), (2, "", None, None, []), (3, "Нет", "странная", ";;", ["2."]), (4, None, "MED", "один", None), (5, "  ", "чушь", "", [" 7 "])],
    more="SELECT CAST(doc_id + 100 AS INT) AS n, text AS answer, CASE doc_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN ' низкая ' WHEN 2 THEN lang END AS confidence, concat(lang, '; ', source, ';') AS attachments, split(concat('[', CAST(doc_id AS STRING), '],x,', CAST(n_chars AS STRING)), ',') AS used FROM documents",
)


@query(f"""SELECT n, {strip("coalesce(answer, '')")} AS answer,
 coalesce(CASE lower({strip("coalesce(confidence, '')")}) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CONFIDENCE.items())} END, CASE WHEN {strip("coalesce(answer, '')")} = '' THEN 'low' ELSE 'medium' END) AS confidence,
 array_to_string(list_filter(list_transform(string_split(coalesce(attachments, ''), ';'), lambda x: {strip('x')}), lambda x: x <> ''), '|') AS attachments,
 array_to_string(list_filter(list_transform(coalesce(used, []), lambda x: try_cast(regexp_replace(regexp_replace(x, '^[\\[\\] .]+', ''), '[\\[\\] .]+$', '') AS INTEGER)), lambda x: x IS NOT NULL), ',') AS used FROM {RAW_ANSWERS.sql}""")
def normalize_answers(spark: SparkSession, sf: str) -> DataFrame:
    d = RAW_ANSWERS.df(spark, sf)
    return d.select("n", T.strip(T.text("answer")).alias("answer"), T.confidence("confidence", "answer").alias("confidence"), F.array_join(T.split_list("attachments"), "|").alias("attachments"), F.coalesce(F.array_join(F.transform(T.whole_numbers("used"), lambda x: x.cast("string")), ","), F.lit("")).alias("used"))


CLASSES = Literal("n int, raw string", [(1, "IV класс опасности"), (2, "3 класс опасн"), (3, "iii"), (4, "нет"), (5, None)], more="SELECT CAST(doc_id + 100 AS INT) AS n, text AS raw FROM documents")


@query(f"SELECT n, CASE WHEN f = '' THEN coalesce(raw, '') ELSE coalesce(CASE f {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ROMAN.items())} END, f) || ' класс опасности' END AS class FROM (SELECT n, raw, upper(regexp_extract(coalesce(raw, ''), '(?i)([IVX]{{1,3}}|[1-5])', 1)) AS f FROM {CLASSES.sql})")
def waste_classes(spark: SparkSession, sf: str) -> DataFrame:
    return CLASSES.df(spark, sf).select("n", T.waste_class("raw").alias("class"))


ANCHORS = Literal("n int, text string", [(1, "см. табл. 4.1"), (2, "п. 2.3.5 тома"), (3, "этап. 5 месяцев"), (4, "Раздел 7"), (5, None)], more="SELECT CAST(doc_id + 100 AS INT) AS n, concat('по табл. ', CAST(doc_id % 9 AS STRING), '.', CAST(doc_id % 4 AS STRING), '. ', coalesce(text, '')) AS text FROM documents")


@query(r"SELECT n, nullif(regexp_replace(regexp_extract(lower(coalesce(text, '')), '(?:^|[^а-яёa-z])(?:табл[а-яё]*|раздел[а-яё]*|п|пункт[а-яё]*)[.\s]*№?\s*(\d+(?:\.\d+)*)', 1), '\.+$', ''), '') AS anchor FROM " + ANCHORS.sql)
def anchor_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return ANCHORS.df(spark, sf).select("n", T.anchor("text").alias("anchor"))


VOLUMES = Literal("n int, volume string, file string", [(1, "6.1", "том 6.1 оос"), (2, "6.1", "том 6.2 оос"), (3, "6", "том 6.1"), (4, "6", "том 6"), (5, "", "том 6"), (6, "6.1", "том 6.11")], more="SELECT CAST(doc_id + 100 AS INT) AS n, CAST(doc_id % 12 AS STRING) AS volume, concat('том ', CAST(doc_id % 13 AS STRING), '.', CAST(doc_id % 3 AS STRING)) AS file FROM documents")


@query(r"SELECT n, volume <> '' AND regexp_matches(file || ' ', regexp_escape(volume) || '[^\d.]') AS matches FROM " + VOLUMES.sql)
def volume_match(spark: SparkSession, sf: str) -> DataFrame:
    return VOLUMES.df(spark, sf).select("n", T.contains_number(F.col("file"), F.col("volume")).alias("matches"))


NAMES = Literal(
    "file string, section string",
    [("Том 6.1 ООС изм.2.pdf", "OOS"), ("Том 6.1 ООС.pdf", "OOS"), ("Том 6.2 ООС корр 2025-06-01.pdf", "OOS"), ("ПОС_v3.docx", "POS"), ("ПОС.docx", "POS"), ("ПОС финал 01.02.2024.docx", "POS"), ("ИЭИ черновик.pdf", "IEI"), ("отчет ред 3 2024-13-45.pdf", "IEI"), ("Раздел ПД №10_смета rev2.xlsx", "SM"), ("исходная записка 2023.doc", "PZ"), ("", "PZ")],
    more="SELECT concat('Том ', CAST(doc_id % 40 AS STRING), CASE doc_id % 5 WHEN 0 THEN ' корр' WHEN 1 THEN '_v3' WHEN 2 THEN ' финал' WHEN 3 THEN ' изм.2' ELSE '' END, ' 2024-0', CAST(1 + doc_id % 9 AS STRING), '-1', CAST(n_chars % 9 AS STRING), '.pdf') AS file, source AS section FROM documents",
)
_STEM = r"regexp_replace(file, '\.[^./\\]+$', '')"


def _tok(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[\s_\-.]+'), lambda t: t <> '')"


_BARE = rf"regexp_replace(regexp_replace(regexp_replace({_STEM}, '20\d{{2}}[._\-]\d{{1,2}}[._\-]\d{{1,2}}', ' ', 'g'), '\d{{1,2}}[._\-]\d{{1,2}}[._\-]20\d{{2}}', ' ', 'g'), '20\d{{2}}', ' ', 'g')"
_WORD_RANK = "CASE " + " ".join(f"WHEN len(list_filter(t, lambda x: {' OR '.join(f"starts_with(x, '{p}')" for p in ps)})) > 0 THEN {r}" for ps, r, _ in reversed(T.VERSION_WORDS)) + " ELSE 0 END"
_MARKS = ", ".join(f"'{m}'" for m in T.VERSION_NUMBER_MARKS)
VERSIONS_SQL = rf"""(SELECT file, section, CASE WHEN x > 0 THEN greatest(wr, 2) + x ELSE wr END AS rank, ['исходная', 'черновик', 'откорректированная', 'актуальная'][wr + 1] AS label, coalesce(nullif(b, ''), lower(bare)) AS base,
 strftime(coalesce(try_strptime(regexp_replace(regexp_extract(file, '(20\d{{2}}[._-]\d{{2}}[._-]\d{{2}})', 1), '[._]', '-', 'g'), '%Y-%m-%d'), try_strptime(regexp_replace(regexp_extract(file, '(\d{{2}}[._-]\d{{2}}[._-]20\d{{2}})', 1), '[._]', '-', 'g'), '%d-%m-%Y')), '%Y-%m-%d') AS date
 FROM (SELECT file, section, bare, {_WORD_RANK} AS wr,
  greatest(coalesce(list_max(list_transform(t, lambda x: coalesce(try_cast(nullif(regexp_extract(x, '{T.VERSION_NUMBER}', 1), '') AS INTEGER), 0))), 0),
   coalesce(list_max(list_transform(t, lambda x, i: CASE WHEN i > 1 AND list_contains([{_MARKS}], t[i - 1]) AND regexp_matches(x, '^\d+$') THEN x::INTEGER ELSE 0 END)), 0)) AS x,
  array_to_string(list_filter(bt, lambda x, i: NOT (regexp_matches(x, '{T.VERSION_WORD}') OR regexp_matches(x, '{T.VERSION_GLUED}') OR (regexp_matches(x, '^\d{{1,2}}$') AND i > 1 AND regexp_matches(bt[i - 1], '{T.VERSION_WORD}')))), ' ') AS b
  FROM (SELECT file, section, {_BARE} AS bare, {_tok(_STEM)} AS t, {_tok(_BARE)} AS bt FROM {NAMES.sql})))"""


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return NAMES.df(spark, sf).select("file", "section", T.version_rank("file").alias("rank"), T.version_label("file").alias("label"), T.base_name("file").alias("base"), T.date_in_name("file").alias("date"))


@query(f"SELECT * FROM {VERSIONS_SQL}")
def version_names(spark: SparkSession, sf: str) -> DataFrame:
    return versions(spark, sf)


@query(r"SELECT file, nullif(concat_ws(', ', " + ", ".join(rf"CASE WHEN regexp_matches(n, '{p.replace('(?iu)', '(?i)')}') THEN '{label}' END" for p, label in T.VERSION_HINTS) + rf"), '') AS hint FROM (SELECT file, regexp_replace(file, '[._\-]+', ' ', 'g') AS n FROM {NAMES.sql})")
def version_hints(spark: SparkSession, sf: str) -> DataFrame:
    return NAMES.df(spark, sf).select("file", T.version_hint("file").alias("hint"))


@query(rf"SELECT doc_id, len(e)::INT AS n_emails, array_to_string(e, '|') AS emails, len(p)::INT AS n_phones FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{T.EMAIL}') AS e, regexp_extract_all(coalesce(text, ''), '{T.PHONE}') AS p FROM documents) WHERE len(e) + len(p) > 0")
def email_phone_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", T.emails("text").alias("e"), T.phones("text").alias("p")).where("size(e) + size(p) > 0")
    return d.select("doc_id", F.size("e").alias("n_emails"), F.array_join("e", "|").alias("emails"), F.size("p").alias("n_phones"))


QUANTITIES = Literal("n int, text string", [(1, "Выброс 12,5 т/год, шум 45 дБА; площадь 3.2 га."), (2, "12,5 т/год"), (3, None), (4, "5 м³ воды и 10 кг"), (5, "7 т. и 7 Т")], more="SELECT CAST(doc_id + 100 AS INT) AS n, concat(coalesce(text, ''), ' ', CAST(doc_id % 50 AS STRING), ',5 т/год, ', CAST(n_chars AS STRING), ' м3; ', CAST(doc_id % 90 AS STRING), ' дБА') AS text FROM documents")
_QTY = T.QUANTITY.replace("(?iu)", "(?i)")
QTY_SQL = f"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(coalesce(text, ''), '{_QTY}', 1), regexp_extract_all(coalesce(text, ''), '{_QTY}', 2)), lambda q: lower(q[1] || ' ' || q[2]))))"


#: A quantity as one group; "%" is left out, which counts only before a word.
QUANTITY_SQL = r"(?i)(\d+[.,]?\d*\s*(?:г/с|т/год|мг/м3|мг/м³|мкг/м3|дБА|дБ|ПДК|м3/сут|м³/сут|м3|м³|га|км|кВт|л/с|кг|т))(?:$|[^\p{L}\p{N}_])"


@query(f"SELECT n, array_to_string({QTY_SQL}, '|') AS quantities FROM {QUANTITIES.sql}")
def quantity_extract(spark: SparkSession, sf: str) -> DataFrame:
    return QUANTITIES.df(spark, sf).select("n", F.array_join(T.quantities("text"), "|").alias("quantities"))
