"""Queries of registers of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import registers as G, search as R
from .registry import Literal, query, table
from .texts import QTY_SQL, QUANTITIES, kind_sql, squeeze, strip

ANSWERS = Literal(
    "number string, remark string, oos_volume string, answer string, user_answer string, correction string, edit_location string, edit_was string, edit_shall string, attachments array<string>, missing_data string, low_support boolean, status string",
    [
        ("10", "Указать площадь", "6.1", "Площадь 5 га", "", "", "п. 3.1", "4 га", "5 га", ["справка ЦГМС", ""], "", False, "proposed"),
        ("1", "Приложить договор", None, "Приложен", None, "Внести договор", "", "", "", ["договор с полигоном"], "  ", True, "accepted"),
        ("2", "Нет протоколов", "6.2", "", None, "", "", "", "", [], "протокол замеров шума", False, "rejected"),
        ("3", "Проверить", "6.2", "Проверено", "Исправлено", "", "", "", "", None, None, True, "edited"),
        ("21", "Уточнить", "", "Уточнено", "", " ", "табл. 4", "", "новое", ["письмо", "выписка"], "расчёт шума", None, "proposed"),
    ],
    more="SELECT CAST(1000 + doc_id AS STRING) AS number, text AS remark, concat('6.', CAST(doc_id % 5 AS STRING)) AS oos_volume, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS answer, CASE WHEN doc_id % 6 = 0 THEN text END AS user_answer, CASE WHEN doc_id % 5 = 0 THEN lang ELSE '' END AS correction, CASE WHEN doc_id % 8 = 0 THEN concat('п. ', CAST(doc_id AS STRING)) END AS edit_location, CASE WHEN doc_id % 7 = 0 THEN source END AS edit_was, CASE WHEN doc_id % 9 = 0 THEN lang END AS edit_shall, split(concat('договор ', lang, ';письмо ', source, '; '), ';') AS attachments, CASE doc_id % 3 WHEN 0 THEN 'протокол замеров' ELSE '' END AS missing_data, doc_id % 7 = 0 AS low_support, CASE doc_id % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'edited' ELSE 'rejected' END AS status FROM documents",
)
REMARKS = Literal("pos int, number string, text string", [(1, "7", "Первое"), (2, "7", "Второе"), (3, "8", "Третье"), (4, "7", "Ещё"), (5, "10", "Указать  площадь"), (6, "1", "приложить ДОГОВОР"), (7, "2", "Нет протоколов"), (8, "21", "Другой текст")], more="SELECT CAST(doc_id + 100 AS INT) AS pos, CAST(1000 + doc_id % 700 AS STRING) AS number, CASE WHEN doc_id % 3 = 0 THEN text ELSE concat(coalesce(text, ''), ' ') END AS text FROM documents")
STORED = Literal("number string, answer string, status string", [("7", "старое", "accepted"), ("8", "старое", "rejected"), ("9", "лишнее", "proposed"), ("10", "старое", "proposed"), ("11", "отказ", "rejected")], more="SELECT CAST(1000 + doc_id AS STRING) AS number, text AS answer, CASE doc_id % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'edited' ELSE 'rejected' END AS status FROM documents")
FRESH = Literal("number string, answer string, status string", [("7", "новое", "proposed"), ("8", "новое", "proposed"), ("10", "новое", "proposed")], more="SELECT CAST(1000 + doc_id * 2 AS STRING) AS number, source AS answer, 'proposed' AS status FROM documents")


@query(f"SELECT pos, CASE WHEN k > 1 THEN number || '.' || k ELSE number END AS number, text FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY pos) AS k FROM {REMARKS.sql})")
def duplicate_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return G.renumber(REMARKS.df(spark, sf))


@query(f"""SELECT r.number, r.text FROM {REMARKS.sql} r LEFT JOIN {ANSWERS.sql} a USING (number) WHERE NOT coalesce((lower({squeeze('a.remark')}) = lower({squeeze('r.text')}) OR {strip("coalesce(a.remark, '')")} = '')
 AND (a.status IN ('accepted', 'edited') OR (a.status <> 'rejected' AND {strip("coalesce(a.answer, '')")} <> '')), false)""")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    return G.pending(REMARKS.df(spark, sf), ANSWERS.df(spark, sf))


@query(f"""SELECT number, answer, status, origin, row_number() OVER (ORDER BY pos NULLS LAST, length(number), number)::INT AS place FROM (
 SELECT coalesce(s.number, f.number) AS number, CASE WHEN k THEN s.answer ELSE f.answer END AS answer, CASE WHEN k THEN s.status ELSE f.status END AS status, CASE WHEN k THEN 'stored' ELSE 'fresh' END AS origin
 FROM (SELECT s.*, f.number AS fn, f.answer AS fa, f.status AS fs, f.number IS NULL OR coalesce(s.status IN ('accepted', 'edited'), false) AS k FROM {STORED.sql} s FULL JOIN {FRESH.sql} f ON f.number = s.number) s, LATERAL (SELECT s.fn AS number, s.fa AS answer, s.fs AS status) f) LEFT JOIN (SELECT number, min(pos) AS pos FROM {REMARKS.sql} GROUP BY number) USING (number)""")
def status_precedence_merge(spark: SparkSession, sf: str) -> DataFrame:
    order = REMARKS.df(spark, sf).groupBy("number").agg(F.min("pos").alias("pos"))
    return G.merge(order, STORED.df(spark, sf), FRESH.df(spark, sf))


_NEED = f"""(SELECT number, coalesce(oos_volume, '') AS volume, CASE WHEN len(n) = 0 AND coalesce(low_support, false) THEN ['Ответ не подтверждён источниками'] ELSE n END AS n FROM (SELECT number, oos_volume, low_support,
 list_concat(CASE WHEN {strip("coalesce(missing_data, '')")} <> '' THEN [{strip("coalesce(missing_data, '')")}] ELSE [] END, list_filter(list_transform(coalesce(attachments, []), lambda x: {strip('x')}), lambda x: x <> '')) AS n FROM {ANSWERS.sql}))"""
GAPS = f"(SELECT number, {kind_sql('need')} AS kind, {kind_sql('need', 2)} AS human, need, volume FROM (SELECT number, volume, unnest(n) AS need FROM {_NEED}))"


@query(f"SELECT * FROM {GAPS}")
def gap_rows(spark: SparkSession, sf: str) -> DataFrame:
    return G.gaps(ANSWERS.df(spark, sf))


@query(f"""SELECT kind, human, count(*) AS n, count(DISTINCT number) AS n_remarks, array_to_string(list_transform(list_sort(list_distinct(list({{'l': length(number), 'v': number}})))[1:14], lambda x: x.v), ', ') AS numbers,
 array_to_string(list_sort(list_filter(list_distinct(list(volume)), lambda v: v <> ''))[1:3], ', ') AS volumes, arg_min(need, {{'l': length(number), 'v': number, 'n': need}}) AS example FROM {GAPS} GROUP BY kind, human""")
def gaps_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return G.gaps_by_kind(G.gaps(ANSWERS.df(spark, sf)))


def _filled(*cs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({strip(f"coalesce({c}, '')")}, '')" for c in cs) + ")"


@query(f"SELECT number, coalesce({_filled('edit_location', 'oos_volume')}, '—') AS location, coalesce({_filled('edit_was')}, '—') AS was, coalesce({_filled('edit_shall', 'correction')}, '—') AS shall, status FROM {ANSWERS.sql} WHERE status <> 'rejected' AND {_filled('edit_shall', 'correction', 'edit_was')} IS NOT NULL")
def changes_rows(spark: SparkSession, sf: str) -> DataFrame:
    return G.changes(ANSWERS.df(spark, sf))


@query(f"SELECT status, count(*) AS n, count(*) FILTER (coalesce(low_support, false)) AS flagged FROM {ANSWERS.sql} GROUP BY ROLLUP (status)")
def unreviewed_stats(spark: SparkSession, sf: str) -> DataFrame:
    return G.review_stats(ANSWERS.df(spark, sf))


@query(f"SELECT number, status FROM {ANSWERS.sql} WHERE status IN ('accepted', 'edited')")
def export_filter(spark: SparkSession, sf: str) -> DataFrame:
    return G.to_export(ANSWERS.df(spark, sf)).select("number", "status")


@query(f"""SELECT number, remark, coalesce(nullif({strip("coalesce(user_answer, '')")}, ''), coalesce(answer, '')) AS answer, concat_ws(' ', CASE WHEN status = 'proposed' THEN '⚠НЕ ПРОВЕРЕН' END, CASE WHEN status = 'rejected' THEN '✗ОТКЛОНЁН' END, CASE WHEN coalesce(low_support, false) THEN '⚠БЕЗ ОПОРЫ' END) AS marks FROM {ANSWERS.sql}""")
def answers_table(spark: SparkSession, sf: str) -> DataFrame:
    return G.answer_rows(ANSWERS.df(spark, sf))


USED = Literal("number string, sources array<int>, used array<int>, unsupported boolean, confidence string", [("1", [1, 2, 3], [2], False, "high"), ("2", [], [1], False, "high"), ("3", [1], [], True, "medium"), ("4", [1, 2], [5], None, "medium")], more="SELECT CAST(1000 + doc_id AS STRING) AS number, split(concat(CAST(doc_id % 3 AS STRING), ',', CAST(3 + doc_id % 4 AS STRING)), ',') AS sources, split(CAST(doc_id % 5 AS STRING), ',') AS used, doc_id % 7 = 0 AS unsupported, 'high' AS confidence FROM documents")


@query(f"SELECT number, len(list_filter(sources, lambda s: list_contains(used, s)))::INT AS n_matched, len(list_filter(sources, lambda s: list_contains(used, s))) = 0 AS unverified, CASE WHEN len(sources) = 0 OR coalesce(unsupported, false) THEN 'low' ELSE confidence END AS confidence FROM {USED.sql}")
def answer_flags(spark: SparkSession, sf: str) -> DataFrame:
    return G.used_sources(USED.df(spark, sf))


@query("SELECT unit, count(*) AS n_values, string_agg(value, '|' ORDER BY value) AS values FROM (SELECT DISTINCT lower(o_orderpriority) AS unit, replace(floor(o_totalprice / 10000)::INT::VARCHAR, ',', '.') AS value FROM orders) GROUP BY unit HAVING count(*) > 3")
def global_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return G.contradictions(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("unit"), F.floor(F.col("o_totalprice") / 10000).cast("int").cast("string").alias("value")))


@query(f"SELECT id, len(o) AS n, array_to_string(list_sort(o)[1:8], '|') AS values FROM (SELECT a.n AS id, list_filter({QTY_SQL.replace('text', 'a.text')}, lambda x: NOT list_contains({QTY_SQL.replace('text', 'b.text')}, x)) AS o FROM {QUANTITIES.sql} a JOIN {QUANTITIES.sql} b ON b.n = a.n % 5 + 1) WHERE len(o) > 0")
def consistency_compare(spark: SparkSession, sf: str) -> DataFrame:
    q = QUANTITIES.df(spark, sf)
    # Sources have the few numbers that a remainder can give: as a rule few rows, which go to the answers.
    sources = R.small(q.where("n BETWEEN -3 AND 5").select(F.col("n").alias("m"), F.col("text").alias("source")))
    pairs = q.select(F.col("n").alias("id"), F.col("text").alias("answer")).join(sources, F.expr("m = id % 5 + 1"))
    return G.unsupported(pairs, T.quantities)


PREFER = Literal("key string, section string, ord int", [("A", "F", 1), ("A", "O", 2), ("N", "O", 1), ("R", "F", 1)])


@query(f"""WITH v AS (SELECT l_returnflag AS key, l_discount::VARCHAR AS value, l_linestatus AS section, l_shipdate::DATE::VARCHAR AS file FROM lineitem),
 g AS (SELECT key, value, count(*) AS n, array_to_string(list_sort(list_distinct(list(file)))[1:8], '|') AS sources, coalesce(min(ord), 99) AS best FROM v LEFT JOIN {PREFER.sql} USING (key, section) GROUP BY key, value)
 SELECT key, value, n, sources, row_number() OVER (PARTITION BY key ORDER BY best, n DESC, value)::INT AS place, count(*) OVER (PARTITION BY key) > 1 AS conflict FROM g""")
def indicator_variants_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_discount").cast("string").alias("value"), F.col("l_linestatus").alias("section"), F.to_date("l_shipdate").cast("string").alias("file"))
    return G.indicator_variants(found, PREFER.df(spark, sf))


LINES = Literal("n int, line string", [(1, "0301;Азота диоксид;0,85;25;96,5"), (2, "0301 Азота диоксид 1.25 12"), (3, "0330;Сера диоксид;2024;7"), (4, "2024 год 0,5"), (5, "0616 Ксилол  0,07"), (6, "итого"), (7, None), (8, "0330;Сера диоксид;0,4;1,9")], more="SELECT CAST(doc_id + 100 AS INT) AS n, concat('0', CAST(300 + doc_id % 30 AS STRING), ';Вещество ', lang, ';', CAST(doc_id % 3 AS STRING), ',', CAST(10 + doc_id % 89 AS STRING), ';', CAST(n_chars AS STRING)) AS line FROM documents")


@query(rf"""WITH p AS (SELECT n, regexp_extract(' ' || coalesce(line, ''), '[^\d](\d{{4}})(?:[^\d]|$)', 1) AS code, regexp_replace(' ' || coalesce(line, ''), '^.*?[^\d]\d{{4}}([^\d]|$)', '\1') AS tail FROM {LINES.sql}),
 r AS (SELECT n, code, trim(regexp_extract(tail, '[А-Яа-яЁёA-Za-z][А-Яа-яЁёA-Za-z \-]*')) AS name, list_filter(list_transform(regexp_extract_all(tail, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.')::DOUBLE), lambda x: x > 0 AND x <= 100 AND x <> floor(x))[1] AS share FROM p)
 SELECT code, arg_max(name, {{'s': share, 'n': -n}}) AS name, max(share) AS share, max(share) > 1 AS exceeds FROM r WHERE code <> '' AND NOT coalesce(try_cast(code AS INT) BETWEEN 1900 AND 2100, false) AND share IS NOT NULL GROUP BY code""")
def dispersion_max(spark: SparkSession, sf: str) -> DataFrame:
    return G.dispersion_max(LINES.df(spark, sf))


CODES = Literal("n int, code string", [(1, "0301"), (2, "0301"), (3, "330"), (4, ""), (5, None), (6, "0616")], more="SELECT CAST(doc_id + 100 AS INT) AS n, CASE doc_id % 4 WHEN 0 THEN CAST(1000 + doc_id AS STRING) WHEN 1 THEN lang WHEN 2 THEN CAST(2000 + doc_id % 50 AS STRING) END AS code FROM documents")


@query(rf"SELECT n, CASE WHEN {strip("coalesce(code, '')")} = '' THEN 'no code' WHEN NOT regexp_full_match({strip("coalesce(code, '')")}, '\d{{4}}') THEN 'format' WHEN count(*) OVER (PARTITION BY code) > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM {CODES.sql}")
def validate_codes(spark: SparkSession, sf: str) -> DataFrame:
    return G.validate_codes(CODES.df(spark, sf))


EDITS = Literal("number string, words array<string>", [("1", ["таблица", "выбросов", "загрязняющих"]), ("2", ["отходы", "строительства", "образование"]), ("3", ["шум"]), ("4", ["выбросы", "отходов"])], more="SELECT CAST(1000 + doc_id AS STRING) AS number, split(concat('выбросы отходы ', lower(coalesce(text, ''))), ' ') AS words FROM documents")
CHAPTERS = Literal("chapter int, stems array<string>", [(1, ["выброс", "загряз"]), (2, ["отходо", "образо"]), (3, ["отходы"])])


@query(f"""WITH s AS (SELECT number, chapter, count(*) AS score FROM (SELECT number, unnest(list_distinct(list_transform(list_filter(words, lambda w: length(w) >= 6), lambda w: left(w, 6)))) AS stem FROM {EDITS.sql}) JOIN (SELECT chapter, unnest(stems) AS stem FROM {CHAPTERS.sql}) USING (stem) GROUP BY ALL)
 SELECT e.number, b.chapter FROM {EDITS.sql} e LEFT JOIN (SELECT number, arg_min(chapter, {{'s': -score, 'c': chapter}}) AS chapter FROM s GROUP BY number) b USING (number)""")
def chapter_match(spark: SparkSession, sf: str) -> DataFrame:
    return G.best_chapter(EDITS.df(spark, sf), CHAPTERS.df(spark, sf))


@query("""WITH a AS (SELECT doc_id, lang, source, sha256(text) AS s, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE trim(text) <> ''),
 p AS (SELECT x.lang, x.doc_id, x.s AS positive, y.s AS negative, row_number() OVER (PARTITION BY x.doc_id ORDER BY (y.i - x.i + x.n) % x.n) AS k FROM a x JOIN a y ON x.lang = y.lang AND x.s <> y.s AND x.source <> y.source)
 SELECT lang AS project, doc_id AS pos, doc_id::VARCHAR AS anchor, positive, negative FROM p WHERE k = 1""")
def hard_negative_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, each named by its hash, as snippets."""
    from ..operators import evaluation as E

    d = table(spark, sf, "documents").where(F.trim("text") != "")
    return E.triples(d.select(F.col("lang").alias("project"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("remark"), F.sha2("text", 256).alias("snippet"), F.col("source").alias("file")))
