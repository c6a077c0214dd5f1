"""Queries of duplicates, versions, sections and inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import documents as D
from .registry import Literal, query, table
from .texts import FINGERPRINT, SHINGLES, VERSIONS_SQL, W, versions

_FP = f"f AS (SELECT doc_id, {FINGERPRINT} AS fingerprint FROM documents)"


@query(f"WITH {_FP} SELECT doc_id, o AS owner, c AS copies, CASE WHEN doc_id = o THEN 'done' ELSE 'skipped' END AS status FROM (SELECT doc_id, min(doc_id) OVER w AS o, count(*) OVER w AS c FROM f WINDOW w AS (PARTITION BY fingerprint))")
def exact_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return D.duplicate_groups(table(spark, sf, "documents"))


@query(f"WITH {_FP} SELECT min(f.doc_id) AS doc_id, f.fingerprint FROM f JOIN documents d USING (doc_id) WHERE d.lang <> 'en' AND f.fingerprint NOT IN (SELECT f.fingerprint FROM f JOIN documents d USING (doc_id) WHERE d.lang = 'en') GROUP BY f.fingerprint")
def content_dedup_index(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    index = docs.where("lang = 'en'").select(T.fingerprint("text").alias("fingerprint"))
    return D.unseen(docs.where("lang <> 'en'"), index)


@query(f"""WITH s AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM (SELECT doc_id, {SHINGLES} AS s FROM (SELECT doc_id, {W} AS w FROM documents)) WHERE len(s) > 0 GROUP BY list_sort(s)),
 e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
 i AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
 SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM i WHERE round(c::DOUBLE / (na + nb - c), 6) >= 0.85""")
def content_dup_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return D.similar_contents(table(spark, sf, "documents"))


_CURRENT = f"""(SELECT file, section, rank, date, base, section || '::' || base AS group_key, c AS is_current, CASE WHEN c AND label = 'исходная' THEN 'актуальная' ELSE label END AS label
 FROM (SELECT *, row_number() OVER (PARTITION BY section || '::' || base ORDER BY rank DESC, coalesce(date, '') DESC, file DESC) = 1 AS c FROM {VERSIONS_SQL}))"""


@query(f"SELECT * FROM {_CURRENT}")
def version_current(spark: SparkSession, sf: str) -> DataFrame:
    return D.current_versions(versions(spark, sf))


@query(f"SELECT section, file, date, label, lag(label) OVER w AS previous, row_number() OVER w::INT AS place FROM {_CURRENT} WINDOW w AS (PARTITION BY section ORDER BY coalesce(date, ''), file)".replace("OVER w::INT", "OVER w"))
def version_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return D.timeline(D.current_versions(versions(spark, sf))).withColumn("place", F.col("place").cast("long"))


# Section codes, their numbers, and words that give them away in a file's name.
AREAL = [
    ("PZ", "1", False), ("PZU", "2", False), ("AR", "3", False), ("KR", "4", True), ("IOS", "5", False), ("IOS_EOM", "5.1", True), ("IOS_VK", "5.2", False),
    ("IOS_VO", "5.3", False), ("IOS_OV", "5.4", True), ("IOS_SS", "5.5", False), ("IOS_GS", "5.6", True), ("IOS_TH", "5.7", True), ("POS", "6", True),
    ("POD", "7", False), ("OOS", "8", True), ("PB", "9", False), ("ODI", "10", False), ("EE", "10.1", False), ("SM", "11", False), ("GOCHS", "11.1", False), ("OTHER", "12", False),
]
SURVEYS = [("IEI", True), ("IGMI", True), ("IGI", True), ("IGDI", False), ("IGEI", False)]
EXTRA_SOURCES = [("OOS", "IEI"), ("OOS", "IGMI"), ("OOS", "IGI"), ("OOS", "IGEI"), ("IEI", "IGMI"), ("IEI", "IGI"), ("IEI", "IGEI"), ("IEI", "IGDI"), ("IEI", "OOS"), ("OCENKA", "IEI"), ("OCENKA", "IGMI"), ("OCENKA", "OOS")]
KEYWORDS = [
    ("OOS", "tok", "оос"), ("OOS", "tok", "пмоос"), ("OOS", "tok", "ос"), ("OOS", "sub", "охран окружающ"), ("OOS", "sub", "охрана окружающ"), ("OOS", "sub", "мероприятий по охране"),
    ("POS", "tok", "пос"), ("POS", "sub", "организац строительств"), ("POS", "sub", "организации строительства"), ("POD", "tok", "под"), ("POD", "sub", "снос"), ("POD", "sub", "демонтаж"),
    ("IEI", "tok", "иэи"), ("IEI", "sub", "инженерно экологическ"), ("IGMI", "tok", "игми"), ("IGMI", "sub", "гидрометеоролог"), ("PZ", "tok", "пз"), ("PZ", "sub", "пояснительн записк"),
    ("AR", "tok", "ар"), ("AR", "sub", "архитектурн решен"), ("KR", "tok", "кр"), ("KR", "sub", "конструктивн"), ("SM", "tok", "см"), ("SM", "tok", "смета"), ("SM", "sub", "сметн"), ("PB", "tok", "пб"), ("PB", "sub", "пожарн безопасност"),
]
LINEAR_SIGNALS = ["ппо", "полос отвод", "линейн", "трасс", "км ", "трубопровод", "газопровод", "нефтепровод", "автомобильн дорог", "лэп", "ткр"]

KEYS, NUMBERS = Literal("code string, kind string, word string", KEYWORDS), Literal("code string, num string", [x[:2] for x in AREAL])
REQUIRED, SURVEY, EXTRAS = Literal("code string, is_source boolean", [(c, s) for c, _, s in AREAL]), Literal("code string, is_source boolean", SURVEYS, more="SELECT n_name AS code, n_regionkey < 2 AS is_source FROM nation", source="nation"), Literal("target string, code string", EXTRA_SOURCES, more="SELECT CASE WHEN n_regionkey = 0 THEN 'IEI' ELSE 'OOS' END AS target, n_name AS code FROM nation", source="nation")
FILES = Literal("file string", [(f,) for f in ("П-1-ПОС1.pdf", "Раздел ПД №8_ООС.pdf", "Раздел 5.4.2 чертежи.pdf", "охрана окружающей среды том 6.pdf", "смета.xlsx", "readme.txt", "ПЗ пояснительная записка.docx", "Трасса газопровода ППО.pdf")], more="SELECT concat('Раздел ПД №', CAST(1 + doc_id % 12 AS STRING), '_', source, '_', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN ' оос' WHEN 1 THEN ' смета' WHEN 2 THEN ' охрана окружающей среды' WHEN 3 THEN ' трасса' ELSE '' END, '.pdf') AS file FROM documents")
_NORM = r"regexp_replace(lower(coalesce(file, '')), '[._\-]+', ' ', 'g')"

CLASSIFIED = rf"""(WITH n AS (SELECT file, {_NORM} AS norm, regexp_extract_all({_NORM}, '[а-яёa-z0-9]+') AS t, nullif(regexp_extract(lower(file), '(?:под)?раздел[аы]?\s*(?:пд\s*)?(?:№|no|n)?\s*(\d+(?:\.\d+)*)', 1), '') AS num FROM {FILES.sql}),
 h AS (SELECT file, code, CASE WHEN kind = 'tok' AND (list_contains(t, word) OR list_contains(list_filter(list_transform(t, lambda x: regexp_replace(x, '\d+$', '')), lambda x: length(x) >= 2), word)) THEN 5 + 0.5 * length(word)
   WHEN kind = 'sub' AND len(list_filter(string_split(word, ' '), lambda p: NOT contains(norm, p))) = 0 THEN 3 END AS score FROM n, {KEYS.sql}),
 p AS (SELECT file, unnest(generate_series(len(string_split(num, '.')), 1, -1)) AS k, num FROM n WHERE num IS NOT NULL),
 f AS (SELECT file, arg_max(code, k) AS code, CASE WHEN max(k) = any_value(len(string_split(p.num, '.'))) THEN 6 ELSE 4 END AS score FROM p JOIN {NUMBERS.sql} m ON m.num = array_to_string(string_split(p.num, '.')[1:k], '.') GROUP BY file),
 a AS (SELECT file, code, sum(score)::DOUBLE AS score FROM (SELECT * FROM h WHERE score IS NOT NULL UNION ALL SELECT * FROM f) GROUP BY file, code)
 SELECT * FROM (SELECT file, code, round(score, 1) AS score, row_number() OVER (PARTITION BY file ORDER BY score DESC, code)::INT AS rank FROM a) WHERE rank <= 3)"""


@query(f"SELECT * FROM {CLASSIFIED}")
def section_classify(spark: SparkSession, sf: str) -> DataFrame:
    return D.classify(FILES.df(spark, sf), KEYS.df(spark, sf), NUMBERS.df(spark, sf))


@query(f"SELECT CASE WHEN {' + '.join(f"max(contains(lower(file), '{s}')::INT)" for s in LINEAR_SIGNALS)} >= 2 THEN 'линейный' ELSE 'площадной' END AS object_type FROM {FILES.sql}")
def object_type(spark: SparkSession, sf: str) -> DataFrame:
    return D.object_type(FILES.df(spark, sf), LINEAR_SIGNALS)


OVERRIDES = Literal("file string, override string", [("readme.txt", "PB"), ("смета.xlsx", "UNKNOWN")])
_INVENTORY = f"(SELECT f.file, coalesce(nullif(o.override, 'UNKNOWN'), c.code, 'UNKNOWN') AS section FROM {FILES.sql} f LEFT JOIN (SELECT * FROM {CLASSIFIED} WHERE rank = 1) c USING (file) LEFT JOIN {OVERRIDES.sql} o USING (file))"


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    files = FILES.df(spark, sf)
    best = D.classify(files, KEYS.df(spark, sf), NUMBERS.df(spark, sf), top=1).select("file", F.col("code").alias("section"))
    return D.with_overrides(files.join(best, "file", "left"), OVERRIDES.df(spark, sf))


@query(f"SELECT * FROM {_INVENTORY}")
def inventory_overrides(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf)


@query(f"SELECT coalesce(r.code, p.code) AS code, coalesce(n, 0) AS n_files, coalesce(names, '') AS names, CASE WHEN n IS NULL THEN 'missing' WHEN r.code IS NULL THEN 'extra' ELSE 'present' END AS status FROM {REQUIRED.sql} r FULL JOIN (SELECT section AS code, count(*) AS n, string_agg(file, '|' ORDER BY file) AS names FROM {_INVENTORY} WHERE section <> 'UNKNOWN' GROUP BY section) p ON p.code = r.code")
def section_overview(spark: SparkSession, sf: str) -> DataFrame:
    return D.overview(inventory(spark, sf), REQUIRED.df(spark, sf)).withColumn("n_files", F.col("n_files").cast("long"))


@query(f"SELECT DISTINCT code FROM (SELECT code FROM {REQUIRED.sql} WHERE is_source UNION ALL SELECT code FROM {SURVEY.sql} WHERE is_source UNION ALL SELECT code FROM {EXTRAS.sql} WHERE target = 'IEI' UNION ALL SELECT 'IEI') WHERE code IN (SELECT code FROM {REQUIRED.sql} UNION ALL SELECT code FROM {SURVEY.sql})")
def source_sections(spark: SparkSession, sf: str) -> DataFrame:
    return D.source_sections(REQUIRED.df(spark, sf), SURVEY.df(spark, sf), EXTRAS.df(spark, sf), "IEI")


@query("SELECT count(*) AS files, sum(strlen(html))::BIGINT AS bytes FROM pages")
def manifest_measure(spark: SparkSession, sf: str) -> DataFrame:
    return D.measure(table(spark, sf, "pages"), F.octet_length("html").cast("long"))


@query("SELECT source AS file, doc_id, n_chars AS n FROM documents WHERE lang <> 'fr' AND doc_id % 7 <> 0 UNION ALL SELECT source, doc_id, -1 FROM documents WHERE doc_id % 7 = 0")
def upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").select(F.col("source").alias("file"), "doc_id", F.col("n_chars").alias("n"), "lang")
    return D.upsert(chunks.where("lang <> 'fr'").drop("lang"), chunks.where("doc_id % 7 = 0").select("file", "doc_id", F.lit(-1).cast("long").alias("n")), ["doc_id"])


@query("SELECT source AS file, doc_id FROM documents WHERE source <> (SELECT min(source) FROM documents)")
def delete_by_file(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("source").alias("file"), "doc_id")
    return D.without_file(docs, docs.agg(F.min("file")).first()[0])
