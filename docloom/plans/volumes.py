"""Queries of volumes, contacts and provider ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import entities as EN, graph as GR, volumes as O
from .graphs import _W, EDGES, PRESENT, TERM_TEXTS, TERMS
from .registry import Literal, query

ANSWERS = Literal("number string, oos_volume string, status string", [("1", "Том 6.1", "accepted"), ("2", "том 6", "edited"), ("3", "", "accepted"), ("4", "том 6.1", "rejected"), ("5", "Том 6.1 ООС.docx", "accepted"), ("6", "том 9", "accepted"), ("7", None, "edited")], more="SELECT CAST(1000 + doc_id AS STRING) AS number, concat('Том ', CAST(doc_id % 15 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '' END) AS oos_volume, CASE doc_id % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'edited' ELSE 'rejected' END AS status FROM documents")
FILES = Literal("pos int, file string", [(1, "Том 6 ООС.docx"), (2, "Том 6.1 ООС.docx"), (3, "Том 6.2.docx")], more="SELECT CAST(n_nationkey + 10 AS INT) AS pos, concat('Том ', CAST(n_nationkey AS STRING), '.docx') AS file FROM nation", source="nation")


def _bounded(hay: str, needle: str) -> str:
    return f"({needle} <> '' AND regexp_matches({hay} || ' ', regexp_escape({needle}) || '[^\\d.]'))"


_V, _N, _STEM = "lower(trim(coalesce(oos_volume, '')))", "lower(file)", r"regexp_replace(lower(file), '\.[^./\\]+$', '')"
_BELONGS = rf"({_V} <> '' AND ({_bounded(_N, _V)} OR {_bounded(_V, _N)} OR {_bounded(_V, _STEM)} OR (regexp_matches({_V}, '\.(docx|doc|pdf)$') AND {_bounded(_N, f"regexp_replace({_V}, '\\.[^./\\\\]+$', '')")})))"


@query(f"""WITH a AS (SELECT * FROM {ANSWERS.sql} WHERE status IN ('accepted', 'edited')), m AS (SELECT number, file FROM a JOIN {FILES.sql} f ON {_BELONGS})
 SELECT * FROM m UNION ALL SELECT number, (SELECT arg_min(file, pos) FROM {FILES.sql}) FROM a WHERE number NOT IN (SELECT number FROM m)""")
def correction_volumes(spark: SparkSession, sf: str) -> DataFrame:
    return O.assign(ANSWERS.df(spark, sf), FILES.df(spark, sf))


HEALTH = Literal("provider string, ok boolean, best_model string, tier double, quality int, ms int", [("a", True, "x-70b", 0.0, 1, 300), ("local", True, "chat:14b", 2.0, 0, None), ("b", True, "m", 1.0, 0, 100), ("c", False, "m", 0.0, 0, 1), ("d", True, "", 0.0, 0, 1), ("e", True, "y", 1.0, 0, 50)], more="SELECT s_name AS provider, s_acctbal > 0 AS ok, concat('chat:', CAST(s_suppkey % 80 AS STRING), 'b') AS best_model, CAST(s_nationkey % 3 AS DOUBLE) AS tier, CAST(s_suppkey % 4 AS INT) AS quality, CAST(s_suppkey % 7 AS INT) AS ms FROM supplier", source="supplier")
_SIZE = r"coalesce(try_cast(nullif(regexp_extract(lower(best_model), '[:\-_ ](\d{1,3}(?:\.\d)?)\s*b(?:$|[^\p{L}\p{N}_])', 1), '') AS DOUBLE), try_cast(nullif(regexp_extract(lower(best_model), '(\d{2,3})b', 1), '') AS DOUBLE), 0)"


@query(f"SELECT provider, row_number() OVER (ORDER BY CASE WHEN provider = 'local' AND {_SIZE} >= 13 THEN 0.5 ELSE tier END, quality, coalesce(ms, 1000000), provider)::INT AS place FROM {HEALTH.sql} WHERE ok AND best_model <> ''")
def provider_order(spark: SparkSession, sf: str) -> DataFrame:
    return O.working_order(HEALTH.df(spark, sf))


MODELS = Literal("provider string, pos int, model string", [("a", 1, "big-chat-large"), ("a", 2, "big-chat"), ("a", 3, "text-embed-3"), ("a", 4, "mini"), ("a", 5, "other"), ("b", 1, "x")], more="SELECT p_brand AS provider, CAST(p_partkey AS INT) AS pos, concat(p_type, '-', CAST(p_partkey AS STRING)) AS model FROM part", source="part")
LIKED = Literal("provider string, ord int, pattern string", [("a", 1, "^mini"), ("a", 2, "chat")], more="SELECT DISTINCT p_brand AS provider, CAST(1 AS INT) AS ord, lower(p_type) AS pattern FROM part WHERE p_size = 10", source="part")


@query(f"""WITH c AS (SELECT * FROM {MODELS.sql} WHERE NOT regexp_matches(lower(model), 'bge|embed|rerank|whisper|tts|audio|image|vision-only|dall|sora|veo|imagen|moderation|guard|nomic|minilm|clip')),
 l AS (SELECT provider, model, min(ord) AS ord FROM c JOIN {LIKED.sql} USING (provider) WHERE regexp_matches(lower(model), lower(pattern)) GROUP BY ALL)
 SELECT * FROM (SELECT provider, model, row_number() OVER (PARTITION BY provider ORDER BY ord NULLS LAST, CASE WHEN ord IS NOT NULL THEN length(model) ELSE pos END, pos)::INT AS place FROM c LEFT JOIN l USING (provider, model)) WHERE place <= 4""")
def model_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return O.ranked_models(MODELS.df(spark, sf), LIKED.df(spark, sf))


TITLES = Literal("file string, page int, text string", [("a.docx", 0, "ООО «Эко Проект»\nГИП: Иванов И.И.\ntel +7 (495) 123-45-67, a@b.ru"), ("a.docx", 1, "Разработал Петров П.П."), ("b.docx", 0, "ГИП Иванов И.И.\nЭксперт Сидоров С. С."), ("b.docx", 5, "Директор Поздно П.П."), ("c.docx", 0, None)], more="SELECT CAST(doc_id AS STRING) AS file, CAST(doc_id % 8 AS INT) AS page, concat('ООО «', source, '»', chr(10), 'ГИП: Иванов И.И.', chr(10), coalesce(text, '')) AS text FROM documents")


@query()
def contacts(spark: SparkSession, sf: str) -> DataFrame:
    return O.contacts(TITLES.df(spark, sf))


@query(f"""SELECT DISTINCT trim(regexp_replace(o, '\\s+', ' ', 'g')) AS organisation FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{O.ORGANISATION}')) AS o FROM {TITLES.sql})""")
def organisations(spark: SparkSession, sf: str) -> DataFrame:
    return O.organisations(TITLES.df(spark, sf))


@query(f"SELECT src, dst, src IN (SELECT code FROM {PRESENT.sql}) AS src_present, dst IN (SELECT code FROM {PRESENT.sql}) AS dst_present FROM {EDGES.sql}")
def edge_presence(spark: SparkSession, sf: str) -> DataFrame:
    return GR.edges_present(EDGES.df(spark, sf), PRESENT.df(spark, sf))


@query(rf"""WITH t AS (SELECT n, lower(coalesce(text, '')) AS t FROM {TERM_TEXTS.sql}), p AS (SELECT n, t, unnest(generate_series(1, length(t))) AS s FROM t),
 m AS (SELECT n, code, s, s + length(alias) AS e FROM p JOIN {TERMS.sql} a ON substr(t, s, length(alias)) = alias AND (s = 1 OR regexp_matches(substr(t, s - 1, 1), '{_W}')) AND (s + length(alias) > length(t) OR regexp_matches(substr(t, s + length(alias), 1), '{_W}')))
 SELECT code, count(DISTINCT n) AS n_answers FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.n = a.n AND b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s) GROUP BY code""")
def emission_substances(spark: SparkSession, sf: str) -> DataFrame:
    found = EN.match_terms(TERM_TEXTS.df(spark, sf), TERMS.df(spark, sf))
    return found.groupBy("code").agg(F.countDistinct("n").alias("n_answers"))


