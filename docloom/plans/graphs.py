"""Queries of graphs, memory, norms and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import entities as EN, graph as GR, memory as M, normatives as N
from .registry import SQL, Literal, query, table
from .texts import _REF_LIST, REFERENCES, REFERENCES_SQL, T, reference_key_sql

EDGES = Literal("src string, dst string", GR.EDGES, more="SELECT DISTINCT concat('S', CAST(l_suppkey AS STRING)) AS src, concat('P', CAST(l_partkey AS STRING)) AS dst FROM lineitem", source="lineitem")
PRESENT, VIRTUAL, CHANGED = Literal("code string", [("POS",), ("OOS",), ("IEI",)], more="SELECT concat('S', CAST(s_suppkey AS STRING)) AS code FROM supplier", source="supplier"), Literal("code string", [(v,) for v in GR.VIRTUAL]), Literal("code string", [("TKR",), ("IGMI",)], more="SELECT concat('S', CAST(s_suppkey AS STRING)) AS code FROM supplier WHERE s_acctbal < 0", source="supplier")


@query(f"""SELECT code, CASE WHEN code IN (SELECT code FROM {VIRTUAL.sql}) THEN 'virtual' ELSE 'section' END AS kind, code IN (SELECT code FROM {PRESENT.sql}) AS present, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree
 FROM (SELECT src AS code, 0 AS i, 1 AS o FROM {EDGES.sql} UNION ALL SELECT dst, 1, 0 FROM {EDGES.sql}) GROUP BY code""")
def graph_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return GR.vertices(EDGES.df(spark, sf), PRESENT.df(spark, sf), VIRTUAL.df(spark, sf))


_WALK = f"WITH RECURSIVE e AS (SELECT * FROM {EDGES.sql}), walk AS (SELECT code, 0 AS depth, code AS via FROM {CHANGED.sql} UNION ALL SELECT e.dst, depth + 1, via || '>' || e.dst FROM walk JOIN e ON e.src = walk.code)"


@query(f"{_WALK} SELECT code, min(depth) AS depth, arg_min(via, {{'d': depth, 'v': via}}) AS via FROM walk WHERE depth > 0 GROUP BY code")
def cascade_downstream(spark: SparkSession, sf: str) -> DataFrame:
    return GR.downstream(EDGES.df(spark, sf), CHANGED.df(spark, sf))


@query(f"{_WALK} SELECT code, max(depth) AS level FROM walk GROUP BY code")
def cascade_topo_levels(spark: SparkSession, sf: str) -> DataFrame:
    edges, changed = EDGES.df(spark, sf), CHANGED.df(spark, sf)
    return GR.levels(edges, GR.downstream(edges, changed).select("code").unionByName(changed).distinct())


@query(f"""WITH r AS ({SQL['cascade_downstream']}), n AS (SELECT count(*) AS n FROM r)
 SELECT 0 AS depth, '' AS code, 'Изменение в: ' || (SELECT string_agg(DISTINCT code, ', ' ORDER BY code) FROM {CHANGED.sql}) AS line UNION ALL
 SELECT 0, ' ', CASE WHEN n = 0 THEN 'Прямых зависимых разделов не обнаружено.' ELSE 'Затронутые разделы/расчёты (проверить на согласованность):' END FROM n UNION ALL
 SELECT depth, code, '  • ' || coalesce(p.p_name, code) || ' (глубина ' || depth || '; путь: ' || replace(via, '>', ' → ') || ')' FROM r LEFT JOIN part p ON 'P' || p.p_partkey = code""")
def cascade_explained(spark: SparkSession, sf: str) -> DataFrame:
    """The report of what changes of suppliers reach, by way of the sections and of the parts they supply."""
    changed = CHANGED.df(spark, sf)
    labels = table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("label"))
    return GR.explained(changed, GR.downstream(EDGES.df(spark, sf), changed), labels)


_KG = "(SELECT 'proj:' || user_id AS u, 'pol:' || event_type AS v, 'EMITS' AS kind, ts FROM events)"


@query(f"SELECT u, v, kind, (sum(w))::BIGINT AS weight, min(a) AS first_seen, max(b) AS last_seen FROM (SELECT u, v, kind, 1 AS w, ts AS a, ts AS b FROM {_KG} UNION ALL SELECT 'proj:0', 'pol:' || event_type, 'EMITS', 5, min(ts), max(ts) FROM events GROUP BY event_type) GROUP BY ALL")
def kg_edge_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    seen = e.select(F.concat(F.lit("proj:"), F.col("user_id").cast("string")).alias("u"), F.concat(F.lit("pol:"), "event_type").alias("v"), F.lit("EMITS").alias("kind"), "ts")
    old = e.groupBy("event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).select(F.lit("proj:0").alias("u"), F.concat(F.lit("pol:"), "event_type").alias("v"), F.lit("EMITS").alias("kind"), F.lit(5).cast("long").alias("weight"), "first_seen", "last_seen")
    return GR.merge_edges(old, seen)


@query(f"SELECT DISTINCT u AS project, v AS entity FROM {_KG} WHERE contains(lower(v), 'i')")
def kg_projects_with_entity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.concat(F.lit("proj:"), F.col("user_id").cast("string")).alias("u"), F.concat(F.lit("pol:"), "event_type").alias("v"))
    return GR.projects_with(e, "I")


@query("SELECT event_type AS kind, count(*) AS nodes FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY event_type")
def kg_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type", "user_id").distinct().groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("nodes"))


MEMORY = Literal("project string, number string, remark string, answer string, retracted boolean", [("a", "1", "r1", "x", True), ("a", "2", "r2", "x", True), ("a", "3", "r3", "x", False), ("b", "1", "r4", "x", None)], more="SELECT lang AS project, CAST(doc_id AS STRING) AS number, text AS remark, source AS answer, doc_id % 5 = 0 AS retracted FROM documents")
INCOMING = Literal("project string, number string, remark string, answer string", [("a", "1", "r1", "x"), ("a", "2", "r2", "y"), ("a", "3", "r3b", "x"), ("c", "9", "r9", "z")], more="SELECT lang AS project, CAST(doc_id * 2 AS STRING) AS number, text AS remark, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS answer FROM documents")


@query(f"""SELECT project, number, CASE WHEN w THEN nr ELSE remark END AS remark, CASE WHEN w THEN na ELSE answer END AS answer, CASE WHEN w THEN false ELSE coalesce(retracted, false) END AS retracted, w AS changed FROM (
 SELECT coalesce(s.project, i.project) AS project, coalesce(s.number, i.number) AS number, s.remark, s.answer, s.retracted, i.remark AS nr, i.answer AS na, i.number IS NOT NULL AND NOT coalesce(coalesce(s.retracted, false) AND s.answer = i.answer, false) AS w
 FROM {MEMORY.sql} s FULL JOIN {INCOMING.sql} i ON s.project = i.project AND s.number = i.number)""")
def memory_upsert_retract(spark: SparkSession, sf: str) -> DataFrame:
    return M.upsert(MEMORY.df(spark, sf), INCOMING.df(spark, sf))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_MT = rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 4 AND NOT list_contains([{_STOP}], t)))"
_PAIRS = "SELECT conv_id * 100 + turn AS id, conv_id, turn, text FROM conversations"


@query(f"""WITH m AS (SELECT id, conv_id, text, {_MT} AS t FROM ({_PAIRS}) WHERE id IN (SELECT conv_id * 100 + turn FROM conversations WHERE role = 'user')),
 e AS (SELECT id, len(t) AS n, unnest(t) AS w FROM m), c AS (SELECT a.id AS query_id, b.id, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.w = b.w GROUP BY ALL),
 s AS (SELECT query_id, c.id, round(c::DOUBLE / (na + nb - c), 6) AS score FROM c JOIN m q ON q.id = c.query_id JOIN m ON m.id = c.id WHERE q.conv_id <> m.conv_id AND lower(q.text) <> lower(m.text))
 SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s WHERE score >= 0.12) WHERE rank <= 3""")
def memory_similar(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("role = 'user'")
    m = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("project"), F.col("text").alias("remark"), F.lit(False).alias("retracted")).distinct()
    return M.similar(m.withColumnRenamed("id", "query_id"), m)


@query("SELECT conv_id AS query_id, string_agg('Замечание: ' || left(coalesce(q, ''), 300) || chr(10) || 'Ответ: ' || left(coalesce(a, ''), 500), chr(10) || chr(10) ORDER BY turn) AS block FROM (SELECT u.conv_id, u.turn, min(u.text) AS q, min(a.text) AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' GROUP BY ALL) GROUP BY conv_id")
def fewshot_block(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("remark"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = u.join(a, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.min("remark").alias("remark"), F.min("answer").alias("answer"))
    return M.few_shot(pairs.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "remark", "answer"))


REGISTRY = Literal("ord int, id string, status string", [(1, "СП 47.13330.2012", "replaced"), (2, "СП 47.13330.2016", "actual"), (3, "ОНД-86", "cancelled"), (4, "ГОСТ Р 56062-2014", "actual"), (5, "ГН 2.1.6.3492-16", "actual")])


@query(f"""WITH f AS (SELECT n, unnest(list_transform({REFERENCES_SQL}, lambda r, i: {{'pos': i - 1, 'ref': r}})) AS x FROM (SELECT n, {_REF_LIST} AS l FROM {REFERENCES.sql})),
 k AS (SELECT n, x.pos::INT AS pos, x.ref AS ref, {reference_key_sql('x.ref')} AS k FROM f), g AS (SELECT ord, {reference_key_sql('id')} AS rk, lower(coalesce(status, 'actual')) AS state FROM {REGISTRY.sql}),
 e AS (SELECT n, pos, arg_max(state, ord) AS state FROM k JOIN g ON rk = k GROUP BY ALL),
 p AS (SELECT n, pos, min(ord) AS o FROM k JOIN g ON starts_with(k, left(rk, greatest(6, length(rk) - 4))) OR starts_with(rk, left(k, greatest(6, length(k) - 4))) GROUP BY ALL)
 SELECT k.n, k.pos, ref, CASE WHEN state IS NOT NULL THEN state WHEN o IS NOT NULL THEN 'edition_mismatch' ELSE 'unknown' END AS outcome FROM k LEFT JOIN e USING (n, pos) LEFT JOIN p USING (n, pos)""")
def normative_check(spark: SparkSession, sf: str) -> DataFrame:
    return N.check(REFERENCES.df(spark, sf), REGISTRY.df(spark, sf))


TERMS = Literal("alias string, code string", [("углеводороды", "0401"), ("непредельные углеводороды", "0501"), ("ксилол", "0616"), ("толуол", "0621"), ("ацетон", "1401"), ("сажа", "0328")])
TERM_TEXTS = Literal("n int, text string", [(1, "Выброс: ксилол, толуол, ацетон."), (2, "непредельные углеводороды и сажа"), (3, "углеводороды; непредельные углеводороды"), (4, "ксилолы"), (5, None)], more="SELECT CAST(item_id + 100 AS INT) AS n, concat(text, ' Ксилол, непредельные углеводороды') AS text FROM benchmark", source="benchmark")
_W = r"[^\p{L}\p{N}_]"


@query(rf"""WITH t AS (SELECT n, lower(coalesce(text, '')) AS t FROM {TERM_TEXTS.sql}), p AS (SELECT n, t, unnest(generate_series(1, length(t))) AS s FROM t),
 m AS (SELECT n, code, s, s + length(alias) AS e FROM p JOIN {TERMS.sql} a ON substr(t, s, length(alias)) = alias AND (s = 1 OR regexp_matches(substr(t, s - 1, 1), '{_W}')) AND (s + length(alias) > length(t) OR regexp_matches(substr(t, s + length(alias), 1), '{_W}')))
 SELECT DISTINCT n, code FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.n = a.n AND b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s)""")
def entity_dictionary_match(spark: SparkSession, sf: str) -> DataFrame:
    return EN.match_terms(TERM_TEXTS.df(spark, sf), TERMS.df(spark, sf))


@query("SELECT user_id::VARCHAR AS number, arg_max(event_type, {'t': ts, 'i': event_id}) AS status, arg_max(event_id, {'t': ts, 'i': event_id})::VARCHAR AS user_answer FROM events GROUP BY user_id")
def decisions_applied(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    answers = e.select(F.col("user_id").cast("string").alias("number")).distinct().select("number", F.lit("proposed").alias("status"), F.lit(None).cast("string").alias("user_answer"))
    return M.decide(answers, e.select(F.col("user_id").cast("string").alias("number"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("status"), F.col("event_id").cast("string").alias("user_answer")))
