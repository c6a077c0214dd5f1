"""Queries of retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import search as R
from ..operators.tables import saved
from .registry import Literal, query, table
from .texts import _REF_LIST, REFERENCES_SQL, reference_key_sql

#: Words, and each normative code as one more token.
_CODES = f"list_transform(list_filter(list_transform([{_REF_LIST}], lambda l: {REFERENCES_SQL})[1], lambda r: true), lambda r: regexp_replace({reference_key_sql('r')}, '[-/]+$', ''))"
TOK = rf"list_concat(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_\-]+'), CASE WHEN regexp_matches(coalesce(text, ''), '\d') THEN {_CODES} ELSE [] END)"

BM25 = rf"""toks AS (SELECT doc_id AS id, lang, {TOK} AS t FROM documents),
 post AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM toks) GROUP BY id, len(t), term),
 tot AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM toks),
 raw AS (SELECT term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS raw FROM (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term), tot),
 stats AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT round(avg(raw), 9) FROM raw) * 0.25e0 ELSE raw END AS idf FROM raw),
 asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL),
 scored AS (SELECT query_id, id, round(sum(qtf * (idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)))), 6) AS score FROM post JOIN stats USING (term) JOIN asked USING (term), tot {{where}} GROUP BY query_id, id),
 bm25 AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= {{k}})"""


def bm25_sql(k: int, where: str = "") -> str:
    return BM25.replace("{where}", where).replace("{k}", str(k))


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {bm25_sql(8)} SELECT query_id, id, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(queries_of(spark, sf), table(spark, sf, "documents"), 8)


@query(f"WITH {bm25_sql(5, "WHERE id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de'))")} SELECT query_id, id, score, rank FROM bm25")
def bm25_section_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(queries_of(spark, sf), table(spark, sf, "documents"), 5, where=F.col("lang").isin("en", "de"))


@query(f"WITH {bm25_sql(1)} SELECT (SELECT n FROM tot) AS n, round((SELECT avgdl FROM tot), 6) AS avgdl, count(*) AS vocabulary, round(avg(idf), 6) AS mean_idf, max(df) AS max_df FROM stats")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    counted = saved(R.vocabulary(table(spark, sf, "documents")), "vocabulary")
    totals = counted.where("term IS NULL").select(F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    s = R.term_stats(counted.where("term IS NOT NULL").select("term", "df"), totals).agg(F.count(F.lit(1)).alias("vocabulary"), F.round(F.avg("idf"), 6).alias("mean_idf"), F.max("df").alias("max_df"))
    return totals.select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(s)


_TARGETS = "SELECT item_id AS query_id, text, concat('src', CAST(item_id % 7 AS STRING)) AS target FROM {t}"


@query(f"WITH {bm25_sql(1, "WHERE (query_id, id) IN (SELECT q.query_id, d.doc_id FROM (" + _TARGETS.replace("{t}", "benchmark") + ") q JOIN documents d ON d.source = q.target)")} SELECT query_id, id AS volume, score FROM bm25")
def target_volume(spark: SparkSession, sf: str) -> DataFrame:
    """The best document for each passage in the one source that it asks for."""
    asked = spark.sql(_TARGETS, t=table(spark, sf, "benchmark"))
    return R.bm25(asked, table(spark, sf, "documents"), 1, within=("target", "source")).select("query_id", F.col("id").alias("volume"), "score")


_CODED = "SELECT {id}, concat(coalesce(text, ''), ' по СП ', CAST(30 + {id} % 40 AS STRING), '.13330.2016 и ГОСТ Р ', CAST(56000 + {id} % 300 AS STRING), '-2014.') AS text FROM {name}"


@query("WITH " + bm25_sql(8).replace("FROM documents", f"FROM (SELECT *, NULL AS lang FROM ({_CODED.format(id='doc_id', name='documents')}))").replace("FROM benchmark", f"FROM ({_CODED.format(id='item_id', name='benchmark')})") + " SELECT query_id, id, score, rank FROM bm25")
def bm25_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Passages and documents that name norms, whose codes are tokens."""
    coded = lambda key, name: spark.sql(_CODED.format(id=key, name="{t}"), t=table(spark, sf, name))
    return R.bm25(coded("item_id", "benchmark").withColumnRenamed("item_id", "query_id"), coded("doc_id", "documents"), 8)


DENSE = """vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 6) AS score FROM vec q JOIN vec d ON q.vec_id <> d.vec_id {where} WHERE q.vec_id % 50 = 0),
 dense AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM pairs) WHERE rank <= 5)"""


def _dense(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.dense(asked, e.where(where).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 5)


@query(f"WITH {DENSE.format(where='')} SELECT * FROM dense")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf)


@query(f"WITH {DENSE.format(where='AND d.label IN (1, 2, 3)')} SELECT * FROM dense")
def cosine_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, "label IN (1, 2, 3)")


LISTS = Literal(
    "query_id long, list int, is_dense boolean, weight double, rank int, id long",
    [(1, 1, False, 1.0, 1, 10), (1, 1, False, 1.0, 2, 11), (1, 2, True, 1.0, 1, 11), (1, 2, True, 1.0, 2, 12), (1, 3, True, 1.0, 1, 12), (1, 3, True, 1.0, 2, 10), (2, 1, False, 10.0, 3, 7), (2, 2, True, 1.0, 1, 8), (2, 2, True, 1.0, 2, 7)],
    more="SELECT 10 + doc_id % 200 AS query_id, CAST(doc_id % 3 AS INT) AS list, doc_id % 3 > 0 AS is_dense, CAST(2 AS DOUBLE) AS weight, CAST(1 + n_chars % 50 AS INT) AS rank, n_chars % 90 AS id FROM documents",
)
RRF = "rrf AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM (SELECT query_id, id, round(coalesce(sum(CASE WHEN NOT is_dense THEN weight / (60 + rank) END), 0) + coalesce(avg(CASE WHEN is_dense THEN weight / (60 + rank) END), 0), 9) AS score FROM lists GROUP BY query_id, id))"


@query(f"WITH lists AS {LISTS.sql}, {RRF} SELECT * FROM rrf")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return R.rrf(LISTS.df(spark, sf))


#: A document's embedding is the vector with its number in the vector table; a query's is that of its item number.
HYBRID = f"""{bm25_sql(20)}, vec AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 6) AS score FROM vec q JOIN vec d ON q.vec_id <> d.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
 dense AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM pairs) WHERE rank <= 20),
 lists AS (SELECT query_id, false AS is_dense, 1.5e0 AS weight, rank, id FROM bm25 UNION ALL SELECT query_id, true, 1e0, rank, id FROM dense), {RRF}"""


@query(f"WITH {HYBRID} SELECT query_id, id, score, rank FROM rrf WHERE rank <= 10")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    asked = queries_of(spark, sf)
    lexical = R.bm25(asked, table(spark, sf, "documents"), 20).select("query_id", F.lit(False).alias("is_dense"), F.lit(1.5).alias("weight"), "rank", "id")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    by_vector = asked.select("query_id").join(vectors.withColumnRenamed("id", "query_id"), "query_id")
    near = R.dense(by_vector, vectors, 20).select("query_id", F.lit(True).alias("is_dense"), F.lit(1.0).alias("weight"), "rank", "id")
    return R.rrf(lexical.unionByName(near), top=10)


CHUNKS = "chunks AS (SELECT doc_id AS id, source AS file, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS chunk_index, contains(text, ' | ') OR contains(text, '###') AS is_table, text FROM documents)"
RUNS = "runs AS (SELECT *, CASE WHEN is_table THEN (chunk_index - row_number() OVER (PARTITION BY file, is_table ORDER BY chunk_index))::INT END AS run FROM chunks)"


def chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    at = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), (F.row_number().over(at) - 1).alias("chunk_index"), (F.col("text").contains(" | ") | F.col("text").contains("###")).alias("is_table"), "text")


@query(f"WITH {CHUNKS}, {RUNS} SELECT file, run, min(chunk_index) AS first_chunk, count(*) AS n FROM runs WHERE run IS NOT NULL GROUP BY file, run")
def table_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = R.table_runs(chunks_of(spark, sf)).where("run IS NOT NULL")
    return r.groupBy("file", "run").agg(F.min("chunk_index").alias("first_chunk"), F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {bm25_sql(6)}, {CHUNKS}, {RUNS},
 a AS (SELECT query_id, rank, b.id AS hit, file, chunk_index AS at, run FROM bm25 b JOIN runs r ON r.id = b.id),
 near AS (SELECT query_id, rank, hit, r.id FROM a JOIN runs r ON r.file = a.file AND r.chunk_index BETWEEN a.at - 1 AND a.at + 1 UNION SELECT query_id, rank, hit, r.id FROM a JOIN runs r ON r.file = a.file AND r.run = a.run),
 first AS (SELECT * EXCLUDE c FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank) AS c FROM near) WHERE c = 1),
 kept AS (SELECT * FROM first UNION ALL SELECT query_id, rank, hit, hit FROM a WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.query_id = a.query_id AND f.hit = a.hit))
 SELECT query_id, rank, hit AS id, string_agg(c.text, chr(10) || '…' || chr(10) ORDER BY c.chunk_index) AS text, string_agg(c.id::VARCHAR, ',' ORDER BY c.chunk_index) AS expanded_from FROM kept JOIN chunks c ON c.id = kept.id GROUP BY query_id, rank, hit""")
def neighbor_expand(spark: SparkSession, sf: str) -> DataFrame:
    hits = R.bm25(queries_of(spark, sf), table(spark, sf, "documents"), 6)
    out = R.neighbours(hits, chunks_of(spark, sf))
    return out.withColumn("expanded_from", F.array_join(F.transform("expanded_from", lambda x: x.cast("string")), ","))


@query()
def near_duplicate_pool(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    hits = R.bm25(queries_of(spark, sf), docs, 8)
    return R.near_duplicates(hits.join(docs.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 3).cast("int").alias("version_rank")), "id"))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> ''))"


@query(f"""WITH {bm25_sql(12)}, p AS (SELECT b.query_id, b.rank, b.id, {_WORDS.format(x='q.text')} AS a, {_WORDS.format(x='d.text')} AS c FROM bm25 b JOIN documents d ON d.doc_id = b.id JOIN benchmark q ON q.item_id = b.query_id),
 s AS (SELECT query_id, rank, id, CASE WHEN len(a) = 0 THEN 0e0 ELSE round(len(list_intersect(a, c))::DOUBLE / len(a), 6) END AS rerank_score FROM p)
 SELECT * FROM (SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INT AS rank FROM s) WHERE rank <= 4""")
def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    docs, asked = table(spark, sf, "documents"), queries_of(spark, sf)
    hits = R.bm25(asked, docs, 12)
    pairs = hits.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(asked.select("query_id", F.col("text").alias("query")), "query_id")
    return R.rerank(pairs, 4, R.token_overlap).select("query_id", "id", "rerank_score", "rank")


#: The place that a hit's text is cut around: the passage itself if it is there, or its first word of 4 letters or more that is.
_MATCH = r"coalesce(list_filter(list_concat([q.text], string_split_regex(q.text, '\s+')), lambda w: length(w) > 3 AND contains(d.text, w))[1], '')"


@query(rf"""WITH {bm25_sql(8)}, h AS (SELECT query_id, rank, source, lang, d.text AS t, length(d.text) AS n, greatest(0, greatest(strpos(d.text, {_MATCH}) - 1, 0) - 1000) AS s FROM bm25 b JOIN documents d ON d.doc_id = b.id JOIN benchmark q ON q.item_id = b.query_id),
 c AS (SELECT query_id, rank, source, lang, CASE WHEN n <= 3000 THEN t ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substr(t, s + 1, 3000) || CASE WHEN s + 3000 < n THEN '…' ELSE '' END END AS part FROM h)
 SELECT query_id, string_agg('[' || rank || '] ' || source || ', ' || lang || chr(10) || part, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_sources FROM c GROUP BY query_id""")
def answer_context(spark: SparkSession, sf: str) -> DataFrame:
    """Eight hits of 3000 characters around the match, as the operator and the reference have them."""
    docs, asked = table(spark, sf, "documents"), queries_of(spark, sf)
    hits = R.bm25(asked, docs, 8).join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("lang").alias("loc"), "text"), "id")
    parts = F.concat(F.array("query"), F.split("query", r"\s+"))
    match = F.get(F.filter(parts, lambda w: (F.length(w) > 3) & F.contains("text", w)), 0)
    return R.context(hits.join(asked.select("query_id", F.col("text").alias("query")), "query_id").withColumn("match", match), match="match")


TRUTH = "truth AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"""WITH {bm25_sql(8)}, {TRUTH}, best AS (SELECT t.query_id, min(rank) AS rank FROM truth t LEFT JOIN bm25 b ON b.query_id = t.query_id AND b.id = t.id GROUP BY t.query_id)
 SELECT count(*) AS n, round(avg(CASE WHEN rank <= 8 THEN 1e0 ELSE 0e0 END), 6) AS recall_at_8, round(avg(coalesce(1e0 / rank, 0)), 6) AS mrr, count(*) FILTER (rank IS NULL) AS misses FROM best""")
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of the benchmark against the documents that hold them word for word, found by whole passages' hashed first words and checked."""
    from ..operators import evaluation as E

    docs, asked = table(spark, sf, "documents"), queries_of(spark, sf)
    return E.metrics(R.bm25(asked, docs, 8), E.verbatim(asked, docs), 8)
