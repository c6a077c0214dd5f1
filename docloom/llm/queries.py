"""The registered query of each operator of this subpackage, and its SQL where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, jaccard, linededup, maxscore, minhash, packing, periodic, quality, spelling, substring, token_store, warc
from .common import workspace
from .tokens import WORD_BPE

END_ID = 2


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "token-store")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_store.read_tokens(spark, path, ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_table(spark, sf_dir, "documents"), window=20)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out("doc_id")), "quality")
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "warc")
    warc.write(warc.with_revisits(_table(spark, sf_dir, "pages"), "page_id", "html", "url"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    # Two scans with the record type pushed down: responses' payloads are held against their digests, revisits are read by their headers.
    kind = lambda name: warc.read(spark, path, payload=False, verify=name == "response", bytes_per_partition=8 << 20).where(F.col("record_type") == name)
    back = kind("response").unionByName(kind("revisit"))
    return back.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"), shingle=4, at_least=Fraction(85, 100))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"), min_lines=3)


def op8_linededup_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line, also those that are repeated singly or in pairs."""
    return linededup.report(_table(spark, sf_dir, "documents"), min_lines=1)


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def _with_periods(docs: DataFrame) -> DataFrame:
    """The query's texts: of each tenth document by the CRC-32 of its id, the words from one on repeat with a period (see the SQL's ``planted``)."""

    @F.pandas_udf("string")
    def planted(ids, texts):
        out = list(texts)
        for row, (doc, text) in enumerate(zip(ids, texts, strict=True)):
            h = zlib.crc32(doc.encode()) if doc else 1
            words = (text or "").encode().split() if h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                out[row] = b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))]).decode()
        return type(texts)(out, dtype=object)

    return docs.withColumn("text", planted(F.col("doc_id").cast("string"), "text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_with_periods(_table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.similar(_table(spark, sf_dir, "documents"), shingle=5, at_least=Fraction(85, 100))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _slip(doc_id: int | None) -> Callable[[str], str]:
    """The query's slips of the pen: of each 199th word of a document by the CRC-32 of id and word, one code point goes."""
    if doc_id is None:
        return lambda word: word
    start = zlib.crc32(f"{doc_id}:".encode())

    def slip(word: str) -> str:
        h = zlib.crc32(word.encode(), start)
        return word if h % 199 else word[: (at := h % len(word))] + word[at + 1 :]

    return slip


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return spelling.variants(spelling.words(docs, least_length=6, least_count=5, change=_slip), times=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_substring": op4_substring,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_jaccard": op7_jaccard,
    "op8_linededup": op8_linededup,
    "op8_linededup_single": op8_linededup_single,
    "op9_maxscore": op9_maxscore,
    "op10_bpe": op10_bpe,
    "op11_periodic": op11_periodic,
    "op12_minhash": op12_minhash,
    "op13_spelling": op13_spelling,
}

#: SQL for the table of CRC-32 by byte, from its polynomial.
_CRC_TABLE = """tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], generate_series(1, 8)),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(generate_series(0, 255)) AS i)))"""


def _crc(x: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8, from the table's column t."""
    digit = lambda at: f"strpos('0123456789ABCDEF', substr(hex({x}), {at}, 1))"
    octets = f"list_transform(generate_series(1, len(hex({x})) // 2), lambda j: ({digit('2 * j - 1')} * 16 + {digit('2 * j')} - 17)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
    "op4_substring": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS p, w FROM t WHERE len(w) >= 20),
             h AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 19], ' ')) AS k FROM g),
             r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM h) WHERE n > 1),
             gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS p FROM r),
             gl AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
        SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(ps, i::BIGINT), false)), ' '), '')) AS kept_sha256
        FROM t LEFT JOIN gl USING (doc_id)""",
    "op7_jaccard": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM t),
             e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
             i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM i WHERE 100 * c >= 85 * (na + nb - c)),
             d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT d.b, reach.r FROM reach JOIN d ON d.a = reach.v)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r) AS component_id FROM s JOIN reach ON reach.v = s.doc_id GROUP BY s.doc_id, s.s""",
    "op8_linededup": r"""
        WITH t AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*')) AS w FROM documents),
             g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS p, w FROM t WHERE len(w) >= 3),
             r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w[p:p + 2] ORDER BY doc_id, p) AS n FROM g) WHERE n > 1),
             gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 2)) AS p FROM r),
             gl AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
        SELECT t.doc_id, len(w)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(ps, i::BIGINT), false)), chr(10)), '')) AS kept_sha256
        FROM t LEFT JOIN gl USING (doc_id)""",
    "op8_linededup_single": r"""
        WITH t AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*')) AS w FROM documents),
             g AS (SELECT doc_id, unnest(w) AS line, unnest(generate_series(1, len(w))) AS p FROM t WHERE len(w) > 0),
             k AS (SELECT doc_id, p, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS n FROM g),
             s AS (SELECT doc_id, count(*) FILTER (n > 1) AS n_removed, string_agg(line, chr(10) ORDER BY p) FILTER (n = 1) AS kept FROM k GROUP BY doc_id)
        SELECT t.doc_id, len(w)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM t LEFT JOIN s USING (doc_id)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
             first AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload),
             bits AS (SELECT page_id, strlen(payload) AS payload_bytes, first,
                      array_to_string(list_transform(generate_series(1, 40), lambda i: lpad(bin(strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '') AS b
                      FROM p JOIN first USING (payload))
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(generate_series(0, 31), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + list_sum(list_transform(generate_series(1, 5), lambda k: CASE WHEN substr(b, 5 * j + k, 1) = '1' THEN (1 << (5 - k)::INT) ELSE 0 END))::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM bits""",
    "op9_maxscore": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.c, d.c)::BIGINT AS score
                   FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
             r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_periodic": rf"""
        WITH {_CRC_TABLE},
             o AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             h AS (SELECT r, {_crc("doc_id::VARCHAR")} AS h FROM o, tab),
             a AS (SELECT r, doc_id, w, h, h // 10 AS g, len(w) AS n, (h // 10) % len(w) AS a FROM o JOIN h USING (r)),
             planted AS (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(generate_series(0, n - 1),
                         lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
             e AS (SELECT r, unnest(w) AS w, unnest(generate_series(0, len(w) - 1)) AS i, len(w) AS n FROM planted WHERE len(w) > 0),
             same AS (SELECT x.r, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
             isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
             stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS n FROM isle GROUP BY r, q, k),
             run AS (SELECT r, s, n, min(q) AS q FROM stretch WHERE n >= greatest(6, 4 * q) GROUP BY r, s, n),
             told AS (SELECT r, count(*) AS n_runs, min({{'minus': -n, 's': s, 'q': q}}) AS best, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY r),
             gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(generate_series(s + q, s + n - 1)) AS i FROM run) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.minus)::BIGINT AS length, best.q::BIGINT AS period,
               (1000 * -best.minus // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i::BIGINT - 1), false)), ' '), '')) AS collapsed_sha256
        FROM planted LEFT JOIN told USING (r) LEFT JOIN gone USING (r)""",
    "op12_minhash": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(generate_series(1, len(w) - 4), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS s FROM t),
             e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
             i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM i WHERE 100 * c >= 85 * (na + nb - c)),
             d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT d.b, reach.r FROM reach JOIN d ON d.a = reach.v)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept FROM s JOIN reach ON reach.v = s.doc_id GROUP BY s.doc_id, s.s""",
    "op13_spelling": rf"""
        WITH RECURSIVE {_CRC_TABLE},
             t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+') AS w FROM documents),
             d AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM t) GROUP BY doc_id, w),
             h AS (SELECT w, n, {_crc("(doc_id || ':' || w)")} AS h FROM d, tab),
             v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % len(w)) || substr(w, h % len(w) + 2) ELSE w END AS word, n FROM h) GROUP BY word
                   HAVING len(word) >= 6 AND sum(n) >= 5),
             x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(generate_series(1, len(word))) AS i FROM v)),
             p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
                   UNION SELECT x.x, v.n, x.word, x.n FROM x JOIN v ON v.word = x.x
                   UNION SELECT x.word, x.n, x.x, v.n FROM x JOIN v ON v.word = x.x),
             k AS (SELECT word, count(*) AS n_near, min({{'minus': -near_n, 'form': near}}) AS best FROM p GROUP BY word),
             f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.minus >= 5 * v.n THEN best.form END AS form, CASE WHEN -best.minus >= 5 * v.n THEN -best.minus END AS form_n FROM v LEFT JOIN k USING (word)),
             s AS (SELECT word, word AS last, 0 AS step FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.last WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, root.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM f JOIN (SELECT word, arg_max(last, step) AS root FROM s GROUP BY word) root USING (word)""",
}

