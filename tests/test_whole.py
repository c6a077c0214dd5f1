"""Operators do their whole job: codes as tokens, whole texts, all valid neighbours."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from docloom.operators import memory as M, search as R
from docloom.plans import QUERIES


def test_bm25_counts_normative_codes(spark):
    texts = {1: "по СП 47.13330.2016 и ГОСТ Р 17.1", 2: "сп 47 13330 2016 по тексту", 3: "нет норм, 47", 4: "СП 47.13330.2016, изм. 1", 5: "шум и пыль"}
    tokens = {
        1: ["по", "сп", "47", "13330", "2016", "и", "гост", "р", "17", "1", "сп47.13330.2016", "гостр17.1"],
        2: ["сп", "47", "13330", "2016", "по", "тексту", "сп47"],
        3: ["нет", "норм", "47"],
        4: ["сп", "47", "13330", "2016", "изм", "1", "сп47.13330.2016"],
        5: ["шум", "и", "пыль"],
    }
    asked = ["сп", "47", "13330", "2016", "сп47.13330.2016"]
    n, avgdl = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = round(sum(raw.values()) / len(raw), 9)
    want = {}
    for d, ts in tokens.items():
        tf = Counter(ts)
        score = sum((raw[t] if raw[t] >= 0 else 0.25 * mean) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avgdl)) for t in asked if tf[t])
        if round(score, 6) > 0:
            want[d] = round(score, 6)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "СП 47.13330.2016")], "query_id long, text string")
    got = {r.id: r.score for r in R.bm25(queries, docs, 9).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 2e-6 for d in want)
    counted = {r.term: r for r in R.vocabulary(docs).collect()}
    total = counted.pop(None)
    assert {t: r.df for t, r in counted.items()} == df and (total.df, total.length) == (n, round(avgdl * n))


def test_bm25_in_blocks_and_on_odd_rows(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30))), f"s{i % 3}") for i in range(200)] + [(None, "w1 w2 w3", "s1"), (300, None, "s1"), (301, "w1 " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", " ".join(f"w{rng.randint(0, 62)}" for _ in range(5)), f"s{i % 4}" if i % 2 else None) for i in range(12)] + [(None, "w1", None), ("none", None, None)], "query_id string, text string, target string")
    whole = lambda **x: sorted(map(tuple, R.bm25(queries, docs, 4, **x).collect()))
    one, own = whole(), whole(within=("target", "part"))
    monkeypatch.setattr(R, "SMALL", 7)
    monkeypatch.setattr(R, "SCORED_ROWS", 11)
    assert whole() == one and whole(within=("target", "part")) == own and len(one) > 30
    part = {i: p for i, _, p in rows}
    target = {r.query_id: r.target for r in queries.collect()}
    assert all(target[q] is None or part[d] == target[q] for q, d, _, _ in own) and "q3" not in {q for q, *_ in own}
    assert R.bm25(queries, docs.limit(0), 4).count() == R.bm25(queries.limit(0), docs, 4).count() == 0


def test_expansion_keeps_whole_texts(spark, tmp_path):
    texts = [f"начало {i} " + "слово " * 30 + f"конец{i}" for i in range(3)]
    spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "конец1")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = QUERIES["neighbor_expand"](spark, str(tmp_path)).first()
    assert found.text == "\n…\n".join(texts) and found.expanded_from == "0,1,2"


def test_context_is_cut_around_the_match(spark):
    text = "а" * 5000 + "ИТОГО: 12,345 т/год" + "б" * 5000
    hits = spark.createDataFrame([(1, 1, "f", "p", text, "ИТОГО"), (1, 2, "f", "q", "короткий", "нет")], "query_id long, rank int, file string, loc string, text string, match string")
    found = R.context(hits, match="match").first()
    assert found.context == "[1] f, p\n…" + text[4000:7000] + "…\n\n[2] f, q\nкороткий" and found.n_sources == 2


def test_context_query_reaches_the_eighth_hit(spark, tmp_path):
    rows = [(i, "а " * 4000 + "итого " * (9 - i) + "я " * 4000, "f", "ru") for i in range(8)] + [(i, "пусто", "f", "ru") for i in range(8, 30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "итого")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = QUERIES["answer_context"](spark, str(tmp_path)).first()
    assert found.n_sources == 8 and all("итого" in part and len(part) < 3100 for part in found.context.split("\n\n"))


def test_negatives_may_share_an_opening(spark, tmp_path):
    texts = {1: "о" * 60 + "один", 2: "о" * 60 + "два", 3: "о" * 60 + "один"}
    spark.createDataFrame([(d, t, "ru", f"f{d}") for d, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}
    found = {r.pos: (r.positive, r.negative) for r in QUERIES["hard_negative_triples"](spark, str(tmp_path)).collect()}
    assert found == {1: (sha[1], sha[2]), 2: (sha[2], sha[3]), 3: (sha[3], sha[2])}


def test_memory_by_vector_beyond_the_own_project(spark):
    rows = [(i, "own", f"r{i}", False, [1.0, 0.0]) for i in range(40)] + [(100 + i, "copies", "Вопрос", False, [1.0, 0.0]) for i in range(40)]
    rows += [(7000, "other", "a", False, [0.9, 0.1]), (7001, "other", "b", False, [0.8, 0.3]), (7002, "other", "c", True, [1.0, 0.0]), (7003, None, "d", False, [1.0, 0.0]), (7004, "other", "e", False, [0.0, 1.0])]
    memory = spark.createDataFrame(rows, "id long, project string, remark string, retracted boolean, vector array<float>")
    asked = spark.createDataFrame([(7000, "own", "вопрос", [1.0, 0.0])], "query_id long, project string, remark string, vector array<float>")
    assert [(r.id, r.rank) for r in M.similar_by_vector(asked, memory).orderBy("rank").collect()] == [(7000, 1), (7001, 2)]


def test_verbatim_and_references_are_found_wherever_they_stand(spark):
    from docloom.functions import text as T
    from docloom.operators import evaluation as E

    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x" + " ".join(words[3:])), (3, " ".join(words[:9])), (4, None), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(words[3:13])), (2, " ".join(words[:8])), (3, " ".join(words[22:])), (4, "w1 w2"), (5, "w5 w6 w7 w8 w9 w10 w12 w13 w14")], "query_id long, text string")
    assert {tuple(r) for r in E.verbatim(asked, docs).collect()} == {(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 2), (4, 1), (4, 3)}
    names = ["СП 1.2", "гост р 51", "СанПиН 2.1", "ГН 2", "му 3", "МР 4", "рд 52", "ВСН 1", "ОНД-86", "Приказ минприроды россии № 5", "постановление правительства РФ 7", "пп рф 8"]
    plain = lambda pattern: F.regexp_extract_all(F.lit(" и ".join(names)), F.lit(pattern), 0)
    old, new = spark.range(1).select(plain(T.REFERENCE), plain(T.REFERENCE_QUICK)).first()
    assert old == new and len(new) == len(names)


def test_sources_are_not_gathered_by_number(spark, tmp_path):
    """Answers of one remainder share a source; neither is dealt out by it."""
    from docloom.plans import QUERIES

    spark.createDataFrame([(i, f"{i} т и 5 м", "en", "web", 9) for i in range(-220, 200, 7)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["consistency_compare"](spark, str(tmp_path))
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_settings_of_every_event(spark, tmp_path):
    from docloom.plans import SQL
    from tests.oracle import assert_same, connection

    rows = [(1, 7, "click", '{"k": 1}'), (2, 7, "view", '{"k": 2}'), (3, 7, "click", '{"k": 3}'), (4, 7, "click", None), (5, 7, "view", None), (6, 7, None, '{"k": 9}'), (7, 8, "click", '{"k": 4}'), (8, 9, "click", None), (9, 10, None, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    out = QUERIES["settings_merged"](spark, str(tmp_path))
    assert assert_same(out, SQL["settings_merged"], connection(str(tmp_path))) == 4
    found = {r.name: r.json for r in out.collect()}
    assert found["user7"] == '{"click":{"k":3},"in":{"click":[4],"view":[0]},"last":6,"view":{"k":2}}' and found["user8"] == '{"click":{"k":4},"in":{"click":[2]},"last":7}'
    assert found["user9"] == '{"in":{"click":[3]},"last":8}' and found["user10"] == '{"last":9}'
