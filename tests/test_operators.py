"""Operators on small tables: fusion, expansion, memory, graphs, sources, streams."""

import io
import zipfile

from pyspark.sql import functions as F

from docloom.operators import chunks as C, documents as D, graph as GR, memory as M, search as R
from docloom.sources import files as S
from docloom.streaming import jobs as J


def test_rrf_keeps_order_and_weight(spark):
    lists = spark.createDataFrame([(1, False, 1.0, i, i) for i in range(1, 6)], "query_id long, is_dense boolean, weight double, rank int, id long")
    assert [r.id for r in R.rrf(lists).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    lifted = lists.unionByName(spark.createDataFrame([(1, True, 10.0, 1, 9)], lists.schema))
    assert R.rrf(lifted).where("rank = 1").first().id == 9


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "слово")], "query_id long, text string")
    assert R.bm25(asked, docs, 3).count() == 0


def test_near_duplicates_prefer_newer(spark):
    text = " ".join(f"слово{i}" for i in range(30))
    pool = spark.createDataFrame([(1, 1, 10, 0, text), (1, 2, 11, 3, text), (1, 3, 12, 0, "другое " * 3)], "query_id long, rank int, id long, version_rank int, text string")
    assert [(r.rank, r.id) for r in R.near_duplicates(pool).orderBy("rank").collect()] == [(1, 11), (2, 12)]


def test_query_expansion(spark):
    q = spark.createDataFrame([(1, "Шум")], "query_id long, text string")
    found = R.expand_queries(q, 2, lambda texts: [["ШУМ", "уровень шума", "дБА", "ещё"] for _ in texts]).orderBy("n").collect()
    assert [r.text for r in found] == ["Шум", "уровень шума", "дБА"] and R.expand_queries(q).count() == 1


def test_memory_returns_after_a_new_answer(spark):
    stored = spark.createDataFrame([("a", "1", "r", "x", False)], "project string, number string, remark string, answer string, retracted boolean")
    gone = M.retract(stored, stored.select("project", "number"))
    same = M.upsert(gone, stored.select("project", "number", "remark", "answer")).first()
    other = M.upsert(gone, stored.select("project", "number", "remark", F.lit("y").alias("answer"))).first()
    assert (same.retracted, same.changed, other.retracted, other.changed) == (True, False, False, True)


def test_downstream_reaches_once(spark):
    edges = spark.createDataFrame(GR.EDGES, "src string, dst string")
    found = {r.code: r.depth for r in GR.downstream(edges, spark.createDataFrame([("PZU",)], "code string")).collect()}
    assert found["POS"] == 1 and found["OOS"] == 2 and found["SZZ"] == 3
    assert GR.downstream(edges, spark.createDataFrame([("SZZ",)], "code string")).count() == 0


def test_chunk_ids_are_stable(spark):
    pages = spark.createDataFrame([("p", "f", 0, "стр. 3", "OOS", "шапка\n" + "строка таблицы | 1\n" * 200, True)], "project string, file string, page int, loc string, section string, text string, is_table boolean")
    a, b = (C.build(pages).orderBy("chunk_index").collect() for _ in range(2))
    assert [r.id for r in a] == [r.id for r in b] and len(a) > 2 and a[1].text.startswith("шапка") and a[0].page_number == 3


def test_embedding_only_sends_misses(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string")
    cache = spark.createDataFrame([], "k string, vector array<float>")
    whole, fresh = C.embedded(chunks, cache, "m", lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert whole.count() == 3 and fresh.count() == 2
    assert C.embedded(chunks, fresh, "m", lambda texts: 1 / 0)[1].count() == 0


def test_similar_contents_by_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randint(0, 50)}" for _ in range(80)]
    docs = [(i, " ".join(base[: 80 - rng.randint(0, 12)] + [f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 8))])) for i in range(40)] + [(99, None), (98, "a b")]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in docs if t}
    least: dict = {}
    for d, s in sorted(sets.items()):
        if s:
            least.setdefault(frozenset(s), d)
    reps = [(d, s) for s, d in least.items()]
    want = {(a, b) for a, s in reps for b, t in reps if a < b and len(s & t) / len(s | t) >= 0.85}
    got = {(r.a, r.b) for r in D.similar_contents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and want


def _docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Абзац</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def _xlsx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="s"><si><t>0330</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="s"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>0.5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Привет".encode("cp1251"))
    (tmp_path / "b.docx").write_bytes(_docx())
    (tmp_path / "c.xlsx").write_bytes(_xlsx())
    (tmp_path / "d.xml").write_bytes(b'<r k="v">t</r>')
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.bin").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("dir/x.txt", "внутри")
        z.writestr("__MACOSX/x.txt", "нет")
    found = {r.file.rpartition("/")[2] + str(r.page): r for r in S.pages(S.files(spark, str(tmp_path))).collect()}
    assert found["a.txt0"].text == "Привет" and found["b.docx1"].text == "a | " and found["b.docx1"].is_table
    assert found["c.xlsx0"].text == "0330 |  | 0.5" and found["d.xml0"].text == "v\nt" and "KeyError" in found["e.pdf0"].error and "f.bin0" not in found
    archives = spark.read.format("binaryFile").load(str(tmp_path / "g.zip"))
    assert [(r.path, r.extension) for r in S.unpacked(archives).collect()] == [("dir__x.txt", "txt")]


def test_stores(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert S.json_store(spark, str(tmp_path / "s.jsonl"), "a int").count() == 2 and S.json_store(spark, str(tmp_path / "none"), "a int").count() == 0
    t = str(tmp_path / "t")
    S.swap_table(spark.range(3).toDF("a"), t)
    S.swap_table(spark.read.parquet(t).where("a > 0"), t)
    assert spark.read.parquet(t).count() == 2
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, ord int, v string")
    assert S.last_wins(rows, "k").first().v == "new" and [r.ord for r in S.tail(rows, 1, "ord").collect()] == [2]
    link = spark.createDataFrame([("https://drive.google.com/file/d/AbC-1/view",)], "u string").select(S.drive_link("u")).first()[0]
    assert link == "https://drive.google.com/uc?export=download&id=AbC-1"


def test_stream_equals_batch(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = J.stream_latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest_state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("latest_state").collect()) == sorted(J.latest(log).collect())


def test_incremental_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Один"), (2, "один "), (3, "Два")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen: list[int] = []
    for _ in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        J.index_stream(spark, stream, str(tmp_path / "manifest"), str(tmp_path / "cp"), lambda d, e: seen.extend(r.doc_id for r in d.collect())).awaitTermination(120)
        spark.createDataFrame([(4, "ДВА"), (5, "Три")], docs.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(seen) == [1, 3, 5]


def test_memories_in_shards_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 7)
    monkeypatch.setattr(M, "COUNTED", 30)
    words = ["шумовое", "воздействие", "площадка", "выбросы", "отходы", "расчёт", "том1", "сети"]
    memory = [(i, None if i % 11 == 0 else f"p{i % 4}", " ".join(words[j] for j in range(8) if (i * 37 >> j) & 1) or None, i % 9 == 0) for i in range(40)]
    queries = [(i, p, r) for i, p, r, _ in memory]
    tokens = lambda r: {w for w in (r or "").lower().split() if len(w) >= 4}
    want = set()
    for a, p, r in queries:
        near = []
        for b, o, s, gone in memory:
            x, y = tokens(r), tokens(s)
            if x and y and not gone and None not in (p, o) and p != o and r != s:
                score = round(len(x & y) / len(x | y), 6)
                near += [(-score, b)] if x & y and score >= 0.12 else []
        want |= {(a, b, -score, rank) for rank, (score, b) in enumerate(sorted(near)[:3], 1)}
    got = M.similar(spark.createDataFrame(queries, "query_id long, project string, remark string"), spark.createDataFrame(memory, "id long, project string, remark string, retracted boolean"))
    assert {tuple(r[c] for c in ("query_id", "id", "score", "rank")) for r in got.collect()} == want and len(want) > 50
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_timeline_of_files_of_one_name_whatever_their_order(spark):
    rows = [("a", "x", "2024-01-01", label) for label in ("актуальная", "исходная", "исходная")]
    for some in (rows, rows[::-1]):
        got = D.timeline(spark.createDataFrame(some, "section string, file string, date string, label string").coalesce(1))
        assert [r.label for r in got.orderBy("place").collect()] == ["исходная", "исходная", "актуальная"]


def test_similar_contents_whatever_is_common(spark, monkeypatch):
    """Which elements are held to be common changes the order of search and never the pairs; nor does rounding lose one."""
    docs = [(i, "notice that all of them begin with one two three " + " ".join(f"w{i // 3}x{j}" for j in range(40)) + f" end{i % 3}") for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for asked, common in ((1, 100_000), (1, 3), (10**9, 1)):
        monkeypatch.setattr(D, "ASKED", asked)
        monkeypatch.setattr(D, "COMMON", common)
        found.append({(r.a, r.b) for r in D.similar_contents(table).collect()})
    assert found[0] == found[1] == found[2] == {(a, b) for a, _ in docs for b, _ in docs if a < b and a // 3 == b // 3}


def test_similar_contents_asks_for_few_elements():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[1, 2, 3, 4, 5, 6, 7, 8, 9, 10], []], pa.list_(pa.int64()))], ["id", "s"])
    common = [type("R", (), {"key": k, "holders": h}) for k, h in ((1, 9), (3, 2))]
    (out,) = D._rarest(common, 0.85)([batch])
    assert out.to_pylist() == [{"id": 1, "n": 10, "key": 2}, {"id": 1, "n": 10, "key": 4}]
