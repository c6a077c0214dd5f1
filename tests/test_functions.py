"""Text and Arrow functions on literal inputs and by properties."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docloom.functions import arrow as A, text as T, vectors as V


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_categories(spark):
    cases = {"Выполнить перерасчёт": "Перерасчёт", "Привести по ГОСТ 17.2": "Нормативы", "Приложить договор": "Доп. документы", "": "Правка по источникам"}
    for text, want in cases.items():
        assert one(spark, text, T.remark_category("x"))[0] == want


def test_versions(spark):
    get = lambda name: one(spark, name, T.version_rank("x"), T.base_name("x"), T.date_in_name("x"))
    assert get("Том 6.1 ООС изм.2.pdf")[:2] == (4, "том 6 1 оос")
    assert get("Том 6.2 ООС.pdf")[1] == "том 6 2 оос"
    assert get("ПОС_v3.docx")[0] > get("ПОС.docx")[0]
    assert get("ООС корр 2025-06-01.pdf")[1:] == ("оос", "2025-06-01")
    assert get("x 2025-13-41.pdf")[2] is None


def test_anchor_and_volume(spark):
    assert one(spark, "см. табл. 4.1", T.anchor("x"))[0] == "4.1"
    assert one(spark, "п. 2.3.5", T.anchor("x"))[0] == "2.3.5"
    assert one(spark, "этап. 5 месяцев", T.anchor("x"))[0] is None
    assert one(spark, "том 6.1", T.contains_number(F.col("x"), F.lit("6.1")), T.contains_number(F.col("x"), F.lit("6")))[:] == (True, False)


def test_garbled(spark):
    for text, want in (("(cid:1)(cid:2)(cid:3)" + "x" * 80, True), ("ɉɈɈɋ Ʌɢɫɬ " * 10, True), ("Обычный русский текст тома. " * 5, False), ("(cid:1)", False), (None, False)):
        assert one(spark, text, T.is_garbled("x"))[0] is want


def test_nulls_everywhere(spark):
    columns = [T.normalize_text("x"), T.fingerprint("x"), T.tokens("x"), T.search_tokens("x"), T.memory_tokens("x"), T.shingles("x"), T.slug("x"), T.references("x"), T.remark_category("x"), T.gap_kind("x"), T.waste_class("x"), T.base_name("x"), T.version_rank("x"), T.emails("x"), T.quantities("x")]
    assert len(one(spark, None, *columns)) == len(columns)


def test_search_tokens_hold_codes(spark):
    assert "сп47.13330.2016" in one(spark, "по СП 47.13330.2016", T.search_tokens("x"))[0]


def test_similarities(spark):
    r = spark.range(1).select(V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), V.minhash_similarity(F.array(F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(0))), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert abs(r[0] - 0.5**0.5) < 1e-12 and r[1] == 1.0 and r[2] == 0.0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="аб. ;\n\t1", max_size=4000))
def test_chunks_cover_the_text(text):
    whole = A.normalize_text(text)
    pieces = A.chunk_text(text, size=300, overlap=50, least=1)
    assert all(len(p) <= 300 for p in pieces) and all(p in whole for p in pieces)
    assert {c for p in pieces for c in p.split()} == set() or "".join(whole.split())[:5] in "".join("".join(p.split()) for p in pieces)


def test_short_text_is_one_chunk():
    assert A.chunk_text("кратко") == ["кратко"] and A.chunk_text("  ") == [] and A.chunk_text(None) == []


def test_points_keep_the_tail():
    text = "\n".join(f"{i}. " + "Пункт документа с достаточно длинным текстом. " * 12 for i in range(1, 8)) + "\nИТОГО 5 т/год"
    pieces = A.chunk_points(text)
    assert pieces[-1].endswith("ИТОГО 5 т/год") and all(len(p) >= 80 for p in pieces)


def test_simhash_and_minhash():
    rng = random.Random(1)
    words = [rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(400)]
    a, b = " ".join(words), " ".join(words[:390])
    same = sum(x == y for x, y in zip(A.minhash(a), A.minhash(b), strict=True)) / 64
    assert same > 0.8 and A.minhash("") == [0] * 64 and A.simhash("") == 0
    assert bin((A.simhash(a) ^ A.simhash(b)) & (2**64 - 1)).count("1") < 16 and -(2**63) <= A.simhash(a) < 2**63


def test_numbered():
    assert A.split_numbered("1. Первое замечание тома\nпродолжение\n17\n2) Второе замечание тома") == [("1", "Первое замечание тома продолжение 17"), ("2", "Второе замечание тома")]
    assert A.split_numbered("без номеров") == [] and A.split_numbered(None) == []


def test_tolerant_json():
    assert A.tolerant_json('```json\n{"a": 1,}\n```') == '{"a":1}'
    assert A.tolerant_json("Ответ: {'a': [1]} конец") == '{"a":[1]}'
    assert A.tolerant_json('{"s": "}"} хвост') == '{"s":"}"}' and A.tolerant_json("нет") is None


def test_indicator():
    scan = A.scan_indicator([r"площад\w* застройки"], [r"м2", r"м²"], 1, 5_000_000)
    assert scan("Площадь застройки составляет 12 345,6 м2. Ещё 7 м2") == ["12345.6"]
    assert scan("Площадь застройки. Итого 5 м2") == [] and scan(None) == []


def test_bytes_and_markup():
    assert A.decode_bytes("Ёж".encode("cp1251")) == "Ёж" and A.decode_bytes("Ёж".encode()) == "Ёж" and A.decode_bytes(None) is None
    assert A.xml_text(b'<a k="v">t<b/>u</a>').split("\n") == ["v", "t", "u"] and A.xml_text(b"<a") is None
    assert A.html_text("<p>a<script>x</script> b</p>") == "a b"


def test_hashes_of_runs_are_those_of_distinct_runs_within_a_text():
    import pyarrow as pa

    from docloom.functions.arrow import run_hashes

    lists = [["a", "b", "c", "a", "b", "c"], ["b", "c"], None, [], ["c", "a", "b"], ["ab", "c", ""]]
    got = [x.tolist() for x in run_hashes(pa.array([["z"], *lists], pa.list_(pa.string())).slice(1), 3)]
    runs = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (x or [] for x in lists)]
    assert [*map(len, got)] == [*map(len, runs)] and all(x == sorted(x) for x in got)
    assert set(got[4]) < set(got[0]) and not set(got[5]) & set(got[0])


def test_functions_take_large_batches_in_parts(spark, monkeypatch):
    """One value for each row, in order, nulls too, with few rows in Python at once."""
    from pyspark.sql import functions as F

    from docloom.functions import arrow as A

    most = max(len(x) for x in _parts(A, 1000))
    assert most <= A.ROWS
    rows = spark.range(0, 1050, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("1. Замечание номер "), "id")).alias("t"))
    got = rows.select("id", A.split_numbered_udf()("t").alias("r"), A.chunk_text_udf()("t").alias("c"), A.simhash_udf()("t").alias("h")).collect()
    for r in got:
        text = None if r.id % 7 == 0 else f"1. Замечание номер {r.id}"
        assert [tuple(x) for x in r.r] == A.split_numbered(text) and r.c == A.chunk_text(text) and r.h == A.simhash(text)
    assert len(got) == 1050


def _parts(A, n):
    import pyarrow as pa

    return A.chunk_text_udf().func(iter([pa.array(["text"] * n)]))
