"""Dictionary terms and indicators against loops over one text at a time; what an answer makes up; decisions in force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import entities as E, indicators as I

TERMS = [
    ("азота диоксид", "0301"), ("оксид азота", "0304"), ("азот (iv)", "0301"), ("углерод (сажа)", "0328"), ("углерод сажа", "0328"), ("сажа", "0328"), ("no", "0304"), ("no2", "0301"), ("бенз/а/пирен", "0703"),
    ("углеводороды", "0401"), ("непредельные углеводороды", "0501"), ("(iv)", "X"), ("б-10", "B"), ("грунтовый каток тяжёлый", "K3"), ("грунтовый каток", "K2"), ("каток", "K1"), ("а а", "AA"), ("—", "dash"),
]


def brute_terms(text, terms):
    low, covered, out = (text or "").lower(), [], set()
    for alias, code in sorted(terms, key=lambda t: -len(t[0])):
        for m in re.finditer(r"(?<![\w])" + re.escape(alias) + r"(?![\w])", low):
            if re.search(r"\w", alias) and not any(a <= m.start() and m.end() <= b for a, b in covered):
                covered.append(m.span())
                out.add(code)
    return out


def test_terms(spark):
    rng = random.Random(3)
    parts = [a for a, _ in TERMS] + ["оксид", "азот", "(", ")", "iv", "/", "-", "10", "каток", "а", " ", "  ", ".", " ", ", "]
    texts = [(i, "".join(rng.choice(parts) + rng.choice([" ", "", " ", ", "]) for _ in range(rng.randint(0, 12)))) for i in range(700)] + [(5000, None), (5001, ""), (5002, "сажа " * 30_000)]
    got = {n: set() for n, _ in texts}
    for r in E.match_terms(spark.createDataFrame(texts, "n int, text string"), spark.createDataFrame(TERMS, "alias string, code string")).collect():
        got[r.n].add(r.code)
    assert got == {n: brute_terms(t, TERMS) for n, t in texts}


def test_terms_are_joined_by_words(spark):
    """No nested loop, no text beside its words; the last entry of an alias holds; empty tables give nothing."""
    texts, terms = spark.createDataFrame([(1, "Угарный газ, CO.")], "n int, text string"), spark.createDataFrame([("co", "old", 1), ("CO", "new", 2), ("угарный газ", "0337", 3)], "alias string, code string, ord int")
    found = E.match_terms(texts, terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.code for r in found.collect()} == {"new", "0337"}
    assert E.match_terms(texts.limit(0), terms).count() == E.match_terms(texts, terms.limit(0)).count() == 0


def test_a_word_of_many_terms_is_no_hot_key(spark, monkeypatch):
    """Runs meet terms as wholes: a row for each run, however many terms share its words; also where the index is not broadcast."""
    texts = spark.createDataFrame([(1, "шум " * 300 + "шум 7")], "n int, text string")
    terms = spark.createDataFrame([(f"шум {i}", f"c{i}") for i in range(1000)], "alias string, code string")
    for most in (E.INDEXED, 0):
        monkeypatch.setattr(E, "INDEXED", most)
        assert [tuple(r) for r in E.match_terms(texts, terms).collect()] == [(1, "c7")]
    joined = E.placed_runs(texts, [2]).join(E.term_index(terms).drop("size"), "core")
    assert joined.count() == 1


MACHINES = [("экскаватор", "Экскаватор"), ("cat", "Экскаватор"), ("камаз", "Автосамосвал"), ("самосвал", "Автосамосвал"), ("б-10", "Бульдозер")]
SUBSTANCES = [("азота диоксид", "0301", "Азота диоксид"), ("сажа", "0328", "Сажа")]


@pytest.fixture(scope="module")
def dictionaries(spark):
    return spark.createDataFrame(SUBSTANCES, "alias string, code string, name string"), spark.createDataFrame(MACHINES, "alias string, name string")


def test_entities(spark, dictionaries):
    texts = [
        (1, "Самосвал КАМАЗ-65115 и экскаватора CAT 320D; отходы 4 класса опасности и IV класс опасности, 47110101521. Азота  диоксид; азота диоксид, сажа 0,5 т/год, 12 %, 3%х."),
        (2, "По СП 47.13330.2016 и ГОСТ Р 56062-2014, приказом 273; расчёт № 3.1, Таблица 4. Шум 45 дБА, 45 дБАх"),
        (3, None),
    ]
    got = {}
    for r in E.entities(spark.createDataFrame(texts, "n int, text string"), *dictionaries).collect():
        got.setdefault((r.n, r.kind), set()).add(r.value)
    assert got == {
        (1, "techniques"): {"Автосамосвал", "экскаватора", "Экскаватор"},
        (1, "waste_classes"): {"IV класс опасности"},
        (1, "fkko"): {"47110101521"},
        (1, "pollutants"): {"Азота диоксид", "Сажа"},
        (1, "quantities"): {"0,5 т/год", "3%"},
        (2, "normatives"): {"сп 47.13330.2016", "гост р 56062-2014", "приказом 273", "№ 3.1"},
        (2, "calcs"): {"расчёт № 3.1", "таблица 4."},
        (2, "quantities"): {"45 дба"},
    }


def test_made_up_numbers(spark, dictionaries):
    source = "Валовый выброс азота диоксида составляет 0,0125 г/с."
    answers = [(1, "Выполнен перерасчёт: выброс 0,8412 г/с, что соответствует 3,55 т/год."), (2, "Выброс составляет 0,0125 г/с."), (3, "Сажа; КАМАЗ 65115"), (4, None)]
    sides = [E.entities(spark.createDataFrame(rows, "n int, text string"), *dictionaries) for rows in (answers, [(1, source)])]
    pairs = spark.createDataFrame([(i, i, 1) for i, _ in answers], "id int, answer int, source int")
    assert {(r.id, r.kind, r.n, r["values"]) for r in E.made_up(*sides, pairs).collect()} == {(1, "quantities", 2, "0,8412 г/с|3,55 т/год"), (3, "pollutants", 1, "Сажа"), (3, "techniques", 1, "Автосамосвал")}


def brute_scan(text):
    low, out = (text or "").lower(), []
    plain = lambda s: re.sub("[  ]", "", s).replace(",", ".").rstrip(".")
    for key, unit, least, most, _, spellings in I.INDICATORS:
        value = re.compile(rf"({I.NUMBER})\s*(?:{'|'.join(I.UNIT_SPELLINGS[unit])})\b", re.I)
        for s in spellings:
            for m in re.finditer(s, low):
                window = low[m.end() : m.end() + 160]
                if cut := re.search(r"[.;]\s", window):
                    window = window[: cut.start()]
                if (hit := value.search(window)) and least <= float(plain(hit[1])) <= most:
                    out.append((key, plain(hit[1]), m.start()))
    return sorted(out)


def test_scan(spark):
    rng = random.Random(5)
    mention = ["площадь застройки", "площади участка", "протяжённость", "длина трассы", "валовый выброс", "выбросы составят 12 т/год", "итого по выбросам", "водопотребление", "размер сзз", "уровень шума", "масса отходов"]
    unit = ["м2", "м²", "кв. м", "км", "мес.", "чел.", "т/год", "г/с", "шт", "м3/сут", "м", "дБА", "кг", "метров"]
    number, fill = ["5", "12,5", "1 234,5", "0.003", "45", "100 000", "7.", "1 200"], [" составляет ", " — ", ". ", "; ", " (таблица 4.1) ", ". Далее ", " слово" * 25 + " ", ": ", " "]
    texts = [(i, "".join(rng.choice([rng.choice(mention), rng.choice(number) + rng.choice([" ", ""]) + rng.choice(unit), rng.choice(fill)]) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 9)))) for i in range(600)]
    texts += [(900, None), (901, ""), (902, "уровень шума 45 дБА. " * 3000)]
    got = {n: [] for n, _ in texts}
    for r in I.scan(spark.createDataFrame(texts, "n int, text string")).collect():
        got[r.n].append((r.key, r.value, r.start))
    assert {n: sorted(v) for n, v in got.items()} == {n: brute_scan(t) for n, t in texts}


def test_registry_keeps_what_people_settled(spark):
    found = spark.createDataFrame([("noise", "45", "OOS", "a"), ("noise", "45", "PZ", "b"), ("noise", "50", "IEI", "c"), ("szz", "100", "PZ", "a"), ("szz", "300", "OOS", "b"), ("area_build", "7", "PZ", "a")], "key string, value string, section string, file string")
    settled = spark.createDataFrame([("szz", "250", "manual"), ("workers", "12", "chosen")], "key string, value string, source string")
    got = {r.key: (r.value, r.source, r.conflict, r.n_variants, r.variants, r.files) for r in I.registry(found, I.owners(spark), settled).collect()}
    assert got == {"noise": ("45", "auto", True, 2, "45|50", "a|b"), "szz": ("250", "manual", False, 2, "300|100", "b"), "area_build": ("7", "auto", False, 1, "7", "a"), "workers": ("12", "chosen", False, 0, "", "")}


def test_decisions_as_of(spark):
    log = spark.createDataFrame([("a", "1", "found", 1, 1), ("a", "2", "chosen", 2, 2), ("a", "3", "found", 3, 3), ("a", "4", "manual", 4, 4), ("a", None, "manual", 6, 5), ("b", "9", "manual", 5, 6), ("b", "8", "manual", 5, 7), ("c", None, "found", 1, 8)], "key string, value string, source string, ts int, seq int")
    at = lambda t: {r.key: (r.value, r.source) for r in I.settled_as_of(log, F.lit(t) if t else None).collect()}
    assert at(1) == {"a": ("1", "found")} and at(3) == {"a": ("2", "chosen")} and at(5) == {"a": ("4", "manual"), "b": ("8", "manual")} and at(None) == {"a": ("2", "chosen"), "b": ("8", "manual")}


def test_what_is_ahead_is_found_in_one_look_at_each_row(spark):
    texts = [(1, "Уровень шума; уровень шума 45 дБА. " * 300), (2, "Водоотведение, водоотведение 3 м3/сут. Уровень шума: нет. 50 дБА")]
    found = I.scan(spark.createDataFrame(texts, "n int, text string"))
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = sorted((r.n, r.key, r.start, r.value) for r in found.collect())
    assert got == [(1, "noise", 35 * i + 14, "45") for i in range(300)] + [(2, "water_drain", 0, "3"), (2, "water_drain", 15, "3")]


def test_files_of_a_value_are_gathered_in_portions(spark):
    found = spark.createDataFrame([("noise", "55", f"s{i % 2}", f"f{i:04}") for i in range(600)] * 2, "key string, value string, section string, file string")
    got = I.registry(found, I.owners(spark), spark.createDataFrame([], "key string, value string, source string"))
    (row,) = got.collect()
    assert (row.value, row.n_variants, row.files) == ("55", 1, "|".join(f"f{i:04}" for i in range(8)))
