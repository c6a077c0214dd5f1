"""Caches, layered settings, archives, cascades and numbering against plain loops."""

import io
import json
import random
import zipfile
from copy import deepcopy

import pytest
from pyspark.sql import functions as F

from docloom.operators import cache as C, graph as GR, settings as SE
from docloom.operators.tables import numbered
from docloom.sources import files as S


def test_cache_against_a_dict(spark):
    rng = random.Random(2)
    held, cache = {}, spark.createDataFrame([], "key string, value long, seq long")
    for batch in range(3):
        rows = [(rng.choice("abcdefgh"), batch * 100 + i, batch * 100 + i) for i in range(6)] + [(None, 1, batch * 100 + 50)]
        for k, v, s in rows:
            if k is not None:
                held.pop(k, None)
                held[k] = (v, s)
        while len(held) > 4:
            held.pop(next(iter(held)))
        cache = C.evict(C.put(cache, spark.createDataFrame(rows, cache.schema)), 4)
        assert {r.key: (r.value, r.seq) for r in cache.collect()} == held
    asked = spark.createDataFrame([(k, k * 3, 900 + i) for i, k in enumerate(["a", "q", "q", *held])], "key string, what string, seq long")
    calls = []

    def make(missing):
        calls.extend(r.key for r in missing.collect())
        return missing.select("key", F.length("what").cast("long").alias("value"))

    got, after = C.through(cache, asked, make, 5)
    assert sorted(calls) == sorted({"a", "q"} - held.keys())
    assert {r.key: r.value for r in got.collect()} == {"a": 3, "q": 3} | {k: v for k, (v, _) in held.items()} and after.count() == 5
    timed = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:50"), ("c", None)], "key string, at string")
    assert [r.key for r in C.alive(timed, F.lit("2024-01-01 00:01:30"), 60).collect()] == ["b"]
    stamped = spark.createDataFrame([("a", 1), ("b", 2)], "key string, stamp int")
    assert [r.key for r in C.unchanged(stamped, spark.createDataFrame([("a", 1), ("b", 3)], stamped.schema)).collect()] == ["a"]


def deep(base, over):
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = deep(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def random_settings(rng, depth=0):
    out = {}
    for _ in range(rng.randint(0, 3)):
        kind = rng.random()
        out[rng.choice(["a", "b", 'c"d', "ё x"])] = random_settings(rng, depth + 1) if kind < 0.5 and depth < 3 else rng.choice([1, 2.5, None, True, "x", 'q"ё', [], [1, {"z": 2}], "{}"])
    return out


def test_settings_against_deep_merge(spark):
    rng = random.Random(9)
    layers, want = [], {}
    for name in range(60):
        out = {}
        for order in range(rng.randint(1, 4)):
            one = random_settings(rng)
            out = deep(out, one)
            layers.append((f"n{name}", order, json.dumps(one, ensure_ascii=False)))
        if out:
            want[f"n{name}"] = out
    layers += [("broken", 0, "{"), ("broken", 1, None), ("list", 0, "[1]"), ("n0", 9, "nonsense")]
    found = SE.rebuilt(SE.merged(SE.flattened(spark.createDataFrame(layers, "name string, ord int, json string")))).collect()
    assert {r.name: json.loads(r.json) for r in found} == want
    both = spark.createDataFrame([("d", 0, '{"list": [1, 2], "x": {"l": []}}'), ("d", 1, '{"list": [{"a": 3}], "x": {"l": ["q"]}}')], "name string, ord int, json string")
    joined = SE.rebuilt(SE.merged(SE.flattened(both), join_lists=True))
    assert json.loads(joined.first().json) == {"list": [1, 2, {"a": 3}], "x": {"l": ["q"]}}
    assert joined.select(SE.setting("json", "x.l[0]").alias("v"), SE.setting("json", "x.none", "d").alias("d")).first() == ("q", "d")


def test_archives_report_what_they_leave_out(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/x.txt", "short")
        z.writestr("big.txt", "0" * 5000)
        z.writestr("skip.exe", "x")
    cut = bytearray(raw.getvalue())
    archives = spark.createDataFrame([("z.zip", raw.getvalue()), ("bad.zip", b"no archive"), ("null.zip", None)], "path string, content binary")
    got = {(r.archive, r.path): (r.content and bytes(r.content), bool(r.error)) for r in S.unpacked(archives, largest=1000).collect()}
    assert got == {("z.zip", "a__x.txt"): (b"short", False), ("z.zip", "big.txt"): (None, True), ("bad.zip", None): (None, True), ("null.zip", None): (None, True)}
    cut[40:44] = b"\xff\xff\xff\xff"  # inside the first member
    broken = {r.path: bool(r.error) for r in S.unpacked(spark.createDataFrame([("z.zip", bytes(cut))], archives.schema)).collect()}
    assert broken["a__x.txt"] and not broken["big.txt"]


def test_last_wins_keeps_all_columns(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, ord int, _n string")
    assert {tuple(r) for r in S.last_wins(rows, "k").collect()} == {("a", 2, "y"), ("b", 1, "z")}


def test_levels_with_cycles_and_depth(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(25)]
    edges = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("y", "behind"), ("free", "y")], "src string, dst string")
    codes = edges.select("src").union(edges.select("dst")).toDF("code").distinct()
    got = {r.code: r.level for r in GR.levels(edges, codes).collect()}
    assert got == {f"c{i:03}": i for i in range(26)} | {"x": None, "y": None, "behind": None, "free": 0}
    down = {r.code: (r.depth, r.via) for r in GR.downstream(edges, spark.createDataFrame([("x",)], "code string")).collect()}
    assert down == {"y": (1, "x>y"), "x": (2, "x>y>x"), "behind": (2, "x>y>behind")}
    lines = GR.explained(spark.createDataFrame([("x",)], "code string"), GR.downstream(edges, spark.createDataFrame([("free",)], "code string")), spark.createDataFrame([("y", "Y!")], "code string, label string")).orderBy("depth", "code").collect()
    assert [r.line for r in lines] == ["Изменение в: x", "Затронутые разделы/расчёты (проверить на согласованность):", "  • Y! (глубина 1; путь: free → y)", "  • behind (глубина 2; путь: free → y → behind)", "  • x (глубина 2; путь: free → y → x)"]
    assert GR.levels(edges.limit(0), codes.limit(0)).count() == 0


def test_numbering(spark):
    rows = [(i * 7919 % 1000, f"r{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "a long, row0 string").repartition(5)
    got = {r.row0: r.place for r in numbered(df, [F.desc("a"), "row0"]).collect()}
    assert got == {name: i for i, (_, name) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert numbered(df.limit(0), ["a"]).count() == 0


def test_a_swap_that_dies_leaves_a_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    one, two = (spark.createDataFrame([(i,)], "a int") for i in (1, 2))
    S.swap_table(one, path)
    S.swap_table(two.union(S.kept_table(spark, path)), path)
    assert sorted(r.a for r in S.kept_table(spark, path).collect()) == [1, 2]
    (tmp_path / "t").rename(tmp_path / "t.old")  # dead between the renames, with nothing new beside it
    assert S.kept_table(spark, path).count() == 2
    (tmp_path / "t").rename(tmp_path / "t.old")
    one.write.parquet(f"{path}.next")
    assert [r.a for r in S.kept_table(spark, path).collect()] == [1]
