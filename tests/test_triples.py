"""Hard negatives against a loop around each project's circle."""

import random

from docloom.operators import evaluation as E


def brute(rows):
    out = []
    for project in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == project and (r[3] or "").strip()), key=lambda r: r[1])
        for i, (_, pos, remark, snippet, file) in enumerate(own):
            for j in range(1, len(own)):
                other = own[(i + j) % len(own)]
                if other[3] != snippet and other[4] != file:
                    out.append((project, pos, remark, snippet, other[3]))
                    break
    return out


def test_triples(spark):
    rng = random.Random(6)
    rows = [(f"p{p}", i, f"r{i}", rng.choice(["a", "b", "c", "a", "a", " ", None]), rng.choice(["f", "g", "f", None])) for p in range(6) for i in range(rng.randint(0, 25))]
    rows += [("long", i, f"r{i}", "same" if i != 40 else "other", "f" if i % 50 else "g") for i in range(70)] + [("alone", 1, "r", "s", "f"), ("equal", 1, "r", "s", "f"), ("equal", 2, "r", "s", "g")]
    df = spark.createDataFrame(rows, "project string, pos long, remark string, snippet string, file string")
    assert sorted(map(tuple, E.triples(df).collect()), key=repr) == sorted(brute(rows), key=repr)
    assert E.triples(df.limit(0)).count() == 0
