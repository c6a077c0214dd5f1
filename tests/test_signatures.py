"""Stored signatures: never taken twice, and their pairs against every pair and against exact similarity."""

import random

from pyspark.sql import functions as F

from docloom.functions.arrow import minhash, simhash
from docloom.operators import signatures as S


def texts():
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 400)}"
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(40, 160))]
        out.append(" ".join(base))
        for _ in range(4):
            other = list(base)
            for _ in range(rng.randint(1, 2)):
                other[rng.randrange(len(other))] = word()
            out.append(" ".join(other))
    return out + ["", "a b c", "A b c", "a b d", "x", "one two three four", out[0], out[0].upper()]


def alike(a, b):
    (ma, sa), (mb, sb) = a, b
    if any(ma) and any(mb):
        return sum(x == y for x, y in zip(ma, mb, strict=True)) / 64
    return 0.0 if sa == sb == 0 else 1 - ((sa ^ sb) & (2**64 - 1)).bit_count() / 64


def test_pairs(spark):
    rows = [*enumerate(texts())] + [(900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store, named = S.signed(docs)
    text_of = {r.content: r.doc_id for r in named.orderBy(F.desc("doc_id")).collect()}
    content = {c: dict(rows)[i] or "" for c, i in text_of.items()}
    sketch = {c: (minhash(t), simhash(t)) for c, t in content.items()}
    want = {(a, b): round(alike(sketch[a], sketch[b]), 6) for a in content for b in content if a < b}
    got = {(r.a, r.b): r.similarity for r in S.pairs(store).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.85 - 1e-9}
    # Of pairs that are alike by their exact sets, nine in ten at least are found.
    grams = {c: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for c, t in content.items()}
    exact = {(a, b) for a, b in want if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.85 * len(grams[a] | grams[b])}
    found = {(r.a, r.b) for r in S.confirmed(S.pairs(store, 0.75), docs).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) and len(exact) > 5
    assert S.pairs(store.limit(0)).count() == 0


def test_known_contents_are_not_sketched_again(spark, monkeypatch):
    docs = spark.createDataFrame([*enumerate(texts())], "doc_id long, text string")
    store = spark.createDataFrame(S.signed(docs)[0].collect(), S.signed(docs)[0].schema)
    again, named = S.signed(docs, store)
    assert again.count() == 0 and named.count() == docs.count()
    fresh, _ = S.signed(docs.unionByName(spark.createDataFrame([(999, "something new here for once")], docs.schema)), store)
    assert [r.n_chars for r in fresh.collect()] == [27]


def test_recall_on_the_given_documents(spark):
    from docloom.operators.documents import similar_contents
    from docloom.plans import QUERIES
    from tests.oracle import SF

    exact = {(r.a, r.b) for r in similar_contents(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    found = {(r.a_id, r.b_id) for r in QUERIES["signature_pairs"](spark, SF).collect()}
    found |= {(b, a) for a, b in found}
    assert sum(p in found for p in exact) >= 0.9 * len(exact)


def test_every_document_of_a_content_is_named(spark, tmp_path):
    from docloom.plans import QUERIES

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (3, long), (9, long), (4, long + " more"), (1, None), (2, ""), (8, "short one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a_id, r.b_id, r.a_copies, r.b_copies) for r in QUERIES["signature_pairs"](spark, str(tmp_path)).collect()}
    assert {tuple(sorted(x[:2])) for x in got} == {(3, 4), (3, 5), (3, 9), (1, 2)}
    assert (3, 5, 3, 3) in got and (1, 2, 2, 2) in got


def test_planes_never_lose_a_pair(spark):
    """Two MinHashes with as many places apart as may be, and one more."""
    import hashlib

    base = [int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:7]) for i in range(64)]
    apart = lambda d: [~x & (2**56 - 1) if i % 4 == 0 and i // 4 < d else x for i, x in enumerate(base)]
    store = spark.createDataFrame([("a", None, base), ("b", None, apart(16)), ("c", None, apart(16)[:1] + base[1:])], "content string, simhash long, minhash array<long>")
    assert {(r.a, r.b): r.similarity for r in S.pairs(store, 0.75).collect()} == {("a", "b"): 0.75, ("a", "c"): round(63 / 64, 6), ("b", "c"): round(49 / 64, 6)}
