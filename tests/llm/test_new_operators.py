"""Periodic runs, MinHash near duplicates and spelling variants against brute force, with odd rows."""

import hashlib
import io
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from docloom.llm import exact_dedup, jaccard, maxscore, minhash, near, periodic, quality, spelling, tokens, warc
from docloom.llm.queries import _slip, tokenizer_path
from tests.llm.test_operators import SCHEMA, brute_components, corpus


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "k") for i, t in corpus()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_runs(w, min_length, min_exponent):
    n, out = len(w), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(min_length, min_exponent * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        letters, n = rng.choice(["a", "ab", "abc", "abcde"]), rng.randint(0, 60)
        w = [rng.choice(letters) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 4))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least, times in ((6, 4), (2, 2), (8, 3)):
            assert periodic.find_runs(w, least, times) == brute_runs(w, least, times)


def test_runs_of_long_texts():
    """Over a million words: one run of one word, of a long period, and none at all."""
    n = 1_200_000
    assert periodic.find_runs(["a"] * n) == [(0, n, 1)]
    assert periodic.find_runs([str(i % 1000) for i in range(n)]) == [(0, n, 1000)]
    assert periodic.find_runs([str(i) for i in range(n)]) == []


PERIODS = [(1, "a b a b a b a b a b c"), (2, "x x x x x x\ny y  y y y y y"), (3, "é é é É É É É É É"), (4, None), (5, ""), (6, " \n "), (7, "one two three"), (None, "z z z z z z z"), (1, "a b a b a b a b a b c"), (9, "q " * 4000)]


def test_periodic_rows(spark, none):
    df = spark.createDataFrame([(i, t, "en", "s", 0, 7, "k") for i, t in PERIODS], SCHEMA)
    want = []
    for i, t in PERIODS:
        w = (t or "").encode().split()
        found = brute_runs(w, 6, 4)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digests = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found).encode(), b" ".join(x for k, x in enumerate(w) if k not in gone))]
        want.append((i, len(w), len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, *digests))
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(periodic.report(df).collect()) == order(want)
    assert order(periodic.runs(df).collect()) == order([(i, *r) for i, t in PERIODS for r in brute_runs((t or "").encode().split(), 6, 4)])
    left = periodic.collapsed(df)
    assert left.columns == df.columns
    assert order((r.doc_id, r.text) for r in left.collect()) == order([(1, "a b c"), (1, "a b c"), (2, "x y"), (3, "é é é É"), (4, None), (5, ""), (6, " \n "), (7, "one two three"), (None, "z"), (9, "q")])
    assert periodic.report(none).count() == periodic.runs(none).count() == periodic.collapsed(none).count() == 0


@pytest.mark.parametrize(("k", "t"), [(5, Fraction(85, 100)), (4, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_minhash(docs, k, t):
    want = brute_components(corpus(), k, t)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.similar(docs, k, t).collect()} == want
    left = minhash.one_of_each(docs, k, t)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {c for _, c in want.values()}


def hot_group():
    """Near copies of one text by chains, one passage shared by 500 otherwise different documents, and copies."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    base, passage, rows = text(80), text(120), []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(80)] = f"e{rng.randint(0, 40)}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(2000 + i, " ".join(text(rng.randint(10, 60)) + passage + text(rng.randint(10, 60)))) for i in range(500)]
    return rows + [(5000 + i, " ".join(base)) for i in range(60)]


@pytest.mark.parametrize("operator", [minhash, jaccard])
def test_hot_groups(spark, monkeypatch, operator):
    monkeypatch.setattr(near, "PART", 16)
    rows, k, t = hot_group(), 4, Fraction(85, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in operator.similar(df, k, t).collect()} == brute_components(rows, k, t)


def test_minhash_samples_and_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[200:2200]
    x, y = minhash.samples(a), minhash.samples(b)
    j = 1800 / 2200
    assert abs((x == y).mean() - j) < 0.1
    apart = int(np.bitwise_count(minhash.odd_sketch(x).view(np.uint64) ^ minhash.odd_sketch(y).view(np.uint64)).sum())
    bits = 64 * minhash.WORDS
    assert abs(1 + bits / 4 * np.log(1 - 2 * apart / bits) / minhash.SAMPLES - (x == y).mean()) < 0.05
    for t in (Fraction(85, 100), Fraction(1, 2)):
        rows = minhash.rows_of(t)
        assert (1 - float(t) ** rows) ** (minhash.SAMPLES // rows) <= minhash.MISSED
    assert minhash.most_apart(Fraction(1)) == 0 and minhash.most_apart(Fraction(1, 2)) > minhash.most_apart(Fraction(9, 10))
    assert np.array_equal(minhash.samples(np.concatenate([pool] * 3)[:9000]), minhash.samples(pool))


def test_rows_of_one_id_keep_their_texts(spark, none):
    """Documents that share an id, or have none, with other texts than a copy of theirs, lose nothing."""
    words = [f"w{i}" for i in range(100)]
    own, close = " ".join(words), " ".join([*words, "x"])
    rows = [(3, own), (5, close), (5, "a wholly different text of some length"), (5, "a wholly different text of some length"), (None, own), (None, None), (7, None), (8, ""), (9, own)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 7, "k") for i, t in rows], SCHEMA)
    order = lambda found: sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)
    for operator in (jaccard, minhash):
        left = operator.one_of_each(df, 5, Fraction(4, 5))
        assert left.columns == df.columns and order(left) == sorted(([r for r in rows if r not in [(5, close), (9, own)]]), key=repr)
        assert operator.one_of_each(none).count() == operator.similar(none).count() == 0
        assert {(r.doc_id, r.n_shingles): r.component_id for r in operator.similar(df).collect()}[5, 97] == 3
    rows = [(5, "unique text A"), (5, "copied text B"), (9, "Copied text B"), (None, "copied text B")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 7, "k") for i, t in rows], SCHEMA)
    assert order(exact_dedup.drop_copies(df)) == sorted([rows[0], rows[2], rows[3]], key=repr)


def near_by_brute(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near_by_brute(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = [form, n, len(close), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return out


def vocabulary():
    rng = random.Random(6)
    letters = "abcéÀz"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(150)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "babab" * 3}
    for w in sorted(words):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    words |= {"l" * 30_000, "l" * 29_999 + "k"}
    return {w: rng.choice([5, 6, 30, 200, 1500]) for w in sorted(words) if len(w) >= 6}


def test_variants(spark):
    counts = vocabulary()
    df = spark.createDataFrame([*counts.items()], "word string, n long").repartition(3)
    got = {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in spelling.variants(df).collect()}
    assert got == brute_variants(counts, 5)
    pairs = {(r.word, r.near) for r in spelling.near_words(df).collect()}
    assert pairs == {(a, b) for a in counts for b in counts if near_by_brute(a, b)}


def test_roots_follow_long_chains(spark):
    chain = ["aaaaaa" + "".join("b" if i < k else "c" for i in range(6)) for k in range(7)]
    df = spark.createDataFrame([(w, 5 ** (k + 1)) for k, w in enumerate(chain)], "word string, n long")
    assert {r.word: r.root for r in spelling.variants(df).collect()} == {w: chain[-1] for w in chain}


def test_pivots_are_apart_and_lightest():
    rng = random.Random(8)
    for _ in range(500):
        grams = [(rng.randrange(5), i) for i in sorted(rng.sample(range(9), rng.randint(3, 6)))]
        weight = [3, 9, 1, 7, 5].__getitem__
        (g, a), (h, b) = spelling.pivots(grams, weight)
        assert abs(a - b) >= 2
        assert weight(g) + weight(h) == min(weight(x) + weight(y) for x, i in grams for y, j in grams if j - i >= 2)


def test_words_of_odd_rows(spark, none):
    rows = [(1, "Straße straße STRASSE straßE x1y abcdef ÀÉÎÕÜß"), (1, "abcdef " * 3), (None, "ABCDEF×÷"), (2, None), (3, ""), (4, "abcdef" * 20_000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 7, "k") for i, t in rows], SCHEMA)
    assert {r.word: r.n for r in spelling.words(df, 6, 1).collect()} == {"straße": 3, "strasse": 1, "abcdef": 4, "ÀÉÎÕÜß": 1, "abcdef×÷": 1, "abcdef" * 20_000: 1}
    assert {r.word: r.n for r in spelling.words(df, 6, 3).collect()} == {"straße": 3, "abcdef": 4}
    want = Counter(w for i, t in rows for w in map(_slip(i), "".join(c.lower() if c.isascii() else c for c in t or "").replace("1", " ").split()) if len(w) >= 6)
    assert {r.word: r.n for r in spelling.words(df, 6, 1, _slip).collect()} == dict(want)
    assert spelling.variants(spelling.words(none)).count() == 0


def test_spelling_broadcasts_no_words(spark, monkeypatch):
    """Tables as small as these in their files may be many times the driver's memory once they are exploded."""
    plans, save = [], spelling.save
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling, "save", lambda df, name: (plan(df), save(df, name))[1])
    rows = [("abcdef", 1), ("abcdeg", 5), ("abcdgg", 25), ("abcggg", 125), ("ghijkl", 3)]
    found = spelling.variants(spark.createDataFrame(rows, "word string, n long"))
    plan(found)
    assert {r.word: r.root for r in found.collect()} == {w: "ghijkl" if w == "ghijkl" else "abcggg" for w, _ in rows}
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_ranks_of_huge_components(spark):
    """Finite components of any size are told apart, where 64 bits would make them ties."""
    rows = [(0, [1.0, 0.5]), (1, [1e20, 0.0]), (2, [1e30, 0.0]), (3, [-1e30, 0.0]), (4, [1e308, 0.0]), (5, [1e308, 1.0]), (6, [2.0, 0.0]), (7, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in maxscore.top_k(vectors, maxscore.F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [5, 4, 2, 1, 6, 3]
    numbers = [0, 1, -1, 255, 256, -255, -256, 1 << 70, -(1 << 70), (1 << 2100) + 1, -(1 << 2100)]
    assert sorted(numbers, key=maxscore.in_order) == sorted(numbers)


@pytest.mark.parametrize("kind", [warc._Plain, warc._Zipped])
def test_cut_off_records_are_told_without_payloads(kind):
    import gzip

    raw = [warc.record({"record_type": t, "record_id": f"<{i}>", "payload": bytes(random.Random(i).randbytes(3000))}) for i, t in enumerate(["response", "revisit"])]
    packed = b"".join(raw) if kind is warc._Plain else b"".join(map(gzip.compress, raw))
    every = lambda data, **x: [h["warc-record-id"] for h, _, _ in warc.records(kind(io.BytesIO(data)), **x)]
    assert every(packed, payload=False) == ["<0>", "<1>"]
    for more in ({"payload": False}, {"payload": False, "wanted": lambda h: h["warc-type"] == "response"}, {}):
        with pytest.raises(ValueError, match="cut off"):
            every(packed[:-500], **more)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys_for_any_tokenizer(name):
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(tokenizer_path(name)), tokens.encoder(tokenizer_path(name))
    rng = random.Random(name)
    alphabet = "aAbB ÀéßŁł\u0130ıﬁ\u00a0\u3000\n\t.,-'<|>9٣日本😀e\u0301"
    texts = ["", "Hello World, the END.", "<|endoftext|> A<|ENDOFTEXT|>b", "x" * 1_200_000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(text.encode()) == b"".join(i.to_bytes(4, "little") for i in ids), text[:60]


def test_labels_learn_one_text_each(spark):
    rows = [(i, f"good word{i}" if i % 2 else f"junk ### {i}") for i in range(40)] + [(i, "good again") for i in range(1, 40, 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = (quality.fit(docs.repartition(n), labels, "quality") for n in (1, 5))
    assert np.array_equal(one.logits, two.logits) and one.bias == two.bias


def test_held_out_labels_are_never_learned(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of many") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    known = labels.where(~quality.held_out("doc_id"))
    turned = known.unionByName(labels.where(quality.held_out("doc_id")).withColumn("quality", 1 - labels.quality))
    assert {r.doc_id for r in known.collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    one, two = (quality.fit(docs, x.where(~quality.held_out("doc_id")), "quality") for x in (labels, turned))
    assert np.array_equal(one.logits, two.logits) and one.bias == two.bias
