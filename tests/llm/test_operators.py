"""The training-data operators on small tables with odd rows, against brute force, round trips and held-out labels."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, components, exact_dedup, jaccard, linededup, maxscore, packing, quality, substring, token_store, warc
from docloom.llm.common import workspace
from docloom.llm.queries import END_ID, ORACLE_SQL, QUERIES, tokenizer_path
from tests.oracle import SF, assert_same, connection

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, key string"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def corpus() -> list[tuple[int, str | None]]:
    """Nulls, empty and long texts, copies, near copies, repeated passages and lines."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))
    docs = [text(rng.randint(1, 120)) for _ in range(60)]
    shared = text(35)
    docs += [d.upper() if i % 2 else d for i, d in enumerate(docs[:10])]
    docs += [docs[i] + " " + text(2) for i in range(20, 30)] + [docs[i].replace(" ", "  ", 3) for i in range(5)]
    docs += [f"{text(20)} {shared} {text(20)}" for _ in range(12)] + [f"{shared} {shared}", "x " * 90, "", "   \n ", "<|endoftext|> A<|ENDOFTEXT|>b"]
    docs += ["\n".join(["line one here", "line two here", "line three", text(3)]) for _ in range(6)] + [text(9000)]
    out = [*enumerate(docs)]
    rng.shuffle(out)
    return [*out, (500, None), (501, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "k") for i, t in corpus()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def twice(spark):
    """Repeated rows and null ids."""
    return spark.createDataFrame([(1, "a b c d e f", "en", "s", 0, 7, "k")] * 2 + [(None, "a b c d e f", "en", "s", 0, 7, "k"), (None, None, None, None, None, None, None), (2, "q", "en", "s", 0, 7, "k")], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], connection()) > 0


def reference_ids() -> dict[int, list[int]]:
    tk = library()
    return {i: tk.encode(t or "", add_special_tokens=False).ids for i, t in corpus()}


def test_token_store(spark, docs, none, twice):
    path = workspace(spark, "store")
    manifest = token_store.write_tokens(docs, path, tokenizer_path(), END_ID, shards=3)
    want, start = reference_ids(), 0
    got = {r.doc_id: r for r in token_store.read_tokens(spark, path).collect()}
    for i in sorted(want):
        raw = struct.pack(f"<{len(want[i]) + 1}I", *want[i], END_ID)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, bytes(got[i].ids)) == (start, len(want[i]) + 1, zlib.crc32(raw), raw)
        start += len(want[i]) + 1
    shards = [token_store.Shard(r.file) for r in manifest.collect()]
    assert [x for x in (s.get(500) for s in shards) if x] == [[END_ID]] and all(s.get(-1) is None for s in shards)
    for df, n in ((none, 0), (twice, 5)):
        token_store.write_tokens(df, path := workspace(spark, "store"), tokenizer_path(), END_ID)
        assert token_store.read_tokens(spark, path).count() == n


def test_token_store_dictionary_is_checked(spark, docs):
    path = workspace(spark, "store")
    file = token_store.write_tokens(docs, path, tokenizer_path(), END_ID, shards=1).first().file
    name = next(x.path for x in token_store._at(path)[0].get_file_info(token_store.pafs.FileSelector(token_store._at(path)[1])) if x.path.endswith(".zdict"))
    token_store._put(f"file://{name}", b"other bytes")
    with pytest.raises(ValueError, match="hash"):
        token_store.Shard(file)


def test_exact_dedup(docs, none, twice):
    low = {i: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for i, t in corpus()}
    groups = defaultdict(list)
    for i, t in low.items():
        groups[t].append(i)
    want = {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in low.items()}
    assert {r.doc_id: tuple(r)[1:] for r in exact_dedup.copies(docs).collect()} == want
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {w[0] for w in want.values()}
    assert exact_dedup.copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert sorted((r.doc_id or 0, r.group_size, r.kept) for r in exact_dedup.copies(twice).collect()) == [(0, 1, True), (0, 3, False), (1, 3, True), (1, 3, True), (2, 1, True)]


def test_hilbert_curve_is_a_walk():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(points, bits=3)
    walk = points[np.argsort(keys)]
    assert sorted(keys.tolist()) == [*range(512)] and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing(docs, none, twice):
    want, pieces = reference_ids(), packing.pack(docs, tokenizer_path(), END_ID, 256, with_ids=True)
    rows = pieces.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in want.items():
        raw = b"".join(bytes(r.ids) for r in sorted(by_doc[i], key=lambda r: r.start))
        assert raw == struct.pack(f"<{len(ids) + 1}I", *ids, END_ID) and {r.doc_tokens for r in by_doc[i]} == {len(ids) + 1}
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in by_doc[i])
    full = []
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        full.append(at)
    assert sorted(by_sequence) == [*range(len(full))] and set(full[:-1]) == {256} and full[-1] <= 256
    whole = packing.sequences(pieces, 256).collect()
    assert all(len(r.ids) == 4 * 256 or len(r.ids) == 4 * r.n_tokens for r in whole) and len(whole) == len(full)
    assert packing.pack(none, tokenizer_path(), END_ID).count() == 0 and packing.pack(twice, tokenizer_path(), END_ID).count() == 5


def brute_windows(docs, window):
    seen, out = set(), {}
    for d, x in sorted(docs):
        w = (x or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_substring(docs, window, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_PHRASES", 50)
    want = brute_windows(corpus(), window)
    assert {r.doc_id: tuple(r)[1:] for r in substring.report(docs, window).collect()} == want
    left = substring.without_repeats(docs, window)
    texts = dict(corpus())
    assert left.columns == docs.columns
    for r in left.collect():
        n, gone, digest = want[r.doc_id]
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == digest
        assert gone or r.text == texts[r.doc_id]


def test_substring_odd(none, twice):
    assert substring.report(none).count() == 0 and substring.without_repeats(none).count() == 0
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.report(twice, 4).collect()) == [(0, 0), (0, 0), (1, 6), (1, 6), (2, 0)]


def test_substring_with_shuffled_sides(docs, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_ROWS", 0)
    assert {r.doc_id: tuple(r)[1:] for r in substring.report(docs, 20).collect()} == brute_windows(corpus(), 20)


def test_quality(spark):
    all_docs, labels = spark.read.parquet(f"{SF.rpartition('/')[0]}/sf0.01/documents.parquet"), spark.read.parquet(f"{SF.rpartition('/')[0]}/sf0.01/labels.parquet")
    model = quality.fit(all_docs, labels.where(~quality.held_out("doc_id")), "quality")
    r = quality.score(all_docs, model).join(labels, "doc_id").where(quality.held_out("doc_id")).select(((F.col("score") >= 0.3) == (F.col("quality") == 1)).alias("ok")).agg(F.avg(F.col("ok").cast("int")), F.count("*")).first()
    assert r[0] >= 0.95 and r[1] > 50


def test_quality_odd(docs, none, spark):
    none_labels = spark.createDataFrame([], "doc_id long, quality int")
    flat = quality.fit(docs, none_labels, "quality")
    assert {r.score for r in quality.score(docs, flat).collect()} == {0.5}
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], none_labels.schema), "quality")
    assert all(r.score > 0.9 for r in quality.score(docs, one).collect()) and quality.score(none, one).count() == 0
    both = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], none_labels.schema), "quality")
    scores = {r.doc_id: r.score for r in quality.score(docs, both).collect()}
    assert len(scores) == docs.count() and scores[500] == scores[501] and all(0 <= s <= 1 for s in scores.values())
    assert quality.keep_good(docs, both, 0.0).count() == docs.count() and quality.keep_good(docs, both, 0.3).columns == docs.columns


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/5", "<p>é</p>"), (3, "http://a/3", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "http://b/1", None), (2, "http://b/2", ""), (7, "http://c\nd", "x" * 3_000_000), (8, "http://c/8", "WARC/1.1\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, pages, compress):
    path = workspace(spark, "warc")
    warc.write(warc.with_revisits(pages, "page_id", "html", "url"), path, compress)
    got = {r.record_id: r for r in warc.read(spark, path, verify=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.refers_to} == {"<urn:page:5>": ("revisit", "<urn:page:3>"), "<urn:page:9>": ("revisit", "<urn:page:3>"), "<urn:page:2>": ("revisit", "<urn:page:1>")}
    for r in pages.collect():
        body = (r.html or "").encode()
        back = got[f"<urn:page:{r.page_id}>"]
        assert back.payload_length == len(body) and back.payload_digest == warc.digest(body) and (back.record_type == "revisit" or bytes(back.payload) == body)
    found = warc.read(spark, path, payload=False).where("record_type = 'revisit' AND target_uri LIKE 'http://b%'")
    assert [(r.record_id, r.payload) for r in found.collect()] == [("<urn:page:2>", None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "BatchScan" in plan


def test_warc_pushdown_skips_payloads():
    import io

    raw = b"".join(warc.record({"record_type": t, "record_id": f"<{i}>", "payload": b"x" * 1000}) for i, t in enumerate(["response", "revisit", "response"]))
    read = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    found = [h["warc-record-id"] for h, _, _ in warc.records(warc._Plain(Counting(raw)), lambda h: h["warc-type"] == "revisit", payload=False)]
    assert found == ["<1>"] and sum(read) == 0
    with pytest.raises(ValueError, match="cut off"):
        [*warc.records(warc._Plain(io.BytesIO(raw[:-500])))]


def test_warc_odd(spark, pages):
    path = workspace(spark, "warc")
    warc.write(warc.with_revisits(pages.limit(0), "page_id", "html", "url"), path)
    token_store._at(path)[0].create_dir(token_store._at(path)[1])
    assert warc.read(spark, path).count() == 0
    kinds = warc.with_revisits(pages, "page_id", "html", "url", at_least=5).groupBy("record_type").count().collect()
    assert dict(map(tuple, kinds)) == {"response": 5, "revisit": 2}


def brute_components(docs, k, t):
    sets = {}
    for d, x in docs:
        w = (x or "").encode().lower().split()
        kk = min(k, len(w))
        sets[d] = {b" ".join(w[i : i + kk]) for i in range(len(w) - kk + 1)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and t.denominator * inter >= t.numerator * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("k", "t"), [(4, Fraction(85, 100)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_jaccard(docs, k, t):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs, k, t).collect()} == brute_components(corpus(), k, t)


def test_jaccard_chains_and_hot_groups(spark, monkeypatch):
    """Chains of near copies, where neighbours are similar and ends are not, and elements common to all."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        if i % 4 == 0:
            base = base[3:] + [f"n{i}a", f"n{i}b", f"n{i}c"]
        rows.append((i, " ".join(base if i % 3 else [*base[:-1], f"z{rng.randint(0, 5)}"])))
    rows += [(200 + i, " ".join([f"c{j}" for j in range(30)] + [f"u{i}_{j}" for j in range(rng.randint(2, 30))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, t in ((1, Fraction(85, 100)), (2, Fraction(4, 5))):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df, k, t).collect()} == brute_components(rows, k, t)
    left = jaccard.one_of_each(df, 1, Fraction(85, 100))
    assert {r.doc_id for r in left.collect()} == {c for _, c in brute_components(rows, 1, Fraction(85, 100)).values()}


def test_jaccard_odd(none, twice):
    assert jaccard.similar(none).count() == 0
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.similar(twice).collect()) == [(0, 0, 0), (0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 1, 2)]


def test_sketch_keys_find_every_similar_pair():
    """Any two sets that are similar enough have more keys in common than either may leave out."""
    rng = np.random.default_rng(1)
    bands = jaccard.Bands(Fraction(85, 100))
    for _ in range(400):
        n = int(rng.integers(5, 400))
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        swaps = int(len(own) * 0.15 / 2 / 1.15)
        other = np.unique(np.concatenate([own[swaps:], rng.integers(0, 1 << 63, int(rng.integers(0, swaps + 1))).astype(np.uint64)]))
        same = len(np.intersect1d(own, other))
        if 100 * same >= 85 * (len(own) + len(other) - same) and len(np.setxor1d(own, other)):
            mine, theirs = ({band: (spare, set(found.tolist())) for band, spare, found in jaccard.keys(x, bands)} for x in (own, other))
            assert any(len(mine[b][1] & theirs[b][1]) > max(mine[b][0], theirs[b][0]) for b in mine.keys() & theirs.keys())


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    parent: dict[int, int] = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def brute_lines(docs, k):
    seen, out = set(), {}
    for d, x in sorted(docs):
        w = [s for s in (x or "").split("\n") if s.encode().split()]
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in seen:
                gone[i : i + k] = [True] * k
            seen.add(tuple(w[i : i + k]))
        out[d] = (len(w), sum(gone), hashlib.sha256("\n".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_line_dedup(docs, k):
    assert {r.doc_id: tuple(r)[1:] for r in linededup.report(docs, k).collect()} == brute_lines(corpus(), k)


def test_line_runs(spark, none, twice):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\n\ny"), (3, "a\nb\nc\nd\ne"), (4, "b\nc\nd\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, linededup.runs(df, 2).collect())) == [(2, 1, 3, 1, 1), (4, 0, 3, 1, 1)]
    assert linededup.report(none).count() == 0
    assert sorted((r.doc_id or 0, r.n_removed) for r in linededup.report(twice, 1).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 0)]


def test_maxscore(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 12)) * rng.random(12)
    rows: list[tuple] = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(20)]
    rows += [(900, None), (901, [float("nan")] * 12), (902, [1.0, None]), (903, [float("inf")]), (904, [0.5, 0.5]), (905, []), (None, [1.0])]
    ints = {i: [int(np.floor(1024 * np.float64(np.float32(c)))) for c in x] for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    want = []
    for q in (i for i in ints if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], x)), i) for i, x in ints.items() if i != q)  # noqa: B905
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:10], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = lambda d: sorted(map(tuple, maxscore.top_k(d, F.col("vec_id") % 100 == 0).collect()))
    assert got(df) == sorted(want)
    maxscore.SHARD_ROWS, maxscore.QUERY_ROWS, old = 100, 3, (maxscore.SHARD_ROWS, maxscore.QUERY_ROWS)
    try:
        assert got(df) == sorted(want)
    finally:
        maxscore.SHARD_ROWS, maxscore.QUERY_ROWS = old
    assert got(df.limit(0)) == [] and len(got(df.where("vec_id IN (0, 1, 2)"))) == 2


def test_bpe(docs, none, twice):
    tk, path = library(), tokenizer_path()
    rows = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(docs, path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in corpus():
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert rows[i] == (len(ids), sha(" ".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False)))
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert back[0] == tk.decode(reference_ids()[0], skip_special_tokens=False) and back[500] == ""
    assert bpe.round_trip(none, path).count() == 0 and bpe.round_trip(twice, path).count() == 5


def test_bpe_scan_equals_heap_and_library():
    from hypothesis import given, settings, strategies as st

    model, tk = bpe.load(tokenizer_path()), library()

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80))
    def same(text):
        assert model.encode(text) == tk.encode(text, add_special_tokens=False).ids
        raw = text.encode() or b"a"
        ids = [model.inner[b] for b in raw[:-1]] + [model.last[raw[-1]]]
        assert model.scan([*ids]) == model.heap([*ids])

    same()


def thue_morse(n: int) -> str:
    """The word of 2**n letters that polynomial hashes modulo a power of two can't tell from its complement."""
    return "".join("ab"[i.bit_count() & 1] for i in range(1 << n))


def test_words():
    from docloom.llm import words

    ws = [f"w{i % 1000}".encode() for i in range(40_000)]
    h = words.word_hashes(ws)
    assert len(h) == 40_000 and len(set(h.tolist())) == 1000 and (h[:1000] == h[-1000:]).all()
    assert Counter(words.run_hashes(h[:2000], 5).tolist()).most_common(1)[0][1] == 2
    for n in (10, 11, 12):
        one = thue_morse(n)
        other = one.translate(str.maketrans("ab", "ba"))
        assert len(set(words.word_hashes([one.encode(), other.encode()]).tolist())) == 2
        letters = [words.run_hashes(words.word_hashes([c.encode() for c in w]), 1 << n) for w in (one, other)]
        assert letters[0][0] != letters[1][0]


def test_long_words_are_told_apart(spark):
    one = thue_morse(10)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} x y z"), (2, f"{other} x y z"), (3, f"{one} x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.report(df, 4).collect()} == {1: 0, 2: 0, 3: 4}
    assert {r.doc_id: r.component_id for r in jaccard.similar(df, 4, Fraction(85, 100)).collect()} == {1: 1, 2: 2, 3: 1}


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Null and repeated ids: what occurs once stays, and what is repeated stays once."""
    for ids in ((None, None), (7, 7)):
        df = spark.createDataFrame([(i, t) for i, t in zip(ids, ["a b c d e f x y", "z zz a b c d e f"], strict=True)], "doc_id long, text string")
        left = " ".join(r.text for r in substring.without_repeats(df, 4).collect()).split()
        assert Counter(left) == Counter("a b c d e f x y z zz".split())
        lines = df.withColumn("text", F.regexp_replace("text", " ", "\n"))
        left = " ".join(r.text for r in linededup.without_repeats(lines, 3).collect()).split()
        assert Counter(left) == Counter("a b c d e f x y z zz".split())


CLASHES = ["_gone", "gone", "_of", "_lines", "lines", "_id", "id", "row", "tie", "whole", "starts", "ends", "sum", "first", "key", "n", "at", "word", "bits", "payload", "doc", "component", "_kept"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Every name that operators use inside as an extra column, nulls in all columns, repeated rows, ties."""
    rows = [(1, "a b c d e f g\nl2\nl3", "u"), (1, "a b c d e f g\nl2\nl3", "u"), (2, "a b c d e f g\nl2\nl3", None), (3, "q a b c d e f g\nl2\nl3", "u"), (4, None, "u"), (None, "a b c d e f g", None), (None, None, None), (5, "", "u"), (6, "w " * 30_000, "u"), (7, "v" * 1_100_000, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


OPERATORS = {
    "exact": exact_dedup.drop_copies,
    "near": jaccard.one_of_each,
    "passages": lambda d: substring.without_repeats(d, 4),
    "lines": lambda d: linededup.without_repeats(d, 2),
    "quality": lambda d: quality.keep_good(d, quality.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")), "quality"), 0.0),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_of_filters(clashing, name):
    left = OPERATORS[name](clashing)
    rows = left.collect()
    assert left.columns == clashing.columns and rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert any(r.doc_id == 7 and len(r.text) == 1_100_000 for r in rows)


REPORTS = {
    "copies": exact_dedup.copies,
    "similar": jaccard.similar,
    "passages": substring.report,
    "lines": linededup.report,
    "bpe": lambda d: bpe.round_trip(d, tokenizer_path()),
    "score": lambda d: quality.score(d, quality.fit(d, d.select("doc_id", F.lit(None).alias("quality")), "quality")),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_clashing_names_of_reports(clashing, name):
    assert REPORTS[name](clashing).count() == clashing.count()


def test_clashing_names_of_files(spark, clashing):
    token_store.write_tokens(clashing, path := workspace(spark, "store"), tokenizer_path(), END_ID)
    assert token_store.read_tokens(spark, path).count() == clashing.count()
    assert packing.pack(clashing, tokenizer_path(), END_ID).select("doc_id").distinct().count() == 8
    warc.write(warc.with_revisits(clashing, "doc_id", "text", "url"), path := workspace(spark, "warc"))
    assert warc.read(spark, path).count() == clashing.count()
    vectors = clashing.select("*", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    assert maxscore.top_k(vectors, F.col("doc_id") % 2 == 0, 2, vec_id="doc_id").count() > 0


def test_scores_past_doubles_are_exact(spark):
    """Components near 2**30, whose products doubles round, and near 2**62, whose products 64 bits don't hold."""
    big = 1 << 30
    ids = np.array([1, 2, 3])
    postings, asked = maxscore._exact(np.array([[big + 1, big + 1, big + 1], [0, 1, 2]]), np.array([[big + 1, 1]]))
    found, scores = maxscore.search_shard(ids, postings, 0, asked[0], 3)
    assert found.tolist() == [3, 2, 1] and scores.tolist() == [(big + 1) ** 2 + x for x in (2, 1, 0)]
    rows = [(0, [2.0**52, 1.0]), (1, [2.0**52, 1.0]), (2, [2.0**52, 3.0]), (3, [-(2.0**52), 0.0])]
    got = [(r.rank, r.vec_id, r.score) for r in maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2, (1 << 63) - 1), (2, 1, (1 << 63) - 1), (3, 3, -(1 << 63))]


def test_documents_that_share_a_passage_only(spark):
    """Short documents that are otherwise different don't become pairs for each passage they share."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(rng.randint(15, 60)))) for i in range(500)]
    rows += [(600 + i, rows[i][1] + " tail") for i in range(0, 40, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()} == brute_components(rows, 5, Fraction(4, 5))
