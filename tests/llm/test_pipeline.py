"""The pipeline's stages, each on what the one before kept, against brute force."""

import zlib
from collections import defaultdict
from fractions import Fraction

import corpus_pipeline as P
from docloom.llm.common import save
from docloom.llm.queries import END_ID, tokenizer_path
from tests.llm.test_operators import brute_components, brute_windows
from tests.oracle import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, quality = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = (before, {r.doc_id: r.text for r in docs.collect()})
    before, after = kept["quality_classifier"]
    known = [i for i in before if i in quality]
    assert sum((i in after) == bool(quality[i]) for i in known) >= 0.9 * len(known) and all(before[i] == t for i, t in after.items())
    before, after = kept["exact_dedup"]
    groups = defaultdict(list)
    for i, t in before.items():
        groups[(t or "").lower() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t)].append(i)
    assert set(after) == {max(g) for g in groups.values()}
    before, after = kept["ngram_jaccard_join"]
    assert set(after) == {c for _, c in brute_components([*before.items()], 5, Fraction(4, 5)).values()}
    before, after = kept["substring_dedup"]
    want = brute_windows([*before.items()], 20)
    assert set(after) == set(before) and all(len((after[i] or "").encode().split()) == n - gone for i, (n, gone, _) in want.items())
    assert all(after[i] == before[i] for i, (_, gone, _) in want.items() if not gone)

    from tokenizers import Tokenizer

    tk, pieces = Tokenizer.from_file(tokenizer_path()), defaultdict(list)
    for r in P.STAGES[-1][1](spark, docs, SF).collect():
        pieces[r.doc_id].append(r)
    for i, t in after.items():
        raw = b"".join(x.to_bytes(4, "little") for x in [*tk.encode(t or "", add_special_tokens=False).ids, END_ID])
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and zlib.crc32(raw[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert 4 * at == len(raw)
    assert set(pieces) == set(after)


def odd_rows():
    words = [f"word{i}" for i in range(60)]
    own, close = " ".join(words), " ".join([*words, "more"])
    passage = " ".join(f"shared{i}" for i in range(30))
    rows = [(3, own), (5, close), (5, "a text of its own under an id that is there twice"), (5, "a text of its own under an id that is there twice"), (7, None), (8, ""), (9, " \n "), (None, own), (None, None)]
    rows += [(20, f"before {passage} after"), (21, f"other {passage} end"), (22, own.upper()), (22, own.upper()), (30, "x" * 1_100_000), (31, "y " * 600_000)]
    return rows


def test_every_stage_on_odd_rows(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, gone string, row long, tie long, whole boolean, node long, part int"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "g", 1, 2, True, 3, 4) for i, t in odd_rows()], columns).repartition(3)
    none = docs.limit(0)
    for name, stage in P.STAGES[:-1]:
        left, empty = stage(spark, docs, SF), stage(spark, none, SF)
        assert left.columns == docs.columns and empty.columns == docs.columns and empty.count() == 0, name
        kept = [tuple(r) for r in left.select("doc_id", "text", "gone", "row", "tie", "whole", "node", "part").collect()]
        assert all(r[2:] == ("g", 1, 2, True, 3, 4) for r in kept), name
        ids = sorted((i if i is not None else -1, (t or "")[:12]) for i, t, *_ in kept)
        if name == "exact_dedup":
            assert ids == sorted((i if i is not None else -1, (t or "")[:12]) for i, t in odd_rows() if (i, t) not in [(3, odd_rows()[0][1]), (7, None)])
        if name == "ngram_jaccard_join":
            assert ids == sorted((i if i is not None else -1, (t or "")[:12]) for i, t in odd_rows() if i not in (21, 22) and (i, t) != odd_rows()[1])
        if name == "substring_dedup":
            assert len(ids) == len(odd_rows()) and {r[0]: r[1] for r in kept}[21] == "other end"
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == len({i for i, _ in odd_rows()}) and P.STAGES[-1][1](spark, none, SF).count() == 0


def test_pipeline_as_registered(spark):
    import __spark_entry__ as e

    rows = e.queries()["pipeline"](spark, SF).collect()
    ends = defaultdict(int)
    for r in rows:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert len({r.doc_id for r in rows}) > 50 and max(ends.values()) <= P.CAPACITY and sorted(ends) == [*range(len(ends))]
