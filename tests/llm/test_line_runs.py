"""Line dedup: removals come from maximal runs, and lines repeated singly or in pairs can go."""

import hashlib

from docloom.llm import linededup, queries


def test_removals_come_from_maximal_runs(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf"), (2, "x\nb\nc\nd\ne\ny")], "doc_id long, text string")
    seen, maximal = [], linededup.maximal

    def spy(later, ranks):
        out = maximal(later, ranks)
        seen.append((len(ranks), [(r.doc_id, r.at, r.n_lines, r.first.doc_id, r.first.at) for r in out.collect()]))
        return out

    monkeypatch.setattr(linededup, "maximal", spy)
    assert {r.doc_id: r.n_removed for r in linededup.report(df, 3).collect()} == {1: 0, 2: 4}
    assert seen == [(3, [(2, 1, 4, 1, 1)])]  # ranked by 1, 2 and 4 lines


def test_single_lines_and_short_copies(spark, tmp_path):
    rows = [(1, "a\nb\nc"), (2, "x\nb\ny\nb"), (3, "short"), (4, "short"), (5, "p\nq"), (6, "p\nq"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op8_linededup_single"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (3, 0, sha("a\nb\nc")), 2: (4, 2, sha("x\ny")), 3: (1, 0, sha("short")), 4: (1, 1, sha("")), 5: (2, 0, sha("p\nq")), 6: (2, 2, sha("")), 7: (0, 0, sha(""))}
