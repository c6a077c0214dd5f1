"""Packs of remarks are answered once each, though runs are killed and models fail."""

import os

import pytest

from docloom.operators import answering as A


def test_killed_runs_repeat_open_packs_only(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/answers", f"{tmp_path}/calls"
    os.mkdir(calls)
    remarks = spark.createDataFrame([(str(i), f"remark {i}", None) for i in range(1, 48)], "number string, text string, context string")

    class Killed(BaseException):
        """What ends a worker, unlike an error of the model."""

    def model(rows, die=False, fail=()):
        done = len([f for f in os.listdir(f"{tmp_path}/answers/commits") if f.endswith(".json")]) if os.path.isdir(f"{tmp_path}/answers/commits") else 0
        if die and done >= 3:
            raise Killed
        if rows[0]["number"] in fail:
            raise ValueError("no reply")
        with open(f"{calls}/{rows[0]['number']}-{os.getpid()}-{done}", "w") as f:
            f.write(",".join(r["number"] for r in rows))
        return [{"number": r["number"], "answer": f" to {r['text']} ", "used": [1]} for r in rows if r["number"] != "5"] + [{"number": "other", "answer": "x"}]

    with pytest.raises(Exception):  # noqa: B017  whatever a dead worker is told as
        A.ask(remarks, folder, lambda rows: model(rows, die=True))
    first = {r.pack for r in A.committed(spark, folder).select("pack").distinct().collect()}
    assert 3 <= len(first) < 5
    failed = A.ask(remarks, folder, lambda rows: model(rows, fail=("41", "1", "11", "21", "31"))).collect()
    assert {r.pack for r in failed} == set(range(5)) - first and all("no reply" in r.error for r in failed)
    assert A.ask(remarks, folder, model).count() == 0 and A.open_packs(spark, folder).count() == 0
    assert A.ask(remarks, folder, lambda rows: 1 / 0).count() == 0  # nothing is left to ask
    asked = [n for f in os.listdir(calls) for n in open(f"{calls}/{f}").read().split(",")]
    assert sorted(map(int, asked)) == [*range(1, 48)]
    got = {r.number: r for r in A.answers(spark, folder).collect()}
    assert len(got) == 47 and {n: r.pack for n, r in got.items()} == {str(i): (i - 1) // 10 for i in range(1, 48)}
    assert got["7"].answer == "to remark 7" and got["7"].confidence == "medium" and (got["5"].answer, got["5"].confidence, got["5"].low_support) == ("", "low", False)


def test_no_remarks(spark, tmp_path):
    none = spark.createDataFrame([], "number string, text string, context string")
    assert A.ask(none, f"file://{tmp_path}/a", lambda rows: rows).count() == 0 and A.answers(spark, f"file://{tmp_path}/a").count() == 0
