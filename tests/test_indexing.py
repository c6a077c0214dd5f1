"""Indexing of files that is killed and run again, and streams that are paused, stopped and watched."""

import time

import pytest
from pyspark.sql import functions as F

from docloom.streaming import indexing as X

def parse(df):
    text = F.col("content").cast("string")
    return df.select("file", text.alias("text"), F.when(text == "", "нет текста").alias("error"))


def cut(df):
    return df.select("file", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))


def files(spark, rows):
    return spark.createDataFrame([(f, c.encode()) for f, c in rows], "file string, content binary")


def state(spark, folder):
    return {r.file: (r.status, r.chunks, r.reason) for r in X.manifest(spark, folder).collect()}


def held(spark, folder):
    return sorted((r.file, r.chunk_index, r.text) for r in X.chunks(spark, folder).collect())


def test_copies_errors_and_changes(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    X.ingest(files(spark, [("b", "one\ntwo"), ("a", "ONE   two"), ("c", "one\ntwo"), ("d", ""), ("e", "")]), 0, folder, parse, cut)
    want = {"a": ("done", 1, None), "b": ("skipped", 0, "дубликат (sha256)"), "c": ("skipped", 0, "дубликат файла (b)"), "d": ("error", 0, "нет текста"), "e": ("error", 0, "нет текста")}
    assert state(spark, folder) == want and held(spark, folder) == [("a", 0, "ONE   two")]
    # Settled files are left alone; those with errors, and with other bytes than before, are indexed again.
    X.ingest(files(spark, [("b", "one\ntwo"), ("a", "one\nand more"), ("d", "now\nthere"), ("f", "now\nthere")]), 1, folder, parse, cut)
    want |= {"a": ("done", 2, None), "d": ("done", 2, None), "f": ("skipped", 0, "дубликат файла (d)")}
    assert state(spark, folder) == want
    assert held(spark, folder) == [("a", 0, "one"), ("a", 1, "and more"), ("d", 0, "now"), ("d", 1, "there")]
    X.ingest(files(spark, []), 2, folder, parse, cut)
    assert state(spark, folder) == want


def test_stream_that_dies_equals_batch(spark, tmp_path):
    """A batch that dies after its files are marked, or after its chunks are written, runs again and ends the same."""
    rows = [(f"{i:02}", f"text {i % 7}\nline {i}" if i % 5 else f"same {i % 2}") for i in range(24)]
    source = f"{tmp_path}/in"
    for part in range(3):
        files(spark, rows[part::3]).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = lambda: spark.readStream.schema("file string, content binary").option("maxFilesPerTrigger", 1).parquet(source)
    folder, checkpoint = f"file://{tmp_path}/index", f"{tmp_path}/cp"
    calls = {"parse": 0, "cut": 0}

    def dying(name, at, then):
        def run(df):
            calls[name] += 1
            if calls[name] == at:
                raise RuntimeError("killed")
            return then(df)

        return run

    one, two = dying("parse", 2, parse), dying("cut", 3, cut)
    deaths = 0
    for _ in range(5):
        try:
            X.index_files(stream(), folder, checkpoint, one, two).awaitTermination()
            break
        except Exception as error:
            assert "killed" in str(error)
            deaths += 1
            assert {"running"} <= {s for s, _, _ in state(spark, folder).values()}
    assert deaths == 2
    batches = f"file://{tmp_path}/batches"
    names = {p.name: k for k, p in enumerate(sorted((p for p in (tmp_path / "in").glob("*.parquet")), key=lambda p: p.stat().st_mtime))}
    for name, k in names.items():
        X.ingest(spark.read.parquet(f"{source}/{name}"), k, batches, parse, cut)
    assert state(spark, folder) == state(spark, batches) and held(spark, folder) == held(spark, batches)
    assert {s for s, _, _ in state(spark, folder).values()} == {"done", "skipped"}


@pytest.fixture
def events(spark, tmp_path):
    source = f"{tmp_path}/events"
    for part in range(4):
        spark.createDataFrame([(part * 10 + i, i % 3) for i in range(10)], "event_id long, user_id long").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    return lambda: spark.readStream.schema("event_id long, user_id long").option("maxFilesPerTrigger", 1).parquet(source)


def test_pause_and_stop_lose_nothing(spark, tmp_path, events):
    folder, control, out = f"file://{tmp_path}/waiting", f"file://{tmp_path}/control", f"{tmp_path}/out"
    seen = []

    def work(rows, epoch):
        rows.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        seen.append(epoch)
        if epoch == 1:
            X.give_order(spark, control, "*", "stop", 2)

    run = lambda: X.controlled(events(), "user_id", work, folder, control, f"{tmp_path}/cp").awaitTermination()
    X.give_order(spark, control, "1", "pause", 1)
    with pytest.raises(Exception, match="before batch 2"):
        run()
    assert seen == [0, 1]
    done = lambda: sorted(r.event_id for r in spark.read.parquet(out).collect())
    everything = [part * 10 + i for part in range(4) for i in range(10)]
    assert done() == [e for e in everything if e < 20 and e % 10 % 3 != 1]
    X.give_order(spark, control, "*", "resume", 3)
    X.give_order(spark, control, "1", "resume", 4)
    run()
    assert seen == [0, 1, 2, 3] and done() == everything


def test_progress_is_written(spark, tmp_path, events):
    log = f"{tmp_path}/progress"
    listener = X.ProgressLog(spark, log)
    spark.streams.addListener(listener)
    try:
        events().writeStream.foreachBatch(lambda df, epoch: df.count()).option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
        for _ in range(60):
            time.sleep(0.5)
            if spark.read.schema(X.ProgressLog.SCHEMA).json(log).where("event = 'ended'").count():
                break
    finally:
        spark.streams.removeListener(listener)
    rows = spark.read.schema(X.ProgressLog.SCHEMA).json(log).collect()
    assert sum(r["rows"] for r in rows if r.event == "progress" and r["rows"]) == 40
    assert {r.event for r in rows} == {"started", "progress", "ended"} and not any(r.error for r in rows)


def test_names_that_occur_several_times_and_many_names(spark, tmp_path, monkeypatch):
    """Of rows of one name the greatest bytes count, in either way of looking up names; wide rows are shuffled once at most."""
    for limit in (200_000, 0):
        monkeypatch.setattr(X, "SMALL", limit)
        folder = f"file://{tmp_path}/index-{limit}"
        X.ingest(files(spark, [("a", "one"), ("a", "two"), ("b", "x\ny"), ("b", "x\ny"), ("c", "two"), ("d", "")]), 0, folder, parse, cut)
        assert state(spark, folder) == {"a": ("done", 1, None), "b": ("done", 2, None), "c": ("skipped", 0, "дубликат файла (a)"), "d": ("error", 0, "нет текста")}
        assert held(spark, folder) == [("a", 0, "two"), ("b", 0, "x"), ("b", 1, "y")]
    few = X._only(files(spark, [("a", "one"), ("b", "two")]), spark.createDataFrame([("a",)], "file string"))
    assert [r.file for r in few.collect()] == ["a"] and "ShuffledHashJoin" in few._jdf.queryExecution().executedPlan().toString()
