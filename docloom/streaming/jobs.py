"""Job state: decision logs, heartbeats and incremental indexing, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.tables import folder_has, saved

#: Seconds without a heartbeat after which a job counts as dead.
DEAD_AFTER = 120


def micros(c: Column | str) -> Column:
    """A time, with or without zone, in microseconds."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def latest(log: DataFrame, key: str = "user_id", value: str = "event_type") -> DataFrame:
    """key, status, n of an append-only log (ts, event_id): the status of each key's last entry."""
    return log.groupBy(key).agg(F.max_by(value, F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("n"))


def stream_latest(log: DataFrame, key: str = "user_id", value: str = "event_type") -> DataFrame:
    """As :func:`latest`, over a streaming log; to be written in update or complete mode."""
    return latest(log, key, value)


def sessions(beats: DataFrame, key: str = "user_id", gap: int = DEAD_AFTER) -> DataFrame:
    """key, session, first_beat, last_beat, beats of runs of heartbeats (ts) with at most ``gap`` seconds between neighbours."""
    along = Window.partitionBy(key).orderBy("ts", "event_id")
    apart = micros("ts") - micros(F.lag("ts").over(along)) > gap * 1_000_000
    numbered = beats.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("session", F.sum("new").over(along))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("first_beat"), F.max("ts").alias("last_beat"), F.count(F.lit(1)).alias("beats"))


def stale(beats: DataFrame, key: str = "user_id", gap: int = DEAD_AFTER) -> DataFrame:
    """key, last_beat, stale: whether the last heartbeat is more than ``gap`` seconds before the latest of all."""
    last = beats.groupBy(key).agg(F.max("ts").alias("last_beat"))
    now = last.agg(F.max("last_beat").alias("now"))
    return last.crossJoin(F.broadcast(now)).select(key, "last_beat", (micros("now") - micros("last_beat") > gap * 1_000_000).alias("stale"))  # now: one row


def progress(files: DataFrame) -> DataFrame:
    """One row of a manifest (file, status, chunks): total, done, failed, chunks, percent."""
    done = F.count_if(F.col("status").isin("done", "skipped"))
    return files.agg(F.count(F.lit(1)).alias("total"), done.alias("done"), F.count_if(F.col("status") == "error").alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.round(100.0 * done / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("percent"))


def windows(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling windows over events (ts, event_type, value); in a stream, later ones than ``late`` are dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def watch(beats: DataFrame, key: str = "user_id", gap: int = DEAD_AFTER) -> DataFrame:
    """A streaming table of keys that stopped: (key, last_beat) once a key has sent nothing for ``gap`` seconds of event time."""

    def step(name: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], "last_beat": [pd.Timestamp(last, unit="us")]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(r.ts.max().value // 1000) for r in rows)])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + gap * 1000, state.getCurrentWatermarkMs() + 1))

    timed = beats.withWatermark("ts", "0 seconds").select(key, "ts")
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} long, last_beat timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def index_stream(spark: SparkSession, source: DataFrame, manifest: str, checkpoint: str, index: Callable[[DataFrame, int], None]):
    """Index a stream of documents (doc_id, text) once by content.

    Each micro-batch drops contents that the manifest (a Parquet folder) holds, calls ``index`` for the rest and adds them; a batch that is
    run again after a failure rewrites its own part of the manifest.
    """

    def batch(docs: DataFrame, epoch: int) -> None:
        own = docs.sparkSession
        marked = docs.withColumn("fingerprint", T.fingerprint("text"))
        first = marked.groupBy("fingerprint").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d")).select("fingerprint", "d.doc_id", "d.text")
        if folder_has(own, manifest):
            seen = own.read.parquet(manifest).where(F.col("epoch") != epoch).select("fingerprint")
            first = first.join(seen, "fingerprint", "left_anti")
        first = saved(first, "first-contents")  # what is indexed is what the manifest says
        index(first, epoch)
        first.select("doc_id", "fingerprint").write.mode("overwrite").parquet(f"{manifest}/epoch={epoch}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
