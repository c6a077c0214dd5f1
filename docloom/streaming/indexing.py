"""Indexing of files one by one, in batches that can be killed and run again; streams that people pause and stop; progress as rows.

The state of a file is the last entry of an append-only manifest.  A batch first marks its files as in flight, then writes
their chunks to a folder of its own, then their outcomes.  A batch that runs again writes the same folders
again, and chunks count only if the manifest's entry is of their batch; so a batch that died halfway leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import text as T
from ..operators.search import SMALL, small
from ..operators.tables import folder_has, saved

ENTRY = "file string, status string, raw_sha string, fingerprint string, chunks long, reason string"
IN_FLIGHT, FINAL = 0, 1


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The last entry of each file: file, status (running, done, skipped, error), raw_sha, fingerprint, chunks, reason, batch; of batches before one, if given."""
    path = f"{folder}/manifest"
    schema = f"{ENTRY}, batch long, stage int"
    rows = spark.read.schema(schema).parquet(path) if folder_has(spark, path) else spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.groupBy("file").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "file"]), F.struct("batch", "stage")).alias("e"))
    return last.select("file", "e.*").drop("stage")


def pending(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (file, raw_sha) that the manifest doesn't hold as done or skipped with these bytes: new and changed ones, those with errors, and those that were in flight when a run ended."""
    settled = known.where(F.col("status").isin("done", "skipped")).select("file", "raw_sha")
    return files.join(settled, ["file", "raw_sha"], "left_anti")


def _only(wide: DataFrame, names: DataFrame) -> DataFrame:
    """Wide rows of these files: names are broadcast if they are few, else wide rows are shuffled once, and never sorted."""
    return wide.join(F.broadcast(names) if names.count() <= SMALL else names.hint("shuffle_hash"), "file", "left_semi")


def ingest(batch: DataFrame, epoch: int, folder: str, parse: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> None:
    """Index one batch of files (file, content as bytes; the last row of a file's name counts only by its bytes' order).

    parse: (file, content) -> file, text, error (null, or why there is no text), one row a file.  cut: (file, text) -> chunks with their file.
    Of files with equal bytes, then of texts with equal fingerprints, one is indexed: that which earlier batches did, else the first by name. The
    others are skipped with the reason.  A file that failed or was in flight before is indexed as a whole again.
    """
    spark = batch.sparkSession
    known = manifest(spark, folder, before=epoch)
    # Names and sums are few beside bytes: what is to be done is settled on narrow rows, and bytes and texts are asked for once each.
    counted = saved(batch.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max(F.sha2("content", 256)).alias("raw_sha")), "names")
    contents, named, several = batch.select("file", "content"), counted.where("rows = 1").select("file", "raw_sha"), counted.where("rows > 1").select("file")
    if not several.isEmpty():
        last = contents.join(small(several), "file", "left_semi").groupBy("file").agg(F.max("content").alias("content"))
        contents = contents.join(small(several), "file", "left_anti").unionByName(last)
        named = named.unionByName(last.select("file", F.sha2("content", 256).alias("raw_sha")))
    todo = saved(pending(named, known), "todo")
    entry = lambda df, status, **own: df.select("file", F.lit(status).alias("status"), *(own.get(c, F.lit(None)).cast(k).alias(c) for c, k in (("raw_sha", "string"), ("fingerprint", "string"), ("chunks", "long"), ("reason", "string"))))
    write = lambda df, stage: df.write.mode("overwrite").parquet(f"{folder}/manifest/batch={epoch}/stage={stage}")
    write(entry(todo, "running", raw_sha=F.col("raw_sha")), IN_FLIGHT)

    done = known.where("status = 'done'")
    own_names = todo.select("file")
    raw_owners = done.join(own_names, "file", "left_anti").groupBy("raw_sha").agg(F.min("file").alias("owner"))
    first_of = lambda key: F.min("file").over(Window.partitionBy(key))
    owned = todo.join(raw_owners, "raw_sha", "left").withColumn("first", F.coalesce("owner", first_of("raw_sha")))
    owned = saved(owned.select("file", "raw_sha", "first"), "owned")
    copies = owned.where("first <> file")
    # Parsing is the dear step: it is done once, and what follows reads the batch's own folder.
    texts = parse(_only(contents, owned.where("first = file").select("file")))
    texts.withColumn("fingerprint", T.fingerprint("text")).write.mode("overwrite").parquet(f"{folder}/texts/batch={epoch}")
    texts = spark.read.parquet(f"{folder}/texts/batch={epoch}")
    parsed = texts.select("file", "error", "fingerprint").join(owned.select("file", "raw_sha"), "file")
    failed, good = parsed.where("error IS NOT NULL"), parsed.where("error IS NULL")
    seen = done.join(own_names, "file", "left_anti").select("fingerprint").distinct().withColumn("held", F.lit(True))
    marked = good.join(seen, "fingerprint", "left").withColumn("first", first_of("fingerprint"))
    marked = saved(marked.withColumn("repeated", F.coalesce("held", F.lit(False)) | (F.col("first") != F.col("file"))), "marked")
    repeated = F.col("repeated")
    cut(_only(texts.where("error IS NULL").select("file", "text"), marked.where(~repeated).select("file"))).write.mode("overwrite").parquet(f"{folder}/chunks/batch={epoch}")
    counts = spark.read.parquet(f"{folder}/chunks/batch={epoch}").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    indexed = marked.where(~repeated).join(counts, "file", "left")
    sums = {"raw_sha": F.col("raw_sha"), "fingerprint": F.col("fingerprint")}
    zero = F.lit(0)
    why = failed.select(F.col("file").alias("first"), F.col("error").alias("why"))  # copies of a file that failed fail with it
    told = copies.join(why, "first", "left")
    outcome = (
        entry(indexed, "done", **sums, chunks=F.coalesce("n", zero))
        .unionByName(entry(marked.where(repeated), "skipped", **sums, chunks=zero, reason=F.lit("дубликат (sha256)")))
        .unionByName(entry(told.where("why IS NULL"), "skipped", raw_sha=F.col("raw_sha"), chunks=zero, reason=F.concat(F.lit("дубликат файла ("), "first", F.lit(")"))))
        .unionByName(entry(told.where("why IS NOT NULL"), "error", raw_sha=F.col("raw_sha"), chunks=zero, reason=F.col("why")))
        .unionByName(entry(failed, "error", raw_sha=F.col("raw_sha"), chunks=zero, reason=F.col("error")))
    )
    write(outcome, FINAL)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of all files that are done, as their last batch wrote them."""
    rows = spark.read.parquet(f"{folder}/chunks")
    held = manifest(spark, folder).where("status = 'done'").select("file", "batch")
    return rows.join(held, ["file", "batch"], "left_semi").drop("batch")


def index_files(source: DataFrame, folder: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """A stream of files (file, content) into the index of a folder; batches that failed run again where they were."""
    return source.writeStream.foreachBatch(lambda df, epoch: ingest(df, epoch, folder, parse, cut)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StopRequested(Exception):
    """Raised before a batch is worked on; the stream ends, and the batch comes first when it starts again."""


def orders(spark: SparkSession, control: str) -> DataFrame:
    """key, action of the last order for each key in an append-only log (key, action, ts) of JSON lines; the key * is for the stream as a whole."""
    schema = "key string, action string, ts long"
    log = spark.read.schema(schema).json(control) if folder_has(spark, control) else spark.createDataFrame([], schema)
    return log.groupBy("key").agg(F.max_by("action", F.struct("ts", "action")).alias("action"))


def give_order(spark: SparkSession, control: str, key: str, action: str, ts: int) -> None:
    """Add an order (pause, resume or stop) to the log."""
    spark.createDataFrame([(key, action, ts)], "key string, action string, ts long").coalesce(1).write.mode("append").json(control)


def controlled(source: DataFrame, key: str, work: Callable[[DataFrame, int], None], folder: str, control: str, checkpoint: str) -> StreamingQuery:
    """Work through a stream under orders that are read before each batch.

    Rows of a paused key wait in ``folder``, a part for each batch, and join the first batch after its resume.  An order to stop ends the
    stream before the batch; nothing is lost, since the batch isn't committed.  ``work`` gets (rows, batch number) and, as with any such sink, has to
    write by batch number, because a batch that fails is run again.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        # Later orders are for later batches: what this one was told is kept, so that it does the same if it runs again.
        last = orders(spark, control)
        if not last.where("key = '*' AND action = 'stop'").isEmpty():
            raise StopRequested(f"before batch {epoch}")
        told = f"{folder}/orders/batch={epoch}"
        if not folder_has(spark, f"{told}/_SUCCESS"):
            last.write.mode("overwrite").parquet(told)
        paused = spark.read.parquet(told).where("action = 'pause'").select(F.col("key").alias("paused_key"))
        before = f"{folder}/waiting/batch={epoch - 1}"
        if folder_has(spark, before):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(before))
        name = F.col(key).cast("string")
        rows.join(paused, name == F.col("paused_key"), "left_semi").write.mode("overwrite").parquet(f"{folder}/waiting/batch={epoch}")
        work(rows.join(paused, name == F.col("paused_key"), "left_anti"), epoch)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressLog(StreamingQueryListener):
    """Writes a row for each batch of the streams of a session: query, batch, rows, seconds, at; and one when a stream ends, with its error."""

    SCHEMA = "query string, batch long, rows long, seconds double, at string, event string, error string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _write(self, *row) -> None:
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(self.folder)

    def onQueryStarted(self, event) -> None:
        self._write(str(event.id), None, None, None, event.timestamp, "started", None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write(str(p.id), p.batchId, p.numInputRows, p.batchDuration / 1000, p.timestamp, "progress", None)

    def onQueryIdle(self, event) -> None:
        """Nothing to write."""

    def onQueryTerminated(self, event) -> None:
        self._write(str(event.id), None, None, None, None, "ended", event.exception)
