"""Answers to remarks by a model that callers supply, in packs that are asked for once each, however often a run is killed.

The packs are drawn up once and written.  A task asks the model for one pack and then commits its answers by renaming a file into the folder of
commits; a run that starts again asks for the packs without a commit only.  A pack whose model fails stays open and is told.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from .registers import natural_order
from .tables import folder_has, numbered

#: Remarks that a model gets at once.
PACK = 10

ANSWER = "pack long, number string, remark string, answer string, confidence string, used array<int>, attachments array<string>"


def plan(remarks: DataFrame, folder: str, size: int = PACK) -> DataFrame:
    """pack, place, number, text, context of remarks (number, text, context) in packs of ``size`` in natural order; as it was drawn up first, if the folder has a plan."""
    spark, path = remarks.sparkSession, f"{folder}/plan"
    if not folder_has(spark, f"{path}/_SUCCESS"):
        placed = numbered(remarks.select("number", "text", "context"), [*natural_order(), "text", "context"])
        placed.select(F.floor((F.col("place") - 1) / size).alias("pack"), "place", "number", "text", "context").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of all packs that are done, as the model gave them."""
    path = f"{folder}/commits"
    return spark.read.schema(ANSWER).json(path) if folder_has(spark, path) else spark.createDataFrame([], ANSWER)


def open_packs(spark: SparkSession, folder: str) -> DataFrame:
    """The plan's rows of packs that aren't done."""
    return spark.read.parquet(f"{folder}/plan").join(committed(spark, folder).select("pack").distinct(), "pack", "left_anti")


def ask(remarks: DataFrame, folder: str, model: Callable[[list[dict]], list[dict]], size: int = PACK) -> DataFrame:
    """Ask for all open packs; gives pack, error of those that stay open because the model failed.

    model: a pack's remarks (number, text, context) -> their answers (number, answer, and confidence, used, attachments if it has them), on an executor.
    Remarks that it passes over get an empty answer; answers to other numbers are left out.  ``folder`` is one that all executors share, of a file
    system that pyarrow knows.
    """
    spark = remarks.sparkSession
    plan(remarks, folder, size)

    def run(pack: pd.DataFrame) -> pd.DataFrame:
        number = int(pack["pack"].iloc[0])
        pack = pack.sort_values("place")
        rows = [dict(zip(("number", "text", "context"), r, strict=True)) for r in zip(pack.number, pack.text, pack.context, strict=True)]
        try:
            by_number = {str(a.get("number")): a for a in model(rows)}
        except Exception as error:  # noqa: BLE001  the pack stays open and is told
            return pd.DataFrame({"pack": [number], "error": [f"{type(error).__name__}: {error}"[:300]]})
        lines = []
        for r in rows:
            a = by_number.get(r["number"]) or {}
            out = {"pack": number, "number": r["number"], "remark": r["text"], "answer": str(a.get("answer") or ""), "confidence": a.get("confidence"), "used": a.get("used") or [], "attachments": a.get("attachments") or []}
            lines.append(json.dumps(out, ensure_ascii=False))
        fs, at = pafs.FileSystem.from_uri(f"{folder}/commits")
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/_{number}.writing") as f:
            f.write(("\n".join(lines) + "\n").encode())
        fs.move(f"{at}/_{number}.writing", f"{at}/{number}.json")  # the commit: all of the pack or nothing
        return pd.DataFrame({"pack": [], "error": []}).astype({"pack": "int64", "error": "object"})

    todo = open_packs(spark, folder)
    return spark.createDataFrame(todo.groupBy("pack").applyInPandas(run, "pack long, error string").collect(), "pack long, error string")  # one row for each failure


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """number, remark, answer, confidence (high, medium or low), used, attachments (stripped), status, low_support of all packs that are done: proposed; an answer without sources has little support."""
    a = committed(spark, folder)
    given = T.strip(T.text("answer"))
    files = F.filter(F.transform(F.coalesce("attachments", F.array().cast("array<string>")), T.strip), lambda x: x != "")
    used = F.coalesce("used", F.array().cast("array<int>"))
    return a.select("pack", "number", "remark", given.alias("answer"), T.confidence("confidence", "answer").alias("confidence"), used.alias("used"), files.alias("attachments"), F.lit("proposed").alias("status"), ((given != "") & (F.size(used) == 0)).alias("low_support"))
