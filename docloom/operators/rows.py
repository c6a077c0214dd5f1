"""Remarks from the rows of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T

# Words of a header row.
HEADER_HINTS = ["замечан", "п/п", "№", "номер", "содержан", "текст"]


def remarks(tables: DataFrame) -> DataFrame:
    """t, number, text of the remarks in tables' rows (t, pos, cells).

    Blank rows and a header go; the text is the column with most characters; the number is the first column if it is
    another one and at most 12 characters, else the row's place; texts under 8 characters go.
    """
    filled = tables.where(F.exists("cells", lambda c: T.strip(T.text(c)) != ""))
    placed = filled.withColumn("row", F.row_number().over(Window.partitionBy("t").orderBy("pos")))
    header = T.has_any(F.lower(F.array_join(F.transform("cells", T.text), " ")), HEADER_HINTS) & (F.col("row") == 1)
    body = placed.withColumn("header", header).where(~F.col("header")).withColumn("row", F.row_number().over(Window.partitionBy("t").orderBy("pos")))
    cells = body.select("t", F.posexplode("cells").alias("at", "cell")).groupBy("t", "at").agg(F.sum(F.length(T.text("cell"))).alias("n"))
    column = cells.groupBy("t").agg(F.max_by("at", F.struct("n", -F.col("at"))).alias("at"))
    text, first = T.strip(T.text(F.get("cells", F.col("at")))), T.strip(T.text(F.get("cells", F.lit(0))))
    own = (F.col("at") != 0) & (first != "") & (F.length(first) <= 12)
    found = body.join(column, "t").select("t", F.when(own, first).otherwise(F.col("row").cast("string")).alias("number"), text.alias("text"))
    return found.where(F.length("text") >= 8)
