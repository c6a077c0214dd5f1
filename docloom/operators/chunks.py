"""Chunks of documents, with stable ids, context and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import arrow as A, text as T


def build(pages: DataFrame, by_points: bool = False, header: int = 400) -> DataFrame:
    """Chunks of pages (project, file, page, loc, section, text, is_table).

    Tables are always cut by characters, and every piece after the first gets the table's first line before it.
    Chunks of a file are numbered across its pages; ids depend on file, place and text alone.
    """
    plain, points = A.chunk_text_udf(), A.chunk_points_udf()
    cut = F.when(F.col("is_table"), plain("text")).otherwise(points("text")) if by_points else plain("text")
    pieces = pages.select("*", F.posexplode(cut).alias("piece", "chunk")).withColumn("head", F.left(F.get(F.split(T.strip(T.text("text")), "\n"), F.lit(0)), F.lit(header)))
    body = F.when(F.col("is_table") & (F.col("piece") > 0), F.concat_ws("\n", "head", "chunk")).otherwise(F.col("chunk"))
    numbered = pieces.withColumn("chunk_text", body).withColumn("chunk_index", F.row_number().over(Window.partitionBy("project", "file").orderBy("page", "piece")) - 1)
    context = F.concat(F.lit("["), F.concat_ws(" · ", "section", "loc", "file"), F.lit("]"))
    return numbered.select(T.stable_id("file", "loc", "chunk_index", "chunk_text").alias("id"), "project", "file", "loc", T.page_number("loc").alias("page_number"), "section", "is_table", "chunk_index", F.col("chunk_text").alias("text"), context.alias("context"), T.references("chunk_text").alias("references"), T.fingerprint("chunk_text").alias("fingerprint"))


def embedded(chunks: DataFrame, cache: DataFrame, model: str, embed) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors, and the new rows of the cache (k, vector).

    ``embed`` maps lists of texts to lists of vectors; only distinct texts that the cache lacks are sent to it.
    """
    keyed = chunks.withColumn("k", T.cache_key(model, "text"))
    missing = keyed.groupBy("k").agg(F.first("text").alias("text")).join(cache.select("k"), "k", "left_anti")

    @F.pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        return pd.Series([list(map(float, v)) for v in embed(texts.tolist())])

    fresh = missing.select("k", run("text").alias("vector"))
    return keyed.join(cache.select("k", "vector").unionByName(fresh), "k").drop("k"), fresh
