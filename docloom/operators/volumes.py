"""Which volume an answer's correction goes to, people and organisations named in files, ranking of model providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .search import small


def belongs(volume: Column, file: Column) -> Column:
    """Whether an answer's volume label and a file's name mean the same volume: one holds the other, and no digit or dot follows."""
    v, name = F.lower(T.strip(T.text(volume))), F.lower(file)
    bare = lambda c: F.regexp_replace(c, r"\.[^./\\]+$", "")
    named = F.when(v.rlike(r"\.(docx|doc|pdf)$"), T.contains_number(name, bare(v))).otherwise(False)
    return (v != "") & (T.contains_number(name, v) | T.contains_number(v, name) | T.contains_number(v, bare(name)) | named)


def assign(answers: DataFrame, files: DataFrame) -> DataFrame:
    """number, file of accepted and edited answers (number, oos_volume, status) and volumes (pos, file).

    An answer goes to every volume it belongs to; one that belongs to none goes to the first, and a single volume takes all.
    """
    chosen = answers.where(F.col("status").isin("accepted", "edited"))
    volumes = small(files.select("pos", "file"))
    matched = chosen.join(volumes, belongs(F.col("oos_volume"), F.col("file"))).select("number", "file")
    first = files.agg(F.min_by("file", "pos").alias("first"), F.count(F.lit(1)).alias("n"), F.min("file").alias("only"))
    left = chosen.select("number").join(matched.select("number").distinct(), "number", "left_anti").crossJoin(F.broadcast(first)).where(F.col("first").isNotNull()).select("number", F.col("first").alias("file"))  # first: one row
    return matched.unionByName(left)


# Roles and kinds of organisations in title pages.
ROLE = r"(?imu)^[ \t]*(ГИП|Главный инженер проекта|Главный специалист|Разработал|Выполнил|Проверил|Н\.?\s?контр\.?|Нормоконтроль|Директор|Гл\.?\s?эксперт|Эксперт)(?![\p{L}\p{N}_])[:\s.\-—]*((?-i:[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.?|\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?)?))"
ORGANISATION = r'(?:ООО|АО|ПАО|ЗАО|ФАУ|ГАУ|ФГБУ)\s*[«"][^»"]{3,80}[»"]'


def contacts(pages: DataFrame, first: int = 3) -> DataFrame:
    """file, role, name, phone, email of people named with a role on a file's first pages (file, page, text); once each, by the first file."""
    head = pages.where(F.col("page") < first).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", T.text("text").alias("t")))), lambda p: p["t"]), "\n").alias("text"))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(ROLE), 1).alias("role"), F.regexp_extract_all("text", F.lit(ROLE), 2).alias("name"))
    people = head.select("file", F.get(T.phones("text"), F.lit(0)).alias("phone"), F.get(T.emails("text"), F.lit(0)).alias("email"), F.posexplode(pairs).alias("pos", "p"))
    once = Window.partitionBy(F.lower("p.role"), F.lower("p.name")).orderBy("file", "pos")
    return people.withColumn("n", F.row_number().over(once)).where("n = 1").select("file", F.col("p.role").alias("role"), F.col("p.name").alias("name"), "phone", "email")


def organisations(pages: DataFrame) -> DataFrame:
    """organisation, of all names found."""
    return pages.select(F.explode(F.transform(F.regexp_extract_all(T.text("text"), F.lit(ORGANISATION), 0), T.squeeze)).alias("organisation")).distinct()


def model_size(name: Column | str) -> Column:
    """Billions of parameters stated in a model's name, else 0."""
    n = F.lower(T.text(name))
    exact = F.regexp_extract(n, r"[:\-_ ](\d{1,3}(?:\.\d)?)\s*b(?:$|[^\p{L}\p{N}_])", 1)
    loose = F.regexp_extract(n, r"(\d{2,3})b", 1)
    return F.coalesce(F.nullif(exact, F.lit("")).try_cast("double"), F.nullif(loose, F.lit("")).try_cast("double"), F.lit(0.0))


def working_order(health: DataFrame, local: str = "local", large: float = 13.0) -> DataFrame:
    """provider, place of working providers (provider, ok, best_model, tier, quality, ms): cheapest first, then best, then fastest; a large local model counts as tier 0.5."""
    tier = F.when((F.col("provider") == local) & (model_size("best_model") >= large), 0.5).otherwise(F.col("tier"))
    working = health.where(F.col("ok") & (T.text("best_model") != ""))
    order = Window.orderBy(tier, "quality", F.coalesce("ms", F.lit(10**6)), "provider")  # a handful of providers
    return working.select("provider", F.row_number().over(order).alias("place"))


# Parts of the names of models that don't chat.
NO_CHAT = "bge|embed|rerank|whisper|tts|audio|image|vision-only|dall|sora|veo|imagen|moderation|guard|nomic|minilm|clip"


def ranked_models(models: DataFrame, preferences: DataFrame, top: int = 4) -> DataFrame:
    """provider, model, place of chat models (provider, pos, model): by the first preference (provider, ord, pattern) they meet, shorter names first; others behind, as listed."""
    chat = models.where(~F.lower("model").rlike(NO_CHAT))
    liked = chat.join(small(preferences), "provider").where(F.regexp_like(F.lower("model"), F.lower("pattern"))).groupBy("provider", "model").agg(F.min("ord").alias("ord"))
    placed = chat.join(liked, ["provider", "model"], "left")
    order = Window.partitionBy("provider").orderBy(F.col("ord").asc_nulls_last(), F.when(F.col("ord").isNotNull(), F.length("model")).otherwise(F.col("pos")), "pos")
    return placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("provider", "model", "place")
