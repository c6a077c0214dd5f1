"""Dependency and knowledge graphs as vertex and edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .tables import saved, shared_folder

# Which section feeds which, and computed parts that are no sections.
EDGES = [
    ("PZU", "POS"), ("TKR", "POS"), ("POS", "OOS"), ("IEI", "OOS"), ("IGMI", "OOS"), ("IGDI", "OOS"), ("IGI", "OOS"), ("POS", "EMISSIONS"),
    ("EMISSIONS", "DISPERSION"), ("IGMI", "DISPERSION"), ("DISPERSION", "SZZ"), ("POS", "WASTE"), ("IEI", "WASTE"), ("OOS", "EMISSIONS"), ("OOS", "WASTE"), ("OOS", "SZZ"),
]
VIRTUAL = ["EMISSIONS", "DISPERSION", "SZZ", "WASTE"]


def vertices(edges: DataFrame, present: DataFrame, virtual: DataFrame) -> DataFrame:
    """code, kind (section or virtual), present, in_degree, out_degree of each end of an edge (src, dst)."""
    ends = edges.select(F.col("src").alias("code"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("code"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degree = ends.groupBy("code").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    mark = lambda df, name: df.select("code").distinct().withColumn(name, F.lit(True))
    out = degree.join(mark(present, "p"), "code", "left").join(mark(virtual, "v"), "code", "left")
    return out.select("code", F.when(F.col("v"), "virtual").otherwise("section").alias("kind"), F.coalesce("p", F.lit(False)).alias("present"), "in_degree", "out_degree")


def downstream(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """code, depth, via (the shortest path, its least spelling) of everything that depends on a changed code.

    Only the frontier of newly reached codes is extended, so each code is extended at most once; a changed code can be reached itself.
    Every round's frontier is written to the shared folder, one part of the result; there are as many rounds as the deepest path has steps.
    """
    spark = edges.sparkSession
    base = f"{shared_folder(spark)}/downstream-{uuid.uuid4().hex}"
    frontier = changed.select("code", F.col("code").alias("via")).distinct()
    kind = dict(frontier.dtypes)["code"]
    schema = f"code {kind}, via string, depth int"
    reached = spark.createDataFrame([], schema)
    depth = 0
    while True:
        depth += 1
        step = frontier.join(edges, frontier["code"] == edges["src"]).groupBy(F.col("dst").alias("code")).agg(F.min(F.concat_ws(">", "via", "dst")).alias("via"))
        step.join(reached.select("code"), "code", "left_anti").write.parquet(f"{base}/depth={depth}")
        frontier = spark.read.schema(f"code {kind}, via string").parquet(f"{base}/depth={depth}")
        if frontier.isEmpty():
            return reached.select("code", "depth", "via")
        reached = spark.read.schema(schema).parquet(base)


def levels(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """code, level: the longest path to each of ``codes`` within their subgraph; ordered by level and code it is an order to update them in.

    Codes whose predecessors are all placed are peeled off, round by round, and each round is written to the shared folder.  Codes on a cycle, or behind one, are left over: their level is null.
    """
    spark = edges.sparkSession
    base = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"
    todo = codes.select("code").where("code IS NOT NULL").distinct()
    left = edges.join(todo.select(F.col("code").alias("src")), "src", "left_semi").join(todo.select(F.col("code").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    todo, left = saved(todo, "codes"), saved(left, "edges")
    level = 0
    while True:
        todo.join(left.select(F.col("dst").alias("code")), "code", "left_anti").write.parquet(f"{base}/level={level}")
        ready = spark.read.schema(todo.schema).parquet(f"{base}/level={level}")
        placed = spark.read.schema(f"{todo.schema.simpleString()[7:-1].replace(':', ' ')}, level int").parquet(base)
        if ready.isEmpty():
            return placed.select("code", "level").unionByName(todo.select("code", F.lit(None).cast("int").alias("level")))
        left = saved(left.join(ready.select(F.col("code").alias("src")), "src", "left_anti"), "edges")
        todo = saved(todo.join(ready, "code", "left_anti"), "codes")
        level += 1


def explained(changed: DataFrame, affected: DataFrame, labels: DataFrame) -> DataFrame:
    """place, line of a cascade's report: what changed (code), then each affected code (code, depth, via) with its label (code, label; else the code) and path, in order of depth and code."""
    some = affected.agg(F.count(F.lit(1)).alias("n"))
    head = changed.agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("names"))
    first = head.select(F.lit(0).alias("depth"), F.lit("").alias("code"), F.when(F.col("names") == "", "Изменяемые разделы не найдены в графе зависимостей.").otherwise(F.concat(F.lit("Изменение в: "), "names")).alias("line"))
    second = some.select(F.lit(0).alias("depth"), F.lit(" ").alias("code"), F.when(F.col("n") == 0, "Прямых зависимых разделов не обнаружено.").otherwise("Затронутые разделы/расчёты (проверить на согласованность):").alias("line"))
    path = F.replace("via", F.lit(">"), F.lit(" → "))
    named = affected.join(labels.select("code", "label"), "code", "left")
    rest = named.select("depth", "code", F.concat(F.lit("  • "), F.coalesce("label", "code"), F.lit(" (глубина "), F.col("depth").cast("string"), F.lit("; путь: "), path, F.lit(")")).alias("line"))
    return first.unionByName(second).unionByName(rest)


def merge_edges(old: DataFrame, seen: DataFrame) -> DataFrame:
    """u, v, kind, weight, first_seen, last_seen of stored edges and occurrences (u, v, kind, ts); every occurrence adds 1 to the weight."""
    fresh = seen.select("u", "v", "kind", F.lit(1).cast("long").alias("weight"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))
    return old.unionByName(fresh).groupBy("u", "v", "kind").agg(F.sum("weight").alias("weight"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def projects_with(edges: DataFrame, fragment: str) -> DataFrame:
    """project, entity of edges (u, v) whose entity's label holds the fragment, letter case aside."""
    return edges.where(F.contains(F.lower("v"), F.lit(fragment.lower()))).select(F.col("u").alias("project"), F.col("v").alias("entity")).distinct()


def edges_present(edges: DataFrame, present: DataFrame) -> DataFrame:
    """src, dst of edges and whether each end is a present section."""
    codes = present.select("code").distinct()
    has = lambda side: codes.select(F.col("code").alias(side), F.lit(True).alias(f"{side}_present"))
    out = edges.select("src", "dst").join(has("src"), "src", "left").join(has("dst"), "dst", "left")
    return out.select("src", "dst", F.coalesce("src_present", F.lit(False)).alias("src_present"), F.coalesce("dst_present", F.lit(False)).alias("dst_present"))
