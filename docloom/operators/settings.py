"""Layers of settings as JSON: flattened to paths, merged so that the last layer wins, and put together again.

A setting is its path of names and its value.  Objects are merged name by name; any other value of a later layer takes the place of whatever
was there before, and an object the place of a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import saved

#: Names in a path at most; deeper JSON is refused.
DEEPEST = 64


def _kind(v: Column) -> Column:
    """object, array or other."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise("other")


def flattened(layers: DataFrame) -> DataFrame:
    """name, ord, path (array), value (JSON; {} for an object without names) of layers (name, ord, json). A layer whose JSON is broken, null or no object has no settings."""
    level = layers.select("name", "ord", F.array().cast("array<string>").alias("path"), F.try_parse_json("json").alias("v"))
    level = level.where(F.col("v").isNotNull() & (_kind(F.col("v")) == "object"))
    leaves = None
    for _ in range(DEEPEST):
        fields = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
        inner = level.select("name", "ord", "path", F.explode_outer(fields).alias("f"))
        empty = inner.where("f IS NULL AND size(path) > 0").select("name", "ord", "path", F.lit("{}").alias("value"))
        named = saved(inner.where("f IS NOT NULL").select("name", "ord", F.concat("path", F.array("f.key")).alias("path"), F.col("f.value").alias("v")).select("*", F.coalesce(_kind(F.col("v")), F.lit("other")).alias("kind"), F.to_json("v").alias("json")).drop("v"), "settings")
        found = named.where("kind <> 'object'").select("name", "ord", "path", F.coalesce("json", F.lit("null")).alias("value")).unionByName(empty)
        leaves = found if leaves is None else leaves.unionByName(found)
        level = named.where("kind = 'object'").select("name", "ord", "path", F.parse_json("json").alias("v"))
        if level.isEmpty():
            return leaves
    raise ValueError(f"settings of over {DEEPEST} levels")


def merged(leaves: DataFrame, join_lists: bool = False) -> DataFrame:
    """name, path, value of each setting that holds: of the last layer (ord) that says anything about its path.

    Of values that one layer gives one path, the greatest is taken. A value gives way to a later one of the same path, of a path that leads to it (but for an empty object there), or of one that it leads to.
    With ``join_lists``, lists of one path are put together in order of their layers instead.
    """
    if join_lists:
        lists = leaves.where(F.col("value").startswith("["))
        inside = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: F.substring(x["value"], F.lit(2), F.length(x["value"]) - 2)), lambda x: x != ""), ",")
        # Of several layers' lists, the last one's place holds.
        put = lists.groupBy("name", "path").agg(F.max("ord").alias("ord"), F.concat(F.lit("["), inside, F.lit("]")).alias("value")).select("name", "ord", "path", "value")
        leaves = leaves.where(~F.col("value").startswith("[")).unionByName(put)
    # Of the layers that give a path a value, or that give it an empty object, the last ones say all: a row for each path, however many layers.
    leaves = leaves.groupBy("name", "path", (F.col("value") == "{}").alias("empty")).agg(F.max(F.struct("ord", "value")).alias("last")).select("name", "last.ord", "path", "last.value")
    leaves = saved(leaves, "settings")
    # What each layer says about a path, and about every path that leads to it.
    on_the_way = leaves.select("name", "ord", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(F.slice("path", 1, n).alias("path"), ((n < F.size("path")) | (F.col("value") == "{}")).alias("through")))).alias("x"))
    said = on_the_way.select("name", "x.path", "ord", "x.through")
    last = said.groupBy("name", F.col("path").alias("way")).agg(F.max(F.when(~F.col("through"), F.col("ord"))).alias("value_ord"), F.max(F.when(F.col("through"), F.col("ord"))).alias("inside_ord"))
    ways = leaves.select("name", "ord", "path", "value", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("way"))
    # Both sides are shuffled: Spark sizes paths that are exploded as one each, and might broadcast many.
    known = ways.join(last.hint("merge"), ["name", "way"], "left")
    own = F.size("way") == F.size("path")
    later_value = F.coalesce(F.col("value_ord") > F.col("ord"), F.lit(False))
    later_inside = own & F.coalesce(F.col("inside_ord") > F.col("ord"), F.lit(False)) & (F.col("value") != "{}")
    judged = known.groupBy("name", "ord", "path", "value").agg(F.max(later_value | later_inside).alias("gone"))
    left = judged.where("NOT gone").select("name", "ord", "path", "value")
    # An empty object is no more than a sign that there is one: it goes if anything is inside.
    inside_of = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("path")
    filled = left.where(F.size("path") > 1).select("name", inside_of).distinct().withColumn("held", F.lit(True))
    return left.join(filled.hint("merge"), ["name", "path"], "left").where((F.col("value") != "{}") | F.col("held").isNull()).select("name", "path", "value").distinct()


def rebuilt(settings: DataFrame) -> DataFrame:
    """name, json of settings (name, path, value): names in order, objects put together from the deepest up."""
    level = settings = saved(settings, "settings")
    deepest = settings.agg(F.max(F.size("path"))).first()[0] or 0
    field = F.to_json(F.struct(F.element_at("path", -1).alias("k")))
    quoted = F.expr("substring(field, 6, length(field) - 6)")  # {"k":"name"} without all but the name
    for n in range(deepest, 0, -1):
        here = level.where(F.size("path") == n).withColumn("field", field)
        pairs = F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("name"), F.concat(quoted, F.lit(":"), "value").alias("pair"))))
        objects = here.groupBy("name", F.slice("path", 1, n - 1).alias("path")).agg(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["pair"]), ","), F.lit("}")).alias("value"))
        level = level.where(F.size("path") < n).unionByName(objects.select("name", "path", "value"))
    return level.select("name", F.col("value").alias("json"))


def setting(json: Column | str, path: str, default: str | None = None) -> Column:
    """The value at a path of names with points between, as text; a default where it isn't there."""
    c = F.col(json) if isinstance(json, str) else json
    found = F.try_variant_get(F.try_parse_json(c), f"$.{path}", "string")
    return F.coalesce(found, F.lit(default)) if default is not None else found
