"""What the joins for similar documents have in common: from candidate keys to groups of linked documents.

A row is named by its id and a hash of its text (``tie``), so that rows that share an id but not a text are documents of
their own; rows of equal id and text are one.  Rows with equal sets are one class, and only its first node is compared.

* Nodes that share a key are candidates.  In each key all nodes are first held against the least one (its hub).
  Links found so make components.
* In keys that still hold several components all nodes are held against one more, drawn by a hash of key and node.  A node has many keys
  and so meets as many different members of a large group, of which a link to any connects it.
* In keys that hold several components even then, nodes outside the hub's component are held against the key's other nodes,
  unless already connected.  So a large group of near copies costs two comparisons for each member and key, and what is left is few.
* Pairs pass a cheap test of sizes and sketches in the join's own condition before their whole sets are compared.

Keys, hubs and classes that hold many rows never meet in one task: rows of narrow tables are joined with the few hot ones
by broadcast (fewer than ``1 / HOT``), wide sets are sent to as many parts as their pairs need, and the nodes outside a hub's
component are dealt to parts of ``PART`` each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import HOT, attach_groups, forget, save, tidy
from .components import components
from .words import mix

#: Names that are broadcast at most when texts are picked; pairs of one hub, or nodes outside a hub's component, in one part.
BROADCAST_NAMES, PART = 1_000_000, 4096

#: What names a document.
NAME = ["doc_id", "tie"]

LONGS = pa.list_(pa.int64())

#: 64-bit words of a set's own parity bitmap.
FOLDED = 32

#: (size, parity sketch as a list of longs) of both sides -> whether two sets may be similar.
Test = Callable[[Column, list[Column], Column, list[Column]], Column]


def folded(own: np.ndarray) -> np.ndarray:
    """Parity of a set's elements in each of 64 * FOLDED bits."""
    odd = np.bincount((mix(own) % np.uint64(64 * FOLDED)).astype(np.int64), minlength=64 * FOLDED) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bits_apart(a: list[Column], b: list[Column]) -> Column:
    """Population count of the XOR of two bitmaps, as columns of longs."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))


def close_enough(a: Column, bits_a: list[Column], b: Column, bits_b: list[Column], t: Fraction) -> Column:
    """Whether sets of sizes a and b may have this similarity: two that do differ in at most (a + b)(1 - t)/(1 + t) elements, and their bitmaps in no more bits."""
    p, q = t.numerator, t.denominator
    return bits_apart(bits_a, bits_b) * (p + q) <= (a + b) * (q - p)


def named_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).cast("binary").alias("text"))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with one narrow row for each ``key`` in ``table``; the keys of over ``HOT`` of all rows (few) are broadcast."""
    total = rows.count()
    many = save(rows.groupBy(key).count().where(F.col("count") > max(1000, int(total * HOT))).select(key), "hot-keys")
    if many.isEmpty():
        return rows.join(table, key, "left")
    hot = F.broadcast(many)
    others = rows.join(hot, key, "left_anti").join(table, key, "left")
    return rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left").select(others.columns).unionByName(others)


def spread(rows: DataFrame, wide: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of ``rows`` with one wide row for each ``key``: a key of many rows is dealt to parts of about ``PART`` rows by ``by``, and its wide row is sent to each."""
    parts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).where("parts > 1")
    parts = save(parts, "parts")
    if parts.isEmpty():
        return rows.join(wide, key)
    dealt = lookup(rows, parts, key).withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    sent = wide.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(sent, [key, "part"]).drop("part")


class Groups:
    """Similar documents of ``docs``.

    sketches: node, doc_id, tie, n, f1, f2 (128 bits that name the set), parity (list of ``words`` longs) and whatever ``candidates`` asks for.
    candidates: (sketches of one node a class, number of rows) -> key, id (node).
    elements: a text's set as sorted distinct 64-bit hashes.
    """

    def __init__(self, docs: DataFrame, sketches: DataFrame, candidates: Callable[[DataFrame], DataFrame], test: Test, elements: Callable[[bytes | None], np.ndarray], at_least: Fraction, words: int):
        self.texts, self.elements, self.at_least, self.test, self.words = docs, elements, at_least, test, words
        sketches = save(sketches.withColumn("node", F.monotonically_increasing_id()), "sketches")
        total = sketches.count()
        whole = F.struct("n", "f1", "f2")
        filled = sketches.where("n > 0 AND doc_id IS NOT NULL")
        least = F.min(F.struct(*NAME)).alias("least")
        classes = filled.groupBy(whole.alias("set")).agg(F.min("node").alias("first"), least, F.count(F.lit(1)).alias("members")).where("members > 1")
        self.classes = save(classes, "classes")
        again = attach_groups(filled.select("node", whole.alias("set")), self.classes, "set", "members", total)
        self.again = save(again.select("node", "first"), "copies")
        one = filled.join(self.again.where("node <> first"), "node", "left_anti")
        self.shared = candidates(one)
        self.sizes = save(one.select("node", *NAME, "n", "parity"), "sizes")
        self.rows = save(sketches.select("node", *NAME, "n"), "rows")
        forget(sketches)

    def _sides(self) -> tuple[list[Column], list[Column]]:
        parity = [F.get("parity", F.lit(i)) for i in range(self.words)]
        side = lambda s: [F.col("n").alias(f"{s}_n"), *(p.alias(f"{s}_{i}") for i, p in enumerate(parity))]
        return side("x"), side("y")

    def _test(self) -> Column:
        parity = lambda s: [F.col(f"{s}_{i}") for i in range(self.words)]
        p, q = self.at_least.numerator, self.at_least.denominator
        sized = F.least("x_n", "y_n") * q >= F.greatest("x_n", "y_n") * p
        return sized & self.test(F.col("x_n"), parity("x"), F.col("y_n"), parity("y"))

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough. Many pairs may have one b."""
        p, q = self.at_least.numerator, self.at_least.denominator
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = save(self.sizes.select("node", *NAME).join(nodes, "node", "left_semi"), "wanted")
        picked, elements = F.broadcast(wanted) if wanted.count() <= BROADCAST_NAMES else wanted, self.elements

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b["node"], pa.array([elements(x.as_py()).view(np.int64) for x in b["text"]], LONGS)], ["node", "e"])

        sets = save(self.texts.join(picked, NAME).select("node", "text").mapInArrow(run, "node long, e array<long>"), "sets")
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("e").alias("ea")), "a")
        both = spread(left, sets.select(F.col("node").alias("b"), F.col("e").alias("eb")), "b", "a")
        common = F.size(F.array_intersect("ea", "eb")).cast("long")
        out = save(both.where(common * q >= (F.size("ea") + F.size("eb") - common) * p).select("a", "b").distinct(), "links")
        forget(sets, wanted, pairs)
        return out

    def _stars(self, keyed: DataFrame) -> DataFrame:
        """Links of nodes with the hub of a key of theirs (keyed: key, id, hub)."""
        xs, ys = self._sides()
        pairs = keyed.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
        left = pairs.join(self.sizes.select(F.col("node").alias("a"), *xs), "a")
        close = spread(left, self.sizes.select(F.col("node").alias("b"), *ys), "b", "a").where(self._test())
        return self._links(save(close.select("a", "b"), "pairs"))

    def _across(self, placed: DataFrame) -> DataFrame:
        """Links between nodes of different components that share a key (placed: key, id, c, hub, hub_c); one of each is outside the hub's component."""
        xs, ys = self._sides()
        outside = (F.col("c") != F.col("hub_c")).cast("int")
        mixed = save(placed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.sum(outside) / PART).cast("int").alias("parts")).where("parts > 0"), "mixed-keys")
        held = attach_groups(placed, mixed, "key", "members", placed.count()).where("id <> hub OR c <> hub_c")
        held = save(lookup(held, self.sizes.select(F.col("node").alias("id"), "n", "parity"), "id"), "mixed")
        alone = held.where("c <> hub_c").select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("x"), F.col("c").alias("xc"), *xs)
        others = held.where("id <> hub").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("y"), F.col("c").alias("yc"), (F.col("c") != F.col("hub_c")).alias("out"), *ys)
        # All conditions are the join's own, so that only pairs that may be similar become rows.
        once = ~F.col("out") | (F.col("x") < F.col("y"))
        same = (F.col("l.key") == F.col("r.key")) & (F.col("l.part") == F.col("r.part")) & (F.col("xc") != F.col("yc"))
        close = alone.alias("l").join(others.alias("r"), same & once & self._test()).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        return self._links(save(close.distinct(), "pairs"))

    def _placed(self, keyed: DataFrame, near: DataFrame) -> DataFrame:
        """The nodes of keys that hold several components: key, id, c (its component), hub, hub_c; saved."""
        of = lambda c: near.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
        placed = lookup(keyed, of("hub"), "hub").join(of("id"), "id", "left")
        placed = save(placed.select("key", "id", F.coalesce("id_c", "id").alias("c"), "hub", F.coalesce("hub_c", "hub").alias("hub_c")), "placed")
        mixed = save(placed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max(F.col("c") != F.col("hub_c")).alias("several")).where("several").select("key", "members"), "several")
        out = save(attach_groups(placed, mixed, "key", "members", placed.count()).drop("members"), "placed")
        forget(placed, mixed)
        return out

    def _drawn(self, placed: DataFrame) -> DataFrame:
        """Links of nodes with one node of each key of theirs, drawn by hash, that is of another component."""
        draw = F.xxhash64("key", "id")
        drawn = placed.groupBy("key").agg(F.min_by(F.struct("id", "c"), draw).alias("one"), F.count(F.lit(1)).alias("members"))
        drawn = save(drawn.select("key", F.col("one.id").alias("drawn"), F.col("one.c").alias("drawn_c"), "members"), "drawn")
        met = attach_groups(placed.select("key", "id", "c"), drawn, "key", "members", placed.count()).where("c <> drawn_c")
        return self._stars(met.select("key", F.greatest("id", "drawn").alias("id"), F.least("id", "drawn").alias("hub")))

    @staticmethod
    def _merged(near: DataFrame, links: DataFrame) -> DataFrame:
        """node, component of nodes with a link, saved; links (a, b) are new ones between components, so that their graph is small."""
        of = lambda c: near.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
        joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
        last = components(joined).select(F.col("node").alias("component"), F.col("component").alias("last"))
        alone = last.select(F.col("component").alias("node"), "component").join(near.select("node"), "node", "left_anti")
        return save(near.select("node", "component").unionByName(alone).join(last, "component", "left").select("node", F.coalesce("last", "component").alias("component")), "linked")

    def found(self) -> DataFrame:
        """One row for each row of the documents: doc_id, tie, n, least (the name of the least document that links lead to; null for sets without links or copies)."""
        shared = self.shared
        hubs = save(shared.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1"), "hubs")
        keyed = save(attach_groups(shared, hubs, "key", "members", shared.count()).select("key", "id", "hub"), "grouped-keys")
        forget(shared, hubs)
        near = components(self._stars(keyed))
        several = self._placed(keyed, near)
        forget(keyed)
        near = self._merged(near, self._drawn(several))
        left = self._placed(several.select("key", "id", "hub"), near)
        forget(several)
        linked = self._merged(near, self._across(left))
        forget(left)

        # The least name: of a class's rows, and of all classes of a component.
        class_of = self.classes.select(F.col("first").alias("node"), "least")
        names = self.sizes.select("node", F.struct(*NAME).alias("own"))
        in_links = linked.join(class_of, "node", "left").join(names, "node").select("node", "component", F.coalesce("least", "own").alias("least"))
        least = save(in_links.groupBy("component").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("members")), "least")
        by_link = attach_groups(linked, least, "component", "members", linked.count()).select("node", "least")
        by_copy = class_of.join(by_link.select("node"), "node", "left_anti")
        firsts = save(by_link.unionByName(by_copy), "firsts")
        copies = lookup(self.again.withColumnRenamed("node", "row").withColumnRenamed("first", "node"), firsts, "node").select(F.col("row").alias("node"), "least")
        answer = save(copies.unionByName(firsts.join(self.again.select("node"), "node", "left_anti")), "answer")
        tidy(answer.sparkSession)
        return self.rows.join(answer, "node", "left").select(*NAME, "n", "least")


def report(found: DataFrame) -> DataFrame:
    """One row for each row of the documents: doc_id, n_shingles, component_id (the least id that links lead to)."""
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def others(found: DataFrame) -> DataFrame:
    """The names (doc_id, tie) of documents that aren't the least of their group."""
    return found.where(F.struct(*NAME) > F.col("least")).select(*NAME).distinct()
