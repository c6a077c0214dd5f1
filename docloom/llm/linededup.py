"""Removal of repeated line runs by a suffix array (operator 8), with DataFrame functions only.

A document's lines are its non-blank lines in order.  A line is removed if a run of at least
``min_lines`` consecutive lines over it also starts earlier: in a document with a smaller id, or earlier in
the same one.

The suffixes of all line sequences are ranked by their first line, then by two, four and
so on: the pair of ranks at a place and behind it is ranked anew, in a range-sorted
table of the distinct pairs.  A suffix whose prefix occurs once is unique from there on and leaves the
array, which holds repeated suffixes only; doubling ends when none is left.  Suffixes that agree in their
first ``min_lines`` lines (two ranks that may overlap) are one interval of longest common prefix
``min_lines`` or more.  Each is held against the interval's first place: going down the levels of ranks, their
longest common prefix grows by every power of two whose ranks agree.  That is the maximal repeated run, and
the lines of all later runs go.

Documents whose lines all equal those of an earlier one lose every line at once and don't
enter the array.  Ranks of frequent prefixes are broadcast (there are few), so that no
line meets in one task.

A document is named by its id and a hash of its text, so rows that share an id, or have none, are documents of their own.

Results for odd input: a null text has no lines; lines that hold only white space are
neither counted nor removed; documents of fewer than ``min_lines`` lines lose none; repeated
rows (same id and text) are kept alike; documents with null ids come before all others, and those of one id (or of none) are in
order of their texts' hashes; an empty table
gives no row; other columns are left out or, in :func:`without_repeats`, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import attach_groups, forget, fresh, partitions, save

#: Rows that are broadcast at most.
BROADCAST_ROWS = 1_000_000

FIRST_ID = -(1 << 63)

#: What names a document, and a place in it.
NAME = ["doc_id", "tie"]
PLACE = [*NAME, "at"]


def lines_of(text: str) -> Column:
    """The non-blank lines of a text column."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: ~x.rlike(r"^[\x20\x09-\x0D]*$"))


def _name(doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST_ID)).alias("doc_id"), F.xxhash64(text).alias("tie")]


def _ranked(suffixes: DataFrame, total: int) -> DataFrame:
    """Suffixes (doc_id, tie, at, key) whose key occurs twice or more, with the key's rank in sorted order."""
    found = suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    found = found.repartitionByRange(partitions(suffixes.sparkSession), "key").sortWithinPartitions("key").withColumn("rank", F.monotonically_increasing_id())
    found = save(found, "ranks")  # ids that rise along a range-sorted table
    out = save(attach_groups(suffixes, found, "key", "members", total).select(*PLACE, "rank"), "suffixes")
    forget(found)
    return out


def _ahead(ranks: DataFrame, step: int) -> DataFrame:
    return ranks.select(*NAME, (F.col("at") - step).alias("at"), F.col("rank").alias("behind"))


def levels(own: DataFrame, total: int) -> list[DataFrame]:
    """For 1, 2, 4, ... lines, the places (doc_id, tie, at) whose prefix of that length is repeated, with its rank. own: doc_id, tie, ids."""
    out = [_ranked(own.select(*NAME, F.posexplode("ids").alias("at", "key")), total)]
    while True:
        last = out[-1]
        pairs = last.join(_ahead(last, 1 << (len(out) - 1)), PLACE).select(*PLACE, F.struct("rank", "behind").alias("key"))
        longer = _ranked(pairs, total)
        if longer.isEmpty():
            return out
        out.append(longer)


def later_places(ranks: list[DataFrame], min_lines: int, total: int) -> DataFrame:
    """Places where ``min_lines`` lines begin that also begin at an earlier place, with the first such place (first)."""
    level = min_lines.bit_length() - 1
    base = ranks[level] if level < len(ranks) else ranks[-1].where(F.lit(False))
    over = min_lines - (1 << level)
    keyed = base.select(*PLACE, F.struct("rank").alias("key")) if not over else base.join(_ahead(base, over), PLACE).select(*PLACE, F.struct("rank", "behind").alias("key"))
    first = save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(*PLACE)).alias("first")).where("members > 1"), "intervals")
    out = save(attach_groups(keyed, first, "key", "members", total).where(F.struct(*PLACE) > F.col("first")).select(*PLACE, "first"), "later")
    forget(first)
    return out


def maximal(later: DataFrame, ranks: list[DataFrame]) -> DataFrame:
    """The longest common prefix (n_lines) of each place with its first one, but for those that only continue the run of the place before."""
    before = later.select(*NAME, (F.col("at") + 1).alias("at"), F.struct("first.doc_id", "first.tie", (F.col("first.at") + 1).alias("at")).alias("first"))
    runs = save(later.join(before, [*PLACE, "first"], "left_anti").select(*PLACE, "first", F.lit(0).alias("n_lines")), "runs")
    total = runs.count()
    for level in reversed(range(len(ranks))):
        ends = runs.select("*", (F.col("at") + F.col("n_lines")).alias("end"), F.struct("first.doc_id", "first.tie", (F.col("first.at") + F.col("n_lines")).alias("at")).alias("first_end"))
        many = ends.groupBy("first_end").agg(F.count(F.lit(1)).alias("members")).select("members", "first_end", "first_end.*")
        many = save(many.join(ranks[level], PLACE).select("first_end", "members", F.col("rank").alias("first_rank")), "first-ends")
        here = ends.join(ranks[level].select(*NAME, F.col("at").alias("end"), "rank"), [*NAME, "end"])
        agree = attach_groups(here, many, "first_end", "members", total).where("rank = first_rank").select(*PLACE, F.lit(1 << level).alias("more"))
        longer = save(runs.join(agree, PLACE, "left").select(*PLACE, "first", (F.col("n_lines") + F.coalesce("more", F.lit(0))).alias("n_lines")), "runs")
        forget(runs, many)
        runs = longer
    return runs


def _repeats(docs: DataFrame, min_lines: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Maximal later runs (doc_id, tie, at, first, n_lines), and the names of documents that are copies as a whole."""
    hashed = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    rows = save(docs.select(*_name(doc_id, text), F.transform(lines_of(text), hashed).alias("ids")), "line-ids").where(F.size("ids") >= min_lines)
    total, n_lines = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    rows = rows.withColumn("all", F.struct(F.size("ids").alias("n"), F.xxhash64("ids").alias("h1"), F.xxhash64(F.lit(1), "ids").alias("h2")))
    name = F.struct(*NAME)
    classes = save(rows.groupBy("all").agg(F.min(name).alias("class"), F.count(F.lit(1)).alias("members")).where("members > 1"), "classes")
    alike = attach_groups(rows.select(*NAME, "all"), classes, "all", "members", total)
    copies = save(alike.where(name > F.col("class")).select(*NAME).distinct(), "copies")
    # A row that repeats the first of its class in id and text, too, is the same document: it goes into the array once.
    once = rows.join(_small(copies, copies.count()), NAME, "left_anti")
    twice = save(alike.where(name == F.col("class")).groupBy(*NAME).count().where("count > 1").select(*NAME), "repeated-rows")
    if not twice.isEmpty():
        again = once.join(_small(twice, twice.count()), NAME, "left_semi").dropDuplicates(NAME)
        once = once.join(_small(twice, twice.count()), NAME, "left_anti").unionByName(again)
    ranks = levels(once.select(*NAME, "ids"), n_lines)
    later = later_places(ranks, min_lines, n_lines)
    runs = maximal(later, ranks)
    forget(later, *ranks)
    return runs, copies


def runs(docs: DataFrame, min_lines: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal later copies of line runs: doc_id, at, n_lines, and where the same lines begin first (first_doc_id, first_at); without documents that are copies as a whole. A null id is the least long."""
    return _repeats(docs, min_lines, doc_id, text)[0].select("doc_id", "at", "n_lines", F.col("first.doc_id").alias("first_doc_id"), F.col("first.at").alias("first_at"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _removals(docs: DataFrame, min_lines: int, doc_id: str, text: str) -> DataFrame:
    """For documents that lose lines: doc_id, tie, gone (the places of lines to remove) and whole (whether all go)."""
    found, copies = _repeats(docs, min_lines, doc_id, text)
    places = F.sequence("at", (F.col("at") + F.col("n_lines") - 1).cast("int"))
    gone = found.select(*NAME, F.explode(places).alias("at")).groupBy(*NAME).agg(F.collect_set("at").alias("gone"))
    whole = copies.select(*NAME, F.array().cast("array<int>").alias("gone"), F.lit(True).alias("whole"))
    return save(gone.withColumn("whole", F.lit(False)).unionByName(whole), "removals")


def _with_removals(named: DataFrame, found: DataFrame) -> DataFrame:
    rows = found.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    return named.join(_small(found, rows), NAME, "left")


def _kept(lines: str) -> Column:
    """The lines that stay."""
    places = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    stay = F.transform(F.array_except(places, F.col("gone")), lambda i: F.get(F.col(lines), i))
    return F.when(F.col("whole"), F.array().cast("array<string>")).when(F.col("gone").isNotNull(), stay).otherwise(F.col(lines))


def report(docs: DataFrame, min_lines: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by a line feed)."""
    named = docs.select(F.col(doc_id).alias("id"), *_name(doc_id, text), lines_of(text).alias("lines"))
    kept = _with_removals(named, _removals(docs, min_lines, doc_id, text)).withColumn("kept", _kept("lines"))
    return kept.select(F.col("id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, min_lines: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated line runs (and blank lines) cut out of the texts that have any; other texts and columns stay as they are."""
    row = fresh(docs, "row")
    named = docs.select(F.struct("*").alias(row), *_name(doc_id, text), lines_of(text).alias("lines"))
    marked = _with_removals(named, _removals(docs, min_lines, doc_id, text))
    cut = F.when(F.col("whole").isNull(), F.col(row)[text]).otherwise(F.array_join(_kept("lines"), "\n"))
    return marked.select(*(cut.alias(c) if c == text else F.col(row)[c].alias(c) for c in docs.columns))
