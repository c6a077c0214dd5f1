"""Spelling variants of frequent words by pivotal grams (operator 13).

Words are near if one inserted, deleted or replaced code point makes them equal.  A word's grams are its pairs of
neighbouring letters with their positions, ordered by how many words hold them, rarest first.

* The *prefix* of a word is its three first grams in that order: one edit touches two neighbouring grams at most, so three
  hold two that don't overlap.  To be looked up, a prefix holds the places of equal grams, too, ``PLACES`` of each at most.
* Its *pivots* are two of the first three grams that don't overlap and that the fewest words hold together, found by
  dynamic programming over them in order of position.

One edit leaves one of the two pivots whole.  Of two near words, take the one whose prefix ends first (or either): the
pivot of it that is left whole comes before the end of the other's prefix, so the other holds it there.  It moved by one
place at most, and only in the direction in which the lengths differ; at most two equal grams come before it in its own word, and
one edit makes two more at most.  So pivots, with length and position, are an index
that the prefixes of all words are joined against by equality; the edit distance is a condition of that join, so that
only near words become rows.

Each task counts the words of its texts before they are shuffled.  A word's form is its most frequent near word, if that is
``times`` times as frequent or more; roots are found by joining forms with forms until none leads further, which doubles
the steps each time, and forms rise in frequency, so that there are few steps.

Results for odd input: a null text has no words; null or equal ids and repeated rows count each by themselves; words shorter
than ``least_length`` or rarer than ``least_count`` are no words; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import forget, save

#: Letters of words: ASCII and the Latin-1 range from À to ÿ.
LETTERS = "A-Za-zÀ-ÿ"

#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000

#: Places of one gram in a prefix: an edit leaves a pivot among the first five of its gram.
PLACES = 5

#: Steps of one edit that a gram can take: difference of lengths (index less prefix) to differences of positions.
MOVES = {0: (0,), 1: (0, 1), -1: (0, -1)}


def words(docs: DataFrame, least_length: int = 6, least_count: int = 5, change: Callable[[int | None], Callable[[str], str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, of at least so many code points, that occur so often in all documents.

    ``change(doc_id)`` may give a function that each word of that document goes through first (such as a simulated slip of the pen).
    """

    if least_length < 4:
        raise ValueError("pivots need words of at least four code points")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = re.compile(f"[{LETTERS}]+"), Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for name, raw in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                own = Counter(pattern.findall((raw.as_py() or b"").lower().decode()))
                changed = change(name) if change else None
                for word, n in own.items():
                    if changed:
                        word = changed(word)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield passed()
        yield passed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def pivots(prefix: list[tuple[int, int]], weight: Callable[[int], int]) -> list[tuple[int, int]]:
    """Of a prefix's grams (gram, position), the two that don't overlap with the least weight together."""
    by_place = sorted(prefix, key=lambda g: g[1])
    # one[i] and two[i]: the least weight of one gram, and of two apart from each other, among the first i, and which they are.
    one: list[tuple[int, list]] = [(1 << 62, [])]
    two: list[tuple[int, list]] = [(1 << 62, [])]
    for i, (gram, at) in enumerate(by_place):
        apart = i
        while apart and by_place[apart - 1][1] > at - 2:
            apart -= 1
        w = weight(gram)
        two.append(min(two[i], (one[apart][0] + w, [*one[apart][1], (gram, at)]), key=lambda x: x[0]))
        one.append(min(one[i], (w, [(gram, at)]), key=lambda x: x[0]))
    return two[-1][1]


def prefix(word: str, place: dict[str, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The first three grams of a word (place in the order of rarity, position), and those with further places of the same grams."""
    grams = sorted((place[word[i : i + 2]], i) for i in range(len(word) - 1))
    first, seen = grams[:3], Counter()
    wider = []
    for gram, at in grams:
        if gram > first[-1][0]:
            break
        seen[gram] += 1
        if seen[gram] <= PLACES:
            wider.append((gram, at))
    return first, wider


_GRAMS = pa.list_(pa.struct([("gram", pa.int32()), ("at", pa.int32())]))
_GRAMS_SQL = "array<struct<gram: int, at: int>>"


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` for a join in which both sides are shuffled. Spark sizes a table by its compressed file, and as if an exploded list had one item, so that it
    would broadcast many times what the driver holds."""
    return rows.hint("merge")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Pairs (word, n, near, near_n) of words of at least four code points in ``vocabulary`` (word, n; one row a word) that one edit makes equal, in both directions."""
    gram = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2))))).alias("gram")
    # One row for each pair of letters: at most the square of the alphabet's size.
    held = sorted((r["count"], r.gram) for r in vocabulary.select(gram).groupBy("gram").count().collect())
    place, weights = {g: i for i, (_, g) in enumerate(held)}, [n for n, _ in held]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = [prefix(w, place) for w in b["word"].to_pylist()]
            as_rows = lambda grams: [{"gram": g, "at": at} for g, at in grams]
            chosen = [as_rows(pivots(first, weights.__getitem__)) for first, _ in starts]
            arrays = [b["word"], b["n"], pa.array([first[-1][0] for first, _ in starts], pa.int32()), pa.array(chosen, _GRAMS), pa.array([as_rows(wider) for _, wider in starts], _GRAMS)]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "n", "last", "pivots", "prefix"])

    signed = save(vocabulary.select("word", "n").mapInArrow(sign, f"word string, n long, last int, pivots {_GRAMS_SQL}, prefix {_GRAMS_SQL}"), "grams")
    index = signed.select(F.col("word").alias("s"), F.col("n").alias("sn"), F.col("last").alias("s_last"), F.length("word").alias("size"), F.explode("pivots").alias("g")).select("s", "sn", "s_last", "size", "g.gram", "g.at")
    moves = F.explode(F.array(*(F.struct(F.lit(size).alias("size"), F.lit(at).alias("at")) for size, places in MOVES.items() for at in places))).alias("move")
    probe = signed.select(F.col("word").alias("r"), F.col("n").alias("rn"), F.col("last").alias("r_last"), F.explode("prefix").alias("g")).select("*", moves)
    probe = probe.select("r", "rn", "r_last", (F.length("r") + F.col("move.size")).alias("size"), "g.gram", (F.col("g.at") + F.col("move.at")).alias("at"))
    keys = ["gram", "size", "at"]
    same_key = [F.col(f"i.{k}") == F.col(f"p.{k}") for k in keys]
    found = index.alias("i").join(shuffled(probe).alias("p"), [*same_key, F.col("s_last") <= F.col("r_last"), F.col("s") != F.col("r"), F.levenshtein("s", "r", 1) == 1])
    pairs = found.select("s", "sn", "r", "rn").distinct()
    both = pairs.select(F.col("s").alias("word"), F.col("sn").alias("n"), F.col("r").alias("near"), F.col("rn").alias("near_n"))
    return both.unionByName(both.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))).distinct()


def variants(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """One row for each word of ``vocabulary`` (word, n): word, n, n_near, form (its most frequent near word, ties: the first in code-point order, if at least ``times`` as frequent), form_n, root (the last form that forms lead to)."""
    vocabulary = save(vocabulary.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    near = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    held = vocabulary.join(shuffled(near), "word", "left")
    enough = -F.col("best.minus") >= times * F.col("n")
    forms = save(held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    forget(vocabulary)
    roots = save(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        if roots.join(shuffled(onward), "root", "left_semi").isEmpty():
            break
        further = save(roots.join(shuffled(onward), "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
        forget(roots)
        roots = further
    return forms.join(shuffled(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
