"""Spelling variants: words one edit apart, found by pivotal grams.

The grams of a word are its pairs of adjacent letters with their positions, put into one order for all words: rare
ones first. The prefix of a word holds its three rarest grams and every further occurrence of the third; its
pivots are two grams of the prefix that share no letter, chosen by dynamic programming so that the fewest words
contain them. One edit changes at most one of two disjoint grams and moves the other by at most one place. So of
two words that are one edit apart, the one whose prefix ends earlier in the order has a pivot that the prefix of
the other contains, at a place that the difference in length allows. Candidates that meet this way are verified.

Words are counted over all rows. A null or empty text has no words; of a null id the text is ``null``. Repeated
rows count each time; texts of any length are read whole. Forms of equal number: the least by code points. An
empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import source, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAST, EVERY, TIMES, GRAM = 7, 31, 10, 2
#: Words are summed up in a task until so many different ones are held.
HELD = 200_000


def damaged(doc_id, run: str, every: int = EVERY) -> str:
    """``run``, or for one in ``every`` pairs of id and run, without one of its letters."""
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % every == 0 else run


def words(docs: DataFrame, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """``word, n``: words of at least ``least`` letters and two occurrences."""
    # a shorter run cannot become a word, so longer ones are matched from their first letter on
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def count(batches):
        held: Counter = Counter()

        def emptied():
            names, numbers = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run, n in Counter(runs.findall((text or "").translate(LOWER))).items():
                    word = damaged(doc_id, run, every)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield emptied()
        yield emptied()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")


def pivots(grams: list[tuple[int, int]]) -> list[int]:
    """Places of two grams ``(number of words, place)``, by place, that share no letter and are rarest together."""
    best, chosen, free = None, None, None
    at, waiting = sorted(grams, key=lambda g: g[1]), []
    for n, place in at:
        # the rarest single gram that ends before this one
        while waiting and waiting[0][1] + GRAM <= place:
            first = waiting.pop(0)
            free = first if free is None or first < free else free
        if free is not None and (best is None or free[0] + n < best):
            best, chosen = free[0] + n, [free[1], place]
        waiting.append((n, place))
    return chosen


def ranks(held: DataFrame) -> tuple[dict[str, int], dict[int, int]]:
    """The place of every gram in the order of all, and the number of words for each place.

    There are at most as many grams as pairs of the 90 letters.
    """
    letters = F.char_length("word")
    cut = F.transform(F.sequence(F.lit(1), letters - GRAM + 1), lambda i: F.substring(F.col("word"), i, GRAM))
    counted = held.select(F.explode(cut).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    order = sorted(counted, key=lambda r: (r["n"], r["gram"]))
    return {r["gram"]: i for i, r in enumerate(order)}, {i: r["n"] for i, r in enumerate(order)}


def shaped(held: DataFrame) -> DataFrame:
    """``held(word, n)`` with its number of ``letters``, prefix (``grams`` and their ``places``), the ``last`` gram of
    the prefix and the places of its ``pivots``. Grams are their places in the order of all."""
    place_of, number_of = ranks(held)

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            last, grams, places, chosen, stops = [], [], [], [], [0]
            for word in texts:
                found = [place_of[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
                third = sorted(found)[GRAM]
                prefix = [(g, i + 1) for i, g in enumerate(found) if g <= third]
                last.append(third)
                grams += [g for g, _ in prefix]
                places += [i for _, i in prefix]
                stops.append(len(grams))
                chosen.append(pivots([(number_of[g], i) for g, i in prefix]))
            lists = [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(v, pa.int32())) for v in (grams, places)]
            sizes = pa.array([len(w) for w in texts], pa.int32())
            columns = [batch.column(0), batch.column(1), sizes, pa.array(last, pa.int32()), *lists, pa.array(chosen, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "letters", "last", "grams", "places", "pivots"])

    return held.select("word", "n").mapInArrow(
        run, "word string, n long, letters int, last int, grams array<int>, places array<int>, pivots array<int>"
    )


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def _keys() -> list[Column]:
    """Hashes that two words one edit apart have in common, for a gram that the edit leaves alone.

    The edit is on one side of the gram; on the other the letters and their number are equal. If the side of the
    edit has four letters or more in both words, their first two or their last two are equal as well.
    """
    word, at, letters = F.col("word"), F.col("at"), F.col("letters")
    ahead, behind = at - 1, letters - at - 1
    left, right = F.substring(word, F.lit(1), ahead), F.substring(word, at + GRAM, behind)
    found = []
    for name, equal, edited, size in (("before", left, right, behind), ("after", right, left, ahead)):
        place = [F.lit(name), F.col("gram"), equal, F.length(equal)]
        found += [
            F.when(size <= 4, F.xxhash64(*place)),
            F.when(size >= 4, F.xxhash64(*place, F.lit("first"), F.substring(edited, 1, 2))),
            F.when(size >= 4, F.xxhash64(*place, F.lit("last"), F.substring(edited, -2, 2))),
        ]
    return found


def near_pairs(held: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every two words of ``held(word, n)`` that are one edit apart, once."""
    known = table(shaped(held))
    flat = known.select("word", "n", "letters", "last", "pivots", F.inline(F.arrays_zip("grams", "places")))
    flat = flat.withColumnsRenamed({"grams": "gram", "places": "at"})
    keys = F.explode(F.array_compact(F.array(*_keys()))).alias("key")
    prefixes = flat.select("word", "n", "letters", "last", keys)
    asked = flat.filter(F.array_contains("pivots", F.col("at"))).select("word", "n", "letters", "last", keys)
    left, right = asked.alias("x"), prefixes.alias("y")
    met = left.join(
        right,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.last") <= F.col("y.last"))
        & (F.abs(F.col("x.letters") - F.col("y.letters")) <= 1)
        & (F.col("x.word") != F.col("y.word"))
        & one_edit(F.col("x.word"), F.col("y.word")),
    )
    ordered = F.when(F.col("x.word") < F.col("y.word"), F.struct("x.word", "x.n", "y.word", "y.n")).otherwise(
        F.struct("y.word", "y.n", "x.word", "x.n")
    )
    found = met.select(ordered.cast("struct<a:string,a_n:bigint,b:string,b_n:bigint>").alias("p")).select("p.*")
    return found.distinct()


def variants(held: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``held(word, n)``."""
    held = table(held)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )
    numbered = near_pairs(held).select(F.inline(both))
    # the least of the negated number and the word is the commonest, of equal ones the first
    best = numbered.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    )
    common = -F.col("best.n") >= times * F.col("n")
    judged = table(
        held.join(best, "word", "left").select(
            "word",
            F.when(common, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(common, -F.col("best.n")).alias("form_n"),
        )
    )
    # numbers grow along forms, so these are trees; each round doubles the steps that a root is ahead
    roots = table(judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = roots.join(ahead, "root", "left")
        if further.filter("next IS NOT NULL").isEmpty():
            break
        roots = table(further.select("word", F.coalesce("next", "root").alias("root")))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(words(source(spark, sf_dir, "documents")))
