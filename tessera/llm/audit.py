"""Filter interaction audit: what five filters remove alone, together and in every order.

Each document becomes a 32-bit word: bit s is set if the document survives
the subset s of the filters (bit i of s: filter i), that is, if it fails none
of them.  The numbers of survivors of all 32 subsets are then counts of set
bits by position.  Words are added up with carry-save adders, three words of
one weight to a word of that weight and one of the next, so a batch of words
takes a few vector operations a weight and not one a word and bit.  Every
figure of every order follows from the survivors of subsets: an order's step
goes from the subset of the filters before it to that subset and one more.

Filters (words are maximal runs of other characters than blank and
U+0009-U+000D, case-sensitive):

A  under 50 words
B  100 x distinct words < 65 x words
C  100 x characters A-Z > 5 x code points
D  holds one of # $ % & * |
E  identical to the text of a smaller doc_id, anywhere in the table

On Spark: texts are judged where they are; what is shuffled is narrow (id,
SHA-256 of the text, part, four flags), once by id to meet the labels and once
by digest, where rows alike in all but the id have been added up per task, so
a text that a third of all rows hold is a few rows a task.  A word then stands
for ``n`` documents and enters the adders at the weights of ``n``'s binary
digits.  Tasks send 32 counters per part and label; a part's counters end in
one row, from which its 600 lines are written.

Edge cases: a NULL text is empty (it fails A only, or A and E); a NULL source
is the part ''; rows repeated under one id count each, and are no smaller id
to each other; a row without an id fails E never and makes no other row fail
it; documents without a label, or with a NULL one, are neither good nor toxic;
of several labels for an id one that is 1 is enough; no documents give no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"

COUNTERS = "part string, good boolean, toxic boolean, counts array<long>"
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


# --- words and carry-save counting -------------------------------------------------------

def survival_words(fails: np.ndarray) -> np.ndarray:
    """The word of each mask of failed filters: bit s is set if no filter of subset s failed."""
    masks = np.arange(SUBSETS)
    table = np.array([sum(1 << int(s) for s in masks if not s & f) for f in masks], dtype=np.uint64)
    return table.astype(np.uint32)[fails]


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full adders at every bit position: words of the same weight, and carries of the next."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def positional_popcount(words: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """How often each of 32 bit positions is set, word i counting ``times[i]`` times."""
    levels: list[list[np.ndarray]] = [[words]]
    if times is not None:
        levels = [[words[(times >> k) & 1 == 1]] for k in range(int(times.max(initial=0)).bit_length())]
    total = np.zeros(SUBSETS, dtype=np.int64)
    positions = np.arange(SUBSETS, dtype=np.uint32)
    k = 0
    while k < len(levels):
        here = np.concatenate(levels[k]) if levels[k] else np.zeros(0, np.uint32)
        carries = []
        while len(here) >= 3:
            n = len(here) // 3
            kept, carry = carry_save(here[:n], here[n:2 * n], here[2 * n:3 * n])
            carries.append(carry)
            here = np.concatenate([kept, here[3 * n:]])
        for word in here:                        # two words at most are left of a weight
            total += ((word >> positions) & 1).astype(np.int64) << k
        if carries:
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1] += carries
        k += 1
    return total


# --- flags of a document -----------------------------------------------------------------

def text_fails(text: Column) -> Column:
    """Mask of the failed filters among A to D (bit 0 is A); the words are split once."""
    found = F.regexp_extract_all(text, F.lit(WORD), 0)
    sizes = F.transform(F.array(found), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    # judged inside one lambda, so that the split is not repeated for each filter
    few_or_same = F.transform(F.array(sizes), lambda z: F.when(z["n"] < 50, 1).otherwise(0)
                              + F.when(z["d"].cast("long") * 100 < z["n"].cast("long") * 65, 2).otherwise(0))[0]
    return (few_or_same
            + F.when(upper.cast("long") * 100 > F.length(text).cast("long") * 5, 4).otherwise(0)
            + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, fails (mask of the five) and n: how many documents are alike in all of these and in text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
                              F.unhex(F.sha2(text, 256)).alias("digest"),
                              text_fails(text).cast("int").alias("fails"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
                          F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    marks = marks.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = narrow.where(F.col("id").isNotNull()).join(marks, "id", "left")
    nameless = narrow.where(F.col("id").isNull()).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    alike = ["digest", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "fails"]
    # rows of one id lie together already; most groups are single rows
    rows = known.groupBy("id", *alike).agg(F.count(F.lit(1)).alias("n")).unionByName(
        nameless.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.lit(None).cast("long")))
    # n rows, ``named`` of them with an id, and how many of those have the smallest
    groups = rows.groupBy("digest", "part", "good", "toxic", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n"))).alias("named"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    each = groups.withColumn("least", F.min("first.id").over(Window.partitionBy("digest")))
    # of the rows with an id all but those of the smallest id fail E
    spared = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    caught = F.coalesce(F.col("named"), F.lit(0)) - F.coalesce(spared, F.lit(0))
    kinds = F.array(F.struct(F.col("fails").alias("fails"), (F.col("n") - caught).alias("n")),
                    F.struct((F.col("fails") + 16).alias("fails"), caught.alias("n")))
    return each.select("part", "good", "toxic", F.explode(kinds).alias("k")).select(
        "part", "good", "toxic", "k.fails", "k.n").where("n > 0")


# --- survivors and orders ------------------------------------------------------------------

def subset_survivors(rows: DataFrame) -> DataFrame:
    """part, good, toxic, counts: survivors of each of the 32 subsets; rows as ``judged`` makes them."""
    def batch_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (part, good, toxic), g in pdf.groupby(["part", "good", "toxic"], sort=False):
                words = survival_words(g["fails"].to_numpy())
                out.append((part, good, toxic, positional_popcount(words, g["n"].to_numpy()).tolist()))
            yield pd.DataFrame(out, columns=["part", "good", "toxic", "counts"])

    found = rows.mapInPandas(batch_counts, COUNTERS)
    sums = [F.sum(F.col("counts")[s]).alias(f"s{s}") for s in range(SUBSETS)]
    return found.groupBy("part", "good", "toxic").agg(*sums).select(
        "part", "good", "toxic", F.array(*[F.col(f"s{s}") for s in range(SUBSETS)]).alias("counts"))


def order_figures(part: str, everything: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """All lines of a part, from its survivors of the 32 subsets: all, good ones and toxic ones."""
    n, full = len(FILTERS), SUBSETS - 1
    ways = [1, 1, 2, 6, 24]                       # orders of so many filters
    shapley = [sum(ways[bin(s).count("1")] * ways[n - 1 - bin(s).count("1")] * int(everything[s] - everything[s | 1 << i])
                   for s in range(SUBSETS) if not s >> i & 1) for i in range(n)]
    out = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = int(everything[before] - everything[after])
            out.append((part, "".join(FILTERS[j] for j in order), step, int(everything[after]), removed,
                        int(everything[0] - everything[1 << i]) - removed,
                        int(everything[full & ~(1 << i)] - everything[full]),
                        int(good[before] - good[after]), int(toxic[before] - toxic[after]), shapley[i]))
            before = after
    return out


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One line per part, order of the filters and step (see the module's text)."""
    survivors = subset_survivors(judged(documents, labels))
    pick = {"everything": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.sum(F.when(cond, F.col("counts")[s]).otherwise(0)).alias(f"{k}{s}")
            for k, cond in pick.items() for s in range(SUBSETS)]
    parts = survivors.groupBy("part").agg(*sums).select(
        "part", *[F.array(*[F.col(f"{k}{s}") for s in range(SUBSETS)]).alias(k) for k in pick])

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in REPORT.split(", ")]
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame(order_figures(row.part, row.everything, row.good, row.toxic), columns=names)

    return written(parts, "survivors").mapInPandas(lines, REPORT)
