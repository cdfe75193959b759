"""Filter interaction audit: what every order of five filters keeps, removes and loses, by a subset-zeta transform.

Each document becomes a mask, one bit for each filter it fails. A part's rows are
counted by mask, 32 numbers; the zeta transform (one pass a bit) turns them into the
rows whose mask lies inside a set, for all sets. A set of applied filters leaves the
rows whose mask lies inside its complement, so every step of every order is the
difference of two neighbouring sets; the same holds for rows with a label.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import SPACE_CLASS

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)


def text_faults(text: Column) -> Column:
    """The bits of A to D for a text that isn't null: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 3 * F.char_length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): row counts; E, the fifth bit, marks texts that a smaller doc_id has too.

    Texts are known by their SHA-256, so only narrow rows move. Rows of one text meet
    in two steps, first by id, so that thousands of copies are sums by the time they
    share a key; which rows hold the text's least id is settled by a join of those
    sums, and no text's rows are gathered.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_faults(text).alias("faults"))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = own.groupBy("digest", "faults", "part", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(marked, "doc_id", "left").fillna(0, ["good", "toxic"])
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.join(least, "digest").groupBy(
        "part", (F.col("faults") + F.when(later, 16).otherwise(0)).alias("mask"), "good", "toxic").agg(F.sum("n").alias("n"))


def zeta(parts: DataFrame, names: list[str]) -> DataFrame:
    """The arrays over all sets with, for every set, the sum over its subsets: one column step for each bit, as it reads the one before twice."""
    def step(counts: Column, bit: int) -> Column:
        return F.transform(counts, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) != 0, x + F.get(counts, i.bitwiseXOR(F.lit(bit)))).otherwise(x))

    for k in range(len(FILTERS)):
        parts = parts.withColumns({name: step(F.col(name), 1 << k) for name in names})
    return parts


def survivors(counted: DataFrame) -> DataFrame:
    """(part, only, left, good, toxic): counts by mask, and by the set of applied filters what is left, all of it and of either label."""
    at = lambda what: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, what)), F.lit(0)).cast("long") for m in range(SETS)])
    by_part = counted.groupBy("part").agg(
        at(F.col("n")).alias("only"), at(F.col("n")).alias("left"), at(F.col("n") * F.col("good")).alias("good"), at(F.col("n") * F.col("toxic")).alias("toxic"))
    sums = ["left", "good", "toxic"]
    return zeta(by_part, sums).withColumns({name: F.reverse(name) for name in sums})  # complements count backwards


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (a ``lang``), order of the five filters and step, with counts of documents.

    kept: left after the step; removed: by it; redundant: failing its filter but removed
    before; unique_fails: failing no other filter; good_lost, toxic_lost: removed here
    and labelled so; shapley: the filter's removals summed over all orders.

    Null texts count as empty, and empty texts are texts like any other: identical
    ones fail E. A null doc_id is no smaller than any and none is smaller than it, so
    such rows never fail E. Rows with one doc_id and text are as many documents. A
    null lang is the part of the empty string. A label counts if any of an id's label
    rows has it; ids without labels have none. Extra columns are ignored; an empty
    table has no parts and so no rows.
    """
    parts = survivors(masks(docs, labels))
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = sum((F.when(F.instr("filter_order", f) < F.col("step"), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    own = sum((F.when(letter == f, 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"_before": before, "_own": own, "_letter": letter})
    lost = lambda name: F.get(name, F.col("_before")) - F.get(name, F.col("_before") + F.col("_own"))
    n = len(FILTERS)

    def over_orders(bit: int) -> Column:
        """A filter's removals over all orders: each set before it comes up in |set|! (n - 1 - |set|)! of them."""
        sets = [s for s in range(SETS) if not s & bit]
        return sum(((F.get("left", F.lit(s)) - F.get("left", F.lit(s | bit))) * (factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in sets), F.lit(0))

    shapley = F.coalesce(*[F.when(F.col("_letter") == f, over_orders(1 << k)) for k, f in enumerate(FILTERS)])
    failing = F.get("left", F.lit(0)) - F.get("left", F.col("_own"))
    return rows.select(
        "part", "filter_order", "step", F.get("left", F.col("_before") + F.col("_own")).alias("kept"), lost("left").alias("removed"),
        (failing - lost("left")).alias("redundant"), F.get("only", F.col("_own")).alias("unique_fails"), lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"), shapley.cast("long").alias("shapley"))
