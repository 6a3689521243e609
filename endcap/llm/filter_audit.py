"""What each filter removes in each order of all filters, from failure masks and ranks.

A document's failed filters are a mask, so its fate in an order depends on the mask alone: the
first letter in the mask removes it. Orders are numbered as they sort (their Lehmer rank);
those which begin with letters outside the mask and then one inside are one interval
of ranks. Counts per mask are added at the first rank of each interval and taken away behind
its last; the running sum over the ranks is what each order removes at each step.

Everything about a document is a built-in function on its row. Whether a smaller doc_id
has the same text is asked by a join on text and doc_id together (only a group's least
doc_id is in the other table), so copies never meet in one task.

Defined cases: null text counts as empty and null source is the empty string; a row without
``doc_id`` has no labels, is no copy of another row and makes none; repeated doc_ids are rows
of their own and no copies of each other; a doc_id labelled more than once has a label
if one of its rows has it; extra columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endcap.functions.durable import durable

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def failures(docs: DataFrame, min_words: int = 50, distinct_percent: int = 65,
             capital_percent: int = 5, letters: str = r"[#$%&*|]") -> DataFrame:
    """doc_id, part, text_hash and the failure of each filter but the last: a, b, c, d."""
    text = F.coalesce("text", F.lit(""))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    sizes = F.transform(F.array(words), lambda w: F.struct(     # words are split once
        F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("kinds")))
    capitals = (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long")
    w = F.col("w")[0]
    return (kept.withColumn("w", sizes).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_hash"),
        (w["all"] < min_words).alias("a"), (w["kinds"] * 100 < w["all"] * distinct_percent).alias("b"),
        (capitals * 100 > F.length("text") * capital_percent).alias("c"),
        F.col("text").rlike(letters).alias("d")))


def masks(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Per part and mask (bit k: the k-th filter fails): documents, good and toxic ones."""
    rows = durable(failures(docs, **limits))
    least = rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).where(
        F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    marks = (labels.where(F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    e = F.col("doc_id").isNotNull() & F.col("first").isNull()
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(
        [F.col("a"), F.col("b"), F.col("c"), F.col("d"), e])]
    mask = sum(bits[1:], bits[0])
    counted = (rows.join(least, ["text_hash", "doc_id"], "left")
               .groupBy("doc_id", "part", mask.alias("mask")).agg(F.count("*").alias("n")))
    return (counted.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")))


def intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last) of all orders in which a mask falls at a step.

    A prefix of s letters is followed by the orders of the rest: (filters - s)! ranks in a row.
    """
    out = []
    for mask in range(1, 1 << filters):
        for step in range(1, filters + 1):
            for prefix in permutations(range(filters), step):
                if mask >> prefix[-1] & 1 and not any(mask >> f & 1 for f in prefix[:-1]):
                    rank = sum(sum(g < f for g in set(range(filters)) - set(prefix[:k]))
                               * factorial(filters - 1 - k) for k, f in enumerate(prefix))
                    out.append((mask, step, rank, rank + factorial(filters - step)))
    return out


def audit(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """One row per part, order of the filters and step; see the counts' names below."""
    spark, size = docs.sparkSession, len(FILTERS)
    counts = masks(docs, labels, **limits)
    edges = []
    for mask, step, lo, hi in intervals(size):
        edges += [(mask, step, lo, 1), (mask, step, hi, -1)]
    edge = F.broadcast(spark.createDataFrame(edges, "mask int, step int, rank int, sign int"))
    changes = (counts.join(edge, "mask").groupBy("part", "step", "rank")
               .agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS]))

    def with_bit(name: str, of: Column) -> list[Column]:
        return [F.sum(F.when(of(k), F.col("n")).otherwise(0)).alias(f"{name}{k}")
                for k in range(size)]

    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        *with_bit("fails", lambda k: F.col("mask").bitwiseAND(1 << k) != 0),
        *with_bit("only", lambda k: F.col("mask") == 1 << k))
    orders = ["".join(p) for p in permutations(FILTERS)]
    grid = F.broadcast(spark.createDataFrame(
        [(r, o, s + 1, FILTERS.index(o[s])) for r, o in enumerate(orders) for s in range(size)],
        "rank int, filter_order string, step int, f int"))

    def of_filter(name: str) -> Column:
        return F.element_at(F.array(*[F.col(f"{name}{k}") for k in range(size)]), F.col("f") + 1)

    one = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("part", "f")
    rows = (totals.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
            .join(grid, ["rank", "step"])).select(
        "part", "rank", "step", "filter_order", "f", "total",
        of_filter("fails").alias("fails"), of_filter("only").alias("unique_fails"))
    rows = rows.join(changes, ["part", "step", "rank"], "left")
    for c in COUNTS:
        rows = rows.withColumn(c, F.sum(F.coalesce(c, F.lit(0))).over(one))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(order)).alias("kept"),
        F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(whole).alias("shapley"))
