"""Order-dependent computations that stay distributed on hot keys.

A plain window over one key sends the whole key to one task. Here the ordering
value is cut into buckets first; each bucket is summarised, the few summaries of a
key are ordered, and rows only ever meet the rows of their own bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(df: DataFrame, keys: list[str], order: str, weight: str, bucket: Column,
                  out: str = "running", descending: bool = False) -> DataFrame:
    """Inclusive running total of ``weight`` by ``order`` within ``keys``.

    ``bucket`` is a monotone integer function of ``order``. Rows of equal order
    value are summed up before, so each output row is one (keys, order) value.
    """
    def way(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    base = (df.groupBy(*keys, order).agg(F.sum(weight).alias("_w"))
            .withColumn("_b", bucket))
    sums = base.groupBy(*keys, "_b").agg(F.sum("_w").alias("_bw"))
    wb = Window.partitionBy(*keys).orderBy(way("_b"))
    before = sums.select(
        *keys, "_b",
        (F.sum("_bw").over(wb.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bw"))
        .alias("_before"))
    wi = (Window.partitionBy(*keys, "_b").orderBy(way(order))
          .rowsBetween(Window.unboundedPreceding, 0))
    return (base.withColumn("_in", F.sum("_w").over(wi))
            .join(before, [*keys, "_b"])
            .select(*keys, order, F.col("_w").alias(weight),
                    (F.col("_before") + F.col("_in")).alias(out)))


def n50(df: DataFrame, length: str, keys: list[str] | None = None,
        out: str = "n50") -> DataFrame:
    """Longest-first cumulative half of all bases, per key.

    Lengths are counted per distinct value first; the running total runs over
    buckets of 1024 bp.
    """
    keys = keys or []
    work = df.where(F.col(length).isNotNull())
    if not keys:
        work = work.withColumn("_all", F.lit(1))
    ks = keys or ["_all"]
    work = work.withColumn("_bp", F.col(length).cast("long"))
    run = running_total(work, ks, length, "_bp", F.floor(F.col(length) / 1024), "_cum",
                        descending=True)
    total = work.groupBy(*ks).agg(F.sum("_bp").alias("_tot"))
    res = (run.join(total, ks).where(F.col("_cum") * 2 >= F.col("_tot"))
           .groupBy(*ks).agg(F.max(length).alias(out)))
    return res.select(*keys, out)


def delta_groups(df: DataFrame, keys: list[str], value: str, delta: int,
                 bucket_width: int) -> DataFrame:
    """Number the runs of values whose neighbours are at most ``delta`` apart."""
    b = F.floor(F.col(value) / bucket_width)
    base = df.withColumn("_b", b)
    wi = Window.partitionBy(*keys, "_b").orderBy(value)
    base = base.withColumn("_prev", F.lag(value).over(wi))
    # one summary per bucket: its ends; the previous bucket's last value closes the gap
    ends = base.groupBy(*keys, "_b").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.sum((F.col(value) - F.col("_prev") > delta).cast("long")).alias("_inner"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    ends = ends.withColumn(
        "_brk", (F.lag("_hi").over(wb).isNotNull()
                 & (F.col("_lo") - F.lag("_hi").over(wb) > delta)).cast("long"))
    ends = ends.withColumn("_inner", F.coalesce("_inner", F.lit(0)))
    ends = ends.withColumn(
        "_base", F.sum(F.col("_brk") + F.col("_inner")).over(
            wb.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inner"))
    running = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0)
    inb = F.sum(F.coalesce((F.col(value) - F.col("_prev") > delta).cast("long"),
                           F.lit(0))).over(running)
    return (base.withColumn("_run", inb)
            .join(ends.select(*keys, "_b", "_base"), [*keys, "_b"])
            .withColumn("grp", F.col("_base") + F.col("_run"))
            .drop("_b", "_prev", "_run", "_base"))


def interval_groups(df: DataFrame, keys: list[str], start: str, end: str, bucket_width: int,
                    ) -> DataFrame:
    """Number the groups of overlapping intervals (ends inclusive) of each key.

    An interval opens a group when it starts behind every earlier end. The farthest
    earlier end is a running maximum, carried from bucket to bucket.
    """
    base = df.withColumn("_b", F.floor(F.col(start) / bucket_width))
    wi = Window.partitionBy(*keys, "_b").orderBy(start, end)
    past = wi.rowsBetween(Window.unboundedPreceding, -1)
    tops = base.groupBy(*keys, "_b").agg(F.max(end).alias("_top"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    tops = tops.withColumn("_far", F.max("_top").over(
        wb.rowsBetween(Window.unboundedPreceding, -1)))
    base = base.join(tops.select(*keys, "_b", "_far"), [*keys, "_b"])
    far = F.greatest(F.max(end).over(past), F.col("_far"))
    base = base.withColumn("_new", F.coalesce((F.col(start) > far).cast("long"), F.lit(0)))
    count = base.groupBy(*keys, "_b").agg(F.sum("_new").alias("_n"))
    count = count.withColumn("_base", F.sum("_n").over(
        wb.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    inner = F.sum("_new").over(wi.rowsBetween(Window.unboundedPreceding, 0))
    return (base.withColumn("_run", inner)
            .join(count.select(*keys, "_b", "_base"), [*keys, "_b"])
            .withColumn("grp", F.col("_base") + F.col("_run"))
            .drop("_b", "_far", "_new", "_run", "_base"))
