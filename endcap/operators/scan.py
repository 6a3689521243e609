"""Scans over raw reads: counters, telomere filter, dedupe, downsampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endcap.config import GENOME_BP, Settings
from endcap.functions.seq import count_of
from endcap.motifs import MotifTable


def with_canonical_counts(reads: DataFrame, motifs: MotifTable) -> DataFrame:
    """Count the tandem canonical motif on both strands."""
    return (reads.withColumn("n_fwd", count_of(F.col("seq"), motifs.canonical[0] * 2))
            .withColumn("n_rev", count_of(F.col("seq"), motifs.canonical_rc[0] * 2)))


def usable(reads: DataFrame) -> DataFrame:
    return reads.where((F.length("seq") > 0) & ~F.col("is_sup"))


def telomere_reads(reads: DataFrame, motifs: MotifTable, settings: Settings) -> DataFrame:
    """Reads with enough tandem canonical motifs on either strand. Narrow, JVM side."""
    least = settings.min_canonical_hits
    counted = with_canonical_counts(usable(reads), motifs)
    return counted.where((F.col("n_fwd") >= least) | (F.col("n_rev") >= least))


def scan_counters(reads: DataFrame, motifs: MotifTable, settings: Settings,
                  keys: list[str]) -> DataFrame:
    """Read and base counts of one scan, per key."""
    seen = with_canonical_counts(reads.where(F.length("seq") > 0), motifs)
    least = settings.min_canonical_hits
    tel = (F.col("n_fwd") >= least) | (F.col("n_rev") >= least)
    bp = F.length("seq").cast("long")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, bp)), F.lit(0)).cast("long")

    main = ~F.col("is_sup")
    return seen.groupBy(*keys).agg(
        F.count_if(F.col("is_sup")).alias("n_sup"),
        F.count_if(main).alias("n_all"),
        F.count_if(main & tel).alias("n_tel"),
        total(main).alias("bp_all"), total(main & tel).alias("bp_tel"),
        F.floor(total(main) / GENOME_BP + 0.5).cast("long").alias("coverage"))


def dedupe_last(reads: DataFrame, min_len: int, keys: list[str]) -> DataFrame:
    """Long enough reads, one per name: the last record's content, the first's position."""
    rest = [c for c in reads.columns if c not in (*keys, "name", "ord")]
    kept = reads.where(F.length("seq") >= min_len)
    got = kept.groupBy(*keys, "name").agg(
        F.min("ord").alias("ord"), F.max_by(F.struct(*rest), F.col("ord")).alias("_r"))
    return got.select(*keys, "name", "ord", "_r.*")


def downsample(reads: DataFrame, limit: int, keys: list[str], seed: int) -> DataFrame:
    """Keep ``limit`` reads per key in a seeded pseudo-random order; limit < 1 keeps all.

    The order is a hash of the name, so it does not depend on partitioning. Counts per
    hash prefix tell which prefixes are kept whole; only reads of one prefix are ever
    ranked against each other.
    """
    if limit < 1:
        return reads
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("name")))
    rows = reads.withColumn("_h", order).withColumn("_p", F.substring("_h", 1, 3))
    counts = rows.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_n")
    open_ = counts.select(*keys, "_p", (F.lit(limit) - before).alias("_left")).where("_left > 0")
    w = Window.partitionBy(*keys, "_p").orderBy("_h", "ord")
    return (rows.join(open_, [*keys, "_p"]).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= F.col("_left")).select(*reads.columns))
