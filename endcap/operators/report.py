"""Reports over finished alleles: filters, counts, histogram, arms, summary, TSV."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endcap.config import BLANK, UNANCHORED, Settings
from endcap.functions.durable import durable
from endcap.operators.alleles import ORDER, order_key, sample_key

SHORT_TL = 1000


def filter_alleles(heads: DataFrame, reads: DataFrame, min_reads: int = 3, min_tvr: int = 100,
                   min_atl: int = -2000, max_atl: int = 20000, min_maxatl: int = 100,
                   ) -> DataFrame:
    """Add ``fail_reason`` (null = passes), ``n_kept`` and ``max_kept``; first failure wins."""
    ok = (F.col("tl") > min_atl) & (F.col("tl") < max_atl)
    kept = reads.groupBy("aid").agg(F.count_if(ok).alias("n_kept"),
                                    F.max(F.when(ok, F.col("tl"))).alias("max_kept"))
    reason = (F.when(F.col("is_interstitial"), "interstitial")
              .when(F.col("tvr_len") < min_tvr, "min_tvr")
              .when(F.col("n_kept") == 0, "no_atl_in_range")
              .when(F.col("max_kept") < min_maxatl, "min_maxatl")
              .when(F.col("n_kept") < min_reads, "min_reads"))
    return heads.join(kept, "aid").withColumn("fail_reason", reason)


def report_class(heads: DataFrame, settings: Settings) -> DataFrame:
    """Class of each allele in the final plot: unmapped, short, interstitial or pass."""
    whole = F.array_join("chrs", ",")
    return heads.withColumn(
        "report", F.when(whole.isin(UNANCHORED, BLANK), "unmapped")
        .when(F.col("tvr_len") + F.col("tl") < settings.min_report_atl, "short")
        .when(F.col("is_interstitial"), "interstitial").otherwise("pass"))


def summary(heads: DataFrame, reads: DataFrame, settings: Settings) -> DataFrame:
    """The metrics table, one row (per sample). Without passing alleles the averages are null.

    Reads are reduced to (allele, length) counts once; all metrics of reads come from those.
    """
    key = sample_key(heads)
    f = filter_alleles(heads, reads, min_tvr=-1, min_reads=settings.min_reads,
                       min_maxatl=settings.min_report_atl)
    good = F.col("fail_reason").isNull()
    cls = report_class(f, settings)
    top = cls.groupBy(*key).agg(
        F.count_if(good).alias("num_alleles"), F.count_if(~good).alias("num_alleles_fail"),
        F.avg(F.when(good, F.col("tl"))).cast("int").alias("tl_mean"),
        F.percentile(F.when(good, F.col("tl")), F.lit(0.5)).cast("int").alias("tl_median"),
        F.count_if(good & (F.col("tl") < SHORT_TL)).alias("tl_short"),
        *[F.coalesce(F.sum(F.when(F.col("report") == k, F.col("n_reads"))), F.lit(0))
          .cast("long").alias(f"fail_reads_{name}")
          for k, name in (("unmapped", "unmapped"), ("short", "maxatl"),
                          ("interstitial", "interstitial"))])
    used = reads.join(f.where(good).select(*key, "aid"), "aid")
    per_len = used.groupBy(*key, "rlen").agg(F.count(F.lit(1)).alias("_k"),
                                             F.sum(F.col("rlen").cast("long")).alias("_bp"))
    # buckets of lengths, longest first: the bucket in which half of all bases is reached
    bucket = per_len.withColumn("_b", F.floor(F.col("rlen") / 1024))
    sums = bucket.groupBy(*key, "_b").agg(
        F.sum("_k").alias("_k"), F.sum("_bp").alias("_bp"),
        F.array_sort(F.collect_list(F.struct((-F.col("rlen")).alias("neg"), "_bp"))).alias("_in"))
    down = Window.partitionBy(*key).orderBy(F.col("_b").desc())
    whole = Window.partitionBy(*key)
    upto = F.sum("_bp").over(down.rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumns({"_upto": upto, "_all": F.sum("_bp").over(whole),
                             "_reads": F.sum("_k").over(whole)})
    inner = F.aggregate(
        "_in", F.struct((F.col("_upto") - F.col("_bp")).alias("c"), F.lit(None).cast("int").alias("n")),
        lambda acc, x: F.struct((acc["c"] + x["_bp"]).alias("c"), F.coalesce(acc["n"], F.when(
            (acc["c"] + x["_bp"]) * 2 >= F.col("_all"), (-x["neg"]).cast("int"))).alias("n")))["n"]
    lens = sums.where(F.col("_upto") * 2 >= F.col("_all")).groupBy(*key).agg(
        F.max("_reads").alias("num_telreads"),
        F.max((F.col("_all") / F.col("_reads")).cast("int")).alias("telread_mean_length"),
        F.max(inner).alias("telread_n50_length"))
    if not key:
        top, lens = top.withColumn("_one", F.lit(1)), lens.where(
            F.col("num_telreads").isNotNull()).withColumn("_one", F.lit(1))
    out = top.join(lens, key or ["_one"], "left").fillna(0, ["num_telreads"])
    names = ["num_alleles", "num_alleles_fail", "tl_mean", "tl_median", "tl_short", "num_telreads",
             "telread_mean_length", "telread_n50_length", "fail_reads_unmapped",
             "fail_reads_maxatl", "fail_reads_interstitial"]
    return out.select(*key, *names)


def length_edges(low: float = 1e3, high: float = 1e6, edges: int = 60) -> list[float]:
    return [float(x) for x in np.logspace(np.log10(low), np.log10(high), edges)]


def length_histogram(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Reads per logarithmic length bin; the last bin is closed on the right.

    Bin 0 holds what is shorter than the first edge, bin ``len(edges)`` what is longer than
    the last.
    """
    e = length_edges()
    n = F.col("length").cast("double")
    bin_no = F.size(F.filter(F.array(*[F.lit(x) for x in e]), lambda x: x <= n))
    inner = F.least(bin_no, F.lit(len(e) - 1))
    return (lengths.withColumn("bin", F.when(n > e[-1], F.lit(len(e))).otherwise(inner))
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))


def atl_by_arm(heads: DataFrame, reads: DataFrame, settings: Settings) -> DataFrame:
    """Telomere + variant length per read of the first alleles listed on each arm."""
    arm = F.when(F.col("chr0").isin(UNANCHORED, BLANK), "unanchored").otherwise(F.col("chr0"))
    key = sample_key(heads)
    w = Window.partitionBy(*key, "arm_label").orderBy(*ORDER)
    top = (order_key(heads).where(~F.col("is_interstitial")).withColumn("arm_label", arm)
           .withColumn("slot", F.row_number().over(w))
           .where(F.col("slot") <= max(1, settings.ploidy)))
    return (top.select(*key, "aid", "arm_label", "slot", "tvr_len")
            .join(reads.select("aid", F.col("tl").alias("read_tl")), "aid")
            .select(*key, "arm_label", "slot", "aid", (F.col("tvr_len") + F.col("read_tl")).alias("atl")))


def allele_table(heads: DataFrame, reads: DataFrame, settings: Settings) -> DataFrame:
    """Rows of the allele TSV, lists joined by commas, in listing order, one per allele.

    The sink's format holds all reads of an allele in one cell; for alleles of any size use
    ``heads`` and ``reads``, which stay a row per read.
    """
    lists = reads.groupBy("aid").agg(
        F.collect_list(F.struct("tl", "rlen", "name", "mapq")).alias("r"))

    def cell(field: str):
        return F.array_join(F.transform("r", lambda x: x[field].cast("string")), ",")

    if "merged" not in heads.columns:
        heads = heads.withColumn("merged", F.array("aid"))
    # merged alleles list their reads by length and then by the text of the other fields
    as_text = F.transform(
        F.array_sort(F.transform("r", lambda x: F.struct(
            x["tl"].alias("tl"), x["rlen"].cast("string").alias("a"),
            x["mapq"].cast("string").alias("b"), x["name"].alias("name"), x.alias("x")))),
        lambda y: y["x"])
    # ranges are found by a pass of its own over the rows, so lists are sorted after that
    rows = (order_key(heads).join(lists, "aid").orderBy(*sample_key(heads), *ORDER)
            .withColumn("r", F.when(F.size("merged") > 1, as_text).otherwise(F.array_sort("r"))))
    ids = F.transform("merged", lambda x: x.cast("string"))
    mark = F.when(F.col("is_interstitial"), "i").otherwise("")
    return rows.select(
        *sample_key(heads), F.array_join("chrs", ",").alias("#chr"),
        F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("position"),
        F.array_join("ref_samps", ",").alias("ref_samp"),
        F.concat(F.array_join(ids, ","), mark).alias("allele_id"),
        F.col("tl").cast("string").alias(f"TL_{settings.tl_method}"),
        cell("tl").alias("read_TLs"), cell("rlen").alias("read_lengths"),
        cell("mapq").alias("read_mapq"), F.col("tvr_len").cast("string").alias("tvr_len"),
        F.coalesce("tvr_consensus", F.lit("")).alias("tvr_consensus"),
        cell("name").alias("supporting_reads"))


def write_allele_tsv(heads: DataFrame, reads: DataFrame, path: str, settings: Settings) -> None:
    """Ordered TSV part files with one header each; range-sorted, not pulled to one task.

    One folder per sample where alleles carry one.
    """
    writer = allele_table(heads, reads, settings).write.mode("overwrite")
    if sample_key(heads):
        writer = writer.partitionBy("sample")
    (writer.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path))


def write_stats(summary_row: DataFrame, path: str) -> None:
    """The one-row metrics table as TSV with a header."""
    summary_row.coalesce(1).write.mode("overwrite").option("sep", "\t").option(
        "header", True).csv(path)


def write_lengths(all_reads: DataFrame, tel_reads: DataFrame, final_reads: DataFrame,
                  path: str) -> None:
    """Read lengths of the three stages as one parquet table (series, length)."""
    parts = [df.select(F.lit(k).alias("series"), F.length("seq").alias("length"))
             for k, df in (("all", all_reads), ("tel", tel_reads))]
    final = final_reads.select(F.lit("final").alias("series"), F.col("rlen").alias("length"))
    parts[0].unionByName(parts[1]).unionByName(final).write.mode("overwrite").partitionBy(
        "series").parquet(path)


def run_settings(spark: SparkSession, settings: Settings) -> DataFrame:
    """Run metadata: every setting and the seed as rows (key, value)."""
    rows = []
    for f in fields(settings):
        value = getattr(settings, f.name)
        if is_dataclass(value):
            rows += [(f"{f.name}.{g.name}", str(getattr(value, g.name))) for g in fields(value)]
        else:
            rows.append((f.name, str(value)))
    return spark.createDataFrame(rows, "key string, value string")


def write_run_settings(spark: SparkSession, settings: Settings, path: str) -> None:
    (run_settings(spark, settings).coalesce(1).write.mode("overwrite").option("sep", "\t")
     .option("header", True).csv(path))


def consensus_records(consensus: DataFrame) -> DataFrame:
    """Consensus strings as FASTA records (name, seq), named by cluster and variant length."""
    return consensus.select(F.concat_ws("_", "cid", F.concat(F.lit("tvr"), "tvr_len")).alias("name"),
                            F.col("consensus").alias("seq"))


def cluster_order(members: DataFrame) -> DataFrame:
    """Clusters of (cid, rid), largest first, then by their least members: cid, n, least_rid."""
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("least_rid"))
    return size.orderBy(F.col("n").desc(), "least_rid")


def cluster_places(members: DataFrame) -> DataFrame:
    """Clusters with their ``place`` (from 1) in that order.

    The rows are parted by ranges of that order, so no size is one task's; a place is the number
    of rows in the ranges before, and the rank in its own.
    """
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("least_rid"))
    listing = (F.col("n").desc(), F.col("least_rid").asc(), F.col("cid").asc())
    ranged = durable(size.repartitionByRange(*listing).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))       # a row per range
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*listing))
    return (ranged.withColumn("_rank", rank).join(before, "_p")
            .select("cid", "n", "least_rid", (F.col("_b") + F.col("_rank")).alias("place")))
