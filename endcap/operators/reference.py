"""Building a subtelomere reference: cut contig ends, measure and mask their telomeres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endcap.config import Settings
from endcap.functions.batch import struct_udf
from endcap.functions.rank import running_total
from endcap.functions.seq import wrapped_lines
from endcap.motifs import MotifTable
from endcap.operators.signal import telomere_regions, terminal_of

# Kept end of a contig, searched end, line width, the appended telomere.
ARM_BP = 500_000
SEARCH_BP = 50_000
LINE_WIDTH = 60
EXTRA_UNIT, EXTRA_COUNT = "TAACCC", 10_000


def masked(seq: Column, tl: Column, arm: Column) -> Column:
    """Replace the telomere at the outer end by N."""
    n = F.least(tl, F.length(seq))
    rest = F.length(seq) - n
    return (F.when(arm == "p", F.concat(F.repeat(F.lit("N"), n), F.substring(seq, n + 1, rest)))
            .otherwise(F.concat(F.substring(seq, F.lit(1), rest), F.repeat(F.lit("N"), n))))


def contig_arms(contigs: DataFrame) -> DataFrame:
    """Both ends of every contig (name, seq): (name, arm, seq)."""
    s = F.upper("seq")
    return contigs.select("name", F.inline(F.array(
        F.struct(F.lit("p").alias("arm"), F.substring(s, F.lit(1), F.lit(ARM_BP)).alias("seq")),
        F.struct(F.lit("q").alias("arm"), F.right(s, F.lit(ARM_BP)).alias("seq")))))


def arm_lengths(arms: DataFrame, motifs: MotifTable, settings: Settings) -> DataFrame:
    """Add the telomere length ``tl`` measured in the outer stretch of each arm.

    Both arms of a contig no longer than that stretch have one signal, found once.
    """
    words, words_rc = motifs.kmers, motifs.kmers_rc
    last: dict[str, list] = {}

    def one(arm: str, seq: str) -> tuple:
        left = arm == "p"
        part = seq[:SEARCH_BP] if left else seq[-SEARCH_BP:]
        if part not in last:
            last.clear()
            last[part] = telomere_regions(part, words, words_rc, settings)
        return (terminal_of(last[part], settings, settings.min_tel_score, at_left=left)[0],)

    return arms.withColumn("tl", struct_udf(one, "tl int")("arm", "seq")["tl"])


def reference_contigs(contigs: DataFrame, sample: str, motifs: MotifTable, settings: Settings,
                      min_tl: int = 0, add_tel: bool = False,
                      rename: dict[str, str] | None = None) -> DataFrame:
    """Masked arms as (name, seq); optionally the telomeres as contigs of their own."""
    if "_" in sample:
        raise ValueError("a sample name cannot hold an underscore")
    arms = arm_lengths(contig_arms(contigs), motifs, settings).where(F.col("tl") >= min_tl)
    chrom = F.col("name")
    for old, new in (rename or {}).items():
        chrom = F.when(F.col("name") == old, new).otherwise(chrom)
    prefix = f"{sample}_" if sample else ""
    label = F.concat(chrom, F.col("arm"))
    out = arms.select(F.concat(F.lit(prefix), label).alias("name"),
                      masked(F.col("seq"), F.col("tl"), F.col("arm")).alias("seq"))
    if add_tel:
        tel = F.when(F.col("arm") == "p", F.left("seq", "tl")).otherwise(F.right("seq", "tl"))
        out = out.unionByName(arms.select(F.concat(F.lit(f"{prefix}tel-"), label).alias("name"),
                                          tel.alias("seq")))
        extra = contigs.sparkSession.range(1).select(
            F.lit("tel-TAACCC").alias("name"),
            F.repeat(F.lit(EXTRA_UNIT), F.lit(EXTRA_COUNT)).alias("seq"))
        out = out.unionByName(extra)
    return out


def fasta_lines(contigs: DataFrame) -> DataFrame:
    """FASTA text of (name, seq), one row per contig with embedded line breaks."""
    return contigs.select(F.concat_ws(
        "\n", F.concat(F.lit(">"), "name"),
        F.array_join(wrapped_lines(F.col("seq"), LINE_WIDTH), "\n")).alias("value"))


def wrapped_record(name: Column, seq: Column, width: int = LINE_WIDTH) -> Column:
    """One FASTA record with lines of ``width`` letters."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.array_join(wrapped_lines(seq, width), "\n"))


def fasta_index(contigs: DataFrame, width: int = LINE_WIDTH) -> DataFrame:
    """Index of the contigs written as wrapped FASTA in order of ``ord``: name, length, offset
    of the first letter, letters and bytes of a line, as in an index file.

    Offsets are running sums over ranges of ``ord``, so many contigs need no single task.
    """
    n = F.length("seq").cast("long")
    head = F.octet_length("name") + 2
    lines = F.ceil(n / width)
    rows = contigs.select("ord", "name", n.alias("length"), head.cast("long").alias("_head"),
                          (head + n + lines).cast("long").alias("_size"))
    before = running_total(rows, [], "ord", "_size", F.floor(F.col("ord") / 1024), "_end")
    return rows.join(before.select("ord", "_end"), "ord").select(
        "ord", "name", "length", (F.col("_end") - F.col("_size") + F.col("_head")).alias("offset"),
        F.lit(width).alias("linebases"), F.lit(width + 1).alias("linewidth"))
