"""Column expressions on sequences, CIGAR strings and lists of lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def is_nucleotide(seq: Column) -> Column:
    return ~seq.rlike("[^ACGTN]")


def count_of(seq: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed word."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(word)))) / len(word)).cast("int")


def file_format(path: Column) -> Column:
    """Input format by suffix, null when unknown."""
    p = F.lower(path)
    return (F.when(p.rlike(r"\.(fa|fasta)(\.gz)?$"), "fasta")
            .when(p.rlike(r"\.(fq|fastq)(\.gz)?$"), "fastq")
            .when(p.endswith(".bam"), "bam")
            .when(p.endswith(".cram"), "cram")
            .when(p.endswith(".p"), "pickle"))


def wrapped_lines(seq: Column, width: int = 60) -> Column:
    """Cut a sequence into lines of a fixed width, in one pass."""
    return F.split(F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"), "\n")


# ---- CIGAR / SAM -----------------------------------------------------------

def _ops(cigar: Column) -> Column:
    return F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), F.lit(1))


def _op_sum(cigar: Column, codes: str) -> Column:
    picked = F.filter(_ops(cigar), lambda o: F.right(o, F.lit(1)).isin(*codes))
    return F.aggregate(picked, F.lit(0),
                       lambda acc, o: acc + F.rtrim(o, F.lit("MIDNSHPX=")).cast("int"))


def cigar_fields(cigar: Column) -> Column:
    """struct(lead_clip, ref_span, read_span, tail_clip).

    Only the outermost clip of each side counts; N and P advance neither side.
    """
    ops = _ops(cigar)
    first, last = F.element_at(ops, 1), F.element_at(ops, -1)

    def clip(op: Column) -> Column:
        return F.when(F.right(op, F.lit(1)).isin("S", "H"),
                      F.rtrim(op, F.lit("SH")).cast("int")).otherwise(0)

    return F.struct(
        clip(first).alias("lead_clip"),
        _op_sum(cigar, "MX=D").alias("ref_span"),
        _op_sum(cigar, "MX=I").alias("read_span"),
        F.when(F.size(ops) > 1, clip(last)).otherwise(0).alias("tail_clip"))


def sam_fields(flag: Column, ref: Column, pos: Column, mapq: Column, cigar: Column,
               seq: Column) -> Column:
    """Typed alignment with read coordinates in the read's own direction.

    Reference coordinates keep the direction: on the reverse strand pos1 > pos2.
    """
    unmapped = (ref == "*") | (flag.bitwiseAND(4) != 0)
    rev = flag.bitwiseAND(16) != 0
    c = cigar_fields(cigar)
    lead, span, tail, refspan = (c["lead_clip"], c["read_span"], c["tail_clip"], c["ref_span"])
    seqlen = F.length(seq)
    return F.struct(
        F.when(unmapped, 0).when(rev, tail).otherwise(lead).cast("int").alias("read_pos1"),
        F.when(unmapped, seqlen).when(rev, tail + span).otherwise(lead + span)
         .cast("int").alias("read_pos2"),
        F.when(unmapped, "*").otherwise(ref).alias("ref"),
        F.when(unmapped, 0).when(rev, pos + refspan).otherwise(pos).cast("int").alias("pos1"),
        F.when(unmapped, seqlen).when(rev, pos).otherwise(pos + refspan).cast("int").alias("pos2"),
        F.when(rev, "REV").otherwise("FWD").alias("orient"),
        F.when(unmapped, 0).otherwise(mapq).cast("int").alias("mapq"))


# ---- telomere length estimators -------------------------------------------

def tl_estimate(tl: Column, method: str) -> Column:
    """Aggregate over read lengths, truncated toward zero.

    mean, median, max, pNN. Percentiles aggregate counts per distinct value, so a
    hot allele is combined on the map side.
    """
    if method == "mean":
        agg = F.avg(tl)
    elif method == "median":
        agg = F.percentile(tl, F.lit(0.5))
    elif method == "max":
        agg = F.max(tl)
    elif method.startswith("p") and method[1:].isdigit():
        agg = F.percentile(tl, F.lit(int(method[1:]) / 100.0))
    else:
        raise ValueError(f"unknown estimator {method}")
    return agg.cast("int")
