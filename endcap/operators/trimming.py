"""Trimming overlapping alignments of one read in read coordinates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endcap.functions.rank import interval_groups

MIN_SPAN = 200
BUCKET_BP = 1 << 16


def overlap_groups(spans: list[list[int]]) -> list[list[list[int]]]:
    """Put each span into the first group that has an overlapping member."""
    groups: list[list[list[int]]] = []
    for span in spans:
        for g in groups:
            if any(span[0] <= o[1] and span[1] >= o[0] for o in g):
                g.append(span)
                break
        else:
            groups.append([span])
    return groups


def _trim_group(group: list[list[int]], strategy: str, min_span: int) -> list[list[int]]:
    """The strongest span stays; the others lose what it covers, or everything."""
    if len(group) < 2:
        return group
    rank = (lambda s: s[3]) if strategy == "mapq" else (lambda s: s[1] - s[0])
    top = max(group, key=rank)
    lo, hi = top[0], top[1]
    kept = []
    for span in group:
        if span is not top:
            if span[0] >= lo and span[1] <= hi:
                continue
            if span[0] < lo <= span[1]:
                span = [span[0], lo - 1, *span[2:]]
            elif span[0] <= hi < span[1]:
                span = [hi + 1, span[1], *span[2:]]
        if span[1] - span[0] >= min_span:
            kept.append(span)
    return kept


def trim_spans(spans: list[list[int]], strategy: str, min_span: int) -> list[list[int]]:
    """Repeat until no two spans of [start, end, number, mapq] overlap."""
    groups = overlap_groups(spans)
    while any(len(g) > 1 for g in groups):
        flat = sorted(s for g in groups for s in _trim_group(g, strategy, min_span))
        if not flat:
            return []
        groups = overlap_groups(flat)
    return [g[0] for g in groups]


def trim_matches(aln: DataFrame, read: str = "read", strategy: str = "mapq",
                 min_span: int = MIN_SPAN) -> DataFrame:
    """Trim alignments (read, aln_no, read_pos1, read_pos2, mapq) of each read.

    Only overlapping alignments touch each other, so the unit of work is one island of
    overlaps, not the read; alignments that stand alone never leave the JVM.
    """
    cols = ["aln_no", "read_pos1", "read_pos2", "mapq"]
    base = aln.select(read, F.col("aln_no").cast("long"), F.col("read_pos1").cast("int"),
                      F.col("read_pos2").cast("int"), F.col("mapq").cast("int"))
    placed = interval_groups(base, [read], "read_pos1", "read_pos2", BUCKET_BP)
    islands = placed.groupBy(read, "grp").agg(F.array_sort(F.collect_list(
        F.struct(*cols))).alias("items"))
    item = "array<struct<aln_no:long,read_pos1:int,read_pos2:int,mapq:int>>"

    @F.pandas_udf(item)
    def trim(col: pd.Series) -> pd.Series:
        out = []
        for items in col:
            spans = [[x["read_pos1"], x["read_pos2"], x["aln_no"], x["mapq"]] for x in items]
            out.append([{"aln_no": n, "read_pos1": a, "read_pos2": b, "mapq": q}
                        for a, b, n, q in trim_spans(spans, strategy, min_span)])
        return pd.Series(out)

    alone = islands.where(F.size("items") == 1).select(read, F.inline("items"))
    many = islands.where(F.size("items") > 1).select(read, F.inline(trim("items")))
    return alone.unionByName(many)
