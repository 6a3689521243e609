"""Findings of round 3 on the allele TSV: alleles are read in one pass, lists sorted once."""

from pyspark.sql import functions as F

from endcap.config import Settings
from endcap.operators import report as rp
from endcap.sources import files as fl

HEAD = ["#chr", "position", "ref_samp", "allele_id", "TL_p75", "read_TLs", "read_lengths",
        "read_mapq", "tvr_len", "tvr_consensus", "supporting_reads"]


def test_alleles_are_counted_without_a_row_per_read(spark, tmp_path):
    rows = [["chr1p", "5", "s0", "7i", "90", "80,90", "5000,6000", "60,3", "4", "DDDD", "a,b"],
            ["chr1p", "5", "s0", "7i", "90", "70", "4000", "60", "4", "DDDD", "c"],
            ["chr2q", "9", "s1", "8", "50", "50", "4500", "1", "0", "", "d"],
            ["chr2q", "9", "s1", "9", "", "", "", "", "0", "", ""]]
    (tmp_path / "x.tsv").write_text("\n".join("\t".join(r) for r in [HEAD, *rows]) + "\n")
    heads, reads = fl.read_allele_tsv(spark, str(tmp_path))
    assert heads.columns == ["aid", "chrs", "positions", "ref_samps", "is_interstitial", "tl",
                             "tvr_len", "tvr_consensus", "n_reads"]
    got = {r.aid: (r.chrs, r.positions, r.is_interstitial, r.tl, r.tvr_consensus, r.n_reads)
           for r in heads.collect()}
    assert got == {"7": (["chr1p"], [5], True, 90, "DDDD", 3), "8": (["chr2q"], [9], False, 50, "", 1)}
    assert sorted((r.aid, r.tl, r.rlen, r.name, r.mapq) for r in reads.collect()) == [
        ("7", 70, 4000, "c", 60), ("7", 80, 5000, "a", 60), ("7", 90, 6000, "b", 3),
        ("8", 50, 4500, "d", 1)]
    plan = heads._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_lists_are_sorted_after_the_ranges(spark):
    heads = spark.createDataFrame([("7", 90, 4, "DDDD", False)],
                                  "aid string, tl int, tvr_len int, tvr_consensus string, is_interstitial boolean")
    heads = heads.withColumns({"chrs": F.array(F.lit("chr1p")), "positions": F.array(F.lit(5)),
                               "ref_samps": F.array(F.lit("s0"))})
    reads = spark.createDataFrame([("7", t, 5000 + t, f"r{t}", 60) for t in (90, 70, 80)],
                                  "aid string, tl int, rlen int, name string, mapq int")
    table = rp.allele_table(heads, reads, Settings())
    row = table.first()
    assert (row.read_TLs, row.supporting_reads) == ("70,80,90", "r70,r80,r90")
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" in plan[:plan.index("Sort [")] and "array_sort" not in plan[plan.index("Sort ["):]
