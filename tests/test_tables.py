"""Relational operators against hand-computed values and sequential restatements."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from endcap import Settings
from endcap import motifs as mt
from endcap.functions import rank
from endcap.functions import seq as sq
from endcap.operators import alleles as al
from endcap.operators import anchors as an
from endcap.operators import consensus as co
from endcap.operators import report as rp
from endcap.operators import scan as sc
from endcap.operators import trimming as tr
from endcap.operators.distance import Scheme, distances

M, S = mt.human(), Settings()


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_cigar_values(spark):
    for text, want in (("10S100M5I20D50M8H", (10, 170, 155, 8)), ("5H20=1X20=2I", (5, 41, 43, 0)),
                       ("7S", (7, 0, 0, 0)), ("3M2N4M1P", (0, 7, 7, 0))):
        assert tuple(one(spark, sq.cigar_fields(F.lit(text)).alias("c")).c) == want


def test_sam_orientation(spark):
    rows = [("a", 0, "c", 100, 60, "10S50M5S", "A" * 65), ("b", 16, "c", 100, 60, "10S50M5S", "A" * 65),
            ("c", 4, "*", 0, 9, "*", "ACGT")]
    df = spark.createDataFrame(rows, "read string, flag int, ref string, pos int, mapq int, "
                                     "cigar string, seq string")
    got = {r.read: r for r in an.typed_alignments(df).collect()}
    assert (got["a"].read_pos1, got["a"].read_pos2, got["a"].pos1, got["a"].pos2) == (10, 60, 100, 150)
    assert (got["b"].read_pos1, got["b"].read_pos2, got["b"].pos1, got["b"].pos2) == (5, 55, 150, 100)
    assert (got["c"].ref, got["c"].pos2, got["c"].read_pos2, got["c"].mapq) == ("*", 4, 4, 0)


def test_file_formats(spark):
    for path, want in (("a/X.FA.gz", "fasta"), ("b.fastq", "fastq"), ("c.bam", "bam"),
                       ("d.cram", "cram"), ("e.p", "pickle"), ("f.txt", None)):
        assert one(spark, sq.file_format(F.lit(path)).alias("k")).k == want


def test_scan_filter_limits(spark):
    rows = [(n, "CCCTAA" * n, False) for n in (17, 16, 15)] + [(99, "TTAGGG" * 16, False),
                                                                (98, "TTAGGG" * 16, True), (97, "", False)]
    df = spark.createDataFrame(rows, "rid int, seq string, is_sup boolean")
    assert {r.rid for r in sc.telomere_reads(df, M, S).collect()} == {17, 16, 99}


def test_dedupe_keeps_last_content_and_first_position(spark):
    rows = [("x", 1, "AAAA"), ("y", 2, "CCCC"), ("x", 3, "GGGG"), ("x", 4, "T")]
    df = spark.createDataFrame(rows, "name string, ord long, seq string")
    got = {(r.name, r.ord, r.seq) for r in sc.dedupe_last(df, 4, []).collect()}
    assert got == {("x", 1, "GGGG"), ("y", 2, "CCCC")}


def test_tl_estimators(spark):
    df = spark.createDataFrame([("a", v) for v in (-120, 340, 1500, 1810, 2200)]
                               + [("b", -3), ("b", -2)], "aid string, tl int")
    got = {k: {r.aid: r.x for r in df.groupBy("aid").agg(
        sq.tl_estimate(F.col("tl"), k).alias("x")).collect()}
        for k in ("mean", "median", "p75", "p90", "max")}
    assert [got[k]["a"] for k in got] == [1146, 1500, 1810, 2044, 2200]
    assert got["mean"]["b"] == got["median"]["b"] == -2
    top = {n: {r.aid: r.tl for r in al.nth_from_top(df, ["aid"], "tl", n).collect()} for n in (2, 9)}
    assert top[2]["a"] == 1810 and top[9]["a"] == -120
    with pytest.raises(ValueError):
        sq.tl_estimate(F.col("tl"), "mode")


def test_n50(spark):
    for lens, want in (([2, 2, 2, 3, 3, 4, 8, 8], 8), ([10], 10)):
        df = spark.createDataFrame([(x,) for x in lens], "len int")
        assert rank.n50(df, "len").first().n50 == want
    assert rank.n50(spark.createDataFrame([], "len int"), "len").first() is None
    big = np.random.default_rng(0).integers(1, 40000, 500).tolist()
    order = sorted(big, reverse=True)
    want = order[int(np.argmax(np.cumsum(order) * 2 >= sum(order)))]
    df = spark.createDataFrame([(x,) for x in big], "len int")
    assert rank.n50(df, "len").first().n50 == want


def test_groups_do_not_depend_on_buckets(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(s), int(s + w)) for k in "ab" for s, w in
            zip(rng.integers(0, 5000, 80), rng.integers(0, 90, 80))]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    for width in (37, 100000):
        d = rank.delta_groups(df, ["k"], "s", 40, width).collect()
        i = rank.interval_groups(df, ["k"], "s", "e", width).collect()
        for key in "ab":
            mine = sorted((r.s, r.e, r.grp) for r in d if r.k == key)
            assert [b[2] - a[2] for a, b in zip(mine, mine[1:])] == \
                [int(b[0] - a[0] > 40) for a, b in zip(mine, mine[1:])]
            far, grp, want = -1, -1, []
            for s, e in sorted((r[1], r[2]) for r in rows if r[0] == key):
                grp += int(s > far)
                far = max(far, e)
                want.append((s, e, grp))
            assert sorted((r.s, r.e, r.grp) for r in i if r.k == key) == want


def plain_trim(alns, strategy):
    """(start, end, number, mapq) lists trimmed pass by pass."""
    todo = [list(a) for a in alns]
    while True:
        groups = tr.overlap_groups(todo)
        if all(len(g) == 1 for g in groups):
            return sorted(tuple(g[0]) for g in groups)
        nxt = []
        for g in groups:
            size = [a[1] - a[0] for a in g] if strategy == "largest" else [a[3] for a in g]
            lead = g[size.index(max(size))]
            for a in g:
                b = list(a)
                if a is not lead and len(g) > 1:
                    if lead[0] <= a[0] and a[1] <= lead[1]:
                        continue
                    if a[0] < lead[0]:
                        b[1] = min(b[1], lead[0] - 1)
                    else:
                        b[0] = max(b[0], lead[1] + 1)
                if len(g) == 1 or b[1] - b[0] >= 200:
                    nxt.append(b)
        todo = sorted(nxt)


@pytest.mark.parametrize("strategy", ["mapq", "largest"])
def test_trimming(spark, strategy):
    rng = np.random.default_rng(2)
    rows = [(f"r{r}", n, int(s), int(s + w), int(q)) for r in range(6)
            for n, (s, w, q) in enumerate(zip(rng.integers(0, 9000, 7), rng.integers(150, 3000, 7),
                                              rng.integers(0, 60, 7)))]
    df = spark.createDataFrame(rows, "read string, aln_no long, read_pos1 int, read_pos2 int, mapq int")
    got = tr.trim_matches(df, strategy=strategy).collect()
    for r in range(6):
        want = plain_trim([(s, e, n, q) for k, n, s, e, q in rows if k == f"r{r}"], strategy)
        assert sorted((x.read_pos1, x.read_pos2, x.aln_no, x.mapq) for x in got
                      if x.read == f"r{r}") == want


def test_anchor_shares(spark):
    rows = [(1, f"r{i}", ref, 0, span, q) for i, (ref, span, q) in enumerate(
        [("s_chr1q", 900, 60), ("s_chr1q", 800, 60), ("s_chr2q", 900, 5), ("s_chr3p", 1500, 0)])]
    top = spark.createDataFrame(rows, "cluster long, read string, ref string, pos1 int, pos2 int, mapq int")
    scores = an.anchor_scores(top)
    got = {r.ref: round(r.share, 4) for r in scores.collect()}
    assert got == {"s_chr1q": 0.9376, "s_chr2q": 0.0488, "s_chr3p": 0.0136}
    call = an.anchor_calls(scores, S).first()
    assert (call.chrs, call.positions, call.ref_samps) == (["chr1q"], [850], ["s"])


def test_known_region_buffer_is_inclusive(spark):
    reg = spark.createDataFrame([("c", 10000, 11000)], "contig string, start int, end int")
    pts = spark.createDataFrame([("c", p) for p in (7999, 8000, 13000, 13001)] + [("d", 9000)],
                                "contig string, pos int")
    assert {r.pos for r in an.in_known_region(pts, reg, S).collect()} == {8000, 13000}


def votes(spark, rows):
    df = spark.createDataFrame([("g", i, r) for i, r in enumerate(rows)],
                               "cid string, row_no int, aligned string")
    got = co.consensus_strings(co.column_votes(df, "C", "CA", raise_letter="C", lower_letter="A"))
    r = got.first()
    return r.consensus if r else ""


def test_column_votes(spark):
    assert votes(spark, ["DD", "EE"]) == "DD"                       # too few rows
    assert votes(spark, ["DC", "DC", "DC", "CC"]) == "DC"
    assert votes(spark, ["CD", "CD", "CD", "CD"][:3] + ["CCC"]) == "CDC"
    assert votes(spark, ["CF", "CF", "CF", "CC", "CC", "CC", "CC"]) == "CF"   # second, trusted
    assert votes(spark, ["-D", "-D", "-D", "CD"]) == "D"            # mostly gaps
    assert votes(spark, ["DF", "EF", "CF", "AF"]) == "CF"           # tie: canonical is raised
    assert votes(spark, ["DF", "EF", "EF", "DF"]) == "EF"           # tie: greater letter


def sequential_merge(rows, cut, bp, seed):
    """Merge the first compatible pair in listing order, start over, until none is left."""
    scheme = Scheme(kind="plain", free_right=True, equalize=False, shuffles=3, seed=seed)
    alleles = [dict(r) for r in rows]
    memo = {}

    def near(a, b):
        if not a["tvr"] or not b["tvr"] or a["place"] != b["place"] or abs(a["pos"] - b["pos"]) > bp:
            return False
        k = (a["tvr"], b["tvr"])
        if k not in memo:
            memo[k] = distances([k], scheme)[0] <= cut * 10
        return memo[k]

    root = {a["aid"]: a["aid"] for a in alleles}
    while True:
        hit = next(((a, b) for a, b in itertools.combinations(alleles, 2) if near(a, b)), None)
        if hit is None:
            return root
        a, b = hit
        win, lose = (b, a) if b["n"] > a["n"] else (a, b)
        win["n"] += lose["n"]
        alleles.remove(lose)
        root = {k: (win["aid"] if v == lose["aid"] else v) for k, v in root.items()}


def test_merge_near_equals_sequential_merging(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("DFL"), 60)) for _ in range(3)]
    rows = []
    for i in range(40):
        t = base[i % 3]
        at = int(rng.integers(0, 50))
        tvr = "" if i % 11 == 0 else t[:at] + "E" * (1 + i % 7) + t[at:] + "C" * (i % 9)
        rows.append({"aid": f"a{i:02d}", "place": ("chr1q", "s") if i % 4 else ("chrUq", "-"),
                     "pos": int(rng.integers(0, 4000)) if i % 4 else 0, "tl": 5000 - i,
                     "n": int(rng.integers(3, 30)), "tvr": tvr})
    df = spark.createDataFrame(
        [(r["aid"], [r["place"][0]], [r["pos"]], [r["place"][1]], False, len(r["tvr"]), r["tvr"],
          r["tl"], r["n"]) for r in rows],
        "aid string, chrs array<string>, positions array<int>, ref_samps array<string>, "
        "is_interstitial boolean, tvr_len int, tvr_consensus string, tl int, n_reads long")
    got = {r.aid: r.root for r in al.merge_near(df, S).collect()}
    order = [r.aid for r in al.order_key(df).orderBy(*al.ORDER).collect()]
    listed = sorted(rows, key=lambda r: order.index(r["aid"]))
    want = sequential_merge(listed, S.near_cut, S.near_bp, S.seed)
    assert got == want and len(set(want.values())) < len(want)


def test_reports_without_alleles(spark):
    heads = spark.createDataFrame([], "aid string, chrs array<string>, positions array<int>, ref_samps "
                                      "array<string>, is_interstitial boolean, tvr_len int, tl int, n_reads long")
    reads = spark.createDataFrame([], "aid string, tl int, rlen int, name string, mapq int")
    got = rp.summary(heads, reads, S).first()
    assert got.num_alleles == 0 and got.tl_mean is None and got.telread_n50_length is None


def test_cluster_places(spark):
    import random
    r = random.Random(4)
    rows = [(f"c{r.randrange(60)}", i) for i in range(150)] + [(f"one{i}", 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "cid string, rid long")
    members = {}
    for cid, rid in rows:
        members.setdefault(cid, []).append(rid)
    want = sorted(members, key=lambda c: (-len(members[c]), min(members[c])))
    got = {x.cid: x.place for x in rp.cluster_places(df).collect()}
    assert got == {c: i + 1 for i, c in enumerate(want)}
