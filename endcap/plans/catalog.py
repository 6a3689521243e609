"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from endcap import motifs as mt
from endcap.config import Settings
from endcap.functions import seq as sq
from endcap.functions.batch import struct_udf
from endcap.functions.durable import durable, shared_folder
from endcap.functions.rank import delta_groups, interval_groups, n50
from endcap.operators import alleles as al
from endcap.operators import anchors as an
from endcap.operators import colorvec as cv
from endcap.operators import consensus as co
from endcap.operators import grouping as gr
from endcap.operators import hits as ht
from endcap.operators import reference as rf
from endcap.operators import report as rp
from endcap.operators import scan as sc
from endcap.operators import signal as sg
from endcap.operators.trimming import trim_matches
from endcap.plans import calling
from endcap.sources import files as fl
from endcap.sources import planted

SETTINGS = Settings()
Query = Callable[[SparkSession, str], DataFrame]


def motif_table() -> mt.MotifTable:
    return mt.human(SETTINGS.read_type)


def toward_q(reads: DataFrame) -> DataFrame:
    """Planted reads turned so that the telomere is at the right."""
    return reads.withColumn("seq", F.when(F.col("rid") % 2 == 1,
                                          sq.reverse_complement(F.col("seq")))
                            .otherwise(F.col("seq")))


def q_reads(spark: SparkSession, d: str) -> DataFrame:
    return toward_q(planted.reads(spark, d)).select("rid", "sample", "name", "seq")


def colored(spark: SparkSession, d: str) -> DataFrame:
    return ht.color_vectors(q_reads(spark, d), motif_table())


def kept_reads(spark: SparkSession, d: str) -> DataFrame:
    m = motif_table()
    return calling.colored_reads(
        calling.measured_reads(planted.reads(spark, d), m, SETTINGS), m, SETTINGS)


# ---- scans -------------------------------------------------------------------

def reads_scan_stats(spark, d):
    return sc.scan_counters(planted.reads(spark, d), motif_table(), SETTINGS, ["sample"])


def tel_read_filter(spark, d):
    r = sc.telomere_reads(planted.reads(spark, d), motif_table(), SETTINGS)
    return r.select("rid", "n_fwd", "n_rev", F.length("seq").alias("len"))


def read_dedupe_last(spark, d):
    r = planted.reads(spark, d).select("sample", "name", "ord", "rid", "seq")
    r = sc.dedupe_last(r, SETTINGS.min_read_len, ["sample"])
    return r.select("sample", "name", "ord", "rid", F.md5("seq").alias("seq_md5"))


def reverse_complement(spark, d):
    r = planted.reads(spark, d)
    return r.select("rid", F.md5(sq.reverse_complement(F.col("seq"))).alias("rc_md5"),
                    sq.is_nucleotide(F.col("seq")).alias("valid"))


def downsample(spark, d):
    r = planted.reads(spark, d).select("sample", "name", "ord", "rid")
    return sc.downsample(r, 25, ["sample"], SETTINGS.seed)


# ---- motif hits ----------------------------------------------------------------

def _hit_stats(h: DataFrame) -> DataFrame:
    return h.groupBy("rid", "ki").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("s").cast("long")).alias("sum_s"),
        F.sum((F.col("e") - F.col("s")).cast("long")).alias("bases"))


def motif_hits(spark, d):
    return _hit_stats(ht.raw_hits(q_reads(spark, d), motif_table()))


def motif_hits_nonoverlap(spark, d):
    return _hit_stats(ht.joined_runs(q_reads(spark, d), motif_table()))


def motif_hits_final(spark, d):
    return _hit_stats(ht.painted_runs(q_reads(spark, d), motif_table()))


def canonical_bases(spark, d):
    m = motif_table()
    count = struct_udf(lambda s: (int(sg.covered(s, m.canonical).sum()),
                                  int(sg.covered(s, m.canonical_rc).sum())),
                       "bases_p int, bases_q int")
    return planted.reads(spark, d).withColumn("c", count("seq")).select(
        "rid", "c.bases_p", "c.bases_q")


# ---- signal ----------------------------------------------------------------------

def density_window(spark, d):
    m = motif_table()

    def one(seq: str) -> tuple:
        h = sg.window_hits(sg.covered(seq, m.kmers_rc), SETTINGS.window)
        return (len(h), int(h.sum()), int(h.max(initial=0)), int((h >= 50).sum()))

    stats = struct_udf(one, "n_windows int, sum_hits long, max_hits int, n_half int")
    return q_reads(spark, d).withColumn("w", stats("seq")).select("rid", "w.*")


def tel_regions(spark, d):
    """Regions of the unsmoothed signal."""
    m = motif_table()

    def one(seq: str) -> tuple:
        power = sg.signal_power(seq, m.kmers, m.kmers_rc, SETTINGS.window, smoothing=False)
        if not len(power):
            return (0, 0, 0)
        regs = sg.regions(power, SETTINGS.power)
        return (len(regs), sum(e - s for s, e, c in regs if c < 0),
                max((e - s for s, e, c in regs if c < 0), default=0))

    stats = struct_udf(one, "n_regions int, q_bases int, longest_q int")
    return q_reads(spark, d).withColumn("w", stats("seq")).select("rid", "w.*")


def terminal_tl(spark, d):
    m = calling.measured_reads(planted.reads(spark, d), motif_table(), SETTINGS)
    return m.select("rid", "flipped", "term_tel", "nontel_end", "inner_s", "inner_e")


def read_filter_flags(spark, d):
    m = calling.measured_reads(planted.reads(spark, d), motif_table(), SETTINGS)
    return m.groupBy("sample").agg(*[F.count_if(F.col(c)).alias(c)
                                     for c in ("short_tel", "nontel", "short_subtel", "keep")])


def fusion_flanks(spark, d):
    m = calling.measured_reads(planted.reads(spark, d), motif_table(), SETTINGS)
    return sg.fusion_flanks(m, SETTINGS).select(
        "rid", "side", "read_len", F.length("flank").alias("flank_len"))


# ---- colour vectors ------------------------------------------------------------------

def color_vector(spark, d):
    return colored(spark, d).select("rid", F.length("cvec").alias("len"),
                                    F.md5("cvec").alias("cvec_md5"))


def rle_runs(spark, d):
    return cv.color_runs(colored(spark, d)).groupBy("rid", "letter").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max(F.col("e") - F.col("s")).alias("longest"),
        F.sum((F.col("e") - F.col("s")).cast("long")).alias("bases"))


def denoise(spark, d):
    roles = cv.Roles.of(motif_table())

    def one(text: str) -> tuple:
        out = cv.denoise(cv.as_codes(text), roles.canonical, roles.denoise, roles.merge)
        return (out.tobytes().decode(),)

    return (colored(spark, d).withColumn("o", struct_udf(one, "clean string")("cvec")["clean"])
            .select("rid", F.length("o").alias("len"), F.md5("o").alias("clean_md5")))


def density_boundary(spark, d):
    roles = cv.Roles.of(motif_table())
    at = struct_udf(lambda t: (cv.density_border(cv.has(cv.as_codes(t), roles.subtel),
                                                 *cv.COARSE, below=True),), "pos int")
    return colored(spark, d).select("rid", at("cvec")["pos"].alias("pos"))


def cumulative_boundary(spark, d):
    roles = cv.Roles.of(motif_table())
    at = struct_udf(lambda t: (cv.cumulative_border(
        cv.has(cv.as_codes(t)[::-1], roles.tvr), cv.STRICT[1], cv.STRICT[2]),), "pos int")
    return colored(spark, d).select("rid", at("cvec")["pos"].alias("pos"))


def subtel_tvr_split(spark, d):
    return kept_reads(spark, d).select("rid", "tlen", "subtel_len", "tvrtel_len", "err_len",
                                       F.md5("tvrtel").alias("tvrtel_md5"))


# ---- similarity ------------------------------------------------------------------------

def pair_distance(spark, d):
    m = motif_table()
    reads = kept_reads(spark, d).select(F.col("sample").alias("gid"),
                                        F.col("tvrtel").alias("cseq"))
    strings = durable(gr.distinct_strings(reads, SETTINGS.step0.prefix)).withColumn(
        "blk", F.col("gid"))
    scheme = gr.Scheme(canonical=m.canonical_letter, shuffles=SETTINGS.step0.shuffles,
                       seed=SETTINGS.seed)
    dist = gr.block_distances(strings, scheme, SETTINGS)
    return (dist.select("blk", F.explode("d").alias("d")).groupBy("blk")
            .agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("d") >= 1).alias("n_far"),
                 F.round(F.min("d"), 6).alias("least")))


def tvr_clusters(spark, d):
    m = motif_table()
    reads = kept_reads(spark, d).select("rid", F.col("sample").alias("gid"),
                                        F.col("tvrtel").alias("cseq"))
    scheme = gr.Scheme(canonical=m.canonical_letter, shuffles=SETTINGS.step0.shuffles,
                       seed=SETTINGS.seed)
    got = gr.ward_groups(durable(reads), SETTINGS.step0, scheme, SETTINGS)
    return got.groupBy("gid", "cid").agg(F.count(F.lit(1)).alias("n"),
                                         F.min("rid").alias("least_rid"))


def equal_variants(spark, d):
    """Single-linkage groups of the reads' own variant parts, told by their least read."""
    roles = cv.Roles.of(motif_table())
    size = struct_udf(lambda t: (cv.variant_length(t, roles),), "n int")
    reads = (kept_reads(spark, d).withColumn("v", size("tvrtel")["n"]).where("v > 0")
             .select(F.col("sample").alias("gid"), F.col("rid").alias("id"),
                     F.expr("substring(tvrtel, 1, v)").alias("s")))
    got = gr.collapse_equal(durable(reads), SETTINGS.collapse, SETTINGS)
    return got.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(
        "least_rid")).drop("comp")


def clustered_reads(spark, d):
    """Final clusters of reads, told by their least read."""
    m = motif_table()
    got, _ = calling.cluster_reads(durable(kept_reads(spark, d)), m, SETTINGS)
    return got.groupBy("sample", "cid").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias(
        "least_rid")).drop("cid")


def column_consensus(spark, d):
    r = planted.table(spark, d, "documents")
    aligned = r.select(
        F.concat_ws("/", "source", "lang").alias("cid"), F.col("doc_id").alias("row_no"),
        F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")),
                    "BDEFHIJKLMNOPQRSUVWXYZ", "CGA-CGA-CGA-CGA-CGA-CG").alias("aligned"))
    votes = co.column_votes(aligned, "C", "CA", raise_letter="C", lower_letter="A")
    return co.consensus_strings(votes).select(
        "cid", F.length("consensus").alias("len"), F.md5("consensus").alias("consensus_md5"))


def msa_consensus(spark, d):
    """Consensus and variant length of the planted alleles."""
    m = motif_table()
    members = (kept_reads(spark, d)
               .withColumn("cid", F.concat_ws("/", "sample", F.col("al").cast("string")))
               .select("cid", "rid", "tvrtel"))
    got = co.cluster_consensus(members, m)
    return got.select("cid", F.length("consensus").alias("len"), "tvr_len")


def noisy_consensus(spark, d):
    """Consensus of strings with errors, one cluster per source, all strings heard."""
    got = co.cluster_consensus(planted.noisy_strings(spark, d), motif_table())
    variant = F.rtrim("consensus", F.lit("C"))
    return got.select("cid", F.length(variant).alias("len"), F.md5(variant).alias("variant_md5"))


def called_alleles(spark, d):
    got = calling.call_alleles(planted.reads(spark, d), motif_table(), SETTINGS)
    return got.heads.select("aid", "n_reads", "tl", "tvr_len",
                            F.md5("tvr_consensus").alias("tvr_md5"))


# ---- alignments ----------------------------------------------------------------------------

def typed(spark, d):
    return an.typed_alignments(an.split_read_names(planted.sam(spark, d)))


def cigar_parse(spark, d):
    s = planted.sam(spark, d).where("cigar <> '*'")
    return s.select("aln_no", sq.cigar_fields(F.col("cigar")).alias("c")).select("aln_no", "c.*")


def sam_orient(spark, d):
    return typed(spark, d).select("aln_no", "kind", "cluster", "read", "read_pos1", "read_pos2",
                                  "ref", "pos1", "pos2", "orient", "mapq")


def best_alignment(spark, d):
    aln = typed(spark, d)
    return (an.top_alignments(aln).join(an.best_mapq(aln), ["cluster", "read"])
            .select("cluster", "read", "aln_no", "span", "mapq", "ref", "pos1", "pos2",
                    "best_mapq"))


def anchor_scores(spark, d):
    s = an.anchor_scores(an.top_alignments(typed(spark, d)))
    return s.select("cluster", "ref", "weighted", "n_reads", "anchor",
                    F.round("share", 9).alias("share"))


def anchor_calls(spark, d):
    c = an.anchor_calls(an.anchor_scores(an.top_alignments(typed(spark, d))), SETTINGS)
    return c.select("cluster", F.array_join("chrs", ",").alias("chr"),
                    F.array_join(F.transform("positions", lambda x: x.cast("string")), ",")
                    .alias("position"), F.array_join("ref_samps", ",").alias("ref_samp"))


def interstitial_annotate(spark, d):
    p = typed(spark, d).where("ref <> '*'").select("aln_no", F.col("ref").alias("contig"),
                                                   F.col("pos2").alias("pos"))
    return an.in_known_region(p, planted.regions(spark, d), SETTINGS)


def fusion_calls(spark, d):
    return an.fusion_calls(typed(spark, d), planted.regions(spark, d), SETTINGS)


def match_trimming(spark, d):
    """Trim the items of each order as if they were alignments of one read."""
    li = planted.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read"),
        F.xxhash64("l_partkey", "l_suppkey", "l_linenumber").alias("aln_no"),
        (F.col("l_partkey") * 3).cast("int").alias("read_pos1"),
        (F.col("l_partkey") * 3 + F.col("l_quantity") * 40).cast("int").alias("read_pos2"),
        (F.col("l_suppkey") % 61).cast("int").alias("mapq"))
    return trim_matches(li)


# ---- alleles and reports -------------------------------------------------------------------

def heads_and_reads(spark, d) -> tuple[DataFrame, DataFrame]:
    h = planted.allele_heads(spark, d).select(
        "aid", F.array("chr0").alias("chrs"), F.array("pos0").alias("positions"),
        F.array("ref0").alias("ref_samps"), "is_interstitial", "tvr_len")
    r = planted.allele_reads(spark, d)
    return al.with_tl(h, r, SETTINGS.tl_method), r


def allele_rows(spark, d):
    """Alleles of the planted truth: length estimate and variant length."""
    r = planted.reads(spark, d).where("tvr_bp > 0").withColumn(
        "aid", F.concat_ws("/", "sample", F.col("al").cast("string")))
    cons = r.groupBy("aid").agg(F.min("tvr_bp").alias("tvr_len"))
    members = r.select(F.col("aid").alias("cid"), F.length("seq").alias("rlen"), "name",
                       F.length("seq").alias("tlen"),
                       (F.length("seq") - F.col("tvr_bp") - F.col("tel_bp")).alias("subtel_len"),
                       F.lit(0).alias("err_len"), F.lit(60).alias("mapq"))
    reads = al.allele_reads(members, cons.withColumnRenamed("aid", "cid"))
    return al.with_tl(cons, reads, SETTINGS.tl_method).select("aid", "tvr_len", "tl", "n_reads")


def tl_estimators(spark, d):
    r = planted.allele_reads(spark, d)
    x = F.col("tl")
    base = r.groupBy("aid").agg(
        *[sq.tl_estimate(x, k).alias(f"tl_{k}") for k in ("mean", "median", "p75", "max")])
    top = al.nth_from_top(r, ["aid"], "tl", 2).withColumnRenamed("tl", "tl_2fromtop")
    return base.join(top, "aid")


def near_alleles(spark, d):
    return al.near_counts(heads_and_reads(spark, d)[0], SETTINGS.near_bp)


def allele_collapse(spark, d):
    """Merging of alleles at one place; the variant part is spelled from the allele's numbers."""
    h, _ = heads_and_reads(spark, d)
    unit = F.element_at(F.split(F.lit("DDDDDD FFFFFF LLLLLL NNNNNN KKKKKK"), " "),
                        (F.col("aid") % 5 + 1).cast("int"))
    other = F.element_at(F.split(F.lit("CCCCCC SSSSSS GGGGGG"), " "),
                         (F.col("aid") % 3 + 1).cast("int"))
    tvr = F.concat(F.repeat(unit, (F.col("tvr_len") % 7 + 4).cast("int")),
                   F.repeat(other, (F.col("tvr_len") % 5 + 3).cast("int")))
    h = h.withColumn("tvr_consensus", F.when(F.col("tvr_len") > 0, tvr).otherwise(""))
    roots = al.merge_near(h, SETTINGS)
    return roots.groupBy("root").agg(F.count(F.lit(1)).alias("n_alleles"))


def allele_filter_reasons(spark, d):
    f = rp.filter_alleles(*heads_and_reads(spark, d))
    return f.groupBy(F.coalesce("fail_reason", F.lit("pass")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_alleles"), F.sum("n_kept").alias("n_kept"))


def report_classes(spark, d):
    h, _ = heads_and_reads(spark, d)
    return rp.report_class(h, SETTINGS).groupBy("report").agg(
        F.count(F.lit(1)).alias("n_alleles"), F.sum("n_reads").alias("n_reads"))


def final_order(spark, d):
    h = al.order_key(heads_and_reads(spark, d)[0])
    return h.select("aid", "chr_rank", "arm", "neg_tl", "pos0").orderBy(*al.ORDER)


def read_n50(spark, d):
    r = planted.reads(spark, d).withColumn("len", F.length("seq"))
    return n50(r, "len", ["sample"])


def summary_metrics(spark, d):
    return rp.summary(*heads_and_reads(spark, d), SETTINGS)


def readlen_histogram(spark, d):
    r = planted.reads(spark, d).withColumn("length", F.length("seq"))
    tel = sc.telomere_reads(r, motif_table(), SETTINGS)
    both = (r.select(F.lit("all").alias("series"), "length")
            .unionByName(tel.select(F.lit("tel").alias("series"), "length")))
    return rp.length_histogram(both, ["series"])


def atl_by_arm(spark, d):
    h, r = heads_and_reads(spark, d)
    got = rp.atl_by_arm(h, r, SETTINGS)
    return got.groupBy("arm_label", "slot", "aid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("atl").cast("long").alias("sum_atl"))


def allele_tsv_rows(spark, d):
    h, r = heads_and_reads(spark, d)
    t = rp.allele_table(h.withColumn("tvr_consensus", F.repeat(F.lit("D"), F.col("tvr_len"))), r,
                        SETTINGS)
    return t.select("allele_id", F.col("#chr").alias("chr"), "position", "ref_samp",
                    F.col("TL_p75").alias("tl"), "read_TLs", "read_lengths", "tvr_len")


def time_groups(spark, d):
    e = planted.table(spark, d, "events").select(
        "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    g = delta_groups(e, ["user_id"], "t", 7200, 86400)
    return g.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"),
                                           F.max("t").alias("t1"))


def span_groups(spark, d):
    e = planted.table(spark, d, "events").select(
        "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + (F.col("value") * 100).cast("long")).alias("e"))
    g = interval_groups(e, ["user_id"], "s", "e", 86400)
    return g.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"),
                                           F.max("e").alias("e"))


def ref_mask(spark, d):
    r = toward_q(planted.reads(spark, d))
    m = rf.masked(F.col("seq"), F.col("tel_bp"), F.when(F.col("rid") % 3 == 0, "p").otherwise("q"))
    lines = sq.wrapped_lines(m, rf.LINE_WIDTH)
    return r.select("rid", F.md5(m).alias("masked_md5"), F.size(lines).alias("n_lines"),
                    F.md5(F.array_join(lines, "|")).alias("lines_md5"))


def reference_arms(spark, d):
    r = q_reads(spark, d).select(F.col("rid").cast("string").alias("name"), "seq")
    arms = rf.arm_lengths(rf.contig_arms(r), motif_table(), SETTINGS)
    return arms.select("name", "arm", "tl")


# ---- files: written from the tables, read again ----------------------------------------------

def _lengths_and_sums(df: DataFrame) -> DataFrame:
    return df.select("name", F.length("seq").alias("len"), F.md5("seq").alias("seq_md5"),
                     F.length("qual").alias("qual_len"), F.md5("qual").alias("qual_md5"))


def fasta_records(spark, d):
    """Reads as FASTA text with wrapped lines, read again."""
    path = shared_folder(spark)
    r = planted.reads(spark, d).where("seq <> ''")
    r.select(rf.wrapped_record(F.concat_ws(" ", F.col("rid").cast("string"), "sample"),
                               F.col("seq"))).write.text(path)
    return _lengths_and_sums(fl.read_any(spark, [path + "/*.txt"], "fasta")).drop(
        "qual_len", "qual_md5")


def fastq_records(spark, d):
    """Reads as FASTQ text, read again; a quarter of the quality lines starts with '@'."""
    path = shared_folder(spark)
    r = planted.reads(spark, d).where("seq <> ''")
    qual = F.translate("seq", "ACGT", "@+I!")
    r.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("rid").cast("string")), "seq", F.lit("+"),
                         qual)).write.text(path)
    return _lengths_and_sums(fl.read_any(spark, [path + "/*.txt"], "fastq"))


def fasta_index(spark, d):
    """Index of all reads as one wrapped FASTA in order of ``rid``."""
    r = planted.reads(spark, d).select(F.col("rid").alias("ord"), F.col("rid").cast("string")
                                       .alias("name"), "seq")
    return rf.fasta_index(r).select("name", "length", "offset", "linebases", "linewidth")


def stage_lengths(spark, d):
    """Read lengths of the stages, written and read again."""
    path = shared_folder(spark)
    r = planted.reads(spark, d)
    rp.write_lengths(r, sc.telomere_reads(r.withColumn("length", F.length("seq")), motif_table(),
                                          SETTINGS), planted.allele_reads(spark, d), path)
    return (spark.read.parquet(path).groupBy("series", "length")
            .agg(F.count(F.lit(1)).alias("n")))


def allele_tsv_back(spark, d):
    """The allele TSV, written and read again: its read rows."""
    path = shared_folder(spark)
    h, r = heads_and_reads(spark, d)
    rp.write_allele_tsv(h.withColumn("tvr_consensus", F.repeat(F.lit("D"), F.col("tvr_len"))), r,
                        path, SETTINGS)
    heads, reads = fl.read_allele_tsv(spark, path)
    return (reads.join(heads.select("aid", "tvr_len", "n_reads", F.length("tvr_consensus")
                                    .alias("cons_len")), "aid")
            .select("aid", "name", "tl", "rlen", "mapq", "tvr_len", "n_reads", "cons_len"))


def cluster_listing(spark, d):
    """Place of every planted cluster in the listing: largest first, then by least read."""
    r = planted.reads(spark, d).select(
        F.concat_ws("/", "sample", F.col("al").cast("string")).alias("cid"), "rid")
    return rp.cluster_places(r)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    reads_scan_stats, tel_read_filter, read_dedupe_last, reverse_complement, downsample,
    motif_hits, motif_hits_nonoverlap, motif_hits_final, canonical_bases, density_window,
    tel_regions, terminal_tl, read_filter_flags, fusion_flanks, color_vector, rle_runs, denoise,
    density_boundary, cumulative_boundary, subtel_tvr_split, pair_distance, tvr_clusters,
    equal_variants, clustered_reads, column_consensus, msa_consensus, noisy_consensus,
    called_alleles, cigar_parse, sam_orient,
    best_alignment, anchor_scores, anchor_calls, interstitial_annotate, fusion_calls,
    match_trimming, allele_rows, tl_estimators, near_alleles, allele_collapse,
    allele_filter_reasons, report_classes, final_order, read_n50, summary_metrics,
    readlen_histogram, atl_by_arm, allele_tsv_rows, time_groups, span_groups, ref_mask,
    reference_arms, fasta_records, fastq_records, fasta_index, stage_lengths, allele_tsv_back,
    cluster_listing)}
