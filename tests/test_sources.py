"""File readers and sinks on small files."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from endcap import Settings
from endcap import motifs as mt
from endcap.operators import reference as rf
from endcap.operators import report as rp
from endcap.sources import files as fl
from endcap.sources.bam import read_alignments, read_bam
from endcap.streaming.scan import measured_stream


def test_fasta(spark, tmp_path):
    body = ">r1 x\ty\nACGT\nAC\n\nGT\n>r2\nTTTT\n>r3\n"
    p, z = str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")
    open(p, "w").write(body)
    gzip.open(z, "wt").write(body)
    for path in (p, z):
        got = [(r.name, r.seq) for r in fl.read_any(spark, [path]).orderBy("ord").collect()]
        assert got == [("r1 x y", "ACGTACGT"), ("r2", "TTTT"), ("r3", "")]
    with pytest.raises(ValueError):
        fl.read_any(spark, [p, p])
    both = fl.read_any(spark, [p, z]).orderBy("ord").collect()
    assert [r.name for r in both] == ["r1 x y", "r2", "r3"] * 2


def test_fastq(spark, tmp_path):
    p = str(tmp_path / "a.fastq")
    open(p, "w").write("@r1\tz\nACGT\n+\n@III\n@r2\nGG\n+r2\n!!\n")
    got = [(r.name, r.seq, r.qual) for r in fl.read_any(spark, [p]).orderBy("ord").collect()]
    assert got == [("r1 z", "ACGT", "@III"), ("r2", "GG", "!!")]


def test_fastq_over_splits(spark, tmp_path):
    p = str(tmp_path / "b.fastq")
    want = [(f"r{i}", "ACGT" * (1 + i % 7)) for i in range(400)]
    open(p, "w").write("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = fl.read_fastq(spark, p).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.name, r.seq) for r in got] == want


@pytest.mark.parametrize("size", ["37", "150", "1500", "100000"])
def test_fastq_qualities_over_splits(spark, tmp_path, size):
    import random
    r = random.Random(int(size))
    want, text = [], ""
    for i in range(300):
        seq = "".join(r.choice("ACGT") for _ in range(r.randint(0 if i % 50 == 3 else 1, 30)))
        qual = "".join(r.choice("@@I+!") for _ in seq)
        end = "\r\n" if i % 9 == 0 else "\n"
        want.append((f"r{i}", seq, qual))
        text += end.join([f"@r{i}", seq, "+" if i % 2 else f"+r{i}", qual, ""])
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.fastq").write_text(text + "\n\n", newline="")
    (folder / "b.fastq").write_text("@x1\nAC\n+\n@@\n@x2\nGG\n+\n", newline="")   # cut off behind +
    (folder / "c.fastq").write_text("@y1\nAC\n+\nII\n@y2", newline="")              # a name alone
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = fl.read_fastq(spark, str(folder)).orderBy("file", "ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(x.name, x.seq, x.qual) for x in got] == want + [
        ("x1", "AC", "@@"), ("x2", "GG", ""), ("y1", "AC", "II"), ("y2", "", "")]


def test_whole_fastq_records_are_not_shuffled(spark, tmp_path):
    p = tmp_path / "c.fastq"
    p.write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(50)))
    plan = fl.read_fastq(spark, str(p))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    whole = plan[:plan.index("Join")]                # the first branch of the union
    assert "Window" not in whole.split("Union")[1].split("Relation")[0]


def test_fastq_pieces_are_joined_by_the_task_that_reads_them(spark, tmp_path):
    p = tmp_path / "d.fastq"
    p.write_text("".join(f"@r{i}\nACGT\n+\n{'@' if i % 3 else 'I'}II{i}\n" for i in range(40)))
    got = fl.read_fastq(spark, str(p))
    assert "FullOuter" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.name, r.qual) for r in got.orderBy("ord").collect()] == [
        (f"r{i}", f"{'@' if i % 3 else 'I'}II{i}") for i in range(40)]


def bgzf(data):
    out = b""
    for k in range(0, len(data), 300):
        raw = data[k:k + 300]
        z = zlib.compressobj(wbits=-15)
        body = z.compress(raw) + z.flush()
        out += (b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC"
                + struct.pack("<HH", 2, len(body) + 25) + body
                + struct.pack("<II", zlib.crc32(raw), len(raw)))
    return out


def bam_record(name, flag, ref, pos, mapq, cigar, seq, qual):
    codes = "=ACMGRSVTWYHKDBN"
    packed = [codes.index(x) for x in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq),
                       -1, -1, 0)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o))
                                             for n, o in cigar)
    body += bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2]))
    body += bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 7) + \
        b"s_chr1\0" + struct.pack("<i", 1000)
    rec = bam_record("a", 0, 0, 9, 60, [(2, "S"), (3, "M")], "ACGTN", "IIIII")
    rec += bam_record("b", 2048 | 16, 0, 99, 3, [(4, "=")], "ACGT", "")
    rec += bam_record("c", 4, -1, -1, 0, [], "A" * 501, "")
    p = str(tmp_path / "x.bam")
    open(p, "wb").write(bgzf(head + rec))
    got = read_alignments(spark, p).orderBy("ord").collect()
    assert [(r.name, r.flag, r.ref, r.pos, r.mapq, r.cigar, r.seq) for r in got] == [
        ("a", 0, "s_chr1", 10, 60, "2S3M", "ACGTN"), ("b", 2064, "s_chr1", 100, 3, "4=", "ACGT"),
        ("c", 4, "*", 0, 0, "*", "A" * 501)]
    assert [(r.name, r.is_sup) for r in read_bam(spark, p).orderBy("ord").collect()] == [
        ("a", False), ("b", True), ("c", False)]
    cut = str(tmp_path / "cut.bam")
    data = bgzf(head + rec)
    open(cut, "wb").write(data[:-60])
    with pytest.raises(Exception, match="truncated"):
        read_bam(spark, cut).collect()


def bam_file(n, seed, block=300, refs=3):
    """(bytes, places of the blocks' contents, places and rows of the records)."""
    import random
    r = random.Random(seed)
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", refs)
    for i in range(refs):
        data += struct.pack("<i", 6) + f"chr_{i}".encode() + b"\0" + struct.pack("<i", 1 << 20)
    starts, rows = [], []
    pos = sorted((r.randrange(refs), r.randrange(60000)) for _ in range(n))
    for i, (ref, at) in enumerate(pos):
        seq = "".join(r.choice("ACGT") for _ in range(r.choice([3, 40, 900])))
        rec = bam_record(f"r{i}", 0, ref, at, 60, [(len(seq), "M")], seq,
                         "!" * len(seq) if i % 3 else "")
        tags = b"NMi" + struct.pack("<i", i) + b"XZZab\0" + b"XBBs" + struct.pack("<Ihh", 2, 1, 2)
        rec = struct.pack("<i", len(rec) - 4 + len(tags)) + rec[4:] + tags
        starts.append(len(data))
        rows.append((f"r{i}", f"chr_{ref}", at + 1, seq))
        data += rec
    return data, starts, rows


def test_bam_over_splits(spark, tmp_path):
    data, _, want = bam_file(300, 5)
    p = str(tmp_path / "many.bam")
    open(p, "wb").write(bgzf(data) + bgzf(b" ")[:0])
    for size in (0, 97, 1000, 7777):
        got = read_alignments(spark, "file:" + p, split_bytes=size)
        assert size == 0 or got.rdd.getNumPartitions() > 8
        got = got.orderBy("ord").collect()
        assert [(r.name, r.ref, r.pos, r.seq) for r in got] == want
        assert len({r.ord for r in got}) == len(got)
    folder = read_bam(spark, str(tmp_path)).count()
    assert folder == read_bam(spark, str(tmp_path / "m*.bam")).count() == 300


def test_bam_regions_read_fewer_bytes(spark, tmp_path):
    from endcap.sources import bam
    data, starts, rows = bam_file(400, 6)
    p = str(tmp_path / "x.bam")
    z = bgzf(data)
    open(p, "wb").write(z)
    # places of the blocks, then an index with one chunk a record in its smallest bin
    blocks, at = [], 0
    while at < len(z):
        blocks.append(at)
        at += bam.block_size(z, at)
    virtual = [blocks[s // 300] << 16 | s % 300 for s in [*starts, len(data) - 1]]
    index = b"BAI\1" + struct.pack("<i", 3)
    for ref in range(3):
        bins = {}
        for i, (_, name, pos, seq) in enumerate(rows):
            if name == f"chr_{ref}":
                lo, hi = pos - 1, pos - 1 + len(seq)
                number = max(b for b in bam.bins_of(lo, hi) if all(
                    x in bam.bins_of(y, y + 1) for x in [b] for y in (lo, hi - 1)))
                bins.setdefault(number, []).append((virtual[i], virtual[i + 1]))
        index += struct.pack("<i", len(bins))
        for number, chunks in bins.items():
            index += struct.pack("<Ii", number, len(chunks))
            index += b"".join(struct.pack("<QQ", *c) for c in chunks)
        index += struct.pack("<i", 0)
    for regions in ("chr_1:20000-30000", "chr_0:1-5000,chr_2:59000-70000", "chr_1", "none"):
        want = [r for r in rows for name, lo, hi in bam.parsed_regions(regions)
                if r[1] == name and r[2] - 1 < hi and r[2] - 1 + len(r[3]) > lo]
        open(p + ".bai", "wb").write(index)
        got = read_alignments(spark, p, regions=regions).orderBy("ord").collect()
        assert [(r.name, r.ref, r.pos, r.seq) for r in got] == want, regions
    ranges = bam.indexed_ranges(p + ".bai", [f"chr_{i}" for i in range(3)],
                                bam.parsed_regions("chr_1:20000-30000"))
    assert 0 < sum(e[0] - b[0] for b, e in ranges) < len(z) / 5
    # without an index the same rows come from a scan; a filter on ref is pushed
    assert read_alignments(spark, p, regions="chr_1", split_bytes=2000).count() == sum(
        r[1] == "chr_1" for r in rows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = read_alignments(spark, p).where("ref = 'chr_1'")
        assert got.count() == sum(r[1] == "chr_1" for r in rows)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_contigs_by_index(spark, tmp_path):
    rows = [(i, f"s_chr{i}p", "acgtn" * (37 * i)) for i in range(9)]
    p = str(tmp_path / "ref.fa")
    lines = "".join(f">{n}\n" + "".join(s[k:k + 60] + "\n" for k in range(0, len(s), 60))
                    for _, n, s in rows)
    open(p, "w").write(lines)
    ask = ["s_chr3p", "s_chr8p", "s_chr0p", "s_nonep"]
    want = {n: s.upper() for _, n, s in rows if n in ask} | {"s_nonep": None}
    scanned = {r.name: r.seq for r in fl.fetch_contigs(spark, p, ask).collect()}
    contigs = spark.createDataFrame(rows, "ord long, name string, seq string")
    index = rf.fasta_index(contigs).orderBy("ord").collect()
    open(p + ".fai", "w").write("".join(
        f"{r.name}\t{r.length}\t{r.offset}\t{r.linebases}\t{r.linewidth}\n" for r in index))
    got = {r.name: r.seq for r in fl.fetch_contigs(spark, "file:" + p, ask).collect()}
    assert got == scanned == want
    with open(p, "r+b") as f:                         # bytes of other contigs are not looked at
        f.seek(index[5].offset)
        f.write(b">>>>>>>>")
    assert {r.name: r.seq for r in fl.fetch_contigs(spark, p, ask).collect()} == want
    with pytest.raises(Exception, match="does not fit"):
        fl.fetch_contigs(spark, p, ["s_chr5p"]).collect()


def test_sam_and_index(spark, tmp_path):
    p = str(tmp_path / "x.sam")
    open(p, "w").write("@HD\tVN:1.6\nq\t16\ts_chr1q\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    r = fl.read_sam(spark, p).first()
    assert (r.read_name, r.flag, r.ref, r.pos, r.mapq, r.cigar, r.seq) == \
        ("q", 16, "s_chr1q", 5, 60, "4M", "ACGT")
    f = str(tmp_path / "x.fai")
    open(f, "w").write("t2t_chr1p\t500000\t17\t60\t61\n")
    r = fl.read_fai(spark, f).first()
    assert (r.samp, r.chr, r.end_offset) == ("t2t", "chr1p", 17 + 500000 + 8334)


def test_motif_file(spark, tmp_path):
    p = str(tmp_path / "k.tsv")
    open(p, "w").write("# c\nCCCTAA\tblue\tC\tcanonical\n\nCCCTGA\tred\tD\ttvr,nofilt\n"
                       "CCTGG\tblue\tC\tcanonical,nanopore_only\n")
    assert mt.MotifTable.read(spark, p, "hifi").kmers == ("CCCTGA", "CCCTAA")
    assert mt.MotifTable.read(spark, p, "ont").canonical == ("CCCTAA", "CCTGG")


def test_allele_tsv_round_trip(spark, tmp_path):
    heads = spark.createDataFrame(
        [("1", ["chr2q"], [900], ["s"], False, 4, "DDDD", 1200, 3),
         ("2", ["chr1p", "chr3q"], [5, 7], ["s", "t"], True, 0, "", 10, 2)],
        "aid string, chrs array<string>, positions array<int>, ref_samps array<string>, "
        "is_interstitial boolean, tvr_len int, tvr_consensus string, tl int, n_reads long")
    reads = spark.createDataFrame(
        [("1", 1200, 9000, "a", 60), ("1", 900, 8000, "b", 0), ("1", 1300, 7000, "c", 3),
         ("2", 10, 5000, "d", 1), ("2", -4, 5000, "e", 2)],
        "aid string, tl int, rlen int, name string, mapq int")
    p = str(tmp_path / "alleles")
    rp.write_allele_tsv(heads, reads, p, Settings())
    h, r = fl.read_allele_tsv(spark, p)
    cols = ["aid", "chrs", "positions", "ref_samps", "is_interstitial", "tvr_len", "tvr_consensus",
            "tl", "n_reads"]
    assert sorted(map(tuple, h.select(cols).collect())) == sorted(map(tuple, heads.select(cols).collect()))
    assert sorted(map(tuple, r.collect())) == sorted(map(tuple, reads.collect()))
    one = rp.filter_alleles(h, r).where("aid = '1'").first()
    assert one.fail_reason == "min_tvr" and one.n_kept == 3


def test_reference_builder(spark, tmp_path):
    sub = "ACGTTGCATGCCGATATCGA" * 100
    seq = "CCCTAA" * 100 + sub + "TTAGGG" * 150
    contigs = spark.createDataFrame([("chr1", seq.lower())], "name string, seq string")
    got = {r.name: r.seq for r in rf.reference_contigs(contigs, "me", mt.human("hifi"), Settings(),
                                                       add_tel=True, rename={"chr1": "chr9"}).collect()}
    assert set(got) == {"me_chr9p", "me_chr9q", "me_tel-chr9p", "me_tel-chr9q", "tel-TAACCC"}
    p, q = got["me_chr9p"], got["me_chr9q"]
    assert len(p) == len(q) == len(seq)
    assert abs(len(p) - len(p.lstrip("N")) - 600) < 60 and p.endswith(sub[-20:] + "TTAGGG" * 150)
    assert abs(len(q) - len(q.rstrip("N")) - 800) < 60 and q.startswith("CCCTAA" * 100)
    out = str(tmp_path / "ref")
    rf.fasta_lines(contigs).write.text(out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert max(len(x) for x in lines) == 60 and "".join(lines[1:]) == seq.lower()


def test_stream_equals_batch(spark, tmp_path):
    seqs = ["ACGTTGCATGCCGATATCGA" * 150 + "TTAGGG" * n for n in (0, 100, 400)]
    rows = [(i, f"r{i}", s, False) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "rid long, name string, seq string, is_sup boolean")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    s = Settings(min_read_len=1000)
    stream = measured_stream(spark.readStream.schema(df.schema).parquet(src), mt.human(), s)
    q = (stream.writeStream.format("memory").queryName("seen").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.rid, r.keep) for r in spark.table("seen").collect()}
    assert got == {(1, True), (2, True)}


def test_index_metadata_and_consensus(spark, tmp_path):
    rows = [(0, "s_chr1p", "ACGTN" * 30), (1, "s_chr1q", "A" * 60), (2, "s_x", "C")]
    contigs = spark.createDataFrame(rows, "ord long, name string, seq string")
    text = "\n".join(r.t for r in contigs.orderBy("ord").select(
        rf.wrapped_record(F.col("name"), F.col("seq")).alias("t")).collect()) + "\n"
    for r in rf.fasta_index(contigs).collect():
        lines = text[r.offset:].split(">")[0].strip().split("\n")
        assert "".join(lines) == rows[r.ord][2] and r.length == len(rows[r.ord][2])
        assert all(len(x) == r.linebases for x in lines[:-1]) and r.linewidth == r.linebases + 1
    got = {r.key: r.value for r in rp.run_settings(spark, Settings(seed=5)).collect()}
    assert got["seed"] == "5" and got["step0.cut"] == "0.2"
    cons = spark.createDataFrame([("c1", "DDC", 2)], "cid string, consensus string, tvr_len int")
    fl.write_fasta(rp.consensus_records(cons), str(tmp_path / "cons"))
    assert [(r.name, r.seq) for r in fl.read_fasta(spark, str(tmp_path / "cons")).collect()] == [
        ("c1_tvr2", "DDC")]
    order = rp.cluster_order(spark.createDataFrame(
        [("b", 5), ("a", 9), ("a", 2), ("c", 1)], "cid string, rid long")).collect()
    assert [r.cid for r in order] == ["a", "c", "b"]
    assert mt.built_in("maize").canonical[0] == "CCCTAAA"
    with pytest.raises(ValueError):
        mt.built_in("unknown")
