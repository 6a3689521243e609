"""Read and reference files as DataFrames.

``reads`` tables have: file, ord, name, seq, qual, is_sup. ``ord`` grows along a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endcap.functions.seq import file_format
from endcap.sources.storage import exists, opened

FILE_SHIFT = 42
ROW_MASK = (1 << 33) - 1


def check_inputs(paths: list[str]) -> None:
    """Refuse doubled paths, which would count reads twice."""
    if len(set(paths)) != len(paths):
        raise ValueError("an input path is given twice")


def _name(raw: Column) -> Column:
    return F.trim(F.replace(raw, F.lit("\t"), F.lit(" ")))


def _position() -> Column:
    """Order within a file: where the split starts plus the row's number in the task."""
    row = F.monotonically_increasing_id().bitwiseAND(ROW_MASK)
    return F.col("_metadata.file_block_start") + row


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records. Splittable: records part at a line starting with '>'."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), _position().alias("ord"))
    text = F.regexp_replace(F.ltrim("value"), "^>", "")
    lines = F.split(text, "\r?\n")
    seq = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x)), "")
    return raw.select("file", "ord", _name(lines[0]).alias("name"), seq.alias("seq"),
                      F.lit("").alias("qual"), F.lit(False).alias("is_sup")).where("name <> ''")


def _lines(text: str) -> Column:
    """The lines of a text; a pattern is needed only where it holds carriage returns."""
    return F.when(F.contains(text, F.lit("\r")), F.split(text, "\r?\n")).otherwise(F.split(text, "\n"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a task in their order as (file, blk, ord, head, rest): a piece of three lines
    and one of one line right behind it are a row, other pieces a row of their own."""
    last = None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        names = ["file", "blk", "ord", "head", "rest"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        found = []
        for file, blk, no, value, n in zip(*(c.to_pylist() for c in batch.columns)):
            behind = last is not None and last[:3] == (file, blk, no - 1)
            if n == 1 and behind:
                found.append((*last, value))
                last = None
                continue
            if last is not None:
                found.append((*last, None))
            last = (file, blk, no, value) if n == 3 else None
            if n == 1:
                found.append((file, blk, no, None, value))
        yield rows(found)
    if last is not None:
        yield rows([(*last, None)])


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Strict four-line FASTQ records. Splittable: records part at a line starting with '@'.

    A quality line may start so too. Then the record comes as two pieces behind one another,
    of three lines and of one. They are put together by the task that reads both; where a split
    ends between them, by their order among the few pieces left.
    """
    text = F.when(F.endswith("value", F.lit("\n")) | F.endswith("value", F.lit("\r")),
                  F.rtrim("value", F.lit("\r\n"))).otherwise(F.col("value"))
    raw = spark.read.option("lineSep", "\n@").text(path).select(
        text.alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("blk"), _position().alias("ord"))
    # the first record's own '@' is still there
    first = (F.col("blk") == 0) & F.startswith("value", F.lit("@")) & F.contains("value", F.lit("\n"))
    pieces = raw.withColumn("value", F.when(first, F.substring("value", 2, 1 << 30)).otherwise(
        F.col("value"))).select("file", "blk", "ord", "value", _lines("value").alias("l"))

    def records(df: DataFrame, qual: Column) -> DataFrame:
        return df.select("file", "ord", _name(F.col("l")[0]).alias("name"),
                         F.trim(F.coalesce(F.get("l", 1), F.lit(""))).alias("seq"),
                         F.trim(F.coalesce(qual, F.lit(""))).alias("qual"),
                         F.lit(False).alias("is_sup"))

    parts = F.size("l").isin(1, 3)
    whole = records(pieces.where(~parts), F.get("l", 3))
    met = (pieces.where(parts).select("file", "blk", "ord", "value", F.size("l").alias("n"))
           .mapInArrow(_put_together, "file string, blk long, ord long, head string, rest string")
           .select("file", "blk", "ord", _lines("head").alias("l"), "rest"))
    inside = met.where("l is not null and rest is not null")
    # at most one head and one tail of a split are left; a head meets the tail numbered next
    order = Window.partitionBy("file").orderBy("blk", "ord")
    edge = met.where("l is null or rest is null").withColumn("no", F.row_number().over(order))
    heads = edge.where("l is not null").drop("rest")
    tails = edge.where("l is null").drop("l")
    apart = heads.join(tails.select("file", (F.col("no") - 1).alias("no"), "rest"),
                       ["file", "no"], "left")
    alone = tails.join(heads.select("file", (F.col("no") + 1).alias("no")), ["file", "no"],
                       "left_anti").withColumn(
        "l", F.array(F.regexp_replace("rest", "^@", "")))         # a name and nothing else
    split = inside.unionByName(apart.select(*inside.columns)).unionByName(alone.select(*inside.columns))
    quality = F.when(F.size("l") > 1, F.concat(F.lit("@"), F.col("rest")))
    return whole.unionByName(records(split, quality)).where("name <> ''")


def read_any(spark: SparkSession, paths: list[str], kind: str | None = None) -> DataFrame:
    """Reads of several files; ``ord`` follows the order of the paths.

    The format follows from each path's ending unless ``kind`` (fasta, fastq or bam) names it.
    """
    from endcap.sources.bam import read_bam
    check_inputs(paths)
    kinds = spark.createDataFrame([(p,) for p in paths], "path string").select(
        "path", file_format(F.col("path")).alias("kind"))
    found = {p: kind for p in paths} if kind else {
        r.path: r.kind for r in kinds.collect()}          # one row per given path
    readers = {"fasta": read_fasta, "fastq": read_fastq, "bam": read_bam}
    out = None
    for no, path in enumerate(paths):
        if found[path] not in readers:
            raise ValueError(f"cannot read {path}: format {found[path]} is not supported")
        part = readers[found[path]](spark, path).select(
            "file", "ord", "name", "seq", "qual", "is_sup")
        part = part.withColumn("ord", F.col("ord") + F.lit(no << FILE_SHIFT))
        out = part if out is None else out.unionByName(part)
    return out


SAM_COLUMNS = ("read_name", "flag", "ref", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of SAM text: the columns the anchoring operators expect."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).where("value not like '@%' and value <> ''")
    rows = raw.select(*[f[i].alias(c) for i, c in enumerate(SAM_COLUMNS)],
                      _position().alias("aln_no"))
    return rows.select("aln_no", "read_name", F.col("flag").cast("int"), "ref",
                       F.col("pos").cast("int"), F.col("mapq").cast("int"), "cigar", "seq")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """FASTA index with the sample and arm that contig names carry."""
    schema = "name string, length long, offset long, linebases int, linewidth int"
    got = spark.read.schema(schema).option("sep", "\t").csv(path)
    return (got.withColumn("samp", F.split_part("name", F.lit("_"), F.lit(1)))
            .withColumn("chr", F.split_part("name", F.lit("_"), F.lit(2)))
            .withColumn("end_offset", F.col("offset") + F.col("length")
                        + F.ceil(F.col("length") / F.col("linebases"))))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Reference contigs, upper case: (name, seq)."""
    return read_fasta(spark, path).select("name", F.upper("seq").alias("seq"))


def fetch_contigs(spark: SparkSession, path: str, names: DataFrame | list[str],
                  index: str | None = None) -> DataFrame:
    """(name, seq) of named contigs, upper case; ``seq`` is null for names the file lacks.

    With an index (``path`` + ".fai" by default) each task reads the bytes of its contigs and
    no others. Without one, and for gzip files, whose bytes cannot be sought, the file is scanned.
    """
    if isinstance(names, list):
        names = spark.createDataFrame([(n,) for n in names], "name string")
    names = names.select("name").distinct()
    index = index or path + ".fai"
    if path.endswith(".gz") or not exists(index):
        return names.join(read_contigs(spark, path), "name", "left")
    places = (names.join(read_fai(spark, index), "name", "left")
              .select("name", "length", "offset", "linebases", "linewidth")
              .repartition("name"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(path) as f:
            for pdf in frames:
                for r in pdf.itertuples(index=False):
                    yield pd.DataFrame({"name": [r.name], "seq": [_letters(f, r)]})

    return places.mapInPandas(read, "name string, seq string")


def _letters(f, place) -> str | None:
    """Letters of one contig by its index row."""
    if pd.isna(place.length):
        return None
    n, at, bases, width = (int(x) for x in place[1:])
    if not n:
        return ""
    size = (n - 1) // bases * width + (n - 1) % bases + 1
    got = f.read_at(size, at).translate(None, b"\r\n").upper().decode()
    if len(got) != n or ">" in got:
        raise ValueError(f"the index does not fit the file at {place.name}")
    return got


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Known interstitial regions: contig, start, end, label (tab separated)."""
    return (spark.read.schema("contig string, start int, end int, label string")
            .option("sep", "\t").option("comment", "#").csv(path))


def read_allele_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The allele TSV as (heads, reads). Rows of one allele's parts come together again."""
    raw = spark.read.option("sep", "\t").option("header", True).option("nullValue", "").csv(path)
    tl = next(c for c in raw.columns if c.startswith("TL_"))
    ids = F.split("allele_id", ",")
    base = raw.select(
        F.split("#chr", ",").alias("chrs"),
        F.transform(F.split("position", ","), lambda x: x.cast("int")).alias("positions"),
        F.split("ref_samp", ",").alias("ref_samps"),
        F.regexp_replace(ids[0], "i$", "").alias("aid"),
        F.exists(ids, lambda x: F.endswith(x, F.lit("i"))).alias("is_interstitial"),
        F.col(tl).cast("int").alias("tl"), F.col("tvr_len").cast("int").alias("tvr_len"),
        F.coalesce("tvr_consensus", F.lit("")).alias("tvr_consensus"),
        F.arrays_zip(*[F.split(c, ",").alias(a) for c, a in (
            ("read_TLs", "tl"), ("read_lengths", "rlen"), ("read_mapq", "mapq"),
            ("supporting_reads", "name"))]).alias("r"))
    reads = base.select("aid", F.inline("r")).select(
        "aid", F.col("tl").cast("int").alias("tl"), F.col("rlen").cast("int").alias("rlen"),
        "name", F.col("mapq").cast("int").alias("mapq"))
    # a row's cells tell its number of reads: no second pass over the file, and no row per read
    rows = base.withColumn("n", F.coalesce(F.size("r"), F.lit(0)).cast("long")).where("n > 0")
    heads = rows.groupBy("aid").agg(
        *[F.first(c).alias(c) for c in base.columns if c not in ("aid", "r")],
        F.sum("n").alias("n_reads"))
    return heads, reads


def write_fasta(records: DataFrame, path: str, gzip: bool = True) -> None:
    """Records (name, seq) as FASTA text, one sequence line each."""
    (records.where(F.length("seq") > 0)
     .select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq"))
     .write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path))
