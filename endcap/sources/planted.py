"""Reads, alignments and alleles derived from the general test tables.

The test tables hold no sequence data. Letters of each document are mapped to
nucleotides; a stretch of subtelomere shared by the allele, variant repeats and a
telomere of known length follow; every second read is turned around. One read per
document, of the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from endcap.operators.grouping import task_count

READS = """
with base as (
  select doc_id as rid, concat('s', cast(doc_id % 16 as varchar(20))) as sample,
         concat(source, '/', md5(text)) as name,
         translate(upper(regexp_replace(text, '[^A-Za-z]', ''{g})),
                   'BDEFHIJKLMNOPQRSUVWXYZ', 'CGATCGATCGATCGATCGATCG') as letters,
         cast(floor(doc_id / 16.0) as int) % 4 as al,
         cast(doc_id % 9 as int) as k9, cast(doc_id % 23 as int) as k23
  from documents),
parts as (
  select *,
    case al when 0 then concat(repeat('TCAGGG', 12), repeat('TTAGGG', 3), repeat('CTAGGG', 9))
            when 1 then concat(repeat('TGAGGG', 16), repeat('TCAGGG', 6), repeat('TTAGGG', 2),
                               repeat('TGAGGG', 4))
            when 2 then concat(repeat('TTCGGG', 10), repeat('CTAGGG', 14))
            else concat(repeat('CGAGGG', 7), repeat('TCAGGG', 7), repeat('TTCGGG', 9)) end
    as allele_tvr
  from base),
built as (
  select *,
    case when k9 = 4 then '' when k23 = 7 then '' else
      concat(allele_tvr, case when rid % 27 = 1 then 'CTAGGG' else '' end) end as tvr,
    case when k9 = 4 then 0 when k23 = 7 then 60 else 190 + cast(rid % 61 as int) end as n_tel,
    repeat(translate(concat(md5(concat(sample, 'a', cast(al as varchar(9)))),
                            md5(concat(sample, 'b', cast(al as varchar(9)))),
                            md5(concat(sample, 'c', cast(al as varchar(9)))),
                            md5(concat(sample, 'd', cast(al as varchar(9)))),
                            md5(concat(sample, 'e', cast(al as varchar(9)))),
                            md5(concat(sample, 'f', cast(al as varchar(9))))),
                     '0123456789abcdef', 'ACGTACGTACGTACGT'), 16) as shared
  from parts),
turned as (
  select *, concat(letters, shared, tvr, repeat('TTAGGG', n_tel),
                   case when k23 = 7 and k9 <> 4 then reverse(shared) else '' end) as seq_q
  from built)
select rid, rid as ord, sample, name, al,
       length(tvr) as tvr_bp, 6 * n_tel as tel_bp,
       rid % 29 = 3 as is_sup,
       case when rid % 2 = 1 then reverse(translate(seq_q, 'ACGT', 'TGCA')) else seq_q end as seq
from turned
"""

# a string of variant letters per source, and a canonical tail that differs from row to row
VARIANT = """translate(concat(md5(concat('a', source)), md5(concat('b', source)), md5(concat('c', source)),
                   md5(concat('d', source)), md5(concat('e', source))),
            '0123456789abcdef', 'DEFGDEFGDEFGDEFG')"""
NOISY_TRUTH = f"""
select distinct source as cid,
  {VARIANT} as variant
from documents where source is not null
"""


def noisy_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, rid, tvrtel): one string per document, its source's letters with 3.5 errors in a
    hundred (substitutions, deletions and insertions in equal shares, told by hashes).

    Rows are a few bytes before their letters are spelled, so they are spread by number."""
    docs = table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_id")
    whole = docs.repartition(task_count(docs), "doc_id").selectExpr(
        "source as cid", "doc_id as rid", f"concat({VARIANT}, repeat('C', cast(100 + doc_id % 61 as int))) as t")
    letter = "translate(substr(h, 3, 1), '0123456789abcdef', 'DEFGDEFGDEFGDEFG')"
    return whole.selectExpr("cid", "rid", f"""array_join(transform(
      transform(sequence(1, length(t)), i -> struct(substr(t, i, 1) as x,
                                                    md5(concat(rid, ':', i)) as h)),
      s -> case when substr(s.h, 1, 2) < '03' then {letter.replace('h,', 's.h,')}
                when substr(s.h, 1, 2) < '06' then ''
                when substr(s.h, 1, 2) < '09' then concat(s.x, {letter.replace('h,', 's.h,')})
                else s.x end), '') as tvrtel""")


SAM = """
select event_id as aln_no,
  case when user_id % 11 = 0
       then concat(case when event_id % 2 = 0 then 'interstitial-left_' else 'interstitial-right_' end,
                   cast(5000 + user_id as varchar(20)), '_r_', cast(user_id as varchar(20)))
       else concat('cluster-', cast(user_id as varchar(20)), '_read-', cast(event_id % 40 as varchar(20)),
                   '_r_', cast(event_id % 40 as varchar(20))) end as read_name,
  cast(case event_type when 'error' then 4 when 'view' then 16 when 'click' then 2064 else 0 end as int)
    as flag,
  case when event_type = 'error' then '*' else
    concat('s', cast(event_id % 2 as varchar(20)), '_chr',
           cast(1 + (user_id + (event_id % 3) * (event_id % 5)) % 22 as varchar(20)),
           case when user_id % 2 = 0 then 'p' else 'q' end) end as ref,
  cast(1000 + user_id * 700 + event_id % 311 as int) as pos,
  cast(event_id % 61 as int) as mapq,
  case when event_type = 'error' then '*' else
    concat(case when event_id % 3 = 0 then '' else concat(cast(1 + event_id % 50 as varchar(20)), 'S') end,
           cast(500 + event_id % 1500 as varchar(20)), 'M',
           cast(1 + event_id % 7 as varchar(20)), 'I',
           cast(3 + event_id % 70 as varchar(20)), '=',
           cast(1 + event_id % 9 as varchar(20)), 'D',
           cast(2 + event_id % 5 as varchar(20)), 'X',
           case when event_id % 4 = 1 then concat(cast(1 + event_id % 33 as varchar(20)), 'H') else '' end)
    end as cigar,
  repeat('ACGTA', cast(300 + event_id % 90 as int)) as seq
from events
"""

ALLELE_HEADS = """
select o_orderkey as aid,
  concat('chr', case when o_orderkey % 29 = 0 then 'U'
                     when o_orderkey % 24 = 22 then 'X' when o_orderkey % 24 = 23 then 'Y'
                     else cast(1 + o_orderkey % 24 as varchar(20)) end,
         case when o_orderkey % 29 = 0 then 'q' when o_orderkey % 48 < 24 then 'p' else 'q' end)
    as chr0,
  case when o_orderkey % 29 = 0 then '-' else concat('s', cast(o_custkey % 3 as varchar(20))) end
    as ref0,
  cast(case when o_orderkey % 29 = 0 then 0 else (o_custkey * 7919) % 500000 end as int) as pos0,
  o_orderkey % 31 = 5 as is_interstitial,
  cast(case when o_orderkey % 13 = 0 then 0 else (o_orderkey * 37) % 900 end as int) as tvr_len
from orders
"""

ALLELE_READS = """
select l_orderkey as aid, cast(l_linenumber as int) as ln,
  cast(l_quantity * 150 as int) - 1200 - cast(l_partkey % 17 as int)
    + case when l_partkey % 41 = 0 then 19000 else 0 end as tl,
  cast(4000 + l_partkey * 7 % 9000 + l_suppkey % 50 as int) as rlen,
  concat(cast(l_orderkey as varchar(20)), '-', cast(l_partkey as varchar(20)), '-',
         cast(l_linenumber as varchar(20))) as name,
  cast(l_partkey % 61 as int) as mapq
from lineitem
"""

REGIONS = """
select concat('s', cast(p_partkey % 2 as varchar(20)), '_chr', cast(1 + p_partkey % 22 as varchar(20)),
              case when p_size % 2 = 0 then 'p' else 'q' end) as contig,
  cast(p_partkey * 53 % 110000 as int) as start,
  cast(p_partkey * 53 % 110000 + 300 + p_size * 20 as int) as "end"
from part
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; a file too small to be split is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """Run one of the texts above on a table of a folder."""
    sql = (sql.replace("{g}", "").replace('"end"', "`end`").replace(f"from {name}", "from {src}"))
    return spark.sql(sql, src=table(spark, sf_dir, name))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed count keeps filters above the derived columns, computed once."""
    return load(spark, sf_dir, READS, "documents").observe(
        "planted", F.count(F.lit(1)).alias("n"))


def sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, SAM, "events")


def allele_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, ALLELE_HEADS, "orders")


def allele_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, ALLELE_READS, "lineitem")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, REGIONS, "part")


def oracle(sql: str) -> str:
    """The same text for the checking engine, whose replace needs a flag for all matches."""
    return sql.strip().replace("{g}", ", 'g'")
