"""The registered queries as plain SQL for the checking engine."""

from __future__ import annotations

from endcap import motifs as mt
from endcap.config import CHROM_RANK, Settings
from endcap.operators.colorvec import Roles
from endcap.operators.report import length_edges
from endcap.sources import planted

S = Settings()
M = mt.human(S.read_type)
ROLES = Roles.of(M)


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


def _letters(letters: str) -> str:
    return ", ".join(repr(x) for x in letters)


READS = f"reads as ({planted.oracle(planted.READS)})"
# reads turned with the telomere to the right
QREADS = READS + """,
qreads as materialized (
  select rid, sample, name,
         case when rid % 2 = 1 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as seq
  from reads)"""
# long enough reads with a planted telomere, one per name; k23 = 7 marks an inner telomere only
TRUTH = f"""
with {READS},
truth as (
  select rid, sample, al, cast(rid % 23 as int) as k23 from reads
  where not is_sup and length(seq) >= {S.min_read_len} and rid % 9 <> 4
  qualify row_number() over (partition by sample, name order by ord desc) = 1)"""
MOTIFS = "motif(ki, kmer, kmer_rc, letter) as (values " + _rows(
    list(zip(range(len(M.kmers)), M.kmers, M.kmers_rc, M.letters))) + ")"
SUPER = "bigger(ki, super_ki) as (values " + _rows(
    [(i, j) for i, js in enumerate(M.superstrings()) for j in js]) + ")"


def hits(src: str, word: str, name: str = "hit") -> str:
    """Non-overlapping matches of each motif: pieces between matches, summed up."""
    return f"""
{name}_piece as (
  select rid, ki, length({word}) as k, unnest(string_split(seq, {word})) as piece,
         generate_subscripts(string_split(seq, {word}), 1) as idx
  from {src}, motif),
{name}_end as (
  select rid, ki, k, idx,
         cast(sum(length(piece)) over (partition by rid, ki order by idx) as int)
         + cast(idx * k as int) as e,
         count(*) over (partition by rid, ki) as n
  from {name}_piece),
{name} as materialized (
  select rid, ki, cast(e - k as int) as s, cast(e as int) as e from {name}_end where idx < n)"""


FINAL = f"""
with {QREADS}, {MOTIFS}, {SUPER}, {hits('qreads', 'kmer_rc')},
big as (
  select h.rid, b.ki, h.s as bs, h.e as be, unnest(range((greatest(h.s - 20, 0)) // 64, (h.e - 1) // 64 + 1)) as bin
  from hit h join bigger b on h.ki = b.super_ki),
free as materialized (
  select * from hit h where not exists (
    select 1 from big b where b.rid = h.rid and b.ki = h.ki and b.bin = h.s // 64
      and h.s < b.be and b.bs < h.e)),
brk as (
  select *, case when lag(e) over (partition by rid, ki order by s) = s then 0 else 1 end as new
  from free),
numbered as (
  select *, sum(new) over (partition by rid, ki order by s) as run from brk),
joined as materialized (
  select rid, ki, min(s) as s, max(e) as e from numbered group by rid, ki, run),
final as materialized (
  select rid, ki, s, least(e, coalesce(min(s) over (
    partition by rid order by s range between 1 following and unbounded following), e)) as e
  from joined)"""

STATS = """
select rid, ki, count(*) as n, cast(sum(s) as bigint) as sum_s, cast(sum(e - s) as bigint) as bases
from {} group by rid, ki"""

# colour vector as a full partition into runs of one letter
RUNS = FINAL + """,
colored as (
  select f.rid, f.s, f.e, m.letter,
         lag(f.e) over w as pe, lag(m.letter) over w as pl
  from final f join motif m using (ki) window w as (partition by f.rid order by f.s)),
marked as (
  select *, sum(case when pe = s and pl = letter then 0 else 1 end)
              over (partition by rid order by s) as run from colored),
painted as (
  select rid, min(s) as s, max(e) as e, min(letter) as letter from marked group by rid, run),
gaps as (
  select rid, coalesce(lag(e) over (partition by rid order by s), 0) as s, s as e, 'A' as letter
  from painted
  union all
  select q.rid, coalesce(max(p.e), 0), length(q.seq), 'A'
  from qreads q left join painted p using (rid) group by q.rid, q.seq),
runs as materialized (
  select * from painted union all select * from gaps where e > s)"""

COVER = """
{name} as materialized (
  select distinct rid, unnest(range(s, e)) as i from {hits})"""

DENSITY = f"""
with {QREADS}, {MOTIFS}, {hits('qreads', 'kmer_rc', 'hq')}, {hits('qreads', 'kmer', 'hp')},
{COVER.format(name='cq', hits='hq')},
{COVER.format(name='cp', hits='hp')},
base as (select rid, length(seq) as n, unnest(range(0, length(seq))) as i from qreads),
flag as (
  select b.rid, b.n, b.i, case when cq.i is null then 0 else 1 end as hq,
         case when cp.i is null then 0 else 1 end as hp
  from base b left join cq using (rid, i) left join cp using (rid, i)),
win as materialized (
  select rid, n, i,
         cast(sum(hq) over w as bigint) as q, cast(sum(hp) over w as bigint) as p
  from flag
  window w as (partition by rid order by i rows between 1 following and {S.window} following)
  qualify i < n - {S.window})"""

TYPED = f"""
with sam as ({planted.oracle(planted.SAM)}),
ops as (
  select *, regexp_extract_all(cigar, '\\d+[MIDNSHPX=]') as o from sam),
cig as (
  select *,
    case when regexp_matches(cigar, '^\\d+[SH]') then cast(regexp_extract(cigar, '^(\\d+)', 1) as int) else 0 end as lead_clip,
    cast(coalesce(list_sum(list_transform(list_filter(o, lambda x: regexp_matches(x, '[MX=D]$')), lambda x: cast(x[1:-2] as int))), 0) as int) as ref_span,
    cast(coalesce(list_sum(list_transform(list_filter(o, lambda x: regexp_matches(x, '[MX=I]$')), lambda x: cast(x[1:-2] as int))), 0) as int) as read_span,
    case when len(o) > 1 and regexp_matches(cigar, '[SH]$') then cast(regexp_extract(cigar, '(\\d+)[SH]$', 1) as int) else 0 end as tail_clip
  from ops),
typed as materialized (
  select aln_no, length(seq) as seq_len,
    case when read_name like 'cluster-%' then 'subtel' when read_name like 'interstitial-left%' then 'left' else 'right' end as kind,
    try_cast(regexp_extract(read_name, '^cluster-(\\d+)_', 1) as bigint) as cluster,
    try_cast(regexp_extract(read_name, '^interstitial-[a-z]+_(\\d+)_', 1) as int) as read_len,
    regexp_replace(read_name, '^[^_]*_[^_]*_', '') as read,
    case when un then 0 when rev then tail_clip else lead_clip end as read_pos1,
    case when un then length(seq) when rev then tail_clip + read_span else lead_clip + read_span end as read_pos2,
    case when un then '*' else ref end as ref,
    case when un then 0 when rev then pos + ref_span else pos end as pos1,
    case when un then length(seq) when rev then pos else pos + ref_span end as pos2,
    case when rev then 'REV' else 'FWD' end as orient,
    case when un then 0 else mapq end as mapq
  from (select *, (ref = '*' or flag & 4 <> 0) as un, flag & 16 <> 0 as rev from cig))"""

TOP = TYPED + """,
ranked as (
  select *, abs(read_pos2 - read_pos1) as span,
    row_number() over (partition by cluster, read order by abs(read_pos2 - read_pos1) desc, mapq desc,
      greatest(read_pos1, read_pos2) - seq_len desc, aln_no desc) as rn
  from typed where kind = 'subtel'),
top as materialized (select * from ranked where rn = 1)"""

SCORES = TOP + """,
per as (
  select cluster, ref, cast(sum(abs(pos1 - pos2) * (mapq + 1)) as bigint) as weighted,
    count(*) as n_reads, cast(trunc(quantile_cont(pos2, 0.5)) as int) as anchor
  from top where ref <> '*' group by cluster, ref),
scored as materialized (
  select *, weighted / sum(weighted) over (partition by cluster) as share from per)"""

REGIONS = f"""region_dim as ({planted.oracle(planted.REGIONS)})"""
KNOWN = """exists (
  select 1 from region_dim r where r.contig = {contig} and {pos} between r.start - 2000 and r."end" + 2000)"""

ALLELES = f"""
with head as ({planted.oracle(planted.ALLELE_HEADS)}),
aread as ({planted.oracle(planted.ALLELE_READS)}),
est as (
  select aid, cast(trunc(quantile_cont(tl, 0.75)) as int) as tl, count(*) as n_reads
  from aread group by aid),
allele as materialized (select * from head join est using (aid))"""

RANK = "case " + " ".join(
    f"when chr0[1:-2] = '{k}' then {v}" for k, v in CHROM_RANK.items()) + " else 99 end"

FILTERED = ALLELES + """,
kept as (
  select aid, count(*) filter (where tl > -2000 and tl < 20000) as n_kept,
         max(tl) filter (where tl > -2000 and tl < 20000) as max_kept
  from aread group by aid),
judged as materialized (
  select a.*, n_kept, max_kept,
    case when is_interstitial then 'interstitial' when tvr_len < {min_tvr} then 'min_tvr'
         when n_kept = 0 then 'no_atl_in_range' when max_kept < 100 then 'min_maxatl'
         when n_kept < 3 then 'min_reads' else 'pass' end as reason
  from allele a join kept using (aid))"""

CLASS = """case when chr0 in ('chrUq', 'chrBq') then 'unmapped' when tvr_len + tl < 100 then 'short'
  when is_interstitial then 'interstitial' else 'pass' end"""

COUNTS = """
  cast((length(seq) - length(replace(seq, '{f}', ''))) / 12 as int) as n_fwd,
  cast((length(seq) - length(replace(seq, '{r}', ''))) / 12 as int) as n_rev""".format(
    f=M.canonical[0] * 2, r=M.canonical_rc[0] * 2)

ISLANDS = """
  select rid, cast(coalesce(sum(greatest(0, e - greatest(s, coalesce(far, 0)))), 0) as int) as n from (
    select rid, s, e, max(e) over (partition by rid order by s, e
      rows between unbounded preceding and 1 preceding) as far from {h} h
      join (values {ks}) c(ki) using (ki))
  group by rid"""


def _canon(kmers: tuple[str, ...]) -> str:
    return ", ".join(f"({i})" for i, k in enumerate(M.kmers) if k in kmers)


def texts() -> dict[str, str]:
    edges = length_edges()
    bins = "case " + " ".join(f"when length >= {e!r} then {i + 1}" for i, e in
                              reversed(list(enumerate(edges[:-1])))) + " end"
    q: dict[str, str] = {}
    q["reads_scan_stats"] = f"""
with {READS}, c as (select *, {COUNTS} from reads where length(seq) > 0)
select sample, count(*) filter (where is_sup) as n_sup, count(*) filter (where not is_sup) as n_all,
  count(*) filter (where not is_sup and (n_fwd >= 8 or n_rev >= 8)) as n_tel,
  cast(coalesce(sum(length(seq)) filter (where not is_sup), 0) as bigint) as bp_all,
  cast(coalesce(sum(length(seq)) filter (where not is_sup and (n_fwd >= 8 or n_rev >= 8)), 0) as bigint) as bp_tel,
  cast(floor(coalesce(sum(length(seq)) filter (where not is_sup), 0) / 3.1e9 + 0.5) as bigint) as coverage
from c group by sample"""
    q["tel_read_filter"] = f"""
with {READS}, c as (select *, {COUNTS} from reads where length(seq) > 0 and not is_sup)
select rid, n_fwd, n_rev, length(seq) as len from c where n_fwd >= 8 or n_rev >= 8"""
    q["read_dedupe_last"] = f"""
with {READS}
select sample, name, min(ord) as ord, max(rid) as rid, md5(arg_max(seq, ord)) as seq_md5
from reads where length(seq) >= {S.min_read_len} group by sample, name"""
    q["reverse_complement"] = f"""
with {READS}
select rid, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) as rc_md5,
  not regexp_matches(seq, '[^ACGTN]') as valid from reads"""
    q["downsample"] = f"""
with {READS}
select sample, name, ord, rid from reads
qualify row_number() over (partition by sample order by md5('{S.seed}:' || name), ord) <= 25"""
    q["motif_hits"] = (f"with {QREADS}, {MOTIFS}, {hits('qreads', 'kmer_rc')}"
                       + STATS.format("hit"))
    q["motif_hits_nonoverlap"] = FINAL + STATS.format("joined")
    q["motif_hits_final"] = FINAL + STATS.format("final")
    q["canonical_bases"] = f"""
with {READS}, {MOTIFS}, {hits('reads', 'kmer', 'hp')}, {hits('reads', 'kmer_rc', 'hq')},
p as ({ISLANDS.format(h='hp', ks=_canon(M.canonical))}),
q as ({ISLANDS.format(h='hq', ks=_canon(M.canonical))})
select rid, coalesce(p.n, 0) as bases_p, coalesce(q.n, 0) as bases_q
from reads left join p using (rid) left join q using (rid)"""
    q["density_window"] = DENSITY + """
select r.rid, greatest(length(r.seq) - 100, 0) as n_windows, coalesce(cast(sum(q) as bigint), 0) as sum_hits,
  coalesce(max(q), 0) as max_hits, count(q) filter (where q >= 50) as n_half
from qreads r left join win using (rid) group by r.rid, r.seq"""
    q["tel_regions"] = DENSITY + """,
cls as (
  select rid, i, case when p::double / 100 - q::double / 100 >= 0.5 then 1
                      when p::double / 100 - q::double / 100 <= -0.5 then -1 else 0 end as c, n
  from win where i < n - 200 and n >= 200),
brk as (
  select *, case when c = lag(c) over (partition by rid order by i) then 0 else 1 end as new from cls),
run as (select *, sum(new) over (partition by rid order by i) as g from brk),
reg as (
  select rid, g, min(c) as c, count(*) as w, max(i) = max(any_value(n)) over (partition by rid) - 201 as is_last
  from run group by rid, g),
fixed as (select rid, c, case when is_last and w = 1 then 0 else w end as w from reg)
select r.rid, count(c) as n_regions, cast(coalesce(sum(w) filter (where c = -1), 0) as int) as q_bases,
  coalesce(max(w) filter (where c = -1), 0) as longest_q
from qreads r left join fixed using (rid) group by r.rid"""
    q["color_vector"] = RUNS + """
select q.rid, length(any_value(q.seq)) as len,
  md5(coalesce(string_agg(repeat(letter, cast(e - s as int)), '' order by s), '')) as cvec_md5
from qreads q left join runs using (rid) group by q.rid"""
    q["rle_runs"] = RUNS + """
select rid, letter, count(*) as n_runs, max(e - s) as longest, cast(sum(e - s) as bigint) as bases
from runs group by rid, letter"""
    q["denoise"] = RUNS + f""",
live as (select * from runs where not (e - s < 10 and letter in ({_letters(ROLES.denoise)}))),
near as (
  select *, case when lag(letter) over w = letter and letter in ({_letters(ROLES.merge)})
                  and s - lag(e) over w <= 50 then 0 else 1 end as new
  from live window w as (partition by rid order by s)),
grp as (select *, sum(new) over (partition by rid order by s) as g from near),
seg as (select rid, g, min(s) as s, max(e) as e, min(letter) as letter from grp group by rid, g),
txt as (
  select *, s - coalesce(lag(e) over (partition by rid order by s), 0) as gap from seg),
whole as (
  select rid, max(e) as last, string_agg(repeat('C', cast(gap as int)) || repeat(letter, cast(e - s as int)), '' order by s) as t
  from txt group by rid),
filled as (
  select rid, case when length(seq) = 0 then '' else
    coalesce(t, '') || repeat('C', cast(length(seq) + 1 - coalesce(last, 0) as int)) end as o
  from qreads left join whole using (rid))
select rid, length(o) as len, md5(o) as clean_md5 from filled"""
    q["density_boundary"] = RUNS + f""",
known as (
  select rid, unnest(range(s, e)) as i from runs where letter not in ({_letters(ROLES.subtel)})),
base as (select rid, length(seq) as n, unnest(range(0, length(seq))) as i from qreads),
flag as (select b.*, case when k.i is null then 1 else 0 end as u from base b left join known k using (rid, i)),
win as materialized (
  select rid, n, i, cast(sum(u) over (partition by rid order by i rows between 1 following and 100 following) as int) as u
  from flag qualify i < n - 100),
pick as (
  select rid, min(i) filter (where u <= 12) as first_low,
         case when min(u) < 100 then arg_min(i, u * 1000000 + i) end as lowest
  from win group by rid)
select rid, cast(coalesce(first_low, lowest) as int) as pos from qreads left join pick using (rid)"""
    q["cumulative_boundary"] = RUNS + f""",
hitpos as (
  select r.rid, length(q.seq) - 1 - unnest(range(r.s, r.e)) as i
  from runs r join qreads q using (rid) where letter in ({_letters(ROLES.tvr)})),
cum as (
  select rid, i, row_number() over (partition by rid order by i) as c,
         count(*) over (partition by rid) as t from hitpos),
pick as (
  select rid, min(i) as pos from cum where t >= 100 and c::double / t::double >= 0.125 group by rid)
select rid, cast(coalesce(pos, length(seq)) as int) as pos from qreads left join pick using (rid)"""
    q["column_consensus"] = """
with aligned as (
  select source || '/' || lang as cid, doc_id as row_no, rtrim(
    translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')),
              'BDEFHIJKLMNOPQRSUVWXYZ', 'CGA-CGA-CGA-CGA-CGA-CG'), '-') as t
  from documents),
total as (select cid, count(*) as n_rows, min(row_no) as first_row from aligned group by cid),
ch as (
  select cid, row_no, unnest(string_split(t, '')) as ch, generate_subscripts(string_split(t, ''), 1) - 1 as pos
  from aligned where length(t) > 0),
cnt as (
  select cid, pos, ch, count(*) as n, min(row_no) as f from ch group by cid, pos, ch),
rnk as (
  select *, row_number() over (partition by cid, pos order by n desc, f) as r
  from cnt where ch <> '-'),
cov as (
  select cid, pos, sum(n) as cover, coalesce(sum(n) filter (where ch = '-'), 0) as gaps
  from cnt group by cid, pos),
best as (
  select cid, pos, max(ch) filter (where r = 1) as c1, max(n) filter (where r = 1) as n1,
    max(ch) filter (where r = 2) as c2, max(n) filter (where r = 2) as n2,
    arg_max(ch, (case ch when 'C' then 1 when 'A' then -1 else 0 end) * 1000 + ascii(ch)) as tied
  from rnk group by cid, pos),
vote as (
  select cov.cid, cov.pos, case
    when cover < 3 then 'C'
    when n1 >= 3 and c1 not in ('C', 'A') then c1
    when n2 >= 3 and c2 not in ('C', 'A') then c2
    when gaps / n_rows > 0.60 then null
    when c2 is null then c1
    when n1 > n2 then c1 else tied end as letter
  from cov join total using (cid) left join best on cov.cid = best.cid and cov.pos = best.pos
  where n_rows >= 3
  union all
  select ch.cid, pos, ch from ch join total using (cid) where n_rows < 3 and row_no = first_row),
text as (
  select cid, string_agg(letter, '' order by pos) as consensus from vote where letter is not null group by cid)
select cid, length(consensus) as len, md5(consensus) as consensus_md5 from text"""
    q["cigar_parse"] = TYPED + """
select aln_no, lead_clip, ref_span, read_span, tail_clip from cig where cigar <> '*'"""
    q["sam_orient"] = TYPED + """
select aln_no, kind, cluster, read, read_pos1, read_pos2, ref, pos1, pos2, orient, mapq from typed"""
    q["best_alignment"] = TOP + """
select t.cluster, t.read, aln_no, span, mapq, ref, pos1, pos2, best_mapq
from top t join (
    select cluster, read, max(mapq) as best_mapq from typed where kind = 'subtel' group by cluster, read)
  using (cluster, read)"""
    q["anchor_scores"] = SCORES + """
select cluster, ref, weighted, n_reads, anchor, round(share, 9) as share from scored"""
    q["anchor_calls"] = SCORES + """,
one as (
  select *, split_part(ref, '_', 1) as samp, split_part(ref, '_', 2) as chr from scored where share >= 0.15
  qualify row_number() over (partition by cluster, split_part(ref, '_', 2) order by share desc, ref desc) = 1)
select cluster, string_agg(chr, ',' order by share desc, ref desc) as chr,
  string_agg(cast(anchor as varchar), ',' order by share desc, ref desc) as position,
  string_agg(samp, ',' order by share desc, ref desc) as ref_samp
from one group by cluster"""
    q["interstitial_annotate"] = TYPED + f""", {REGIONS}
select aln_no, ref as contig, pos2 as pos from typed where ref <> '*' and {KNOWN.format(contig='ref', pos='pos2')}"""
    q["fusion_calls"] = TYPED + f""", {REGIONS},
flank as (
  select *, case when kind = 'left' then pos2 else pos1 end as p from typed
  where kind in ('left', 'right') and ref <> '*'),
best as (
  select * from flank where not {KNOWN.format(contig='ref', pos='p')}
  qualify row_number() over (partition by read, kind order by mapq desc,
    abs(read_pos2 - read_pos1) desc, seq_len desc, read_len desc, ref desc, p desc) = 1)
select a.read, a.ref as left_ref, a.p as left_pos, a.mapq as left_mapq,
  b.ref as right_ref, b.p as right_pos, b.mapq as right_mapq
from best a join best b on a.read = b.read and a.kind = 'left' and b.kind = 'right'
where a.mapq > 0 and b.mapq > 0"""
    q["allele_rows"] = f"""
with {READS}, r as (
  select sample || '/' || cast(al as varchar) as aid, tvr_bp, tel_bp from reads where tvr_bp > 0),
c as (select aid, min(tvr_bp) as tvr_len from r group by aid)
select aid, any_value(tvr_len) as tvr_len,
  cast(trunc(quantile_cont(tvr_bp + tel_bp - tvr_len, 0.75)) as int) as tl, count(*) as n_reads
from r join c using (aid) group by aid"""
    q["tl_estimators"] = f"""
with r as ({planted.oracle(planted.ALLELE_READS)})
select aid, cast(trunc(avg(tl)) as int) as tl_mean, cast(trunc(quantile_cont(tl, 0.5)) as int) as tl_median,
  cast(trunc(quantile_cont(tl, 0.75)) as int) as tl_p75, max(tl) as tl_max,
  list_sort(list(tl), 'desc')[least(2, count(*))] as tl_2fromtop
from r group by aid"""
    q["near_alleles"] = ALLELES + """
select aid, cast(count(*) over (partition by chr0, ref0 order by pos0
  range between 1000 preceding and 1000 following) - 1 as bigint) as n_near from allele"""
    q["allele_filter_reasons"] = FILTERED.format(min_tvr=100) + """
select reason, count(*) as n_alleles, cast(sum(n_kept) as bigint) as n_kept from judged group by reason"""
    q["report_classes"] = ALLELES + f"""
select {CLASS} as report, count(*) as n_alleles, cast(sum(n_reads) as bigint) as n_reads
from allele group by 1"""
    q["final_order"] = ALLELES + f"""
select aid, {RANK} as chr_rank, chr0[-1:] as arm, -tl as neg_tl, pos0 from allele"""
    q["read_n50"] = f"""
with {READS}, c as (
  select sample, length(seq) as len, sum(length(seq)) over (partition by sample order by length(seq) desc
    rows between unbounded preceding and current row) as cum,
    sum(length(seq)) over (partition by sample) as tot from reads)
select sample, max(len) as n50 from c where cum * 2 >= tot group by sample"""
    q["summary_metrics"] = FILTERED.format(min_tvr=-1) + f""",
good as (select * from judged where reason = 'pass'),
used as (select rlen from aread join good using (aid)),
cum as (
  select rlen, sum(rlen) over (order by rlen desc rows between unbounded preceding and current row) as c,
         sum(rlen) over () as t from used),
cls as (select {CLASS} as report, n_reads from allele)
select (select count(*) from good) as num_alleles,
  (select count(*) from judged where reason <> 'pass') as num_alleles_fail,
  (select cast(trunc(avg(tl)) as int) from good) as tl_mean,
  (select cast(trunc(quantile_cont(tl, 0.5)) as int) from good) as tl_median,
  (select count(*) from good where tl < 1000) as tl_short,
  (select count(*) from used) as num_telreads,
  (select cast(trunc(avg(rlen)) as int) from used) as telread_mean_length,
  (select max(rlen) from cum where c * 2 >= t) as telread_n50_length,
  (select cast(coalesce(sum(n_reads), 0) as bigint) from cls where report = 'unmapped') as fail_reads_unmapped,
  (select cast(coalesce(sum(n_reads), 0) as bigint) from cls where report = 'short') as fail_reads_maxatl,
  (select cast(coalesce(sum(n_reads), 0) as bigint) from cls where report = 'interstitial') as fail_reads_interstitial"""
    q["readlen_histogram"] = f"""
with {READS}, c as (select *, length(seq) as length, {COUNTS} from reads),
both_series as (
  select 'all' as series, length from c
  union all select 'tel', length from c where length > 0 and not is_sup and (n_fwd >= 8 or n_rev >= 8))
select series, cast(case when length < {edges[0]!r} then 0 when length > {edges[-1]!r} then {len(edges)}
  else {bins} end as int) as bin, count(*) as n from both_series group by 1, 2"""
    q["atl_by_arm"] = ALLELES + f""",
top as (
  select *, case when chr0 in ('chrUq', 'chrBq') then 'unanchored' else chr0 end as arm_label
  from allele where not is_interstitial),
slots as (
  select *, row_number() over (partition by arm_label order by {RANK}, chr0[-1:], -tl, pos0, aid) as slot
  from top qualify slot <= 2)
select arm_label, cast(slot as int) as slot, aid, count(*) as n,
  cast(sum(t.tvr_len + r.tl) as bigint) as sum_atl
from slots t join aread r using (aid) group by 1, 2, 3"""
    q["allele_tsv_rows"] = ALLELES + """
select cast(aid as varchar) || case when is_interstitial then 'i' else '' end as allele_id,
  any_value(chr0) as chr, cast(any_value(pos0) as varchar) as position, any_value(ref0) as ref_samp,
  cast(any_value(a.tl) as varchar) as tl,
  string_agg(cast(r.tl as varchar), ',' order by r.tl, r.rlen, r.name, r.mapq) as "read_TLs",
  string_agg(cast(r.rlen as varchar), ',' order by r.tl, r.rlen, r.name, r.mapq) as read_lengths,
  cast(any_value(tvr_len) as varchar) as tvr_len
from allele a join aread r using (aid) group by aid, is_interstitial"""
    q["time_groups"] = """
with e as (select user_id, cast(floor(epoch(ts)) as bigint) as t from events),
b as (select *, case when t - lag(t) over (partition by user_id order by t) > 7200 then 1 else 0 end as new from e),
g as (select *, cast(sum(new) over (partition by user_id order by t rows unbounded preceding) as bigint) as grp from b)
select user_id, grp, count(*) as n, min(t) as t0, max(t) as t1 from g group by user_id, grp"""
    q["span_groups"] = """
with e as (
  select user_id, cast(floor(epoch(ts)) as bigint) as s,
         cast(floor(epoch(ts)) as bigint) + cast(trunc(value * 100) as bigint) as e from events),
b as (
  select *, case when s > max(e) over (partition by user_id order by s, e
    rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from e),
g as (select *, cast(sum(new) over (partition by user_id order by s, e rows unbounded preceding) as bigint) as grp from b)
select user_id, grp, count(*) as n, min(s) as s, max(e) as e from g group by user_id, grp"""
    q["ref_mask"] = f"""
with {READS}, t as (
  select rid, tel_bp, case when rid % 2 = 1 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as seq from reads),
m as (
  select rid, case when rid % 3 = 0
    then repeat('N', cast(least(tel_bp, length(seq)) as int)) || substr(seq, tel_bp + 1)
    else substr(seq, 1, greatest(length(seq) - tel_bp, 0)) || repeat('N', cast(least(tel_bp, length(seq)) as int)) end as m
  from t)
select rid, md5(m) as masked_md5, greatest((length(m) + 59) // 60, 1) as n_lines,
  md5(regexp_replace(regexp_replace(m, '(.{{60}})', '\\1|', 'g'), '\\|$', '')) as lines_md5
from m"""
    named = f"with {READS}, r as (select * from reads where seq <> '')"
    q["fasta_records"] = named + """
select cast(rid as varchar) || ' ' || sample as name, length(seq) as len, md5(seq) as seq_md5 from r"""
    q["fastq_records"] = named + """
select cast(rid as varchar) as name, length(seq) as len, md5(seq) as seq_md5, length(seq) as qual_len,
  md5(translate(seq, 'ACGT', '@+I!')) as qual_md5 from r"""
    q["fasta_index"] = f"""
with {READS}, s as (
  select rid, cast(rid as varchar) as name, length(seq) as length,
    length(cast(rid as varchar)) + 2 as head, (length(seq) + 59) // 60 as n_lines from reads)
select name, length, cast(head + coalesce(sum(head + length + n_lines) over (
    order by rid rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
  60 as linebases, 61 as linewidth from s"""
    q["stage_lengths"] = f"""
with {READS}, c as (select *, length(seq) as length, {COUNTS} from reads),
every as (
  select 'all' as series, length from c
  union all select 'tel', length from c where length > 0 and not is_sup and (n_fwd >= 8 or n_rev >= 8)
  union all select 'final', rlen from ({planted.oracle(planted.ALLELE_READS)}))
select series, length, count(*) as n from every group by 1, 2"""
    q["allele_tsv_back"] = ALLELES + """
select cast(aid as varchar) as aid, r.name, r.tl, r.rlen, r.mapq, a.tvr_len,
  count(*) over (partition by aid) as n_reads, a.tvr_len as cons_len
from allele a join aread r using (aid)"""
    q["cluster_listing"] = f"""
with {READS}, c as (
  select sample || '/' || cast(al as varchar) as cid, count(*) as n, min(rid) as least_rid
  from reads group by 1)
select *, row_number() over (order by n desc, least_rid) as place from c"""
    # planted truth: what was built into the reads, without any signal or alignment
    q["read_filter_flags"] = TRUTH + """
select sample, count(case when k23 = 7 then 1 end) as short_tel, cast(0 as bigint) as nontel,
  cast(0 as bigint) as short_subtel, count(case when k23 <> 7 then 1 end) as keep
from truth group by sample"""
    q["noisy_consensus"] = f"""
with truth as ({planted.NOISY_TRUTH})
select cid, length(variant) as len, md5(variant) as variant_md5 from truth"""
    q["equal_variants"] = TRUTH + """
select sample as gid, count(*) as n, min(rid) as least_rid from truth where k23 <> 7
group by sample, al"""
    q["clustered_reads"] = TRUTH + f"""
select sample, count(*) as n, min(rid) as least_rid from truth where k23 <> 7
group by sample, al having count(*) >= {S.min_reads}"""
    return q
