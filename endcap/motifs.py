"""Motif tables: the repeat units looked for, their letters and their roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "A"

# Motif, colour, letter, flags (tab separated, one motif per line).
HUMAN = """\
CCCTAA	blue	C	canonical
CCTGG	blue	C	canonical,nanopore_only
TTTTAA	blue	C	canonical,nanopore_only
CCCTGA	red	D	tvr,nofilt
CCTGA	darkred	E	tvr
CCTTGA	darkred	E	tvr
CGCTGA	darkred	E	tvr
CCGTGA	darkred	E	tvr
CCCTTGA	darkred	E	tvr
CCCTGGA	darkred	E	tvr
CCCAGGA	darkred	E	tvr
CCGCTGA	darkred	E	tvr
CCCTCA	yellow	F	tvr,nofilt
CCTCA	gold	G	tvr,nofilt
CCGTCA	gold	G	tvr,nofilt
CCCCAA	green	H	denoise,tvr
CCCCCA	lightgreen	I	denoise,tvr
CCCAAA	lightgreen	I	denoise,tvr
CCCTCG	tan	K	tvr,nofilt
CCCTAG	orange	L	tvr,nofilt
CCCCTAG	darkorange	M	tvr
CCTAG	darkorange	M	tvr
CCCGAA	violet	N	tvr
CCCGA	darkviolet	P	tvr
CCCCGA	darkviolet	P	tvr
CCCGGA	darkviolet	P	tvr
CCGGAA	darkviolet	P	tvr
CCCCGAA	darkviolet	P	tvr
CCCCAG	purple	R	tvr
CCCTCTAA	cyan	S	tvr,nofilt
CCCATAA	cyan	S	tvr,nofilt
CTCTAA	cyan	S	tvr,nofilt
CGCTAA	cyan	S	tvr,nofilt
CCGTAA	cyan	S	tvr,nofilt
CCTGAA	cyan	S	tvr,nofilt
CCCAGT	cyan	S	tvr,nofilt
CCCGTA	cyan	S	tvr,nofilt
CCCCCG	pink	Q	tvr,subtel-filt
CCCTGG	pink	Q	tvr,subtel-filt
CCCTTA	darkcyan	T	tvr
CCTTAA	darkcyan	T	tvr
CCCTTAA	darkcyan	T	tvr
CCCCTA	slateblue	V	tvr,dubious
CCCCTAA	slateblue	V	tvr,dubious
CCCTAAA	slateblue	V	tvr,dubious
CCCCCTAA	slateblue	V	tvr,dubious
CCCTAAAA	slateblue	V	tvr,dubious
CCCCTACCCTAACCCCTA	slateblue	V	tvr,dubious,hor
CCCCTAACCCTAACCCCTAA	slateblue	V	tvr,dubious,hor
CCTA	darkblue	W	denoise,dubious
CCTAA	darkblue	W	denoise,dubious
CCCTA	darkblue	W	denoise,dubious
CCCTCC	darkgreen	Y	denoise,dubious
CCCCCC	darkgreen	Y	denoise,dubious
CCCAA	darkgreen	Y	denoise,dubious
CCCA	darkgreen	Y	denoise,dubious
CCAA	darkgreen	Y	denoise,dubious
CCA	darkgreen	Y	denoise,dubious
CAA	darkgreen	Y	denoise,dubious
"""

MAIZE = """\
CCCTAAA	blue	C	canonical
CCCTAAAA	darkblue	D	canonical
CCCTAAAAA	darkblue	D	canonical
CCTAAA	green	E	tvr
CTCCTAAA	red	F	tvr
CCCCAAAA	darkcyan	G	denoise,tvr
CCCCAAA	darkcyan	G	denoise,tvr
CCCCAA	darkcyan	G	denoise,tvr
CCCAAAA	darkcyan	G	denoise,tvr
CCAAAA	darkcyan	G	denoise,tvr
"""

NEMATODE = """\
GCCTAA	blue	C	canonical
CCTAA	darkblue	D	tvr
TTAGC	red	E	tvr
"""

_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def reverse_complement(seq: str) -> str:
    bad = set(seq) - set("ACGTN")
    if bad:
        raise ValueError(f"not a nucleotide sequence: {sorted(bad)}")
    return seq.translate(_COMPLEMENT)[::-1]


@dataclass(frozen=True)
class MotifTable:
    """The motif dimension, longest motif first. A few dozen rows by nature."""

    kmers: tuple[str, ...]
    colors: tuple[str, ...]
    letters: tuple[str, ...]
    flags: tuple[tuple[str, ...], ...]
    canonical: tuple[str, ...]
    canonical_letter: str

    @classmethod
    def parse(cls, text: str, read_type: str = "ont") -> MotifTable:
        lines = [ln for ln in text.splitlines() if ln.strip() and not ln.startswith("#")]
        return cls.from_rows([tuple(ln.split("\t")[:4]) for ln in lines], read_type)

    @classmethod
    def from_rows(cls, rows: list[tuple[str, ...]], read_type: str = "ont") -> MotifTable:
        kept = []
        for kmer, color, letter, flagtext in rows:
            flags = tuple(flagtext.strip().split(","))
            if "pacbio_only" in flags and read_type != "hifi":
                continue
            if "nanopore_only" in flags and read_type != "ont":
                continue
            if letter == UNKNOWN:
                raise ValueError(f"letter {UNKNOWN} is reserved for unknown sequence")
            kept.append((kmer, color, letter, flags))
        canon = [r for r in kept if "canonical" in r[3]]
        if not canon:
            raise ValueError("no motif is flagged canonical")
        table = sorted(set(kept), key=lambda r: (len(r[0]), *r), reverse=True)
        kmers, colors, letters, flags = zip(*table)
        return cls(kmers, colors, letters, flags, tuple(r[0] for r in canon), canon[0][2])

    @classmethod
    def read(cls, spark: SparkSession, path: str, read_type: str = "ont",
             limit: int = 4096) -> MotifTable:
        """Load a motif TSV. The row limit proves it is small enough for every task."""
        rows = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
        rows = rows.withColumn("_ord", F.monotonically_increasing_id()).orderBy("_ord")
        got = [r.value for r in rows.select("value").limit(limit + 1).collect()]
        if len(got) > limit:
            raise ValueError(f"a motif table holds at most {limit} rows")
        return cls.parse("\n".join(got), read_type)

    @property
    def kmers_rc(self) -> tuple[str, ...]:
        return tuple(reverse_complement(k) for k in self.kmers)

    @property
    def canonical_rc(self) -> tuple[str, ...]:
        return tuple(reverse_complement(k) for k in self.canonical)

    def superstrings(self) -> list[list[int]]:
        """For each motif, the other motifs that contain it."""
        return [[j for j, big in enumerate(self.kmers) if j != i and small in big]
                for i, small in enumerate(self.kmers)]

    def letters_with(self, flag: str) -> str:
        return "".join(sorted({x for x, f in zip(self.letters, self.flags) if flag in f}))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, k, rc, c, x, list(f)) for i, (k, rc, c, x, f) in enumerate(
            zip(self.kmers, self.kmers_rc, self.colors, self.letters, self.flags))]
        return spark.createDataFrame(
            rows, "ki int, kmer string, kmer_rc string, color string, letter string, "
                  "flags array<string>")

    def super_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, j) for i, js in enumerate(self.superstrings()) for j in js]
        return spark.createDataFrame(rows, "ki int, super_ki int")


BUILT_IN = {"human": HUMAN, "maize": MAIZE, "nematode": NEMATODE}


def built_in(species: str, read_type: str = "ont") -> MotifTable:
    if species not in BUILT_IN:
        raise ValueError(f"built-in motif tables: {', '.join(sorted(BUILT_IN))}")
    return MotifTable.parse(BUILT_IN[species], read_type)


def human(read_type: str = "ont") -> MotifTable:
    return built_in("human", read_type)
