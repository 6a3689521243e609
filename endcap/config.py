"""Run settings.

Defaults equal the published command-line defaults, but strings are compared whole;
``Settings.published`` has the published prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Labels of reads without an anchor, and the order of chromosomes.
UNANCHORED = "chrUq"
BLANK = "chrBq"
CHROM_RANK = {
    **{f"chr{n}": n for n in range(1, 23)},
    "chrX": 23, "chrY": 24, "chrM": 25, "chrF": 26, "chrB": 27, "chrU": 28,
}
MAX_MAPQ = 60
GENOME_BP = 3.1e9


@dataclass(frozen=True)
class ClusterStep:
    """One clustering pass: compared prefix, shuffles behind the null score, cut.

    A prefix of 0 or less stands for the whole string.
    """

    prefix: int
    shuffles: int
    cut: float


PUBLISHED_PREFIXES = {"step0": 1000, "step1": 2000, "step2": 3000, "subtel": 3000, "final": 1000}


@dataclass(frozen=True)
class Settings:
    read_type: str = "ont"
    min_read_len: int = 4000
    min_canonical_hits: int = 8
    min_reads: int = 3
    tl_method: str = "p75"
    downsample: int = -1
    # terminal filters; 0 switches a filter off
    filt_tel: int = 400
    filt_nontel: int = 100
    filt_sub: int = 1000
    # signal
    window: int = 100
    power: float = 0.5
    min_tel_score: int = 100
    min_interstitial: int = 100
    min_fusion_flank: int = 1000
    # clustering
    step0: ClusterStep = ClusterStep(-1, 2, 0.200)
    step1: ClusterStep = ClusterStep(-1, 3, 0.150)
    step2: ClusterStep = ClusterStep(-1, 3, 0.100)
    collapse: ClusterStep = ClusterStep(-1, 3, 0.050)
    subtel: ClusterStep = ClusterStep(-1, 3, 0.200)
    final: ClusterStep = ClusterStep(-1, 1, 100.0)
    near_cut: float = 0.050
    near_bp: int = 1000
    fast: bool = False
    skip_subtel: bool = False
    seed: int = 12345
    # anchoring and reporting
    anchor_share: float = 0.150
    known_region_buffer: int = 2000
    min_report_atl: int = 100
    ploidy: int = 2
    # distinct strings of a group up to which one task links it; larger groups are linked in
    # rounds over many tasks, with the same result
    group_in_task: int = 384
    # alleles of a contig with linked variant parts that one task merges; more go in rounds
    alleles_in_task: int = 1 << 18
    tile: int = 32

    def __post_init__(self) -> None:
        if self.read_type not in ("hifi", "ont"):
            raise ValueError("read_type must be hifi or ont")
        if self.min_reads < 1:
            raise ValueError("min_reads must be at least 1")

    @classmethod
    def published(cls, **others) -> Settings:
        """Settings with the published prefixes of compared strings."""
        got = cls(**others)
        return replace(got, **{name: replace(getattr(got, name), prefix=n)
                               for name, n in PUBLISHED_PREFIXES.items() if name not in others})

    def refine_steps(self) -> list[ClusterStep]:
        if self.fast:
            return [ClusterStep(self.step2.prefix, 1, self.step2.cut)]
        return [self.step1, self.step2]

    def first_step(self) -> ClusterStep:
        return ClusterStep(self.step0.prefix, 1, self.step0.cut) if self.fast else self.step0
