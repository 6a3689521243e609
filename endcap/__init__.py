"""endcap: allele-level telomere analytics for long reads, as Spark jobs."""

from endcap.config import Settings
from endcap.motifs import MotifTable

__all__ = ["MotifTable", "Settings"]
