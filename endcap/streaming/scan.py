"""The stateless first steps on a stream of reads.

Filtering and measuring look at one read at a time, so they run unchanged on a
streaming DataFrame. Clustering needs the complete set of reads and does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from endcap.config import Settings
from endcap.motifs import MotifTable
from endcap.operators.scan import telomere_reads
from endcap.operators.signal import filter_flags, measure


def measured_stream(reads: DataFrame, motifs: MotifTable, settings: Settings) -> DataFrame:
    """Telomere reads of a stream with their measures and filter flags, in append mode."""
    tel = telomere_reads(reads, motifs, settings)
    long_enough = tel.where(f"length(seq) >= {settings.min_read_len}")
    return filter_flags(measure(long_enough, motifs, settings), settings)
