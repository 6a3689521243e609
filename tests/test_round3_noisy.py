"""Findings of round 3 on consensus: strings are spelled by all tasks, few bands are tried."""

import numpy as np
from pyspark.sql import functions as F

from endcap.operators import msa
from endcap.sources import planted


def test_noisy_strings_are_spelled_by_many_tasks(spark):
    rows = planted.noisy_strings(spark, "/root/testdata/sf0.01").select(
        F.spark_partition_id().alias("p"), "rid").groupBy("p").count().collect()
    n = sum(r["count"] for r in rows)
    assert n > 900 and len(rows) >= 8 and max(r["count"] for r in rows) < n / 4


def test_second_band_is_as_wide_as_needed(monkeypatch):
    """A string 150 letters off is aligned like in the whole matrix, in one more band."""
    tried, plain = [], msa._banded

    def noted(lefts, rights, table, width):
        tried.append(width)
        return plain(lefts, rights, table, width)

    rng = np.random.default_rng(4)
    left = "".join(rng.choice(list("DEFGHIK"), 1200))
    right = left[:500] + left[530:800] + "".join(rng.choice(list("DEFGHIK"), 150)) + left[800:]
    table = msa.score_table("C", refine=True)
    want = msa._align_batch([left], [right], table)
    monkeypatch.setattr(msa, "_banded", noted)
    assert msa.align_pairs([(left, right)], table) == want
    assert len(tried) == 2
    tried.clear()
    near = left[:600] + "D" + left[600:]
    assert msa.align_pairs([(left, near)], table) == [plain([left], [near], table, 1200)[0][0]]
    assert len(tried) == 1
