"""Steps of round 3: one-pass matching, bounded batches, comparisons made once, greedy merging."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from endcap import motifs as mt
from endcap.functions.ship import ship
from endcap.operators import hits as ht
from endcap.operators import signal as sg


def odd_reads(n: int = 60) -> list[str]:
    r = random.Random(7)
    parts = ["TTAGGG", "GGGGGG", "CCCTCCC", "N", "ACNGT", "TCAGGG", "x",
             "CCCCTAACCCTAACCCCTAACCCTAACCCCTAA", "CCCCTACCCTAACCCCTACCCTAACCCCTA"]
    made = ["".join(r.choice("ACGT") for _ in range(r.randrange(400)))
            + "".join(r.choice(parts) for _ in range(r.randrange(50))) for _ in range(n)]
    return [*made, "", "A", "CAA", "C" * 40]


def test_matcher_finds_what_the_words_find_alone():
    m = mt.human("ont")
    for words in (m.kmers, m.kmers_rc, m.canonical):
        for seq in odd_reads():
            starts, word = ht.matcher(words).find(seq)
            want = [(k, x.start()) for k, w in enumerate(words) for x in re.finditer(w, seq)]
            assert list(zip(word.tolist(), starts.tolist())) == want


def test_joined_runs_equal_the_relational_steps(spark):
    m = mt.human("ont")
    reads = spark.createDataFrame(list(enumerate(odd_reads())), "rid long, seq string")
    want = ht.join_touching(ht.drop_covered(ht.raw_hits(reads, m), m)).toPandas()
    got = ht.joined_runs(reads, m).toPandas()
    by = ["rid", "ki", "s", "e"]
    pd.testing.assert_frame_equal(got[by].sort_values(by, ignore_index=True),
                                  want[by].sort_values(by, ignore_index=True))
    assert "Exchange" not in ht.joined_runs(reads, m)._jdf.queryExecution().toString()


def test_smoothing_is_the_periodic_transform():
    x = np.repeat(np.random.default_rng(3).integers(-100, 100, 60) / 100, 20)[:1187]
    centre = 4 + 2 * np.arange(594)
    taps = (centre[:, None] - np.arange(8)[None, :]) % 1188
    low, high = sg.decompose(x)[-1], np.append(x, x[-1])[taps] @ sg.DB4_HIGH
    assert np.array_equal(low, high)
    assert np.allclose(sg.recompose(sg.decompose(x))[:1187], x)


def test_batches_for_python_are_bounded_in_bytes(spark):
    ship(spark)
    rows = spark.range(0, 4000, 1, 1).withColumn("s", F.repeat(F.lit("ACGTACGT"), 1000))

    @F.pandas_udf("long")
    def letters(col: pd.Series) -> pd.Series:
        return pd.Series([col.str.len().sum()] * len(col))

    assert rows.select(letters("s").alias("n")).agg(F.max("n")).first()[0] < 5_000_000


def test_arms_of_a_short_contig_share_one_signal(spark, monkeypatch):
    from endcap.config import Settings
    from endcap.operators import reference as rf
    from endcap.operators.signal import terminal_length
    seen, plain = spark.sparkContext.accumulator(0), rf.telomere_regions

    def counted(*args):
        seen.add(1)
        return plain(*args)

    monkeypatch.setattr(rf, "telomere_regions", counted)
    m, s = mt.human("ont"), Settings()
    seqs = {f"c{i}": "CCCTAA" * (60 + 10 * i) + "ACGTTGCATT" * 150 + "TTAGGG" * 90 for i in range(6)}
    contigs = spark.createDataFrame(list(seqs.items()), "name string, seq string")
    got = {(r.name, r.arm): r.tl for r in rf.arm_lengths(rf.contig_arms(contigs), m, s).collect()}
    assert seen.value == 6
    assert got == {(n, arm): terminal_length(q, m.kmers, m.kmers_rc, s, s.min_tel_score,
                                             at_left=arm == "p")[0]
                   for n, q in seqs.items() for arm in "pq"}
    assert min(got.values()) > 300
