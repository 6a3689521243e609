from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from endcap.config import Settings
from endcap.functions.durable import durable
from endcap.operators import alleles as al
from endcap.operators import msa


def test_size_of_a_checkpoint_is_that_of_its_files(spark):
    rows = spark.range(1000).select("id", F.col("id").alias("x"))
    sizes = []
    for _ in range(6):      # each round joins what the last one left with itself
        rows = durable(rows.join(rows.select("id", F.col("x").alias("y")), "id")
                       .select("id", (F.col("x") + F.col("y")).alias("x")))
        sizes.append(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert max(sizes) < 1 << 20
    got = rows.orderBy("id").collect()
    assert [tuple(r) for r in got] == [(i, 64 * i) for i in range(1000)]


def test_checkpoint_without_rows(spark):
    none = durable(spark.range(5).where("id > 9").select("id", F.lit("a").alias("s")))
    assert none.isEmpty() and none.columns == ["id", "s"]
    assert none.join(spark.range(5), "id", "right").count() == 5


def heads(spark, rows):
    return spark.createDataFrame(rows, "aid long, chrs array<string>, positions array<int>, ref_samps "
                                 "array<string>, tvr_consensus string, tl int, n_reads long")


def many_heads(spark, n):
    rng = np.random.default_rng(5)
    units = ["DDDDDD", "FFFFFF", "LLLLLL"]
    return heads(spark, [
        (i, [None if i % 41 == 0 else f"chr{i % 2 + 1}q"], [None if i % 37 == 0 else int(rng.integers(0, 9000))],
         ["s"], "" if i % 19 == 0 else units[i % 3] * (4 + int(rng.integers(0, 4))) + "C" * int(rng.integers(0, 9)),
         None if i % 29 == 0 else int(rng.integers(0, 60)), int(rng.integers(1, 9))) for i in range(n)])


def roots(df, settings):
    return sorted(map(tuple, al.merge_near(df, settings).collect()), key=str)


def test_merging_in_one_task_and_in_rounds_agree(spark):
    one = many_heads(spark, 150)
    twice = one.unionByName(one.where("aid % 5 = 0"))       # rows that come twice
    got = roots(twice, Settings())
    assert got == roots(twice, replace(Settings(), alleles_in_task=0))
    assert {a for a, _ in got} == set(range(150)) and sum(a != r for a, r in got) > 30


def test_pairs_of_alleles_are_not_listed_where_a_task_holds_them(spark, monkeypatch):
    """Alleles at one place have about 45,000 pairs; what is written must follow the alleles."""
    written = []

    def counted(f):
        def run(df):
            out = f(df)
            written.append(out.count())
            return out
        return run

    for name in {"durable", "stored"} & set(dir(al)):
        monkeypatch.setattr(al, name, counted(getattr(al, name)))
    df = heads(spark, [(i, ["chr1q"], [i], ["s"], "DDDDDD" * 5 + "C" * (i % 7), 50, 1) for i in range(300)])
    assert len({r for _, r in roots(df, Settings())}) < 100
    assert max(written) <= 2 * 300


def test_choices_of_long_alignments_are_kept_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    a, b = ("".join(rng.choice(list("ACDEF"), 2500)) for _ in range(2))
    table = msa.score_table("C", refine=True)
    want = msa._banded([a, a], [b, b[:900]], table, 2500)
    made = []

    def zeros(shape, *args, **kinds):
        out = np.empty(shape, *args, **kinds)
        out.fill(0)
        made.append(out.nbytes)
        return out

    monkeypatch.setattr(msa, "TRACE_BYTES", 1 << 16)
    monkeypatch.setattr(msa.np, "zeros", zeros)
    got = msa._banded([a, a], [b, b[:900]], table, 2500)
    assert got[0] == want[0] and list(got[1]) == list(want[1])
    assert max(made) < 5 << 20          # all choices at once are 25 MB
