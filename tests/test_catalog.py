"""Registered queries against their SQL, and the whole way against the planted truth."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from endcap import Settings
from endcap import motifs as mt
from endcap.plans import calling
from endcap.sources import planted

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        number = df[c].dtype.kind in "iufb" or str(df[c].dtype).startswith(("Int", "Float", "bool"))
        df[c] = df[c].astype(float).round(8) if number else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, want = plain(QUERIES[name](spark, SF).toPandas()), plain(con.execute(SQL[name]).df())
    assert len(want) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["fusion_flanks", "read_filter_flags", "reference_arms", "terminal_tl"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_calling_recovers_planted_alleles(spark):
    reads = planted.reads(spark, SF).where("rid % 16 in (0, 6)")     # two of the planted samples
    got = calling.call_alleles(reads, mt.human(), Settings(min_reads=2))
    heads = {r.aid: r for r in got.heads.collect()}
    rows = got.members.groupBy("cid").agg(
        F.countDistinct("sample", "al").alias("kinds"), F.count("*").alias("n"),
        F.min("tel_bp").alias("low"), F.max("tel_bp").alias("high")).collect()
    assert len(rows) >= 3 and got.reads.count() == got.members.count()
    for r in rows:
        assert r.kinds == 1
        if r.cid in heads and len(heads[r.cid].merged) == 1:
            head = heads[r.cid]
            assert head.n_reads == r.n and r.low - 50 <= head.tl <= r.high + 50
