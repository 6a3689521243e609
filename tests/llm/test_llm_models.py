"""Classifiers by held-out accuracy, searches by brute force, and the pipeline."""

import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import corpus_pipeline
from endcap.llm import calibration, multi_index, quality, toxicity, vptree
from endcap.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, x string"


def auc(y, p):
    r = pd.Series(p).rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("name,column,of,held,least", [
    ("op5_fourier_quality", "quality", 5, 0, 0.97), ("op8_boosted_toxicity", "toxic", 4, 2, 0.8)])
def test_held_out_accuracy(spark, name, column, of, held, least):
    import zlib
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % of == held for d in got.doc_id]).all()
    m = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert auc(m[column].to_numpy(), m.score.to_numpy()) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_are_scored(spark, module):
    rows = [(1, None, "a", None), (2, "", None, "b"), (3, "you idiot " * 40, "", ""), (None, "x", "", ""),
            (3, "you idiot " * 40, "", ""), (4, "w " * 60_000, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    column = "quality" if module is quality else "toxic"
    some = [(k, k % 2, k) for k in range(6)] + [(None, 1, 1), (3, None, 1), (2, 7, 1)]
    for labels in (some, []):
        got = module.scored(docs, spark.createDataFrame(labels, f"doc_id long, {column} int, lang int"))
        assert got.count() == len(rows) and got.where("score is null or held_out is null").count() == 0
    assert module.scored(docs.limit(0), spark.createDataFrame(
        some, f"doc_id long, {column} int, lang int")).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for module, column, of, held in ((quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)):
        out = quality.remainder(F.col("doc_id"), of) == held
        other = labels.withColumn(column, F.when(out, 1 - F.col(column)).otherwise(F.col(column)))
        a, b = (module.scored(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
        np.testing.assert_allclose(a.score, b.score, atol=1e-9)


def test_isotonic():
    x, y = np.arange(6.0), np.array([0, 2, 1, 3, 2, 9])
    f = calibration.isotonic(x, np.full(6, 10), y)
    p = f(np.linspace(-1, 7, 50))
    assert (np.diff(p) >= 0).all() and 0 <= p[0] < p[-1] <= 1
    assert calibration.isotonic([], [], [])(np.array([1.0]))[0] == 0.5


def test_normal_equations_sum_to_the_whole(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=(200, 3)), r.integers(0, 2, 200)
    df = spark.createDataFrame([([float(v) for v in a], float(b), int(k % 2))
                                for k, (a, b) in enumerate(zip(x, y))],
                               "x array<double>, label double, fold int").repartition(7)
    f = quality.fourier(x.mean(0), x.std(0), 16)
    z = f(x)
    got = sum(quality.normal_equations(df, f).values())
    np.testing.assert_allclose(got, np.c_[z.T @ z, z.T @ y], atol=1e-8)


def test_trees_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    assert auc(y, toxicity.boost(x, y)(x)) > 0.99


# ---- vectors -------------------------------------------------------------------

VEC = T.StructType([T.StructField("vec_id", T.LongType()),
                    T.StructField("embedding", T.ArrayType(T.FloatType())),
                    T.StructField("label", T.IntegerType()), T.StructField("rank", T.StringType()),
                    T.StructField("u", T.StringType()), T.StructField("cid", T.StringType())])


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 10)).astype(np.float32)
    x[200:260] = x[3]                                         # one very common vector
    x[300:340] = x[5] + 0.1 * r.normal(size=(40, 10))         # near copies
    x[350] = 3 * x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None), (1020, [0.0] * 10), (1040, [nan] * 10), (1060, [inf] + [0.0] * 9),
             (1080, []), (1100, [1.0, 2.0]), (1120, [None] + [1.0] * 9), (None, x[3].tolist())]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "r", "u", "c") for i, v in rows], VEC)


@pytest.mark.parametrize("shard,block", [(8192, 4096), (90, 7)])
def test_factor_one_is_exact(spark, vectors, shard, block):
    got = vptree.nearest(frame(spark, vectors), 20, 20, 1.0, shard, block).toPandas()
    x = np.array([v for _, v in vectors[:400]], np.float32).astype(np.float64)
    assert set(got.query_id) == set(range(0, 400, 20))
    for q, g in got.sort_values("rank").groupby("query_id"):
        s = sum((x[:, c] * x[q, c] for c in range(10)), np.zeros(400))   # in the order of SQL
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert g.vec_id.tolist() == order and g["rank"].tolist() == list(range(1, 21))
        np.testing.assert_array_equal(g.score.to_numpy(), s[order])


def exact(x, q, k):
    s = np.zeros((len(q), len(x)))
    for c in range(x.shape[1]):
        s += x[q][:, c][:, None] * x[:, c]
    s[np.arange(len(q)), q] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s))[:, :k]
    return order, np.take_along_axis(s, order, axis=1)


@pytest.mark.parametrize("kind", ["one-hot", "equal scores", "grid", "norms", "common"])
def test_ties_go_to_the_smaller_id(kind):
    r = np.random.default_rng(5)
    if kind == "one-hot":
        x = np.eye(64)
    elif kind == "equal scores":                     # distinct vectors, all of score 0.5 with the first
        x = np.concatenate([[[1.0, 0, 0]], np.c_[np.full(900, 0.5), r.normal(size=(900, 2))]])
    elif kind == "grid":
        x = r.integers(-2, 3, size=(1500, 4)).astype(float)
        x = x[(x != 0).any(axis=1)]
    elif kind == "norms":
        x = r.normal(size=(1200, 6)) * 10.0 ** r.integers(-6, 8, size=(1200, 1))
    else:
        x = np.concatenate([r.integers(0, 2, size=(300, 5)) + 1.0, np.ones((700, 5))])
        x = x[r.permutation(len(x))]
    q = np.arange(0, len(x), 3)
    want, score = exact(x, q, 20)
    for cut in (10**9, 97):                          # one shard, and several merged by (score, id)
        parts = []
        for lo in range(0, len(x), cut):
            ids = np.arange(lo, min(lo + cut, len(x)))
            parts.append(np.stack(vptree.shard_best(ids, x[ids], q, x[q], 20, 1.0)))
        who, cid, s = np.concatenate(parts, axis=1)
        order = np.lexsort((cid, -s, who))
        who, cid, s = who[order], cid[order], s[order]
        kept = np.arange(len(who)) - np.searchsorted(who, who) < 20
        np.testing.assert_array_equal(cid[kept].reshape(len(q), -1), want)
        np.testing.assert_array_equal(s[kept].reshape(len(q), -1), score)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    got = vptree.nearest(frame(spark, rows)).toPandas()
    assert got.groupby("query_id").vec_id.apply(list).to_dict() == {0: [1, 20], 20: [1, 0]}
    assert vptree.nearest(frame(spark, [])).count() == 0
    assert vptree.nearest(frame(spark, [(20, [1.0])])).count() == 0


def test_larger_factors_trade_recall(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 4))
    ids = np.arange(3000)
    want = vptree.shard_best(ids, x, ids[::50], x[::50], 10, 1.0)
    some = vptree.shard_best(ids, x, ids[::50], x[::50], 10, 4.0)
    full = set(zip(*want[:2]))
    assert 0.3 < len(full & set(zip(*some[:2]))) / len(full) <= 1


def test_production_factor_keeps_neighbours_of_low_dimension():
    r = np.random.default_rng(8)
    plane = np.linalg.qr(r.normal(size=(64, 3)))[0].T
    centres = r.normal(size=(40, 3)) * 3
    x = (centres[r.integers(0, 40, 6000)] + r.normal(size=(6000, 3)) * 0.5) @ plane
    ids = np.arange(6000)
    s = x[::30] @ x.T
    s[np.arange(200), ids[::30]] = -np.inf
    best = np.sort(s, axis=1)[:, -20]
    who, got, score = vptree.shard_best(ids, x, ids[::30], x[::30], 20, vptree.FACTOR)[:3]
    hit = s[who, got] >= best[who] - 1e-9
    assert len(got) == 200 * 20 and hit.mean() >= 0.9


def plain_near(rows, threshold=0.9):
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and len(v) == 10
          and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[k][1] for k in ok], np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= threshold
    np.fill_diagonal(hit, False)
    label = np.array([rows[k][0] for k in ok])
    while True:
        new = np.array([min(a, label[h].min()) if h.any() else a for a, h in zip(label, hit)])
        if (new == label).all():
            break
        label = new
    out = {k: (rows[k][0], 0, rows[k][0]) for k in range(len(rows))}
    out.update({k: (rows[k][0], int(h.sum()), int(c)) for k, h, c in zip(ok, hit, label)})
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("cell,members,visitors", [(512, 1024, 4096), (20, 16, 30)])
def test_near_duplicates_equal_brute_force(spark, vectors, monkeypatch, cell, members, visitors):
    monkeypatch.setattr(multi_index, "CELL", cell)
    monkeypatch.setattr(multi_index, "MEMBERS", members)
    monkeypatch.setattr(multi_index, "VISITORS", visitors)
    got = multi_index.near_duplicates(frame(spark, vectors)).toPandas().astype(object)
    got = got.where(got.notna(), None)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.itertuples()), key=str) \
        == plain_near(vectors)
    assert multi_index.near_duplicates(frame(spark, [])).count() == 0


def test_visits_are_in_order_of_distance():
    r = np.random.default_rng(8)
    u = multi_index.normalised(r.normal(size=(50, 6)))
    grid = multi_index.Grid(r.normal(size=(7, 3)), r.normal(size=(9, 3)), 12)
    a, b = grid.halves(u)
    cost = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
    got = grid.visited(u)
    want = np.sort(cost, axis=1)[:, :12]
    np.testing.assert_allclose(np.take_along_axis(cost, got.astype(int), axis=1), want)


# ---- pipeline ------------------------------------------------------------------

def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near duplicates", "secrets", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        counts.append(docs.count())
    assert 0.8 * before < counts[0] < before and 0.8 * counts[0] < counts[1] < counts[0]
    assert counts[2] == counts[1]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert len(out[out.piece == 0]) == counts[3]
    for stage in (s for _, s in corpus_pipeline.STAGES):
        assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).count() == 0


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names


def test_entry_works_without_this_subpackage():
    code = ("import sys, importlib.abc\n"
            "class No(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith(('endcap.llm', 'corpus_pipeline')):\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, No())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries()\n"
            "assert len(q) >= 50 and not [x for x in q if x.startswith('op')] and 'pipeline' not in q\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
