"""Quality scores: random Fourier features over document statistics, ridge, isotonic.

Each document becomes a row of statistics of its letters, words and lines. Random Fourier
features of the standardised row approximate a Gaussian kernel. The normal equations of
ridge regression are summed per partition, then over partitions by matrix row, for two
folds of the labelled rows; the folds' sum gives the weights, and each fold scored by the
other's weights gives honest raw scores for isotonic calibration (over a histogram of
fixed width). Only one small matrix per fold reaches the driver.

Defined cases: null text is empty; an empty text has all statistics 0 and is scored like
any other; a null ``doc_id`` has no label and counts as not held out; repeated rows are
scored each; labels null or outside 0 and 1 are not learned from. Without any learned
label every score is 0.5. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endcap.functions.durable import durable
from endcap.llm import words as wd
from endcap.llm.calibration import Isotonic, isotonic

FEATURES, RIDGE, WIDTH = 384, 1.0, 0.35
BINS, LOW, HIGH = 2048, -0.5, 1.5
#: Partitions, and groups of partitions, whose sums one group adds.
FAN = 256

_UPPER = [range(65, 91)]
_CLASSES = {
    "upper": _UPPER, "lower": [range(97, 123)], "digit": [range(48, 58)],
    "other_letter": [range(128, 256)], "space": [[32]], "line": [[10]],
    "stop": [[44, 46, 59, 58]], "shout": [[33, 63]], "bar": [[124, 47, 92, 95]],
    "symbol": [[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 96, 123, 125, 126]],
    "quote": [[34, 39, 40, 41, 45, 91, 93]],
}


def _share_distinct(h: np.ndarray, row: np.ndarray, edges: np.ndarray
                    ) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values over values, and the share of the most frequent one."""
    n = np.diff(edges)
    order = np.lexsort((h, row))
    s, r = h[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(s)))
    owner = r[at]
    kinds = np.bincount(owner, minlength=len(n))
    top = wd.per_row(size, np.searchsorted(owner, np.arange(len(n) + 1)), np.maximum)
    d = np.maximum(n, 1)
    return np.where(n > 0, kinds / d, 0.0), top / d


def statistics(column: pa.Array) -> np.ndarray:
    """Rows of document statistics (rows x statistics)."""
    buf, offsets = wd.text_bytes(column)
    starts, ends, first = wd.words_of(buf, offsets)
    n, size = np.diff(first), np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    length = (ends - starts).astype(np.int64)
    h = wd.word_hashes(buf, starts, ends)
    words, b = np.maximum(n, 1), np.maximum(size, 1)
    cols = [np.log1p(n), np.log1p(size)]
    for ranges in _CLASSES.values():
        lut = np.zeros(256, np.uint8)
        for r in ranges:
            lut[list(r)] = 1
        cols.append(wd.per_row(lut[buf], offsets) / b)
    mean = wd.per_row(length, first) / words
    cols += [mean, np.sqrt(np.maximum(wd.per_row(length**2, first) / words - mean**2, 0)),
             np.log1p(wd.per_row(length, first, np.maximum)),
             wd.per_row((length <= 3).astype(np.int64), first) / words,
             wd.per_row((length >= 14).astype(np.int64), first) / words]
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    cols.append(wd.per_row(same, first) / words)
    distinct, top = _share_distinct(h, row, first)
    cols += [distinct * np.log1p(n), distinct, top]
    three = wd.inside(first, 3)
    r3 = row[:len(three)][three]
    d3, t3 = _share_distinct(wd.runs(h, 3)[three], r3, np.searchsorted(r3, np.arange(len(n) + 1)))
    cols += [d3, t3]
    # bytes that begin a word and are capitals; bytes that end a word and are no letters
    if len(starts):
        begin, end = buf[starts], buf[ends - 1]
        cap = ((begin >= 65) & (begin <= 90)).astype(np.int64)
        odd = ((end < 48) | ((end > 57) & (end < 65)) | ((end > 90) & (end < 97))
               | ((end > 122) & (end < 128))).astype(np.int64)
        alone = (odd & (length == 1)).astype(np.int64)
    else:
        cap = odd = alone = np.empty(0, np.int64)
    cols += [wd.per_row(x, first) / words for x in (cap, odd, alone)]
    return np.stack(cols, axis=1).astype(np.float64)


class Fourier(NamedTuple):
    """Standardisation and random directions."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Features with a constant at the end."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2.0 / self.w.shape[1])
        return np.concatenate([f, np.ones((len(x), 1))], axis=1)


def fourier(mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH,
            seed: int = 7) -> Fourier:
    rng = np.random.default_rng(seed)
    w = rng.normal(0, width, (len(mean), features))
    return Fourier(mean, np.where(scale > 0, scale, 1.0), w, rng.uniform(0, 2 * np.pi, features))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in wd.slices(whole.column(1)):
                b = whole.slice(lo, hi - lo)
                x = statistics(b.column(1))
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), flat], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, x array<double>")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1) if n else np.empty((0, 0))


def normal_equations(rows: DataFrame, features: Fourier) -> dict[int, np.ndarray]:
    """Per fold the matrix [Z'Z | Z'y] over rows of x, label and fold.

    Sums of up to ``FAN`` neighbouring partitions are added in one group, then of as many groups.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        node = TaskContext.get().partitionId()
        for b in batches:
            x, y, fold = _matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for f in np.unique(fold):
                z = features(x[fold == f])
                m = np.concatenate([z.T @ z, (z.T @ y[fold == f])[:, None]], axis=1)
                total[int(f)] = total[int(f)] + m if int(f) in total else m
        for f, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(m), f, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)),
                 pa.array(np.full(len(m), node, np.int32)), pa.array(list(m), pa.list_(pa.float64()))],
                ["fold", "i", "node", "m"])

    def add(table: pa.Table) -> pa.Table:
        m = _matrix(table["m"]).sum(axis=0)
        return pa.table({"fold": table["fold"][:1], "i": table["i"][:1], "node": table["node"][:1],
                         "m": pa.array([m], pa.list_(pa.float64()))})

    schema = "fold int, i int, node int, m array<double>"
    parts = rows.select("x", "label", "fold").mapInArrow(run, schema)
    for _ in range(2):
        parts = parts.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy(
            "fold", "i", "node").applyInArrow(add, schema)
    out: dict[int, list] = {}
    for r in parts.groupBy("fold", "i").applyInArrow(add, schema).collect():
        out.setdefault(r["fold"], []).append((r["i"], r["m"]))
    return {f: np.array([m for _, m in sorted(v)]) for f, v in out.items()}


def solve(m: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    d = len(m)
    penalty = np.full(d, ridge)
    penalty[-1] = 1e-6                               # the constant is free
    return np.linalg.solve(m[:, :d] + np.diag(penalty), m[:, d])


class Model(NamedTuple):
    features: Fourier
    weights: np.ndarray
    calibrate: Isotonic

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.calibrate(self.features(x) @ self.weights)


def fit(rows: DataFrame, ridge: float = RIDGE) -> Model | None:
    """From rows of x (array), label (0 or 1) and fold (0 or 1)."""
    width = rows.select(F.size("x").alias("k")).first()
    if width is None:
        return None
    k = width["k"]
    agg = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(k)
           for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = rows.agg(*agg).first()
    features = fourier(np.array([r[f"m{i}"] for i in range(k)]),
                       np.array([r[f"s{i}"] for i in range(k)]))
    sums = normal_equations(rows, features)
    weights = solve(sum(sums.values()), ridge)
    other = {f: solve(sums[1 - f], ridge) if 1 - f in sums else weights for f in sums}

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, fold = features(_matrix(b.column(0))), b.column(2).to_numpy()
            s = np.zeros(len(fold))
            for f, w in other.items():
                s[fold == f] = z[fold == f] @ w
            at = np.clip((s - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], ["bin", "label"])

    bins = (rows.select("x", F.col("label").cast("double").alias("label"), "fold")
            .mapInArrow(raw, "bin int, label double").groupBy("bin")
            .agg(F.count("*").alias("n"), F.sum("label").alias("hits")).orderBy("bin").collect())
    at = np.array([(r["bin"] + 0.5) / BINS * (HIGH - LOW) + LOW for r in bins])
    return Model(features, weights, isotonic(at, [r["n"] for r in bins], [r["hits"] for r in bins]))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def labelled(rows: DataFrame, labels: DataFrame, column: str, of: int, held: int) -> DataFrame:
    """Rows of described documents that may be learned from, with label and fold."""
    key = F.col("doc_id").cast("long")
    usable = (labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
              .where(remainder(key, of) != held)
              .groupBy(key.alias("doc_id")).agg(F.max(column).cast("double").alias("label")))
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int")
    return rows.join(usable, "doc_id").select("doc_id", "x", "label", fold.alias("fold"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, of: int = 5,
           held: int = 0, column: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = durable(described(docs))
    model = fit(durable(labelled(rows, labels, column, of, held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            s = model(_matrix(b.column(1))) if n and model else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), of) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
