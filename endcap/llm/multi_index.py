"""Embedding near-duplicates over an inverted multi-index.

Vectors are normalised and cut in two halves with a codebook each; the pairs of codewords
are the cells of a product grid, and every vector is filed in its own cell. Each vector
visits cells in ascending order of its squared distance to their codeword pairs
(multi-sequence order), as many as make the share of pairs met, in either direction,
reach the target recall; that number is measured beforehand on pairs at the threshold,
made from sampled vectors. All vectors of a visited cell are compared in double
precision, and only pairs at the threshold are linked.

Equal vectors are one class from the start. Cells with many members or visitors are
parted into blocks, so a task has bounded size; pairs are counted where they are met and
never listed, and tasks return numbers of links and spanning forests. The codebooks are
fitted on at most ``SAMPLE`` vectors; every vector is filed and visits.

Defined cases: vectors null, empty, zero, with null or non-finite components or of another
length than the most frequent one link with nothing; a null ``vec_id`` links with nothing
(component null, kept). Rows of equal id and different vectors are rows of their own. Other columns
are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endcap.functions.durable import durable
from endcap.llm import graph
from endcap.llm.vectors import lists, matrix, usable, valid

THRESHOLD, RECALL = 0.9, 0.999
#: Vectors that codebooks are fitted on, and members of a cell on average.
SAMPLE, CELL = 20_000, 512
#: Members and visitors of one block of a cell; rows of one task.
MEMBERS, VISITORS, ROWS = 1_024, 4_096, 8_192


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means codewords of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = _square(x, c).argmin(axis=1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Grid(NamedTuple):
    """Two codebooks, how many cells to visit, and the pairs of ranks that can be among them."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return _square(u[:, :h], self.first), _square(u[:, h:], self.second)

    def visited(self, u: np.ndarray) -> np.ndarray:
        """Cells (rows x visits) in multi-sequence order; the first one is the vector's own.

        The cell at ranks (r, s) has (r + 1) (s + 1) - 1 cells before it, so only rank
        pairs with (r + 1) (s + 1) <= visits need a look.
        """
        a, b = self.halves(u)
        i, j = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        r, s = np.meshgrid(np.arange(len(self.first)), np.arange(len(self.second)), indexing="ij")
        can = (r + 1) * (s + 1) <= self.visits
        r, s = r[can], s[can]
        rows = np.arange(len(u))[:, None]
        cost = a[rows, i[:, r]] + b[rows, j[:, s]]
        top = np.argsort(cost, axis=1, kind="stable")[:, :self.visits]
        return (i[rows, r[top]] * len(self.second) + j[rows, s[top]]).astype(np.int32)


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def needed_visits(u: np.ndarray, grid: Grid, threshold: float, recall: float, seed: int = 5) -> int:
    """Visits that let pairs at the threshold meet, one visiting the other, with ``recall``."""
    if len(u) == 0 or u.shape[1] < 2:
        return grid.visits
    rng = np.random.default_rng(seed)
    u = u[rng.integers(len(u), size=4_000)]
    r = rng.normal(size=u.shape)
    r -= (r * u).sum(1, keepdims=True) * u
    r /= np.sqrt((r**2).sum(1, keepdims=True))
    v = threshold * u + np.sqrt(1 - threshold**2) * r
    ranks = []
    for x, y in ((u, v), (v, u)):
        a, b = grid.halves(x)
        ya, yb = (h.argmin(axis=1) for h in grid.halves(y))
        rank = np.empty(len(x), np.int64)
        for lo in range(0, len(x), 256):
            p = np.arange(lo, min(lo + 256, len(x)))
            cost = a[p][:, :, None] + b[p][:, None, :]
            own = a[p, ya[p]] + b[p, yb[p]]
            rank[p] = (cost < own[:, None, None]).sum(axis=(1, 2))
        ranks.append(rank)
    return int(np.quantile(np.minimum(*ranks), recall, method="higher")) + 1


def grid_for(classes: DataFrame, n: int, threshold: float, recall: float) -> Grid:
    """Codebooks that grow with the root of the input, fitted on a bounded sample."""
    k = max(1, int(np.ceil(np.sqrt(n / CELL))))
    share = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
    rows = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < max(share, 1)).orderBy(
        "cid").limit(SAMPLE).select("u").toPandas()
    u = normalised(np.stack(rows["u"].to_numpy()).astype(np.float64)) if len(rows) else \
        np.zeros((1, 2))
    half = max(1, u.shape[1] // 2)
    k = min(k, len(u))
    b = u[:, half:] if u.shape[1] > 1 else np.zeros((len(u), 1))
    grid = Grid(codebook(u[:, :half], k), codebook(b, k), k * k)
    return grid._replace(visits=min(k * k, needed_visits(u, grid, threshold, recall)))


def _classes(rows: DataFrame) -> DataFrame:
    """vec_id, class id (16 bytes of the vector's hash) and vector of each valid row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1)) + 0.0            # no negative zero
            cid = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cid, pa.binary()), b.column(1)], ["vec_id", "cid", "u"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, cid binary, u {kind}")


def _filed(classes: DataFrame, grid: Grid) -> DataFrame:
    """Per class its vector and the cells it visits, the first one its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("u")
            cells = grid.visited(normalised(matrix(b.column(at)))) if b.num_rows else \
                np.empty((0, 1), np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, lists(cells)], [*b.schema.names, "cells"])

    kind = classes.schema["u"].dataType.simpleString()
    return classes.mapInArrow(run, f"cid binary, u {kind}, copies long, cells array<int>")


def _blocks(filed: DataFrame) -> DataFrame:
    """Rows (task, cell, block, side, cid, u, copies, cells): members and visitors of each block."""
    home = F.col("cells")[0]
    members = filed.groupBy(home.alias("cell")).agg(F.count("*").alias("m"))
    visitors = filed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.count("*").alias("v"))
    size = durable(members.join(visitors, "cell").select(
        "cell", F.ceil(F.col("m") / MEMBERS).cast("int").alias("mb"),
        F.ceil(F.col("v") / VISITORS).cast("int").alias("vb"), "m", "v"))
    rows = size.agg(F.sum(F.col("m") * F.col("vb") + F.col("v") * F.col("mb"))).first()[0] or 0
    tasks = max(1, -(-rows // ROWS))
    mine = filed.select(home.alias("cell"), F.lit(0).alias("side"), "*").join(
        size.drop("m", "v"), "cell")
    mine = mine.withColumns({
        "bm": F.pmod(F.xxhash64("cid"), F.col("mb")).cast("int"),
        "bv": F.explode(F.sequence(F.lit(0), F.col("vb") - 1))})
    seen = filed.select(F.explode("cells").alias("cell"), F.lit(1).alias("side"), "*").join(
        size.drop("m", "v"), "cell")
    seen = seen.withColumns({
        "bv": F.pmod(F.xxhash64("cid"), F.col("vb")).cast("int"),
        "bm": F.explode(F.sequence(F.lit(0), F.col("mb") - 1))})
    task = F.pmod(F.xxhash64("cell", "bm", "bv"), F.lit(tasks)).cast("int")
    return mine.unionByName(seen).select(
        task.alias("task"), "cell", "bm", "bv", "side", "cid", "u", "copies", "cells")


def _compare(threshold: float):
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        u = normalised(matrix(table["u"]))
        cells = matrix(table["cells"], np.int32)
        home = cells[:, 0]
        raw = table["cid"].to_pylist()
        name = {c: k for k, c in enumerate(sorted(set(raw)))}
        node = np.array([name[c] for c in raw])
        copies = table["copies"].to_numpy()
        side = table["side"].to_numpy()
        key = np.stack([table[c].to_numpy() for c in ("cell", "bm", "bv")])
        order = np.lexsort((side, *key[::-1]))
        k = key[:, order]
        edge = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0), [True]]))
        links = np.zeros(len(name), np.int64)
        pairs = [[], []]
        for s, e in zip(edge[:-1], edge[1:]):
            rows = order[s:e]
            m = rows[side[rows] == 0]
            v = rows[side[rows] == 1]
            if not len(m) or not len(v):
                continue
            c = u[v] @ u[m].T
            i, j = np.nonzero(c >= threshold - 1e-9)
            i, j = v[i], m[j]
            keep = node[i] != node[j]
            i, j = i[keep], j[keep]
            keep = (u[i] * u[j]).sum(axis=1) >= threshold
            i, j = i[keep], j[keep]
            # a pair that is also met the other way is counted where the lesser one visits
            back = (cells[j] == home[i][:, None]).any(axis=1)
            keep = ~back | (node[i] < node[j])
            i, j = i[keep], j[keep]
            np.add.at(links, node[i], copies[j])
            np.add.at(links, node[j], copies[i])
            if len(i):
                _, local = np.unique(np.concatenate([node[i], node[j]]), return_inverse=True)
                kept = graph.forest(local[:len(i)].tolist(), local[len(i):].tolist(),
                                    int(local.max()) + 1)
                pairs[0] += node[i[kept]].tolist()
                pairs[1] += node[j[kept]].tolist()
        ids = list(name)
        kept = graph.forest(*pairs, len(ids))
        some = np.flatnonzero(links)
        return pa.table({
            "u": pa.array([ids[x] for x in some] + [ids[pairs[0][x]] for x in kept], pa.binary()),
            "v": pa.array([None] * len(some) + [ids[pairs[1][x]] for x in kept], pa.binary()),
            "links": pa.array([*links[some].tolist(), *[0] * len(kept)], pa.int64())}, schema=schema)

    return run


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL
                    ) -> DataFrame:
    """One row per row of the table: vec_id, n_links, component_id, kept."""
    rows, length = valid(table)
    base = durable(_classes(rows))
    classes = durable(base.groupBy("cid").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("u").alias("u")))
    grid = grid_for(classes, classes.count(), threshold, recall)
    filed = durable(_filed(classes.select("cid", "u", "copies"), grid))
    found = durable(_blocks(filed).groupBy("task").applyInArrow(
        _compare(threshold), "u binary, v binary, links long"))
    links = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    comps = graph.components(found.where("v is not null").select("u", "v"))
    c = (classes.select("cid", "low", "copies")
         .join(links.withColumnRenamed("u", "cid"), "cid", "left")
         .join(comps.withColumnRenamed("node", "cid"), "cid", "left")
         .withColumn("root", F.coalesce("root", "cid")))
    least = c.groupBy("root").agg(F.min("low").alias("component_id"))
    c = graph.spread_join(c, least, "root", "cid").select(
        "cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = base.select("vec_id", "cid").join(c, "cid").select("vec_id", "n_links", "component_id")
    ok = usable() & (F.size("embedding") == length) & F.col("vec_id").isNotNull()
    rest = table.where(~ok).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(rest).select(
        "*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
