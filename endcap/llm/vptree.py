"""Nearest neighbours by inner product: vantage-point trees per shard.

One more component, sqrt(M^2 - |x|^2) with M the largest norm of a shard, makes all its
vectors equally long, so that the largest inner product is the smallest distance and the
triangle inequality holds. A node of a tree keeps a vantage point and the median distance
to it. A query goes first to the side it is on. What lies ``factor`` times the distance to the
border away bounds the inner products behind the border; the other side is left out if
they are all below the query's current k-th one, by more than rounding can move either.
Factor one never leaves out a neighbour; larger ones prune more and may miss some.

A query carries its best as (score, id), the smaller id first among equal scores, through all
leaves, so any number of candidates with the score at the border is settled by id.

Shards and blocks of queries have bounded size, every pair of them is one task, and only
the best of each task are merged. Scores are computed on the original vectors in double
precision, component by component in one order, so equal vectors have equal scores.

Defined cases: vectors null, empty, zero, with null or non-finite components, of another
length than the most frequent one, or without id take no part. Of rows with an equal id
the least vector counts. A query with no other row has no result. Other columns are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endcap.llm.vectors import matrix, valid

#: Vectors of one shard, queries of one block, vectors of one leaf.
SHARD, BLOCK, LEAF = 8_192, 4_096, 128
#: Pruning: one never leaves out a nearest neighbour.
FACTOR = 1.0


def extended(x: np.ndarray) -> np.ndarray:
    """Rows with the component that makes them equally long."""
    n2 = (x**2).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(n2.max() - n2, 0))[:, None]], axis=1)


class Tree:
    """A vantage-point tree over the rows of ``x`` (extended vectors)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 1) -> None:
        self.x, self.leaf = x, leaf                  # rows are equally long
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []                 # (point, border, near, far) or rows
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> int:
        if len(rows) <= self.leaf:
            self.nodes.append((rows,))
            return len(self.nodes) - 1
        point = int(rows[self.rng.integers(len(rows))])
        d = _distance(self.x[point][None], self.x[rows])[0]
        border = float(np.median(d))
        inside = d <= border
        if inside.all():                             # all equally far: no border splits them
            self.nodes.append((rows,))
            return len(self.nodes) - 1
        at = len(self.nodes)
        self.nodes.append(())
        near, far = self._build(rows[inside]), self._build(rows[~inside])
        self.nodes[at] = (point, border, near, far)
        return at

    def search(self, q: np.ndarray, low: np.ndarray, k: int, factor: float
               ) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best of each query (extended by 0), by score and then by ``low`` of the
        row, in order; -1 and a score of -inf where there are fewer."""
        n = len(q)
        best, score = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
        if not n or not len(self.x):
            return best, score
        length = np.sqrt((q**2).sum(axis=1) + (self.x[0]**2).sum())     # of |q| and |x| together
        slip = q.shape[1] * 2.0**-50                 # rounding of a sum of products, relative

        def look(rows: np.ndarray, who: np.ndarray) -> None:
            about = q[who] @ self.x[rows].T
            far = about >= (score[who, -1] - slip * length[who]**2)[:, None]
            w, r = np.nonzero(far)
            if not len(w):
                return
            some = np.unique(w)
            w, r = np.searchsorted(some, w), rows[r]
            who = who[some]
            there = np.repeat(np.arange(len(who)), k)
            w = np.concatenate([there, w])
            s = np.concatenate([score[who].ravel(), inner(q[who[w[len(there):]]], self.x[r])])
            r = np.concatenate([best[who].ravel(), r])
            order = np.lexsort((low[r], -s, w))      # row -1 has score -inf: its id is never asked
            w, s, r = w[order], s[order], r[order]
            place = np.arange(len(w)) - np.searchsorted(w, w)
            kept = place < k
            score[who] = s[kept].reshape(-1, k)
            best[who] = r[kept].reshape(-1, k)

        def visit(at: int, who: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 1:
                look(node[0], who)
                return
            point, border, near, far = node
            gap = _distance(q[who], self.x[point][None])[:, 0] - border
            clear = np.maximum(np.abs(gap) * factor - 2 * np.sqrt(slip) * length[who], 0)
            most = (length[who]**2 * (1 + slip) - clear**2) / 2     # of the products behind it
            for side, other, mine in ((near, far, gap <= 0), (far, near, gap > 0)):
                if not mine.any():
                    continue
                visit(side, who[mine])
                back = mine & (most >= score[who, -1] - slip * length[who]**2)
                if back.any():
                    visit(other, who[back])

        visit(self.root, np.arange(n))
        return best, score


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each pair of rows, summed up from the first component on."""
    out = np.zeros(len(a))
    for c in range(a.shape[1]):
        out += a[:, c] * b[:, c]
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(s, 0))


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors; of equal ids the least vector."""
    ids, x = table["vec_id"].to_numpy(), matrix(table["embedding"])
    order = np.lexsort((*x.T[::-1], ids)) if len(ids) else np.empty(0, np.int64)
    ids, x = ids[order], x[order]
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return ids[new], x[new]


def shard_best(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int,
               factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and scores of the best k of a shard for each query.

    Equal vectors are searched as one, by their least id; each of the k + 1 best stands for
    its k + 1 least ids (one more than asked, as the query's own row falls away).
    """
    u, code = np.unique(x, axis=0, return_inverse=True)
    code = code.ravel()
    order = np.argsort(code, kind="stable")          # ids ascend within equal vectors
    start = np.searchsorted(code[order], np.arange(len(u) + 1))
    zeros = np.zeros((len(q), 1))
    got, found = Tree(extended(u)).search(np.concatenate([q, zeros], axis=1), ids[order[start[:-1]]],
                                          min(k + 1, len(u)), factor)
    who, place = np.nonzero(got >= 0)
    vec, score = got[who, place], found[who, place]
    count = np.minimum(start[vec + 1] - start[vec], k + 1)
    w = np.repeat(np.arange(len(vec)), count)
    inner = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
    cid = ids[order[start[vec[w]] + inner]]
    who, score = who[w], score[w]
    other = cid != q_ids[who]
    who, cid, score = who[other], cid[other], score[other]
    order = np.lexsort((cid, -score, who))
    who, cid, score = who[order], cid[order], score[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    keep = rank < k
    return who[keep], cid[keep], score[keep]


def nearest(table: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR,
            shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row whose id is
    divisible by ``every``."""
    rows, _ = valid(table)
    n = rows.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long"))
                 .alias("q")).first()
    shards, blocks = max(1, -(-n["n"] // shard)), max(1, -(-(n["q"] or 0) // block))
    cand = rows.select(
        "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("_s"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    asked = rows.where(F.col("vec_id") % every == 0).select(
        "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_s"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("_b"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())],
                            names=names)
        ids, x = _distinct(left)
        q_ids, q = _distinct(right)
        who, cid, score = shard_best(ids, x, q_ids, q, k, factor)
        return pa.table([pa.array(q_ids[who]), pa.array(cid), pa.array(score)], names=names)

    best = cand.groupBy("_s", "_b").cogroup(asked.groupBy("_s", "_b")).applyInArrow(
        run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


