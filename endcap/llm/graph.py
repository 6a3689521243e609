"""Connected components of an edge table, by alternating large and small stars.

Per round every node points its larger neighbours, then itself and its smaller ones, at
the least neighbour. Minima combine before they are shuffled. A node with very many
neighbours is met in one join only, against a single row; that join is on the node and a
salt, so its rows are parted, and adaptive execution can split them further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endcap.functions.durable import durable


SALTS = 8


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for each node of an edge ``u, v`` of any ordered type; the root is
    the least node. Loops and repeated edges are allowed; nulls are dropped."""
    e = durable(edges.where("u is not null and v is not null and u != v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct())
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        salted = both.where("v > u").withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        every = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        every = every.withColumn("s", F.col("s").cast("long"))
        large = salted.join(every, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v"))
        e = durable(low.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Join on ``key``, of which ``few`` has one row each and ``many`` may have very many.

    The rows of one key are parted by a hash of ``by``; ``few`` is repeated for each part.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    every = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", salt).join(every, [key, "_salt"]).drop("_salt")


def forest(a, b, n: int) -> list[int]:
    """Places of the pairs (a[i], b[i]) that join two parts so far apart, nodes 0 to n - 1."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return kept
