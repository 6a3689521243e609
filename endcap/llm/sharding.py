"""Consistent-hash ring with virtual nodes and bounded loads.

Every key has a point on a ring, every shard many; a key belongs to the arc that ends at
the next shard point clockwise. A shard takes at most its capacity; keys beyond it
continue clockwise to the next shard with room. Which keys of an arc go on is decided by
their rank on the ring, so the driver needs only one count per arc (shards x virtual nodes
numbers, whatever the input) to lay down which ranks of which arc go where.

With ``epsilon`` 0 the capacities are the even shares themselves: counts differ by one at
most. A larger ``epsilon`` lets shards hold up to (1 + epsilon) of the even share, and
fewer keys move when a shard is added.

Defined cases: a null key has a point like any other; rows of equal key follow each other
on the ring; null text has no bytes. Other columns are not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endcap.functions.durable import durable

VNODES = 64
#: Rows that one task ranks, about.
CELL = 500_000


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in ring order (int64, signed order) and the shard of each."""
    at = {}
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest()
            at.setdefault(int.from_bytes(h, "little", signed=True), s)
    points = np.array(sorted(at), np.int64)
    return points, np.array([at[int(p)] for p in points], np.int64)


def arc_of(points: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The arc of a key is the first point at or after it, around the ring."""
    return np.searchsorted(points, keys, side="left") % len(points)


def capacities(total: int, shards: int, epsilon: float) -> np.ndarray:
    even = np.full(shards, total // shards, np.int64)
    even[:total % shards] += 1
    return even if epsilon == 0 else np.maximum(
        even, int(np.ceil((1 + epsilon) * total / shards)))


def lay(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple]:
    """Segments (arc, first rank, rows, shard), in the order in which shards fill.

    All arcs try their own shard first; then what is left over goes on clockwise.
    """
    room, left = room.copy(), counts.astype(np.int64).copy()
    taken = np.zeros(len(counts), np.int64)
    out = []

    def give(arc: int, shard: int) -> None:
        n = int(min(left[arc], room[shard]))
        if n:
            out.append((arc, int(taken[arc]), n, shard))
            taken[arc] += n
            left[arc] -= n
            room[shard] -= n

    for arc in range(len(counts)):
        give(arc, int(owner[arc]))
    for arc in np.nonzero(left)[0].tolist():
        step = 1
        while left[arc]:
            give(arc, int(owner[(arc + step) % len(owner)]))
            step += 1
    return out


def with_points(docs: DataFrame, key: str, points: np.ndarray, cells: int) -> DataFrame:
    """Adds the point of each key, its arc and its cell, a fixed fraction of the ring."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(b.schema.get_field_index("_point")).to_numpy(zero_copy_only=False)
            arc = arc_of(points, k)
            turn = (k.astype(np.float64) / 2.0**64 + 0.5) * cells
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(arc.astype(np.int32)),
                 pa.array(np.floor(turn).astype(np.int64))], [*b.schema.names, "_arc", "_cell"])

    df = docs.withColumn("_point", F.xxhash64(F.col(key)))
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, _arc int, _cell long")


def ring_shards(rows: DataFrame, key: str, shards: int, vnodes: int = VNODES,
                epsilon: float = 0.0, cell: int = CELL) -> DataFrame:
    """``key``, ``size``, ``text_crc32`` or whatever slim columns ``rows`` has, with ``shard``
    and ``slot`` (gapless from 0 in its shard), which replace columns of these names."""
    points, owner = ring(shards, vnodes)
    rows = rows.drop("shard", "slot")
    given = rows.columns
    names = [f"c{i}" for i in range(len(given))]     # no column of the caller meets one of ours
    rows, key = rows.toDF(*names), names[given.index(key)]
    # the cells of the ring grow in number with the input, so that no task ranks many rows
    base = durable(rows.withColumn("_n", F.monotonically_increasing_id()))
    total = base.count()
    cells = max(1, -(-total // cell))
    base = with_points(base, key, points, cells)
    fine = ["_arc", "_cell"]
    sizes = base.groupBy(*fine).agg(F.count("*").alias("_rows"))
    most = sizes.agg(F.max("_rows")).first()[0] or 0
    # one key may fill a cell by itself; its rows are alike and are parted by row number
    parts = max(1, -(-most // (4 * cell)))
    base = base.withColumn("_part", F.pmod(F.col("_n"), F.lit(parts)))
    fine = [*fine, "_part"]
    sizes = base.groupBy(*fine).agg(F.count("*").alias("_rows"))
    arcs = np.zeros(len(points), np.int64)
    for r in sizes.groupBy("_arc").agg(F.sum("_rows").alias("n")).collect():
        arcs[r["_arc"]] = r["n"]
    start = np.concatenate([[0], np.cumsum(arcs)[:-1]])      # of an arc in the whole ring
    plan = lay(arcs, owner, capacities(total, shards, epsilon))
    filled = np.zeros(shards, np.int64)
    first, shard_of, slot_of = [], [], []
    for arc, at, n, s in plan:
        first.append(int(start[arc]) + at)
        shard_of.append(s)
        slot_of.append(int(filled[s]))
        filled[s] += n
    order = np.argsort(np.array(first, np.int64))
    first = np.array(first, np.int64)[order]
    shard_of, slot_of = (np.array(x, np.int64)[order] for x in (shard_of, slot_of))

    w = Window.partitionBy("_arc").orderBy("_cell", "_part").rowsBetween(
        Window.unboundedPreceding, 0)
    before = sizes.select(*fine, (F.sum("_rows").over(w) - F.col("_rows")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*fine).orderBy("_point", *names, "_n")) - 1
    ranked = base.withColumn("_rank", rank).join(before, fine).select(
        *names, "_arc", (F.col("_before") + F.col("_rank")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arc, r = (b.column(len(names) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            g = start[arc] + r
            k = np.searchsorted(first, g, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], pa.array(shard_of[k].astype(np.int32)),
                 pa.array(slot_of[k] + g - first[k])], [*names, "shard", "slot"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return ranked.mapInArrow(run, f"{schema}, shard int, slot long").toDF(*given, "shard", "slot")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size in UTF-8 bytes plus 16, and the checksum of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
