"""Prefix trie of conversations, from double-array tries of prefix shards.

Each distinct sequence of turns is one row: a string of 32 hex letters a turn (a 128-bit hash of
role and text), which sorts as the sequence does. The rows are dealt out by ranges of this
string, so a shard (a bounded run of sorted rows) holds whole subtrees. It numbers its turns
densely, packs its trie into BASE and CHECK, walks every sequence through them and sums up
from the leaves. Only prefixes of a shard's first and last sequence can also occur in
another shard; these upper nodes go out as parts, which are merged over all shards.

Equal sequences are joined before (their ids in blocks of bounded size), so a conversation
that is copied without end is one row. One conversation's hashes (not its texts) are one row.

Defined cases: rows without ``conv_id`` belong to no conversation and make no node; null role
and text count as empty; null ``turn`` comes first; turns of equal number come by the hash of
role and text; a conversation of another's first turns only may be empty and ends at the
root. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endcap.functions.durable import durable

#: Turns of one double-array trie; ids of one block of equal conversations.
SHARD, BLOCK = 200_000, 1024
HEX = 32
NO_END = hashlib.sha256(b"").hexdigest()


def turn_hash(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id and ``turns``, an array of (hash, UTF-8 bytes of the text), in order."""
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.struct(
            F.col("turn").isNotNull().alias("some"), F.col("turn"),
            turn_hash(F.col("role"), F.col("text")).alias("hash"),
            F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("size")).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list("t")),
        lambda t: F.struct(t["hash"].alias("hash"), t["size"].alias("size"))).alias("turns"))


def rebuilt(rows: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % ``family`` in place of
    its own; h is the CRC-32 of c's decimal number modulo ``most``."""
    own = durable(sequences(rows))
    base = (own.where(F.col("conv_id") % family == 0)
            .select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_first")))
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    first = F.coalesce("_first", F.slice("turns", 1, 0))
    return (own.withColumn("_base", c - c % family).join(base, "_base", "left")
            .select("conv_id", F.concat(F.slice(first, F.lit(1), h),
                                        F.slice("turns", h + 1, F.size("turns"))).alias("turns")))


def keyed(convs: DataFrame) -> DataFrame:
    """conv_id, key (the hashes in one string), its digest, and the sizes."""
    key = F.array_join(F.transform("turns", lambda t: t["hash"]), "")
    return (convs.select("conv_id", key.alias("key"),
                         F.transform("turns", lambda t: t["size"]).alias("sizes"))
            .withColumn("digest", F.md5("key")))


def ends(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per distinct sequence: least id, number, and SHA-256 of its ids in order, comma-joined.

    Ids are listed in blocks by number first; the hash then runs over a sequence's blocks in
    order, a few at a time.
    """
    blocks = (convs.groupBy("digest", F.floor(F.col("conv_id") / block).alias("at"))
              .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
              .select("digest", "at", F.element_at("ids", 1).alias("low"),
                      F.size("ids").cast("long").alias("n"),
                      F.array_join(F.col("ids").cast("array<string>"), ",").alias("text")))
    names = ["low", "n", "sha"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, state, low, n = None, None, 0, 0
        for b in batches:
            out: list[tuple] = []
            for d, first, count, text in zip(*(c.to_pylist() for c in b.columns)):
                if d != digest:
                    if digest is not None:
                        out.append((low, n, state.hexdigest()))
                    digest, state, low, n = d, hashlib.sha256(text.encode()), first, count
                else:
                    state.update(b"," + text.encode())
                    n += count
            yield table(out)
        if digest is not None:
            yield table([(low, n, state.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names)

    return (blocks.repartition("digest").sortWithinPartitions("digest", "at")
            .select("digest", "low", "n", "text").mapInArrow(run, "low long, n long, sha string"))


class DoubleArray:
    """A trie over small numbers: node t is the child of s by number c if t is BASE[s] + c and
    CHECK[t] is s. The root is node 0; numbers count from 1."""

    def __init__(self, parent: np.ndarray, code: np.ndarray, kinds: int):
        """``parent`` of each node (a smaller number; -1 for node 0) and the number that leads there."""
        n = len(parent)
        order = np.lexsort((code[1:], parent[1:])) + 1
        edges = np.searchsorted(parent[order], np.arange(n + 1))
        fan = np.diff(edges)
        self.check = np.full(2 * (n + kinds) + 2, -1, np.int64)
        self.check[0] = 0
        free = list(range(len(self.check) + 1))      # next free place, shortened as it is used
        free[0] = 1

        def next_free(t: int) -> int:
            while free[t] != t:
                free[t] = free[free[t]]
                t = free[t]
            return t

        base, slot = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for s in np.argsort(-fan, kind="stable")[:int((fan > 0).sum())].tolist():
            kids = order[edges[s]:edges[s + 1]]      # the widest nodes find room first
            codes = code[kids]
            first, last = int(codes[0]), int(codes[-1])
            t = next_free(first)
            while True:
                if t - first + last >= len(self.check):
                    more = t - first + last + 1      # twice as much and the place itself
                    self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
                    free += range(len(free), len(self.check) + 1)
                at = codes + (t - first)
                if len(kids) == 1 or (self.check[at] < 0).all():
                    break
                t = next_free(t + 1)
            base[s], slot[kids], self.check[at] = t - first, at, s
            for x in at.tolist():
                free[x] = x + 1
        self.check[slot[1:]] = slot[parent[1:]]      # so far numbers of nodes, now places
        self.base = np.zeros(len(self.check), np.int64)
        self.base[slot] = base
        self.slot = slot

    def walk(self, codes: list[int]) -> int:
        """Node at the end of a sequence, -1 if it is not in the trie."""
        s = 0
        for c in codes:
            t = int(self.base[s]) + c
            if t >= len(self.check) or self.check[t] != s:
                return -1
            s = t
        return s


NODES = ("shard string, node int, parent int, low long, up_low long, depth long, n long, kids long, "
         "leaves long, saved long, size long, sha string, spine int, key string, up_key string")


def shard_nodes(keys: list[str], sizes: list[list[int]], low: list[int], n: list[int],
                sha: list[str]) -> pa.RecordBatch:
    """All nodes of the trie of some sorted distinct sequences.

    ``spine`` has bit 1 for prefixes of the first and bit 2 for prefixes of the last sequence.
    On such nodes ``leaves`` and ``saved`` sum over the nodes below that are off the spine, and
    ``kids`` counts only such children; everywhere else they are whole.
    """
    tokens = [[k[i:i + HEX] for i in range(0, len(k), HEX)] for k in keys]
    kinds, flat = np.unique([t for ts in tokens for t in ts], return_inverse=True)
    at = np.concatenate([[0], np.cumsum([len(t) for t in tokens], dtype=np.int64)])
    codes = [(flat[a:b] + 1).tolist() for a, b in zip(at, at[1:])]
    # nodes in order of first visit: what a sequence shares with the one before is there
    parent, code, depth, size, path, prev = [-1], [0], [0], [0], [0], []
    for cs, bytes_ in zip(codes, sizes):
        same = 0
        while same < min(len(cs), len(prev)) and cs[same] == prev[same]:
            same += 1
        del path[same + 1:]
        for d in range(same, len(cs)):
            parent.append(path[-1])
            code.append(cs[d])
            depth.append(d + 1)
            size.append(bytes_[d])
            path.append(len(parent) - 1)
        prev = cs
    up, step = np.array(parent, np.int64), np.array(code, np.int64)
    trie = DoubleArray(up, step, len(kinds))
    node_at = np.full(len(trie.check), -1, np.int64)
    node_at[trie.slot] = np.arange(len(up))
    m = len(up)
    least, total = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
    hashes = [NO_END] * m
    for k, cs in enumerate(codes):
        end = int(node_at[trie.walk(cs)])
        least[end], total[end], hashes[end] = low[k], n[k], sha[k]
    spine = np.zeros(m, np.int32)
    for bit, cs in ((1, codes[0]), (2, codes[-1])):
        s = 0
        spine[0] |= bit
        for c in cs:
            s = int(trie.base[s]) + c
            spine[node_at[s]] |= bit
    # from the deepest nodes up; CHECK names the parent
    deep = np.array(depth, np.int64)
    weight = np.array(size, np.int64)
    kids, leaves, saved = (np.zeros(m, np.int64) for _ in range(3))
    order = np.argsort(-deep, kind="stable")
    above = node_at[trie.check[trie.slot]]
    for level in np.split(order, np.flatnonzero(np.diff(deep[order])) + 1):
        if deep[level[0]] == 0:
            break
        inner = level[spine[level] == 0]
        leaves[inner] += kids[inner] == 0
        saved[inner] += (total[inner] - 1) * weight[inner]
        p = above[level]
        np.add.at(total, p, total[level])
        np.minimum.at(least, p, least[level])
        np.add.at(kids, above[inner], 1)
        np.add.at(leaves, p, leaves[level])
        np.add.at(saved, p, saved[level])
    digest = hashlib.md5(keys[0].encode()).hexdigest()
    key: list[str | None] = [None] * m
    for sequence, cs in ((keys[0], codes[0]), (keys[-1], codes[-1])):
        s, state = 0, hashlib.md5()
        key[0] = state.hexdigest()
        for d, c in enumerate(cs):
            s = int(trie.base[s]) + c
            state.update(sequence[d * HEX:(d + 1) * HEX].encode())
            key[int(node_at[s])] = state.hexdigest()
    roots = above.copy()
    roots[0] = -1
    up_low = [None if p < 0 or spine[p] else int(least[p]) for p in roots.tolist()]
    up_key = [None if p < 0 else key[p] for p in roots.tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array([digest] * m), pa.array(np.arange(m), pa.int32()), pa.array(roots, pa.int32()),
         pa.array(least), pa.array(up_low, pa.int64()), pa.array(deep), pa.array(total), pa.array(kids), pa.array(leaves), pa.array(saved),
         pa.array(weight), pa.array(hashes), pa.array(spine), pa.array(key, pa.string()),
         pa.array(up_key, pa.string())],
        [x.strip().split(" ")[0] for x in NODES.split(",")])


def trie_nodes(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of all shards; ``distinct`` has key, sizes, low, n, sha."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                turns += len(row[1]) + 1
                if turns >= shard:
                    yield from sliced(shard_nodes(*map(list, zip(*held))))
                    held, turns = [], 0
        if held:
            yield from sliced(shard_nodes(*map(list, zip(*held))))

    def sliced(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, b.num_rows, 20_000):
            yield b.slice(lo, 20_000)

    return (distinct.select("key", "sizes", "low", "n", "sha")
            .repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, NODES))


def merged_spine(spine: DataFrame) -> DataFrame:
    """Upper nodes of all shards, one row each: key, low, n, kids, leaves, saved and the rest.

    What upper nodes add to those above them is summed along the first and the last sequence
    of each shard. Each node counts on one of these paths alone; every path through an ancestor
    brings it the sum of what lies below on it.
    """
    paths = spine.withColumn("side", F.explode(F.filter(
        F.array(F.lit(1), F.lit(2)), lambda b: F.col("spine").bitwiseAND(b) != 0)))
    one = (spine.groupBy("key").agg(
        F.min("low").alias("low"), F.sum("n").alias("n"), F.sum("kids").alias("kids"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.max("size").alias("size"), F.max("depth").alias("depth"),
        F.max("up_key").alias("up_key"),
        F.max(F.when(F.col("sha") != NO_END, F.col("sha"))).alias("sha")))
    home = paths.groupBy("key").agg(F.min(F.struct("shard", "side")).alias("home"))
    below = one.where(F.col("up_key").isNotNull()).groupBy(F.col("up_key").alias("key")).agg(
        F.count("*").alias("more"))
    one = (one.join(home, "key").join(below, "key", "left")
           .withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))))
    own = one.select("key", "home", (F.col("kids") == 0).cast("long").alias("leaf"),
                     F.when(F.col("depth") == 0, 0).otherwise((F.col("n") - 1) * F.col("size"))
                     .alias("spared"))
    here = F.struct("shard", "side") == F.col("home")
    down = Window.partitionBy("shard", "side").orderBy(F.col("depth").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    summed = (paths.select("shard", "side", "depth", "key").join(own, "key")
              .withColumn("leaf", F.sum(F.when(here, F.col("leaf")).otherwise(0)).over(down))
              .withColumn("spared", F.sum(F.when(here, F.col("spared")).otherwise(0)).over(down))
              .groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("spared").alias("spared")))
    up = one.select(F.col("key").alias("up_key"), F.col("low").alias("up_low"))
    return (one.join(summed, "key").join(up, "up_key", "left")
            .select("key", "low", "up_low", "depth", "n", "kids",
                    (F.col("leaves") + F.col("leaf")).alias("leaves"),
                    (F.col("saved") + F.col("spared")).alias("saved"),
                    F.coalesce("sha", F.lit(NO_END)).alias("sha")))


def prefix_nodes(convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie of ``convs`` (conv_id, turns as of ``sequences``).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = durable(keyed(convs))
    distinct = ends(rows).join(rows.select(F.col("conv_id").alias("low"), "key", "sizes"), "low")
    nodes = durable(trie_nodes(distinct, shard))
    spine = nodes.where(F.col("spine") != 0)
    upper = durable(merged_spine(spine))
    # the least id of an upper parent, per shard, so that no parent is one key for all shards
    lows = (spine.join(upper.select("key", F.col("low").alias("top")), "key")
            .select("shard", F.col("node").alias("parent"), "top"))
    inner = (nodes.where(F.col("spine") == 0).join(lows, ["shard", "parent"], "left")
             .withColumn("up_low", F.coalesce("up_low", "top")))
    cols = [F.col("low").alias("conv_id"), "depth", F.col("up_low").alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.col("sha").alias("ends_sha256")]
    return inner.select(*cols).unionByName(upper.select(*cols))
