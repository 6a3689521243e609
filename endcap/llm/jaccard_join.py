"""N-gram Jaccard join by chosen paths.

A document's set holds its distinct runs of five words (a shorter text is one run).
Equal sets are one class from the start. A class takes part in ``runs`` runs. In each,
sets are split on a sampled token: the least of the set under a random order, which two
sets share with a probability equal to their similarity. Buckets above ``small`` members are
split again on another token, up to ``depth`` times; what is small by then is compared
pair by pair on sketches, and what is still large agrees on all its tokens and is taken
as it is. A pair at the threshold t survives a run with probability t ** depth at least,
so the number of runs follows from the target recall.

Candidates are not listed as pairs: buckets give spanning forests, the components of
these are dealt to tasks (large ones as tiles of bounded size), each text once per tile
row, and there all pairs of a component are compared exactly on whole sets. So within a
component no link is lost, and none below the threshold is kept. Tasks return numbers of
links and spanning forests of the links.

Defined cases: null and empty texts have no set and link with nothing; a null ``doc_id``
links with nothing (component null); repeated rows are documents of their own. Other
columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endcap.functions.durable import durable
from endcap.llm import graph
from endcap.llm import words as wd
from endcap.llm.names import free

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Random orders of tokens; also the length of the sketch that pairs are compared on.
ORDERS = 64
DEPTH, SMALL = 3, 128
#: Share of equal sketch places from which a pair counts as a candidate; for a pair at 0.8
#: the share is below that with probability 1e-5.
NEAR = 0.55
SALTS = 8
#: Shingles and classes of one tile side; leaf rows of one comparing task.
TILE, TILE_ROWS, LEAF_ROWS = 1 << 19, 512, 2_048
_rng = np.random.default_rng(20_240_817)
_MUL = _rng.integers(1 << 62, size=ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1 << 63, size=ORDERS, dtype=np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)


def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def shingles(column: pa.Array | pa.ChunkedArray, words: int = WORDS
             ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of all rows, row by row in ascending order, and row edges (n + 1)."""
    buf, offsets = wd.text_bytes(column)
    starts, ends, first = wd.words_of(buf, offsets)
    h = wd.word_hashes(buf, starts, ends)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    ok = wd.inside(first, words)
    s, r = wd.runs(h, words)[ok], row[:len(ok)][ok]
    for size in range(1, words):                      # texts of fewer words: one run of all
        k = np.flatnonzero(count == size)
        if len(k):
            s = np.concatenate([s, wd.runs(h, size)[first[k]]])
            r = np.concatenate([r, k])
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[new], r[new]
    return s, np.searchsorted(r, np.arange(len(count) + 1))


def class_ids(s: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """16 bytes per row that tell its set (zeros if empty)."""
    out = np.zeros((len(edges) - 1, 2), "<u8")
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        a, b = wd.mix(s + _K), wd.mix(s * _K + np.uint64(7))
        n = np.diff(edges)[full].astype(np.uint64)
        out[full, 0] = wd.mix(np.add.reduceat(a, edges[full]) + n)
        out[full, 1] = wd.mix(np.add.reduceat(b, edges[full]) ^ n)
    return out.view(np.uint8).reshape(-1, 16)


def sketches(s: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Least value of each row's set under each random order (uint32, rows x orders)."""
    out = np.full((len(edges) - 1, ORDERS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        for k in range(ORDERS):
            v = ((s * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(v, edges[full])
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    n, width = rows.shape
    at = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(
        np.ascontiguousarray(rows).tobytes())])


def _bytes(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """An Arrow column of equally long binaries as rows of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.empty((0, width), np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[at:at + len(column) * width].reshape(-1, width)


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, class, number of shingles and sketch of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in wd.slices(whole.column(1)):
                b = whole.slice(lo, hi - lo)
                s, edges = shingles(b.column(1), words)
                sk = sketches(s, edges)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), _binary(class_ids(s, edges)),
                     pa.array(np.diff(edges)), _binary(sk.view(np.uint8).reshape(len(sk), -1))],
                    ["doc_id", "text_hash", "cid", "n", "sketch"])

    slim = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, cid binary, n long, sketch binary")


def paths(classes: DataFrame, runs: int, depth: int = DEPTH) -> DataFrame:
    """Per class and run the bucket it is in after each split (k1, k2, ...)."""
    names = [f"k{d + 1}" for d in range(depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk = np.ascontiguousarray(_bytes(b.column(1), 4 * ORDERS)).view("<u4").reshape(-1, ORDERS)
            at = np.arange(len(sk))
            for r in range(runs):
                key = np.full(len(sk), wd.mix(np.array([r], np.uint64) * _K + _K)[0])
                keys = []
                for _ in range(depth):               # the node chooses which order splits it
                    pick = (key % np.uint64(ORDERS)).astype(np.int64)
                    token = sk[at, pick].astype(np.uint64)
                    key = wd.mix(key ^ wd.mix(token + (pick.astype(np.uint64) << np.uint64(40))))
                    keys.append(pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), *keys], ["cid", *names])

    return classes.select("cid", "sketch").mapInArrow(
        run, "cid binary, " + ", ".join(f"{k} long" for k in names))


def leaves(steps: DataFrame, depth: int = DEPTH, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Rows (leaf, cid) of buckets with partners: those to compare, those still large."""
    ready, rows = [], steps
    for d in range(1, depth + 1):
        k = f"k{d}"
        size = rows.groupBy(k).agg(F.count("*").alias("_size")).where("_size > 1")
        # on bucket and salt, so that the rows of one bucket are parted and can be split further
        every = size.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
        rows = durable(salted.join(every, [k, "_salt"]).drop("_salt"))
        ready.append(rows.where(F.col("_size") <= small).select(F.col(k).alias("leaf"), "cid"))
        rows = rows.where(F.col("_size") > small).drop("_size", *([k] if d < depth else []))
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return out, rows.select(F.col(f"k{depth}").alias("leaf"), "cid")


def _edge_rows(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"u": _binary(a.reshape(-1, 16)), "v": _binary(b.reshape(-1, 16))})


def _all_pairs(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within segments, in blocks of bounded size."""
    held_a, held_b, n = [], [], 0
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        i, j = np.triu_indices(e - s, 1)
        held_a.append(i + s)
        held_b.append(j + s)
        n += len(i)
        if n > 200_000:
            yield np.concatenate(held_a), np.concatenate(held_b)
            held_a, held_b, n = [], [], 0
    if n:
        yield np.concatenate(held_a), np.concatenate(held_b)


def small_bucket_edges(leaf: DataFrame, classes: DataFrame, near: float = NEAR) -> DataFrame:
    """Spanning forests of the pairs whose sketches agree enough."""
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:                            # one byte per order is enough here
            sk = _bytes(b.column(1), 4 * ORDERS)[:, ::4]
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(sk)], ["cid", "bits"])

    def run(table: pa.Table) -> pa.Table:
        key = table["leaf"].to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        cid, bits = _bytes(table["cid"], 16)[order], _bytes(table["bits"], ORDERS)[order]
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        name, node = np.unique(cid.view("V16").ravel(), return_inverse=True)
        a, b = [], []
        for i, j in _all_pairs(edges):
            hit = (bits[i] == bits[j]).mean(axis=1) >= near
            a.append(node[i[hit]])
            b.append(node[j[hit]])
        if not a:
            return _edge_rows(cid[:0], cid[:0])
        a, b = np.concatenate(a), np.concatenate(b)
        kept = graph.forest(a.tolist(), b.tolist(), len(name))
        raw = name.view(np.uint8).reshape(-1, 16)
        return _edge_rows(raw[a[kept]], raw[b[kept]])

    parts = max(1, -(-leaf.count() // LEAF_ROWS))
    bits = classes.select("cid", "sketch").mapInArrow(thin, "cid binary, bits binary")
    return (leaf.join(bits, "cid")
            .withColumn("_part", F.pmod(F.xxhash64("leaf"), F.lit(parts)))
            .groupBy("_part").applyInArrow(run, "u binary, v binary"))


def _intersections(s: np.ndarray, edges: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray
                   ) -> np.ndarray:
    """Shared shingles of each row of a with each of b, over those in more than one row."""
    size = np.diff(edges)
    pick = np.unique(np.concatenate([rows_a, rows_b]))
    at = np.concatenate([np.arange(edges[r], edges[r + 1]) for r in pick])
    owner = np.repeat(pick, size[pick])
    _, code, n = np.unique(s[at], return_inverse=True, return_counts=True)
    shared = n[code] > 1
    new = np.cumsum(n > 1) - 1
    code, owner = new[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    place_a = np.full(len(edges) - 1, -1)
    place_b = place_a.copy()
    place_a[rows_a], place_b[rows_b] = np.arange(len(rows_a)), np.arange(len(rows_b))
    out = np.zeros((len(rows_a), len(rows_b)), np.float32)      # counts below 2 ** 24 are exact
    width = max(64, min(4096, (1 << 22) // max(1, len(rows_a) + len(rows_b))))
    total = int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, total, width):
        x, y = np.searchsorted(code, [lo, lo + width])
        c, o = code[x:y] - lo, owner[x:y]
        sides = []
        for place, rows in ((place_a, rows_a), (place_b, rows_b)):
            m = np.zeros((len(rows), width), np.float32)
            k = place[o] >= 0
            m[place[o[k]], c[k]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def verified(texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """Exact comparison inside tiles: links per class and a spanning forest of them.

    ``texts`` has cid, root, copies, text, ``_task`` and ``_side`` (0 for rows compared
    with each other, 1 and 2 for the two sides of a tile).
    """
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        s, edges = shingles(table["text"], words)
        own = class_ids(s, edges)
        cid = _bytes(table["cid"], 16)
        good = (own == cid).all(axis=1)              # another text of the same doc_id is not it
        root = _bytes(table["root"], 16).copy().view("V16").ravel()
        side = table["_side"].to_numpy()
        copies = table["copies"].to_numpy()
        name = cid.copy().view("V16").ravel()
        # copies of a row (repeated doc_id) count once
        key = np.concatenate([cid, side.astype(np.uint8)[:, None]], axis=1)
        _, one = np.unique(np.ascontiguousarray(key).view("V17").ravel(), return_index=True)
        rows = np.sort(one[good[one]])
        size = np.diff(edges)
        u, v, links = [], [], np.zeros(table.num_rows, np.int64)
        order = rows[np.argsort(root[rows], kind="stable")]
        cut = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1], [True]])
                             ) if len(order) else np.zeros(1, int)
        for x, y in zip(cut[:-1], cut[1:]):
            group = order[x:y]
            if side[group[0]] == 0:
                a = b = group
            else:
                a, b = group[side[group] == 1], group[side[group] == 2]
            if not len(a) or not len(b) or len(group) < 2:
                continue
            c = _intersections(s, edges, a, b)
            both = size[a][:, None] + size[b][None, :] - c
            hit = c >= threshold * both - 1e-9
            if a is b:
                np.fill_diagonal(hit, False)
            links[a] += hit @ copies[b]
            if a is not b:
                links[b] += copies[a] @ hit
            i, j = np.nonzero(np.triu(hit) if a is b else hit)
            place = {r: k for k, r in enumerate(group.tolist())}
            i, j = a[i], b[j]
            kept = graph.forest([place[r] for r in i.tolist()], [place[r] for r in j.tolist()],
                                len(group))
            u += [name[r].tobytes() for r in i[kept]]
            v += [name[r].tobytes() for r in j[kept]]
        some = np.flatnonzero(links)
        out_u = [name[r].tobytes() for r in some] + u
        return pa.table({"u": pa.array(out_u, pa.binary()),
                         "v": pa.array([None] * len(some) + v, pa.binary()),
                         "links": pa.array([*links[some].tolist(), *[0] * len(u)], pa.int64())},
                        schema=schema)

    return texts.groupBy("_task").applyInArrow(run, "u binary, v binary, links long")


def _tasks(members: DataFrame) -> DataFrame:
    """Deals the classes of candidate components to tasks: small components together by a
    hash, large ones as pairs of blocks."""
    stats = members.groupBy("root").agg(F.count("*").alias("_m"), F.sum("n").alias("_sum"))
    blocks = F.greatest(F.ceil(F.col("_m") / TILE_ROWS), F.ceil(F.col("_sum") / TILE)).cast("int")
    stats = durable(stats.select("root", blocks.alias("_blocks"), "_sum"))
    total = stats.where("_blocks = 1").agg(F.sum("_sum")).first()[0] or 0
    parts = max(1, -(-total // TILE))
    m = members.join(stats.drop("_sum"), "root")
    whole = m.where("_blocks = 1").select(
        "*", F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(parts))).alias("_task"),
        F.lit(0).alias("_side"))
    block = F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int")
    tiles = (m.where("_blocks > 1").withColumn("_b", block)
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .withColumn("_side", F.when(F.col("_b") == F.col("_o"), 0)
                         .when(F.col("_b") < F.col("_o"), 1).otherwise(2))
             .withColumn("_task", F.concat_ws(":", F.hex("root"), F.least("_b", "_o"),
                                              F.greatest("_b", "_o"))).drop("_b", "_o"))
    return whole.unionByName(tiles).drop("_blocks")


def joined(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD,
           recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, text_hash, component_id (least doc_id reachable by
    links, itself included), n_links (documents at the threshold or above), kept."""
    base = durable(signed(docs, words))
    real = base.where("doc_id is not null and n > 0")
    classes = durable(real.groupBy("cid").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"),
        F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    small, large = leaves(paths(classes, runs_needed(recall, threshold)))
    least = large.groupBy("leaf").agg(F.min("cid").alias("v"))
    stars = large.join(least, "leaf").select(F.col("cid").alias("u"), "v")
    candidates = graph.components(small_bucket_edges(small, classes).unionByName(stars))
    members = candidates.join(classes.drop("sketch"), F.col("node") == F.col("cid")).select(
        "cid", "root", "n", "copies", F.col("rep.doc_id").alias("doc_id"))
    members = durable(members)
    sent = _tasks(members).select("cid", "root", "copies", "_task", "_side",
                                  F.col("doc_id").alias("_d"))
    texts = sent.join(docs.select(F.col("doc_id").cast("long").alias("_d"), "text"), "_d")
    found = durable(verified(texts, threshold, words))
    links = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    comps = graph.components(found.where("v is not null").select("u", "v"))
    c = (classes.select("cid", "rep", "copies")
         .join(links.withColumnRenamed("u", "cid"), "cid", "left")
         .join(comps.withColumnRenamed("node", "cid"), "cid", "left")
         .withColumn("root", F.coalesce("root", "cid")))
    least = c.groupBy("root").agg(F.min("rep").alias("low"))
    c = graph.spread_join(c, least, "root", "cid").select(
        "cid", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = F.col("n_links").isNull()
    me = F.struct("doc_id", "text_hash")
    out = base.select("doc_id", "text_hash", F.when(
        (F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("cid")).alias("cid")).join(
            c, "cid", "left")
    return out.select(
        "doc_id", "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("low.doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (me == F.col("low"))).alias("kept"))


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, one of each group; rows without links all stay."""
    names = docs.columns
    d, h, links = (free(names, x) for x in ("kept_id", "kept_hash", "kept_links"))
    d2, h2 = free(names, "own_id"), free(names, "own_hash")
    keep = (joined(docs, **options).where("kept")
            .groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
            .agg(F.max("n_links").alias(links)))
    a = docs.withColumns({d2: F.col("doc_id").cast("long"), h2: F.xxhash64("text")})
    hit = a.join(keep, F.col(d).eqNullSafe(F.col(d2)) & (F.col(h) == F.col(h2)))
    single = hit.where(F.col(links) == 0)
    # repeated rows of a kept document have the same doc_id and text; one of them stays
    rest = hit.where(F.col(links) > 0).dropDuplicates([d2, h2])
    return single.unionByName(rest).select(*names)
