"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target of words. A document's expected number of copies is its source's
target over its source's size, from 0 to 2; the whole part is certain, the fraction is
rounded so that the words of all copies of a source stay at the target. For that, two
fractional documents of a source meet: mass in words moves from one to the other, in a
random direction that keeps both expectations, until one of them is whole. The other goes
on to the next. One document of a source is left per group of rows; what is left meets in
a tree of groups of groups, and the last one of a source is rounded by itself, so that a
source misses its target by less than the size of one document.

Repeated rows (equal ``doc_id``, source and text) are one row with a number first. Of n such
rows with a fraction f, floor(n f) get the extra copy for certain, and one more takes part in
the rounding with what is left over; so a row that is a third of the table costs no more
accuracy than any other.

Groups are dealt by a hash of the document and random numbers come from hashes, so
results do not depend on partitions and reruns agree.

Defined cases: null text has size 0; null source is a source of its own, listed last;
documents without words are rounded each by itself; of repeated rows as many as said above
have a copy more than the rest. Other columns are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endcap.functions.durable import durable
from endcap.llm.names import free

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Rows of one group at the first level, and groups that meet in one at the next.
GROUP, FAN = 16_384, 256
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def document_words(docs: DataFrame) -> DataFrame:
    """doc_id, source, a hash of the text, and its number of words."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "source",
                       F.xxhash64("text", F.col("text").isNull()).alias("text_hash"),
                       words.alias("size"))


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """source, source_size, target: shares by repeating weights, none above ``most`` times
    its source's size; the excess is shared again among the rest by weight."""
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    src = durable(src.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = src.groupBy("_p").agg(F.count("*").alias("_c"))
    wp = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)   # a row a partition
    before = sums.select("_p", (F.sum("_c").over(wp) - F.col("_c")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("_before")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    src = src.join(before, "_p").select(
        "source", "source_size",
        F.element_at(cycle, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("_w"))
    src = durable(src)
    sums = src.agg(F.sum("source_size"), F.sum("_w")).first()
    total, weight = float(sums[0] or 0) * share, float(sums[1] or 0)
    # sources in the order in which a rising level fills them; the level ends at the first one
    # that, were it full with all before it, leaves no more than the rest takes at that level
    cap = F.col("source_size") * F.lit(float(most))
    src = durable(src.withColumn("_cap", cap).withColumn("_at", F.col("_cap") / F.col("_w"))
                  .repartitionByRange("_at").withColumn("_p", F.spark_partition_id()))
    part = src.groupBy("_p").agg(F.sum("_cap").alias("_c"), F.sum("_w").alias("_v"))
    before = part.select("_p", (F.sum("_c").over(wp) - F.col("_c")).alias("_caps"),
                         (F.sum("_v").over(wp) - F.col("_v")).alias("_ws"))
    run = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = F.col("_caps") + F.sum("_cap").over(run) - F.col("_cap")
    rest = F.lit(weight) - F.col("_ws") - F.sum("_w").over(run) + F.col("_w")
    found = (src.join(before, "_p").select("_at", held.alias("held"), rest.alias("rest"))
             .where(F.col("held") + F.col("_at") * F.col("rest") >= total)
             .agg(F.min(F.struct("_at", "held", "rest")).alias("x")).first()["x"])
    level = (total - found["held"]) / found["rest"] if found else float("inf")
    return src.select("source", "source_size",
                      F.least("_cap", F.col("_w") * F.lit(level)).cast("double").alias("target"))


def _uniform(*keys: np.ndarray) -> float:
    """A number in [0, 1) from integers."""
    h = 0x9E3779B97F4A7C15
    for k in keys:
        h = (h ^ (int(k) & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 31
        h = h * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return (h >> 11) / 2.0**53


def pivot(keys: np.ndarray, sizes: np.ndarray, parts: np.ndarray, seed: int
          ) -> tuple[np.ndarray, int | None]:
    """Round fractions in order; the place of the one still fractional, if any.

    ``sizes`` > 0. The sum of size x part stays the same but for float error.
    """
    f = parts.astype(np.float64).copy()
    held = None
    for i in range(len(f)):
        if not 0.0 < f[i] < 1.0:
            continue
        if held is None:
            held = i
            continue
        c, si, sc = held, sizes[i], sizes[held]
        up = min((1 - f[i]) * si, f[c] * sc)            # mass that i can take from c
        down = min(f[i] * si, (1 - f[c]) * sc)          # mass that c can take from i
        if _uniform(seed, keys[i], keys[c]) * (up + down) < down:
            fills = (1 - f[i]) * si <= f[c] * sc
            f[i], f[c] = (1.0, f[c] - up / sc) if fills else (f[i] + up / si, 0.0)
        else:
            fills = (1 - f[c]) * sc <= f[i] * si
            f[c], f[i] = (1.0, f[i] - down / si) if fills else (f[c] + down / sc, 0.0)
        for x in (i, c):                                # float dust counts as whole
            if f[x] < 1e-12 or f[x] > 1 - 1e-12:
                f[x] = round(f[x])
        held = next((x for x in (i, c) if 0.0 < f[x] < 1.0), None)
    return f, held


_ROW = ("doc_id long, source string, text_hash long, size long, source_size long, "
        "target double, whole int, times long, sure long, part double, _group long")
UNIT = ["doc_id", "source", "text_hash", "size", "source_size", "target", "whole", "times"]
#: Copies of one row that one task writes out.
WRITE = 100_000


def _round_group(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        u = t.to_pandas()
        null = u["source"].isna()
        doc = u["doc_id"].fillna(0).astype("int64").to_numpy()
        # long documents first: what is left over at the end is short
        order = np.lexsort((u["doc_id"].isna(), doc, u["text_hash"], -u["size"].to_numpy(),
                            u["source"].fillna(""), null))
        sizes = u["size"].to_numpy(np.float64)
        parts = u["part"].to_numpy(np.float64).copy()
        keys = u["text_hash"].to_numpy(np.int64)
        src = (u["source"].fillna("") + null.astype(str)).to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(u) else []
        for a, b in zip(starts, [*starts[1:], len(u)]):
            mine = order[a:b]
            pick = mine[sizes[mine] > 0]
            parts[pick], held = pivot(keys[pick], sizes[pick], parts[pick], seed)
            alone = mine[sizes[mine] == 0]
            if last and held is not None:
                alone = np.append(alone, pick[held])
            for i in alone:
                parts[i] = float(_uniform(seed + 1, keys[i], doc[i]) < parts[i])
        return t.set_column(t.schema.get_field_index("part"), "part", pa.array(parts))

    return run


def units(rows: DataFrame) -> DataFrame:
    """Distinct rows of doc_id, source, text_hash and size, with ``times``."""
    return rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("times"))


def rounded(distinct: DataFrame, targets: DataFrame, seed: int = 17, group: int = GROUP,
            fan: int = FAN) -> DataFrame:
    """Adds ``whole``, the copies of each of the ``times`` rows, and ``extra``, how many of
    these rows have one more."""
    distinct = durable(distinct)
    groups = max(1, -(-distinct.count() // group))
    t = targets.withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    more = F.col("times") * F.col("_f")
    df = (distinct.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
          .withColumn("whole", F.floor(rate).cast("int")).withColumn("_f", rate - F.floor(rate))
          .withColumn("sure", F.floor(more).cast("long")).withColumn("part", more - F.floor(more))
          .withColumn("_group", F.pmod(F.xxhash64("doc_id", "text_hash", "source"), F.lit(groups)))
          .select(*UNIT, "sure", "part", "_group"))
    state = durable(df.groupBy("_group").applyInArrow(_round_group(seed, groups == 1), _ROW))
    open_ = (F.col("part") > 0) & (F.col("part") < 1)
    done = []
    while groups > 1:
        done.append(state.where(~open_))
        groups, seed = -(-groups // fan), seed + 2
        left = state.where(open_).withColumn("_group", F.floor(F.col("_group") / fan))
        state = durable(left.groupBy("source", "_group").applyInArrow(
            _round_group(seed, groups == 1), _ROW))
    for d in done:
        state = state.unionByName(d)
    return state.select(*UNIT, (F.col("sure") + F.col("part").cast("long")).alias("extra"))


def spread(rows: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times; many of one row are written by several tasks."""
    few = F.col(times) <= WRITE
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / WRITE))
    name, block = free(rows.columns, "copy"), free(rows.columns, "block")
    many = (rows.where(~few).withColumn(block, F.explode(blocks))
            .withColumn(times, F.least(F.lit(WRITE), F.col(times) - F.col(block) * WRITE))
            .repartition(block).drop(block))
    return (rows.where(few & (F.col(times) > 0)).unionByName(many)
            .withColumn(name, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int"))))
            .drop(name))


def copies(rows: DataFrame, targets: DataFrame, seed: int = 17, group: int = GROUP,
           fan: int = FAN) -> DataFrame:
    """Adds ``copies`` to rows of doc_id, source, text_hash and size."""
    got = durable(rounded(units(rows), targets, seed, group, fan))
    kinds = F.filter(F.array(
        F.struct(F.col("whole").alias("copies"), (F.col("times") - F.col("extra")).alias("rows")),
        F.struct((F.col("whole") + 1).alias("copies"), F.col("extra").alias("rows"))),
        lambda k: k["rows"] > 0)
    return spread(got.select(*UNIT[:-2], F.inline(kinds)), "rows").drop("rows")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0,
          seed: int = 17) -> DataFrame:
    """Sizes, targets and copies of all documents, without their texts."""
    rows = durable(document_words(docs))
    return copies(rows, source_targets(rows, weights, share, most), seed)


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as it is copied.

    Repeated documents are listed once with a number first (in an order of their other
    columns), so that the copies which only some of them get are dealt without one task for all.
    """
    names = docs.columns
    d, s, h, k, w, e, t, m = (free(names, x) for x in (
        "own_id", "own_source", "own_hash", "copy", "whole", "extra", "times", "rows"))
    words = durable(document_words(docs))
    plan = durable(rounded(units(words), source_targets(words, **options)))
    b = plan.where("whole + extra > 0").select(
        F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("text_hash").alias("h"),
        F.col("whole").alias(w), F.col("extra").alias(e), F.col("times").alias(t)).alias("b")
    a = docs.withColumns({d: F.col("doc_id").cast("long"), s: F.col("source"),
                          h: F.xxhash64("text", F.col("text").isNull())}).alias("a")

    def hits(which: str) -> DataFrame:
        return a.join(b.where(which), F.col(f"a.{d}").eqNullSafe(F.col("b.d"))
                      & F.col(f"a.{s}").eqNullSafe(F.col("b.s")) & (F.col(f"a.{h}") == F.col("b.h")))

    cols = [F.col(f"a.`{c}`").alias(c) for c in names]
    single = hits(f"{t} = 1").select(*cols, F.explode(F.array_repeat(
        F.lit(0), (F.col(f"b.{w}") + F.col(f"b.{e}")).cast("int"))).alias(k)).drop(k)
    if plan.where("times > 1").isEmpty():
        return single
    rest = [c for c in names if c != "text"]
    own = [d, s, h, w, e]
    many = (hits(f"{t} > 1").select(*cols, *[F.col(f"a.{c}").alias(c) for c in (d, s, h)],
                                    F.col(f"b.{w}").alias(w), F.col(f"b.{e}").alias(e))
            .groupBy(*rest, *own).agg(F.first("text").alias("text"), F.count("*").alias(m)))
    order = Window.partitionBy(d, s, h).orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(m).over(order) - F.col(m)
    share = F.greatest(F.lit(0), F.least(F.col(m), F.col(e) - before))
    many = many.withColumn(m, F.col(m) * F.col(w) + share).select(*names, m)
    return single.unionByName(spread(many, m).select(*names))
