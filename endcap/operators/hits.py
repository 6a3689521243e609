"""Motif matches in reads, and the rules that make them one clean layer of runs.

The rules, in order: every motif is matched on its own without self-overlap; a match
that touches any match of a longer motif containing it is dropped; touching matches
of one motif join into a run; a run is cut where the next run of any motif starts.

``raw_hits`` and the three relational steps give hits as rows. ``Painter`` applies
the same rules inside one read for the bulk path, where no shuffle is wanted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endcap.motifs import UNKNOWN, MotifTable

BIN = 64


#: Letters looked at together, and the codes of the four known ones; all others count as bad.
SPAN = 8
_CODES = bytes({65: 0, 67: 1, 71: 2, 84: 3}.get(x, 4) for x in range(256))


def match_starts(seq: str, word: str) -> np.ndarray:
    return np.array([m.start() for m in re.finditer(word, seq)], dtype=np.int64)


class Matcher:
    """All matches of many words in a read, each word on its own without self-overlap.

    The next eight letters of a position are one number, and a table tells which words begin
    there; longer words are searched one by one.
    """

    def __init__(self, words: tuple[str, ...]) -> None:
        self.words = words
        self.width = np.array([len(w) for w in words], dtype=np.int64)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= SPAN and set(w) <= set("ACGT")]
        self.rest = [k for k in range(len(words)) if k not in set(short)]
        # words that may overlap themselves
        self.tangled = [k for k in short if any(words[k].startswith(words[k][n:])
                                                for n in range(1, len(words[k])))]
        number = np.arange(4 ** SPAN)
        begins = np.zeros((4 ** SPAN, len(short)), dtype=bool)
        for c, k in enumerate(short):
            code = sum("ACGT".index(x) << 2 * (len(words[k]) - 1 - n) for n, x in enumerate(words[k]))
            begins[:, c] = number >> 2 * (SPAN - len(words[k])) == code
        order = np.flatnonzero(begins.any(axis=1))
        sets, which = np.unique(begins[order], axis=0, return_inverse=True)
        self.table = np.zeros(4 ** SPAN, dtype=np.uint16)
        self.table[order] = which.reshape(-1) + 1
        self.size = np.concatenate(([0], sets.sum(axis=1))).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.members = np.array(short, dtype=np.int64)[np.nonzero(sets)[1]]

    def find(self, seq: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, word) of all matches, by word and start."""
        code = np.frombuffer(seq.encode("ascii", "replace").translate(_CODES) + b"\4" * SPAN, np.uint8)
        two = (code[:-1] << 2 | code[1:] & 3) & 15
        four = two[:-2] << 4 | two[2:]
        eight = four[:-4].astype(np.uint16) << 8 | four[4:]
        seen = self.table[eight]
        at = np.flatnonzero(seen)
        kind = seen[at]
        n = self.size[kind]
        starts = np.repeat(at, n)
        word = self.members[np.repeat(self.first[kind] - np.cumsum(n) + n, n) + np.arange(len(starts))]
        bad = np.flatnonzero(code == 4)
        sound = np.searchsorted(bad, starts) == np.searchsorted(bad, starts + self.width[word])
        if not sound.all():
            starts, word = starts[sound], word[sound]
        for k in self.rest:
            more = match_starts(seq, self.words[k])
            if len(more):
                starts = np.concatenate([starts, more])
                word = np.concatenate([word, np.full(len(more), k)])
        by = np.argsort(word.astype(np.uint16), kind="stable")
        starts, word = starts[by], word[by]
        drop = []
        for k in self.tangled:
            lo, hi = np.searchsorted(word, [k, k + 1])
            if (np.diff(starts[lo:hi]) < self.width[k]).any():
                end = -1
                for i in range(lo, hi):
                    if starts[i] < end:
                        drop.append(i)
                    else:
                        end = starts[i] + self.width[k]
        return (np.delete(starts, drop), np.delete(word, drop)) if drop else (starts, word)


@lru_cache(maxsize=16)
def matcher(words: tuple[str, ...]) -> Matcher:
    """The matcher of some words, built once per worker."""
    return Matcher(words)


class Painter:
    """Turns one read into its colour vector: one letter per base."""

    def __init__(self, motifs: MotifTable, toward_q: bool = True) -> None:
        self.words = motifs.kmers_rc if toward_q else motifs.kmers
        self.letters = np.frombuffer("".join(motifs.letters).encode(), dtype=np.uint8)
        pairs = sorted((j, i) for i, js in enumerate(motifs.superstrings()) for j in js)
        # words inside each word, one after another
        self.n_inside = np.bincount([j for j, _ in pairs], minlength=len(self.words))
        self.first_inside = np.cumsum(self.n_inside) - self.n_inside
        self.inside = np.array([i for _, i in pairs], dtype=np.int64)

    def joined(self, seq: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, motif index) of the joined runs, before they are cut."""
        found = matcher(self.words)
        starts, ki = found.find(seq)
        ends = starts + found.width[ki]
        # each match marks its place for every word inside it; words are laid end to end
        n = self.n_inside[ki]
        row = np.repeat(np.arange(len(starts)), n)
        small = self.inside[np.repeat(self.first_inside[ki] - np.cumsum(n) + n, n) + np.arange(len(row))]
        size = len(seq) + 1
        begun = np.sort(small * size + starts[row])
        over = np.sort(small * size + ends[row])
        free = (np.searchsorted(begun, ki * size + ends)
                == np.searchsorted(over, ki * size + starts, side="right"))
        starts, ends, ki = starts[free], ends[free], ki[free]
        if not len(starts):
            return starts, ends, ki
        head = np.concatenate(([True], (ki[1:] != ki[:-1]) | (starts[1:] != ends[:-1])))
        return starts[head], ends[np.append(head[1:], True)], ki[head]

    def runs(self, seq: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, motif index) of the final runs, by start."""
        s, e, ki = self.joined(seq)
        by = np.lexsort((ki, s))
        s, e, ki = s[by], e[by], ki[by]
        nxt = np.searchsorted(s, s, side="right")
        limit = np.append(s, np.iinfo(np.int64).max)[nxt]
        return s, np.minimum(e, limit), ki

    def paint(self, seq: str) -> np.ndarray:
        out = np.full(len(seq), ord(UNKNOWN), dtype=np.uint8)
        s, e, ki = self.runs(seq)
        n = e - s                       # of runs with one start the last one is on top
        out[np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(self.letters[ki], n)
        return out


def _rows(reads: DataFrame, one: Callable[[str], tuple]) -> DataFrame:
    """(rid, ki, s, e) of what ``one`` finds in each read: (starts, ends, motif indices)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(seq) for seq in batch.column(1).to_pylist()]
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
                    for k in range(3)]
            yield pa.record_batch({
                "rid": pa.array(np.repeat(rid, [len(f[0]) for f in found]).astype(np.int64)),
                "ki": pa.array(cols[2].astype(np.int32)), "s": pa.array(cols[0].astype(np.int32)),
                "e": pa.array(cols[1].astype(np.int32))})

    return (reads.select(F.col("rid").cast("long"), "seq").where("seq is not null")
            .mapInArrow(find, "rid long, ki int, s int, e int"))


def raw_hits(reads: DataFrame, motifs: MotifTable, toward_q: bool = True) -> DataFrame:
    """One row per match: (rid, ki, s, e). A narrow step."""
    words = motifs.kmers_rc if toward_q else motifs.kmers

    def one(seq: str) -> tuple:
        found = matcher(words)
        starts, ki = found.find(seq)
        return starts, starts + found.width[ki], ki

    return _rows(reads, one)


def joined_runs(reads: DataFrame, motifs: MotifTable, toward_q: bool = True) -> DataFrame:
    """The joined runs, not yet cut, as rows (rid, ki, s, e), found within each read: no shuffle."""
    return _rows(reads, Painter(motifs, toward_q).joined)


def painted_runs(reads: DataFrame, motifs: MotifTable, toward_q: bool = True) -> DataFrame:
    """The final runs as rows (rid, ki, s, e), found within each read: no shuffle."""
    return _rows(reads, Painter(motifs, toward_q).runs)


def drop_covered(hits: DataFrame, motifs: MotifTable) -> DataFrame:
    """Drop hits that overlap a raw hit of a longer motif containing theirs.

    An interval anti-join: each longer hit is spread over the position bins in which
    an overlapping start can lie, so the join is an equi-join on (read, motif, bin).
    """
    spark = hits.sparkSession
    longest = max(len(k) for k in motifs.kmers)
    pairs = motifs.super_frame(spark)
    big = (hits.select("rid", F.col("ki").alias("super_ki"), F.col("s").alias("bs"),
                       F.col("e").alias("be"))
           .join(F.broadcast(pairs), "super_ki")
           .withColumn("bin", F.explode(F.sequence(
               F.floor(F.greatest(F.col("bs") - longest, F.lit(0)) / BIN),
               F.floor((F.col("be") - 1) / BIN))))
           .select(F.col("rid").alias("brid"), F.col("ki").alias("bki"),
                   F.col("bin").alias("bbin"), "bs", "be"))
    small = hits.withColumn("bin", F.floor(F.col("s") / BIN))
    hit = ((F.col("rid") == F.col("brid")) & (F.col("ki") == F.col("bki"))
           & (F.col("bin") == F.col("bbin"))
           & (F.col("s") < F.col("be")) & (F.col("bs") < F.col("e")))
    return small.join(big, hit, "left_anti").drop("bin")


def join_touching(hits: DataFrame) -> DataFrame:
    """Join matches of one motif that touch into runs."""
    w = Window.partitionBy("rid", "ki").orderBy("s")
    new = (F.lag("e").over(w).isNull() | (F.lag("e").over(w) != F.col("s"))).cast("int")
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (hits.withColumn("new", new).withColumn("run", run)
            .groupBy("rid", "ki", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
            .drop("run"))


def cut_at_next(runs: DataFrame) -> DataFrame:
    """End each run where the next run of the read starts."""
    w = (Window.partitionBy("rid").orderBy("s")
         .rangeBetween(1, Window.unboundedFollowing))
    return runs.withColumn(
        "e", F.least("e", F.coalesce(F.min("s").over(w), F.col("e"))))


def final_runs(reads: DataFrame, motifs: MotifTable, toward_q: bool = True) -> DataFrame:
    """All four rules on rows: (rid, ki, s, e), runs never overlap."""
    return cut_at_next(join_touching(drop_covered(raw_hits(reads, motifs, toward_q), motifs)))


def color_vectors(reads: DataFrame, motifs: MotifTable, toward_q: bool = True) -> DataFrame:
    """Bulk path: (…, cvec) added to every read in one narrow step."""
    from endcap.functions.batch import text_udf
    painter = Painter(motifs, toward_q)
    return reads.withColumn("cvec", text_udf(lambda s: painter.paint(s).tobytes().decode())("seq"))
