"""Sum-of-squares packing of tokenized documents into fixed-length sequences.

Documents become pieces of at most ``length`` tokens. Pieces are dealt into groups of
bounded size by a hash; inside a group the longest come first, and each goes where the
squared counts of open bins per residual gap become smallest: into an open bin, or into a
new one as long as the group has opened fewer than four fifths of the bins its tokens need.
(Past that number a new bin is opened only if the piece fits nowhere, which lets the short
pieces fill the bins at the end instead of leaving many bins half open.) Where that takes
more bins than the group's tokens need, the group is tried once more, the bin with the
smallest gap left winning among open ones, and the result with fewer bins is kept.

Defined cases: null text counts as empty, an empty text is one piece holding the end id
only; null and repeated ``doc_id`` are kept, each row on its own; other columns of the
input are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endcap.functions.durable import durable

VOCAB, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
END_ID = 0
#: Pieces dealt to one group; a bound on a task's memory, not on the input.
GROUP = 32_768
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long")


@functools.cache
def _encoders(vocab: str | None, ranks: str | None):
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocab or P.path(VOCAB))
    with open(ranks or P.path(RANKS), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=table,
                             special_tokens={})
    return full, fast


def token_ids(text: str | None, vocab: str | None = None,
              ranks: str | None = None) -> np.ndarray:
    """Ids of one text and the end id, as the vocabulary file of ``tokenizers`` gives them.

    The same vocabulary as ranks gives the same ids several times faster; a text that
    spells the special token goes to the full tokenizer.
    """
    full, fast = _encoders(vocab, ranks)
    text = text or ""
    if SPECIAL in text:
        ids = full.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1], out[-1] = ids, END_ID
    return out


def cuts(n: int, length: int) -> list[int]:
    """Starts of the pieces of ``n`` tokens: only the first may be shorter."""
    return [0, *range(n % length or length, n, length)] if n > length else [0]


def token_pieces(docs: DataFrame, length: int = 2048, with_ids: bool = False,
                 vocab: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves (array<int>)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = token_ids(text.as_py(), vocab, ranks)
                at = cuts(len(ids), length)
                for k, (s, e) in enumerate(zip(at, [*at[1:], len(ids)])):
                    part = ids[s:e]
                    row = (doc, k, s, e - s, zlib.crc32(part.tobytes()), part.astype(np.int32))
                    for c, v in zip(cols, row):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, PIECES + (", ids array<int>" if with_ids else "")))


def sum_of_squares(sizes: np.ndarray, capacity: int, fit: bool = False
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken in the given order.

    ``fit`` places by the gap left alone: the smallest one, a new bin only where none is open.
    """
    never = 1 << 60
    count = np.zeros(capacity + 1, np.int64)          # open bins per residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = -(-int(sizes.sum()) // capacity) * 4 // 5
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        have = count[s:]                              # bins with room, by gap left after
        change = np.where(have > 0, 2 * (count[:capacity + 1 - s] - have) + 2, never)
        if have[0]:
            change[0] = 1 - 2 * have[0]               # filled to the end: leaves the sum
        left = int((have > 0).argmax() if fit else change.argmin())
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if change[left] >= never or (not fit and opened < free and fresh < change[left]):
            b, at, left = opened, 0, capacity - s
            opened += 1
        else:
            b, at = stacks[left + s].pop(), capacity - left - s
            count[left + s] -= 1
        if left:
            count[left] += 1
            stacks[left].append(b)
        bins[i], offsets[i] = b, at
    return bins, offsets


def fewest(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``sum_of_squares``, tried again by the gap alone if the tokens would need fewer bins."""
    got = sum_of_squares(sizes, capacity)
    if len(sizes) and got[0].max() >= -(-int(sizes.sum()) // capacity):
        again = sum_of_squares(sizes, capacity, fit=True)
        got = min(got, again, key=lambda x: int(x[0].max()))
    return got


def pack(pieces: DataFrame, length: int = 2048, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of pieces.

    ``pieces`` is used twice (counted, then packed) and should be cheap to read again.
    Other columns of it (such as ``ids``) go along.
    """
    groups = max(1, -(-pieces.count() // group))
    names = pieces.columns

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        number = int(t["_group"][0].as_py())
        key = [t[c].to_numpy(zero_copy_only=False) for c in ("ids_crc32", "piece", "length")]
        doc = t["doc_id"].fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((key[0], key[1], doc, -key[2]))
        bins, offsets = fewest(key[2][order], length)
        t = t.take(pa.array(order)).select(names)
        t = t.append_column("sequence_id", pa.array((np.int64(number) << 32) + bins))
        return t.append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"),
                                               F.lit(groups)))
    return (dealt.groupBy("_group")
            .applyInArrow(run, f"{schema}, sequence_id long, offset long"))


def packed(docs: DataFrame, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """Documents to packed pieces; the tokens are counted once and written down."""
    return pack(durable(token_pieces(docs, length, with_ids)), length)
