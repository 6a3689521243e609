"""Encoding and decoding with a byte-pair vocabulary file, by a segment tree over pair ranks.

A word is a row of symbols. The leaves of its tree hold (rank, place) of each adjacent pair
that merges, inner nodes the smaller of two; so the root is the leftmost pair of lowest rank.
A merge changes at most three leaves and the nodes above them. Words of up to ``WIDE`` bytes
are merged together, their trees being the rows of one matrix; longer words one at a time.

Words already merged are remembered by the worker (a bounded cache; it changes no result).
Texts are split as the vocabulary file says: special tokens first, then Unicode
composition, lower case letter by letter, and words. Characters that this Python does not know yet are
left to the normaliser and splitter of the file itself.

Defined cases: null text counts as empty, an empty text has no ids and decodes to the
empty text; null and repeated ``doc_id`` are kept, each row on its own; other columns of the
input are not looked at. Words and texts may have any length. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endcap.llm import words as wd

VOCAB = "word_bpe_49k.json"
#: Bytes of a word whose tree is a row of a matrix; cells of one matrix; words remembered.
WIDE, CELLS, KNOWN = 512, 1 << 18, 400_000
NONE = np.int64(1) << 62


class Vocabulary(NamedTuple):
    inner: np.ndarray        # id of each byte within a word
    last: np.ndarray         # id of each byte that ends a word, -1 where there is none
    pairs: np.ndarray        # left id x size + right id, sorted
    ranks: np.ndarray        # rank of each of ``pairs``
    product: np.ndarray      # id made by the merge of each rank
    pieces: list[str]        # spelling of each id
    special: dict[str, int]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(sorted(set(range(256)) - set(shown))):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


def where(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCAB)


@functools.cache
def vocabulary(path: str | None = None) -> Vocabulary:
    with open(where(path), encoding="utf-8") as f:
        file = json.load(f)
    model, end = file["model"], file["model"].get("end_of_word_suffix") or ""
    if model["type"] != "BPE" or file["decoder"] is not None or file["post_processor"] is not None:
        raise ValueError("only plain byte-pair vocabularies without decoder are read")
    ids, special = model["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    pieces = [""] * (max([*ids.values(), *special.values()]) + 1)
    for piece, i in [*ids.items(), *special.items()]:
        pieces[i] = piece
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = np.array([ids[a] * len(pieces) + ids[b] for a, b in merges], np.int64)
    order = np.argsort(pairs, kind="stable")
    letters = byte_letters()
    return Vocabulary(np.array([ids.get(c, -1) for c in letters], np.int64),
                      np.array([ids.get(c + end, -1) for c in letters], np.int64),
                      pairs[order], order.astype(np.int64),
                      np.array([ids[a + b] for a, b in merges], np.int64), pieces, special)


def pair_ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair of ids, ``NONE`` where it does not merge (or an id is -1)."""
    key = left * len(v.pieces) + right
    at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
    return np.where((v.pairs[at] == key) & (left >= 0) & (right >= 0), v.ranks[at], NONE)


def symbols(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the bytes of all words and the offsets of the words; bytes without an id fall away."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    out = v.inner[raw]
    full = ends[np.diff(ends, prepend=0) > 0]
    out[full - 1] = v.last[raw[full - 1]]
    kept = np.concatenate([[0], np.cumsum(out >= 0)])
    return out[out >= 0], np.concatenate([[0], kept[ends]])


def merge_rows(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """Merge every row of ids (-1 behind its end; a power of two wide) to the end, in place.

    Ids that were merged away become -1.
    """
    n, w = sym.shape
    shift = np.int64(w.bit_length())
    sym = np.concatenate([sym, np.full((n, 1), -1)], axis=1)      # column w: beyond either end

    def leaf(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(rank < NONE, (rank << shift) | place, NONE)

    tree = np.full((n, 2 * w), NONE)
    tree[:, w:] = leaf(pair_ranks(v, sym[:, :-1], sym[:, 1:]), np.arange(w))
    level = w
    while level > 1:
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2],
                                               tree[:, level + 1:2 * level:2])
        level //= 2
    after = np.tile(np.minimum(np.arange(1, w + 2), w), (n, 1))
    before = np.tile(np.concatenate([[w], np.arange(w)]), (n, 1))
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        root = tree[rows, 1]
        i = root & ((np.int64(1) << shift) - 1)
        j = after[rows, i]
        k, p = after[rows, j], before[rows, i]
        made = v.product[root >> shift]
        sym[rows, i], sym[rows, j] = made, -1
        after[rows, i], before[rows, k] = k, i
        here = leaf(pair_ranks(v, made, sym[rows, k]), i)
        tree[rows, w + j] = NONE
        tree[rows, w + i] = here
        q = np.where(p < w, p, i)
        tree[rows, w + q] = np.where(p < w, leaf(pair_ranks(v, sym[rows, p], made), q), here)
        touched = [w + i, w + j, w + q]
        for _ in range(int(w).bit_length() - 1):
            touched = [t >> 1 for t in touched]
            for t in touched:
                tree[rows, t] = np.minimum(tree[rows, 2 * t], tree[rows, 2 * t + 1])
        rows = rows[tree[rows, 1] < NONE]
    return sym[:, :w]


def merge_long(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """The same for one word of any length, with its tree as a list."""
    n = len(sym)
    w = 1 << max(0, n - 1).bit_length()
    none, size = (int(NONE), 0), len(v.pieces)
    rank = dict(zip(v.pairs.tolist(), v.ranks.tolist()))
    product, ids = v.product.tolist(), sym.tolist()
    tree = [none] * (2 * w)
    for i, r in enumerate(pair_ranks(v, sym[:-1], sym[1:]).tolist()):
        tree[w + i] = (r, i)
    for t in range(w - 1, 0, -1):
        tree[t] = min(tree[2 * t], tree[2 * t + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: tuple[int, int]) -> None:
        t = w + i
        tree[t] = value
        while t > 1:
            t >>= 1
            tree[t] = min(tree[2 * t], tree[2 * t + 1])

    def ranked(i: int, j: int) -> tuple[int, int]:
        return rank.get(ids[i] * size + ids[j], none[0]), i

    while tree[1][0] < none[0]:
        r, i = tree[1]
        j, p = after[i], before[i]
        k = after[j]
        ids[i], ids[j], after[i] = product[r], -1, k
        put(j, none)
        if k < n:
            before[k] = i
        put(i, ranked(i, k) if k < n else none)
        if p >= 0:
            put(p, ranked(p, i))
    return np.array(ids, np.int64)


def merged(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words behind one another, and the offsets of the words (n + 1)."""
    sym, at = symbols(v, words)
    size = np.diff(at)
    left = sym.copy()                    # -1 where an id was merged away
    lo, w = 2, 2
    while w <= WIDE:
        of = np.flatnonzero((size >= lo) & (size <= w))
        step = max(1, CELLS // w)
        for part in (of[a:a + step] for a in range(0, len(of), step)):
            cells = np.arange(w) < size[part, None]
            place = (at[part, None] + np.arange(w))[cells]
            grid = np.full((len(part), w), -1, np.int64)
            grid[cells] = sym[place]
            left[place] = merge_rows(v, grid)[cells]
        lo, w = w + 1, 2 * w
    for i in np.flatnonzero(size > WIDE).tolist():
        left[at[i]:at[i + 1]] = merge_long(v, sym[at[i]:at[i + 1]])
    kept = np.concatenate([[0], np.cumsum(left >= 0)])
    return left[left >= 0], kept[at]


class Splitter:
    """Texts to lists of words (and, as int, special tokens), as the vocabulary file does it."""

    def __init__(self, path: str | None = None):
        import regex
        from tokenizers import Tokenizer

        self.vocab = vocabulary(path)
        with open(where(path), encoding="utf-8") as f:
            file = json.load(f)
        split = file["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in file["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not (
                split["type"] == "Split" and split["invert"] and split["behavior"] == "Removed"):
            raise ValueError("a vocabulary of lower-case words is expected")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(map(regex.escape, self.vocab.special)) or r"(?!)")
        #: whether this Python knows the character of each number
        self.known = bytes(unicodedata.category(chr(c)) != "Cn" for c in range(sys.maxunicode + 1))
        self.file = Tokenizer.from_file(where(path))
        self.byte = {c: b for b, c in enumerate(byte_letters())}

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text.lower())
        if not all(self.known[ord(c)] for c in set(text)):
            parts = self.file.pre_tokenizer.pre_tokenize_str(self.file.normalizer.normalize_str(text))
            return [bytes(self.byte[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in parts]
        text = unicodedata.normalize("NFC", text)
        return self.words.findall(text.replace("Σ", "σ").lower())

    def __call__(self, text: str) -> list[str | int]:
        if "<|" not in text and all(t.startswith("<|") for t in self.vocab.special):
            return self.plain(text)
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(text):
            out += self.plain(text[at:m.start()])
            out.append(self.vocab.special[m[0]])
            at = m.end()
        return out + self.plain(text[at:])


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit) and to the text that the ids decode to."""

    def __init__(self, path: str | None = None):
        self.split = Splitter(path)
        self.vocab = self.split.vocab
        self.known: dict[str | int, tuple[bytes, str]] = {}

    def learn(self, words: set[str | int]) -> None:
        if len(self.known) + len(words) > KNOWN:
            self.known = {}                          # the caller asks for all that it needs
        new = [w for w in words if w not in self.known]
        text = [w for w in new if isinstance(w, str)]
        ids, at = merged(self.vocab, [w.encode("utf-8", "surrogateescape") for w in text])
        raw, at, ids = ids.astype("<u4").tobytes(), at.tolist(), ids.tolist()
        for w, lo, hi in zip(text, at, at[1:]):
            self.known[w] = raw[4 * lo:4 * hi], decode(self.vocab, ids[lo:hi])
        for i in new:
            if isinstance(i, int):
                self.known[i] = i.to_bytes(4, "little"), decode(self.vocab, [i])

    def __call__(self, texts: list[str]) -> list[tuple[bytes, str]]:
        lists = [self.split(t) for t in texts]
        need = set().union(*lists)
        if not need <= self.known.keys():
            self.learn(need)
        known = self.known
        out = []
        for ws in lists:
            got = [known[w] for w in ws]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])))
        return out


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The pieces of the ids, joined by blanks; numbers that are no ids fall away."""
    return " ".join([v.pieces[i] for i in ids if 0 <= i < len(v.pieces) and v.pieces[i]])


@functools.cache
def encoder(path: str | None) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, with_ids: bool = True, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids and decoded text."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for whole in batches:
            for lo, hi in wd.slices(whole.column(1)):
                b = whole.slice(lo, hi - lo)
                got = code(b.column(1).fill_null("").to_pylist())
                cols = [b.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in got], pa.string())]
                if with_ids:
                    cols += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in got],
                                      pa.list_(pa.int32())),
                             pa.array([t for _, t in got], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    cols, names + (["ids", "decoded"] if with_ids else []))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + (", ids array<int>, decoded string" if with_ids else ""))


def decoded(rows: DataFrame, ids: str = "ids", out: str = "decoded",
            path: str | None = None) -> DataFrame:
    """``rows`` with the text of a column of ids (null: null) in a column ``out``."""
    @F.udf("string", useArrow=True)
    def run(x):
        return None if x is None else decode(vocabulary(path), [i for i in x if i is not None])

    return rows.withColumn(out, run(F.col(ids)))
