"""Toxicity scores: gradient-boosted trees over dense lexical features, isotonic.

Features of a text are densities of abusive words (a fixed lexicon, and words and word
beginnings learned from labels, as inflection varies the ends), how often a second-person word stands near one, capitals, punctuation, and
obfuscation (symbols or digits for letters, letters repeated). Trees are boosted on the
logistic loss with histograms; a third of the rows is kept from them for calibration.

The classifier is fitted on at most about ``FIT_ROWS`` labelled rows, taken by a hash of
their ids; every row of the input is scored over its whole text.

Defined cases: null text is empty; an empty text has features 0 and is scored like any
other; a null ``doc_id`` has no label and is not held out; repeated rows are scored each;
labels null or outside 0 and 1 are not learned from. Without labels of both kinds the
score is 1 where the fixed lexicon occurs at least twice per hundred words, else 0.
Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from endcap.functions.durable import durable
from endcap.llm import words as wd
from endcap.llm.calibration import Isotonic, isotonic
from endcap.llm.names import free
from endcap.llm.quality import remainder

#: Bound on the labelled rows that the lexicon, the trees and the calibration are fitted on.
FIT_ROWS = 60_000
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
LEARNED = 256
#: Abusive texts that a learned word needs, and its log odds ratio.
LEAST, ODDS = 3, 2.0
#: Bytes of word beginnings that are learned.
STEMS = range(4, 10)
#: Words between a second-person word and an abusive one that counts as aimed.
NEAR = 6

# Common abusive words, lower case.
LEXICON = """
idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools foolish loser
losers trash garbage scum scumbag clown clowns pathetic worthless disgusting disgrace filth filthy
vermin parasite parasites imbecile retard retarded freak freaks creep creeps jerk jerks bastard
bastards bitch bitches whore slut cunt dick asshole shit shitty crap fuck fucking fucker damn
hate hateful kill ugly lame useless brainless braindead coward cowards liar liars pig pigs rat
connard connards connasse salaud salope pute merde crétin crétins abruti abrutis débile imbécile
idioten dummkopf arschloch scheisse scheiße hurensohn wichser schlampe dreck abschaum trottel
versager ekelhaft wertlos widerlich estúpido estúpida idiota idiotas imbécil mierda puta cabrón
gilipollas basura asqueroso patético inútil escoria maldito
""".split()
# Second-person words of four languages.
SECOND = """
you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine deinen
deiner ihr euch euer eure sie ihnen tú ti contigo vos usted ustedes vosotros vuestro tuyo
""".split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PLAIN = _LOWER.copy()
for _a, _b in zip("013457@$", "oieastas"):
    _PLAIN[ord(_a)] = ord(_b)
_SPELL = _LETTER.copy()
for _a in "013457@$*":
    _SPELL[ord(_a)] = True


def _tokens(kept: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of kept bytes, as wd.words_of gives words."""
    return wd.words_of(np.where(kept, np.uint8(65), np.uint8(32)), offsets)


def _ids(words: list[str]) -> np.ndarray:
    col = pa.array(words, pa.string())
    buf, offsets = wd.text_bytes(col)
    return np.unique(wd.word_hashes(buf, offsets[:-1], offsets[1:]))


def letter_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, and starts, ends, row edges and hashes of runs of letters."""
    buf, offsets = wd.text_bytes(column)
    low = _LOWER[buf]
    starts, ends, first = _tokens(_LETTER[buf], offsets)
    return low, starts, ends, first, wd.word_hashes(low, starts, ends)


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.isin(h, known) if len(known) else np.zeros(len(h), bool)


_FIXED, _SECOND = _ids(LEXICON), _ids(SECOND)


class Lexicon(NamedTuple):
    """Hashes of learned words, and of learned beginnings by their length in bytes."""

    words: np.ndarray
    stems: dict[int, np.ndarray]

    def hits(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray
             ) -> np.ndarray:
        out = _member(h, self.words)
        for n, known in self.stems.items():
            k = np.flatnonzero(ends - starts >= n)
            out[k] |= _member(wd.word_hashes(low, starts[k], starts[k] + n), known)
        return out


def lexicon(words: list[bytes] = (), stems: list[bytes] = ()) -> Lexicon:
    def hashes(items: list[bytes]) -> np.ndarray:
        if not items:
            return np.empty(0, np.uint64)
        buf = np.frombuffer(b"".join(items), np.uint8)
        at = np.cumsum([0, *map(len, items)])
        return np.unique(wd.word_hashes(buf, at[:-1], at[1:]))

    by = {n: hashes([x for x in stems if len(x) == n]) for n in sorted({len(x) for x in stems})}
    return Lexicon(hashes(list(words)), by)


def dense(column: pa.Array, learned: Lexicon) -> np.ndarray:
    """Rows of features."""
    buf, offsets = wd.text_bytes(column)
    low, starts, ends, first, h = letter_words(column)
    n = np.diff(first)
    words, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    fixed, own = _member(h, _FIXED), learned.hits(low, starts, ends, h)
    bad, you = fixed | own, _member(h, _SECOND)
    row = np.repeat(np.arange(len(n)), n)
    # words to the nearest second-person word before or behind, within the text
    at = np.arange(len(h))
    far = 1 << 40
    last = np.maximum.accumulate(np.where(you, at, -far)) if len(h) else at
    nxt = np.minimum.accumulate(np.where(you, at, far)[::-1])[::-1] if len(h) else at
    edge_lo, edge_hi = first[:-1][row], first[1:][row]
    before = np.where(last >= edge_lo, at - last, far)
    behind = np.where(nxt < edge_hi, nxt - at, far)
    aimed = bad & (np.minimum(before, behind) <= NEAR)

    def rate(x: np.ndarray) -> np.ndarray:
        return wd.per_row(x.astype(np.uint8), first) / words

    hits_f, hits_o, hits = (wd.per_row(x.astype(np.uint8), first) for x in (fixed, own, bad))
    kinds = np.zeros(len(n))
    if bad.any():
        pair = np.unique(np.stack([row[bad], _rank(h[bad])]), axis=1)
        kinds = np.bincount(pair[0], minlength=len(n)).astype(float)
    # words spelled with symbols or digits for letters
    s2, e2, f2 = _tokens(_SPELL[buf], offsets)
    odd = wd.per_row(((_SPELL & ~_LETTER)[buf]).astype(np.uint8), offsets)
    spelled = np.zeros(len(n))
    hidden = np.zeros(len(n))
    if len(s2):
        edges = np.stack([s2, e2], axis=1).ravel()
        sym = np.concatenate([[0], np.cumsum((_SPELL & ~_LETTER)[buf])])
        has = sym[edges[1::2]] - sym[edges[::2]]
        inner = (has > 0) & (has < e2 - s2) & _LETTER[buf[s2]]
        r2 = np.repeat(np.arange(len(n)), np.diff(f2))
        spelled = np.bincount(r2[inner], minlength=len(n)).astype(float)
        hh = wd.word_hashes(_PLAIN[buf], s2[inner], e2[inner])
        hidden = np.bincount(r2[inner][_member(hh, _FIXED) | _member(hh, learned.words)],
                             minlength=len(n)).astype(float)
    again = np.zeros(len(buf), np.uint8)
    if len(buf) > 2:
        again[2:] = _LETTER[buf[2:]] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & (buf[2:] < 128)
    upper = ((buf >= 65) & (buf <= 90)).astype(np.uint8)
    shout = ((buf == 33) | (buf == 63)).astype(np.uint8)
    punct = (((buf >= 33) & (buf < 48)) | ((buf >= 58) & (buf < 65)) | ((buf >= 91) & (buf < 97))
             | ((buf >= 123) & (buf < 127))).astype(np.uint8)
    caps = np.zeros(len(h), bool)
    if len(h):
        up = np.concatenate([[0], np.cumsum(upper)])
        caps = (up[ends] - up[starts] == ends - starts) & (ends - starts > 2)
    total = hits + hidden
    return np.stack([
        np.log1p(n), np.log1p(total), 100 * total / words, np.log1p(hits_f), 100 * hits_f / words,
        np.log1p(hits_o), 100 * hits_o / words, kinds, rate(aimed) * 100,
        wd.per_row(aimed.astype(np.uint8), first) / np.maximum(hits, 1), rate(you),
        wd.per_row(upper, offsets) / size, rate(caps), wd.per_row(shout, offsets) / size,
        wd.per_row(punct, offsets) / size, odd / size, spelled / words, hidden,
        wd.per_row(again, offsets) / size], axis=1)


def _rank(h: np.ndarray) -> np.ndarray:
    return np.unique(h, return_inverse=True)[1]


class Trees(NamedTuple):
    """Complete binary trees: split feature and value per inner node, value per leaf."""

    feature: np.ndarray
    value: np.ndarray
    leaf: np.ndarray
    base: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, v, leaf in zip(self.feature, self.value, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > v[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE,
          bins: int = BINS) -> Trees:
    """Second-order boosting on the logistic loss, features cut at quantiles."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    raw = np.full(n, base)
    inner, small = 2**DEPTH - 1, 1.0
    feature, value, leaf = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        fs, vs = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(DEPTH):
            lo, count = 2**d - 1, 2**d
            best = np.full(count, 1e-6)
            for j in range(k):
                b = len(cuts[j]) + 1
                if b == 1:
                    continue
                at = (node - lo) * b + code[:, j]
                gs = np.bincount(at, g, count * b).reshape(count, b).cumsum(axis=1)
                hs = np.bincount(at, h, count * b).reshape(count, b).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + 1) + (gt - gl)**2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < small) | (ht - hl < small)] = 0
                c = gain.argmax(axis=1)
                top = gain[np.arange(count), c]
                for i in np.flatnonzero(top > best):
                    best[i], fs[lo + i], vs[lo + i] = top[i], j, cuts[j][c[i]]
            node = 2 * node + 1 + (x[np.arange(n), fs[node]] > vs[node])
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        step = -rate * gs / (hs + 1)
        raw += step[at]
        feature.append(fs)
        value.append(vs)
        leaf.append(step)
    return Trees(np.array(feature), np.array(value), np.array(leaf), base)


class Model(NamedTuple):
    learned: Lexicon
    trees: Trees | None
    calibrate: Isotonic | None

    def __call__(self, column: pa.Array) -> np.ndarray:
        x = dense(column, self.learned)
        if self.trees is None:
            return (x[:, 2] >= 2).astype(np.float64)
        return self.calibrate(self.trees(x))


def fit_rows(docs: DataFrame, labels: DataFrame, column: str, of: int, held: int,
             most: int = FIT_ROWS) -> DataFrame:
    """Texts of at most about ``most`` rows that may be learned from: doc_id, text, label, part."""
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).where(
        remainder(F.col("doc_id"), of) != held)
    share = most / max(most, usable.count())
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30))
    taken = (usable.where(hashed < int(share * (1 << 30)))
             .groupBy(F.col("doc_id").cast("long").alias("_d"))
             .agg(F.max(column).cast("double").alias("label"))
             .select("_d", "label", F.pmod(F.xxhash64(F.col("_d"), F.lit(3)), F.lit(6))
                     .cast("int").alias("part"))
             .limit(2 * most))                       # the proven bound of what is broadcast
    return docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(
        F.broadcast(taken), "_d")


def learned_lexicons(rows: DataFrame, most: int = LEARNED) -> list[Lexicon]:
    """Words, and beginnings shared by two different words of a text, that stand in many
    more abusive texts than others: of half 0 of the rows, of half 1, and of all."""
    sides = ["n00", "n01", "n10", "n11"]                      # half, label

    def counted(kind: str, names: np.ndarray, side: np.ndarray, spell) -> pa.RecordBatch:
        """Texts per name; ``names`` has columns (text, hash, a token with it)."""
        _, one, code = np.unique(names[1], return_index=True, return_inverse=True)
        n = np.bincount(code * 4 + side[names[0].astype(np.int64)], minlength=4 * len(one))
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(one), pa.string()),
             pa.array([spell(int(i)) for i in names[2][one]], pa.binary()),
             *[pa.array(n[k::4], pa.int64()) for k in range(4)]], ["kind", "word", *sides])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in wd.slices(whole.column(0)):
                b = whole.slice(lo, hi - lo)
                side = 2 * b.column(2).to_numpy() + b.column(1).to_numpy().astype(np.int64)
                low, starts, ends, first, h = letter_words(b.column(0))
                data = low.tobytes()
                row = np.repeat(np.arange(b.num_rows, dtype=np.uint64), np.diff(first))
                pair, one = np.unique(np.stack([row, h]), axis=1, return_index=True)
                yield counted("word", np.stack([*pair, one.astype(np.uint64)]), side,
                              lambda i: data[starts[i]:ends[i]])
                for n in STEMS:
                    t = one[ends[one] - starts[one] >= n]     # a token of each distinct word
                    p = np.stack([row[t], wd.word_hashes(low, starts[t], starts[t] + n)])
                    q, at, times = np.unique(p, axis=1, return_index=True, return_counts=True)
                    k = times > 1
                    yield counted("stem", np.stack([*q[:, k], t[at[k]].astype(np.uint64)]), side,
                                  lambda i, n=n: data[starts[i]:starts[i] + n])

    half = (F.col("part") >= 3).cast("int")
    used = rows.select("text", "label", half.alias("half"))
    total = {(r["half"], r["label"]): r["count"]
             for r in used.groupBy("half", "label").count().collect()}
    counts = durable(used.mapInArrow(run, "kind string, word binary, " + ", ".join(
        f"{c} long" for c in sides)).groupBy("kind", "word").agg(
            *[F.sum(c).alias(c) for c in sides])
        .where((F.col("n01") + F.col("n11") >= LEAST) & (F.length("word") > 2)))
    out = []
    for halves in ((0,), (1,), (0, 1)):
        good, bad = (sum(total.get((h, y), 0) for h in halves) for y in (0.0, 1.0))
        n0, n1 = (sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)) for y in (0, 1))
        if not bad or not good:
            out.append(lexicon())
            continue
        odds = F.log((n1 + 0.5) / bad) - F.log((n0 + 0.5) / good)
        kept = counts.where((n1 >= max(LEAST, 0.02 * bad)) & (odds > ODDS)).withColumn("odds", odds)
        out.append(lexicon(*[[bytes(r["word"]) for r in kept.where(F.col("kind") == k)
                              .orderBy(F.col("odds").desc(), "word").limit(most).collect()]
                             for k in ("word", "stem")]))
    return out


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", of: int = 4, held: int = 2,
        most: int = FIT_ROWS) -> Model:
    rows = fit_rows(docs, labels, column, of, held, most)
    lexicons = learned_lexicons(rows)
    learned = lexicons[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column(2).to_numpy()
            x = None
            for half in (0, 1):                      # each half by the words of the other
                rows_ = np.flatnonzero((part >= 3) == half)
                if len(rows_):
                    f = dense(b.column(0).take(pa.array(rows_)), lexicons[1 - half])
                    x = np.zeros((len(part), f.shape[1])) if x is None else x
                    x[rows_] = f
            if x is None:
                continue
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([flat, b.column(1), b.column(2)],
                                             ["x", "label", "part"])

    got = rows.select("text", "label", "part").mapInArrow(
        run, "x array<double>, label double, part int").toPandas()
    if got.empty or got["label"].nunique() < 2:
        return Model(learned, None, None)
    x, y = np.stack(got["x"].to_numpy()), got["label"].to_numpy()
    hold = (got["part"] % 3 == 2).to_numpy()
    if len(np.unique(y[~hold])) < 2 or hold.sum() < 50:
        hold = np.zeros(len(y), bool)                # too few rows to keep some apart
    trees = boost(x[~hold], y[~hold])
    raw = trees(x[hold] if hold.any() else x)
    yy = y[hold] if hold.any() else y
    value, at = np.unique(np.round(raw, 3), return_inverse=True)
    return Model(learned, trees, isotonic(value, np.bincount(at), np.bincount(at, yy)))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that are not rejected, unchanged, with all their columns."""
    model = fit(docs, labels)
    at, score = docs.columns.index("text"), free(docs.columns, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in wd.slices(whole.column(at)):
                b = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model(b.column(at)))],
                                                 [*b.schema.names, score])

    schema = T.StructType([*docs.schema, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema).where(F.col(score) < threshold).drop(score)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, of: int = 4,
           held: int = 2, column: str = "toxic", most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels, column, of, held, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in wd.slices(whole.column(1)):
                b = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(b.column(1)))],
                                                 ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), of) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
