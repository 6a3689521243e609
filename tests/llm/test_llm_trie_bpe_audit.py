"""Byte pairs, prefix tries and filter orders against plain restatements, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from endcap.llm import bpe, filter_audit, prefix_trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, w string"
TURNS = "conv_id long, turn long, role string, text string, shard string, key string"


# ---- byte pairs ----------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCAB))


def same_as_library(library, texts):
    for text, (raw, decoded) in zip(texts, bpe.encoder(None)(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, ascii(text)
        assert decoded == library.decode(ids, skip_special_tokens=False)


POOL = [*"abcdeABC  \t\n'sσΣİß日本é̀1²½٣!?<|>_-\u0085 ​\x1c\x1f😀가", "<|endoftext|>", "<|startoftext|>",
        "<|ENDOFTEXT|>", "'re", "՘", "Ᲊ", "\U00010d50", "the ", "internationalization", "ΑΣ", " Ω"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(POOL), max_size=40).map("".join), max_size=6))
def test_ids_of_odd_texts(texts):
    same_as_library(Tokenizer.from_file(public_tokenizers.path(bpe.VOCAB)), texts)


def test_ids_of_any_characters(library):
    r = random.Random(1)
    pick = [lambda: r.randint(0, 0x2FFF), lambda: r.randint(0, 0xD7FF), lambda: r.randint(0xE000, 0x10FFFF)]
    same_as_library(library, ["".join(chr(r.choice(pick)()) for _ in range(20)) for _ in range(800)])


def test_ids_of_long_words(library):
    r = random.Random(2)
    same_as_library(library, ["a" * 700, "the" * 400 + " x", "ab" * 5000, "x" * 512, "x" * 513, "日" * 300,
                              "".join(r.choice("etaoinsh") for _ in range(30_000))])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="theinga", min_size=1, max_size=16), min_size=1, max_size=9))
def test_matrix_and_single_trees_agree(words):
    v = bpe.vocabulary()
    ids, at = bpe.merged(v, [w.encode() for w in words])
    for w, lo, hi in zip(words, at, at[1:]):
        sym, _ = bpe.symbols(v, [w.encode()])
        left = bpe.merge_long(v, sym)
        assert left[left >= 0].tolist() == ids[lo:hi].tolist()


def test_words_forgotten_between_slices(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 5)
    e = bpe.Encoder()
    for text in ["one two three four", "five six seven one two", "one", ""]:
        assert np.frombuffer(e([text])[0][0], "<u4").tolist() == library.encode(
            text, add_special_tokens=False).ids


def test_encoded_rows(spark, library):
    rows = [(1, "Hello  World"), (1, "Hello  World"), (None, None), (2, ""), (3, " \n"),
            (4, "word " * 60_000), (5, "<|endoftext|>x")]
    df = spark.createDataFrame([(d, t, "en", None, 0, "s", "w") for d, t in rows], DOCS)
    got = sorted(bpe.decoded(bpe.encoded(df), out="again").collect(), key=lambda r: str(r.doc_id))
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, sorted(rows, key=lambda r: str(r[0]))):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens, list(r.ids), r.decoded, r.again) == (d, len(ids), ids, text, text)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encoded(df.limit(0)).count() == 0


# ---- prefix trie ---------------------------------------------------------------

def plain_nodes(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, h, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    nodes = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        turns = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append((c, len(turns)))
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (
            (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(c for c, n in nodes[p] if n == len(p)))
        out.append((min(nodes[p])[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(nodes[p]),
                    len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n, copies=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 12)):
            rows.append((c * r.choice([1, 1, 3]), t, r.choice(["user", "assistant"]),
                         r.choice(["hi", "yes", "no", "日本", ""]) if t < 3 else f"{r.randint(0, 5)}"))
    return rows + [(10_000 + 5 * k, t, "user", f"copy {t}") for k in range(copies) for t in range(10)]


@pytest.mark.parametrize("shard", [1, 7, 60, 200_000])
def test_nodes_by_brute_force(spark, shard):
    rows = talk(shard, 120, 60)
    rows += [(None, 1, "user", "x"), (7001, None, None, None), (7001, 2, "user", "b"), (7001, 2, "a", "b"),
             (7002, 0, "user", "é"), (7002, 0, "user", "é"), (-3, 1, "user", "neg"), (0, 1, "user", "zero"),
             *[(8000, t, "user", f"long {t}") for t in range(900)],
             *[(8001, t, "user", f"long {t}") for t in range(900)]]
    df = spark.createDataFrame([(*r, "s", "k") for r in rows], TURNS).repartition(5)
    got = prefix_trie.prefix_nodes(prefix_trie.rebuilt(df), shard).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_nodes(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_nodes(prefix_trie.rebuilt(df)).count() == 0
    df = spark.createDataFrame([(None, 1, "a", "b", "", "")], TURNS)
    assert prefix_trie.prefix_nodes(prefix_trie.rebuilt(df)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.sets(st.lists(st.integers(1, 9), max_size=6).map(tuple), min_size=1, max_size=40))
def test_double_array_holds_its_sequences(sequences):
    prefixes = sorted({s[:d] for s in sequences for d in range(len(s) + 1)})
    number = {p: i for i, p in enumerate(prefixes)}
    trie = prefix_trie.DoubleArray(np.array([number[p[:-1]] if p else -1 for p in prefixes]),
                                   np.array([p[-1] if p else 0 for p in prefixes]), 9)
    ends = [trie.walk(list(p)) for p in prefixes]
    assert ends == trie.slot.tolist() and len(set(ends)) == len(prefixes)
    for p in prefixes:
        for c in range(1, 11):
            assert (trie.walk([*p, c]) >= 0) == ((*p, c) in number)
    # CHECK leads back to the root
    for p in prefixes[1:]:
        assert trie.check[trie.slot[number[p]]] == trie.slot[number[p[:-1]]]


# ---- orders of filters ---------------------------------------------------------

def plain_audit(docs, labels):
    marks = {}
    for d, q, t in labels:
        old = marks.get(d, (False, False))
        marks[d] = (old[0] or q == 1, old[1] or t == 1)
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    by_part = defaultdict(list)
    for d, text, part in docs:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = ("A" * (len(ws) < 50) + "B" * (100 * len(set(ws)) < 65 * len(ws))
                + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
                + "D" * bool(re.search(r"[#$%&*|]", t))
                + "E" * (d is not None and d > least[t]))
        by_part[part or ""].append((mask, *(marks.get(d, (False, False)) if d is not None else (False, False))))
    out = []
    for part, rows in by_part.items():
        shap, got = defaultdict(int), []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shap[f] += len(gone)
                got.append((part, order, step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone),
                            sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*g, shap[g[1][g[2] - 1]]) for g in got]
    return sorted(out)


def test_audit_by_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "b", "Cc", "dd", "#", "é", "ABC"]) if k % 3 else f"w{r.randint(0, 90)}"
                      for _ in range(r.randint(0, 120))) for k in range(40)]
    docs = [(k, r.choice(texts), r.choice(["s1", "s2", "", None])) for k in range(150)]
    docs += [(None, texts[0], "s1"), (None, None, None), (9, texts[1], "s2"), (9, texts[1], "s2"), (500, None, "s3"),
             (501, "", "s3"), (502, "\t\n", "s3"), (503, "word " * 50_000, "s3"), (-4, texts[2], "s1")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 150, 2)]
    labels += [(8, 1, 0), (8, 0, 1), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame([(a, t, "en", s, 0, "x", "y") for a, t, s in docs], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(d, lab)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                           "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(x) for x in got.collect()) == plain_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert filter_audit.audit(d, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_intervals_cover_every_order_once():
    for mask in range(1, 32):
        ranks = sorted(r for m, _, lo, hi in filter_audit.intervals(5) if m == mask for r in range(lo, hi))
        assert ranks == list(range(120))
