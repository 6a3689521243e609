"""Per-read helpers against hand-computed values and plain restatements of the rules."""

import numpy as np
import pytest

from endcap import Settings
from endcap import motifs as mt
from endcap.operators import colorvec as cv
from endcap.operators import hits as ht
from endcap.operators import signal as sg

M = mt.human()


def text(v):
    return v.tobytes().decode()


def test_reverse_complement():
    assert mt.reverse_complement("CCCTAANG") == "CNTTAGGG"
    with pytest.raises(ValueError):
        mt.reverse_complement("ccc")


def test_motif_table_order_and_flags():
    assert len(M.kmers) == 59 and M.canonical[0] == "CCCTAA" and M.canonical_letter == "C"
    assert [len(k) for k in M.kmers] == sorted((len(k) for k in M.kmers), reverse=True)
    hifi = mt.human("hifi")
    assert "CCTGG" not in hifi.kmers and hifi.canonical == ("CCCTAA",)


def test_match_positions():
    assert ht.match_starts("CCACCACACCA", "CCA").tolist() == [0, 3, 8]


def test_density_frame():
    mask = np.array([True] * 120 + [False] * 130)
    d = sg.window_hits(mask, 100) / 100
    assert len(d) == 150 and d[0] == 1.0 and d[20] == 0.99 and d[149] == 0.0


@pytest.mark.parametrize("n", [112, 300, 1000, 4096])
def test_wavelet_reconstruction(n):
    x = np.random.default_rng(n).random(n)
    y = sg.recompose(sg.decompose(x))
    assert np.allclose(y[:n], x)


def test_odd_signal_grows_by_one():
    x = np.random.default_rng(0).random(1001)
    assert len(sg.smooth(x)) == 1002
    flat = np.zeros(1001)
    assert sg.smooth(flat) is flat


def test_regions_and_short_signal():
    p = np.array([0.0] * 5 + [-0.6] * 4 + [0.7])
    assert sg.regions(p, 0.5) == [(0, 5, 0), (5, 9, -1), (9, 9, 1)]
    assert sg.regions(p[:0], 0.5) == [(0, 0, 0)]


def test_terminal_length_both_ends():
    rng = np.random.default_rng(1)
    sub = "".join(rng.choice(list("ACGT"), 3000))
    q = sub + "TTAGGG" * 200
    tl, edge, inner = sg.terminal_length(q, M.kmers, M.kmers_rc, Settings(), 100)
    # the last window of the signal is dropped, so the measure falls short by one window
    assert abs(tl - 1100) <= 60 and edge == 0 and inner is None
    p = mt.reverse_complement(q)
    tl, _, _ = sg.terminal_length(p, M.kmers, M.kmers_rc, Settings(), 100, at_left=True)
    assert abs(tl - 1200) <= 60     # at the left end nothing is dropped
    assert sg.orient(p, M) == q
    both = sub + "TTAGGG" * 60 + sub
    tl, _, inner = sg.terminal_length(both, M.kmers, M.kmers_rc, Settings(), 100)
    assert tl == 0 and abs(inner[0] - 3000) < 120 and abs(inner[1] - 3360) < 120
    assert sg.terminal_length("", M.kmers, M.kmers_rc, Settings(), 100) == (0, 0, None)


def plain_runs(seq):
    """The four rules spelled out position by position."""
    words = M.kmers_rc
    raw = [[(int(s), int(s) + len(w)) for s in ht.match_starts(seq, w)] for w in words]
    under = [set(p for s, e in hits for p in range(s, e)) for hits in raw]
    runs = []
    for ki, hits in enumerate(raw):
        live = [(s, e) for s, e in hits
                if not any(p in under[j] for j in M.superstrings()[ki] for p in range(s, e))]
        joined = []
        for s, e in live:
            if joined and joined[-1][1] == s:
                joined[-1][1] = e
            else:
                joined.append([s, e])
        runs += [(s, e, ki) for s, e in joined]
    return sorted((s, min([e] + [s2 for s2, _, _ in runs if s < s2 < e]), ki)
                  for s, e, ki in runs)


def test_painter_follows_the_rules():
    rng = np.random.default_rng(7)
    units = ["TTAGGG", "TCAGGG", "TTAGGGG", "TTGGGG", "TAGG", "CTAGGG", "ACGT", "TTTAGGG"]
    for _ in range(40):
        seq = "".join(rng.choice(units, 30))
        s, e, k = ht.Painter(M).runs(seq)
        got = sorted(zip(s.tolist(), e.tolist(), k.tolist()))
        assert got == plain_runs(seq)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_denoise_values():
    v = "C" * 12 + "D" * 4 + "C" * 12 + "E" * 12 + "A" * 5 + "E" * 12
    want = "C" * 28 + "E" * 12 + "A" * 5 + "E" * 12 + "C"
    assert text(cv.denoise(cv.as_codes(v), "C", "D", "CE")) == want
    assert len(cv.denoise(cv.as_codes(""), "C", "D", "CE")) == 0


def test_density_border_edges():
    short = np.ones(60, dtype=bool)
    assert cv.density_border(short, 100, 0.125, below=True) is None
    assert cv.halves(short, None)[0] is short and cv.halves(short, None)[1] is short
    assert cv.density_border(np.ones(300, dtype=bool), 100, 0.125, below=True) is None
    step = np.array([True] * 200 + [False] * 200)
    assert cv.density_border(step, 100, 0.125, below=True) == 187
    half = np.tile([True, False], 200)
    assert cv.density_border(half, 100, 0.125, below=True) == 0


def test_cumulative_border():
    hit = np.array([False] * 50 + [True] * 200)
    assert cv.cumulative_border(hit, 0.125, 100) == 74
    assert cv.cumulative_border(hit[:100], 0.125, 100) == 100


def test_split_read_finds_planted_parts():
    rng = np.random.default_rng(3)
    roles = cv.Roles.of(M)
    sub = "".join(rng.choice(list("ACGT"), 1000))
    cvec = text(ht.Painter(M).paint(sub + "TCAGGG" * 30 + "TTAGGG" * 200))
    sub_len, part_len, err, kept, clean = cv.split_read(cvec, roles)
    assert abs(sub_len - 1000) <= 50 and sub_len + part_len == len(cvec) and err == 0
    assert len(clean) == sub_len + len(kept)
    assert abs(cv.variant_length(kept, roles) - 180) <= 20
    assert cv.variant_length("C" * 500, roles) == 0 and cv.variant_length("", roles) == 0
