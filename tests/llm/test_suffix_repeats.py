"""Repeats against brute force: planted passages, runs, cut texts, hot anchors, odd input; intervals against their definition."""

from __future__ import annotations

import random

import numpy as np
import pytest

from stairwell.llm import suffix_repeats
from stairwell.llm.suffix_repeats import SuffixRepeats, repeat_intervals


def brute(docs: list[tuple], least: int) -> list[tuple[bytes, int, int]]:
    """(kept, removed, spans) of texts in their order."""
    seen, out = set(), []
    for raw in docs:
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if (w := raw[p : p + least]) in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((bytes(x for x, g in zip(raw, gone, strict=True) if not g), sum(gone), spans))
    return out


def corpus(rng: random.Random) -> list[str]:
    letter = lambda n: "".join(rng.choices("abcdeé \n漢", k=n))
    passages = [letter(rng.randint(70, 400)) for _ in range(6)]
    texts = ["", "short", letter(5000), "a" * 900, "ab" * 300 + letter(20), letter(99), "\0" * 300]
    for _ in range(60):
        parts = [letter(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)], letter(rng.randint(0, 90))]
        texts.append("".join(parts))
    base = letter(700)
    for _ in range(12):
        x = list(base)
        x[rng.randrange(700)] = "#"
        texts.append("".join(x))
    return [*texts, texts[20], texts[20], base * 2]


@pytest.mark.parametrize("limits", [{}, {"HOT": 3, "GROUP_ROWS": 40, "DEAL_BYTES": 5000}, {"FLAT": 700}])
def test_like_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_repeats, name, value)
    rng = random.Random(9)
    texts = corpus(rng)
    rng.shuffle(texts)
    ids = sorted(rng.sample(range(-500, 10_000), len(texts)))
    rows = [(i, t, b"x", 3) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string, kept binary, doc int").repartition(4)
    got = {r.doc_id: r for r in SuffixRepeats(df, 100).cut().collect()}
    assert len(got) == len(rows)
    for i, t, want in zip(ids, texts, brute([t.encode() for t in texts], 100), strict=True):
        r = got[i]
        assert (bytes(r.kept), r.n_removed, r.n_spans, r.n_bytes) == (*want, len(t.encode()))


def test_missing_and_repeated_ids(spark):
    long = "".join(random.Random(1).choices("abcdef", k=300))
    rows = [(None, long), (None, None), (7, None), (5, long), (5, long), (9, "x" + long), (9, "y" + long[:250]), (3, "z" * 20)]
    got = SuffixRepeats(spark.createDataFrame(rows, "doc_id long, text string"), 100).cut().collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed))
    assert by[5] == [(300, 0), (300, 0)] and sorted(by[9]) == [(251, 250), (301, 300)]
    assert sorted(by[None]) == [(0, 0), (300, 300)] and by[7] == [(0, 0)] and by[3] == [(20, 0)]
    assert SuffixRepeats(spark.createDataFrame([], "doc_id long, text string"), 100).cut().collect() == []


def test_intervals_are_the_maximal_repeats():
    rng = random.Random(4)
    for _ in range(40):
        pieces = [bytes(rng.choices(b"ab", k=rng.randint(3, 14))) for _ in range(5)]
        group = np.array([0, 0, 1, 0, 1])
        got = {(n, frozenset(zip(o.tolist(), p.tolist(), strict=True))) for n, o, p in repeat_intervals(pieces, group, np.arange(5) * 100, 3)}
        want = set()
        for g in (0, 1):
            members = [k for k in range(5) if group[k] == g]
            places: dict[bytes, list] = {}
            for k in members:
                for a in range(len(pieces[k])):
                    for b in range(a + 3, len(pieces[k]) + 1):
                        places.setdefault(pieces[k][a:b], []).append((k, a))
            for w, at in places.items():
                left = {pieces[k][a - 1 : a] or (k, a) for k, a in at}
                right = {pieces[k][a + len(w) : a + len(w) + 1] or (k, a) for k, a in at}
                if len(at) > 1 and len(left) > 1 and len(right) > 1:
                    want.add((len(w), frozenset(at)))
        assert got == want


def test_groups_list_all_places(spark):
    rng = random.Random(6)
    letter = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = letter(140)
    rows = [(i, letter(80) + passage + letter(80)) for i in range(5)]
    found = SuffixRepeats(spark.createDataFrame(rows, "doc_id long, text string"), 100).groups().collect()
    whole = [r for r in found if len(r.occurrences) == 5]
    assert whole and all(r.occurrences[0].doc == 0 and r.length >= 100 for r in whole)
