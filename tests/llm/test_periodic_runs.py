"""Runs against a search by definition; grammar extensions against comparing words; the query against its plain reading."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from stairwell.llm import periodic_runs, queries
from stairwell.llm.periodic_runs import Grammar, add_runs, find_runs, words_of

SMALL = "/root/testdata/sf0.001"


def brute(words) -> list:
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            if len(stretch) >= max(6, 4 * q) and not any(stretch[p:] == stretch[: len(stretch) - p] for p in range(1, q)):
                out.append((start, q, len(stretch)))
            i += 1
    return sorted(out)


def random_text(rng: random.Random) -> list:
    out = []
    for _ in range(rng.randint(0, 5)):
        base = rng.choices("abc", k=rng.randint(1, 6))
        out += base * rng.randint(1, 7) + base[: rng.randint(0, len(base))]
    return out * rng.choice([1, 1, 1, 3, 5])


def test_runs_by_definition(monkeypatch):
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(700)]
    want = [brute(t) for t in texts]
    assert sum(map(len, want)) > 1000
    assert [find_runs(t) for t in texts] == want
    monkeypatch.setattr(periodic_runs, "GRID", 5)  # every grid by itself
    assert [find_runs(t) for t in texts] == want


def test_extensions():
    rng = random.Random(2)
    for _ in range(300):
        text = random_text(rng) + rng.choices("abcdefgh", k=rng.randint(1, 30))
        grammar = Grammar(np.unique(text, return_inverse=True)[1])
        mirror = grammar.mirror()
        for _ in range(20):
            i, j = sorted(rng.sample(range(len(text) + 1), 2))
            ahead = next((k for k in range(len(text) - j) if text[i + k] != text[j + k]), len(text) - j)
            behind = next((k for k in range(i) if text[i - 1 - k] != text[j - 1 - k]), i)
            assert grammar.extension(i, j) == ahead
            assert mirror.extension(len(text) - j, len(text) - i) == behind


def test_grammar_is_small():
    """Blocks and repetitions shrink to a few symbols, other texts by a constant share per level."""
    for text in (np.zeros(100_000, int), np.tile(np.arange(50), 2000), np.random.default_rng(1).integers(0, 9, 50_000)):
        grammar = Grammar(text)
        assert len(grammar.levels[-1][0]) == 1
        assert len(grammar.levels) < 60 and sum(len(level[0]) for level in grammar.levels) < 10 * len(text)


def row_of(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1])) if runs else None
    gone = {i for s, q, size in runs for i in range(s + q, s + size)}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    shown = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    lines = "".join(f"{s},{size},{q}\n" for s, q, size in runs).encode()
    return (doc_id, len(runs), *shown, digest(lines), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_on_a_table(spark):
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        h, words = zlib.crc32(str(r.doc_id).encode()), (r.text or "").encode().split()
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want.append(row_of(r.doc_id, b" ".join(words).decode()))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, SMALL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 10


def test_odd_rows(spark):
    texts = [None, "", " \n", "a b", "a a a a a", "a a a a a a", "x\x1cy " * 8, "é " * 9 + "z", "one two three " * 2000, "w " * 20_000]
    rows = [(k // 2, t, 5, "own") for k, t in enumerate(texts)] + [(0, None, 5, "own"), (None, "b " * 6, 5, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, other string").repartition(3)
    got = add_runs(docs)
    assert got.columns == ["doc_id", "other", *periodic_runs.RESULTS]
    shown = got.select("doc_id", *periodic_runs.RESULTS[:5], F.sha2("runs", 256), F.sha2("collapsed", 256)).collect()
    short = {tuple(r) for r in shown}
    assert {row_of(i, t) for i, t, *_ in rows if len(t or "") < 9_000} <= short and len(shown) == len(rows)
    by_length = {r.length: (r.n_runs, r.start, r.period, r.collapsed) for r in got.where("length > 1000").collect()}
    assert by_length == {6000: (1, 0, 3, "one two three"), 20_000: (1, 0, 1, "w")}
    assert add_runs(docs.limit(0)).collect() == [] and words_of(None) == []
