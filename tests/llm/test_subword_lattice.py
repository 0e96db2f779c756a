"""The lattice against all segmentations written out, expected counts against them, and the query against plain counting."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stairwell.llm import queries
from stairwell.llm import subword_lattice as lattice

SMALL = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word: bytes, pieces: dict[bytes, int]):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            yield from ([pieces[word[:k]], *rest] for rest in segmentations(word[k:], pieces))


def test_forward_and_expected_against_enumeration():
    rng = random.Random(1)
    pieces = list({*(bytes([b]) for b in b" abc"), b" a", b" ab", b"ab", b"abc", b"bca", b"cc", b" abca"}) + [b""]
    scores = np.log(np.array([rng.random() for _ in pieces]))
    scores -= np.logaddexp.reduce(scores)
    index = {p: k for k, p in enumerate(pieces) if p}
    trie = lattice.build_trie(pieces)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 9))).encode() for _ in range(60)] + [b""]
    counts = np.array([float(rng.randint(1, 5)) for _ in words])
    totals, uses = np.zeros(len(words)), np.zeros(len(pieces))
    for k, word in enumerate(words):
        paths = list(segmentations(b" " + word, index))
        weights = [math.exp(sum(scores[p] for p in path)) for path in paths]
        totals[k] = math.log(sum(weights))
        for path, w in zip(paths, weights, strict=True):
            for p in path:
                uses[p] += counts[k] * w / sum(weights)
    got, found = np.zeros(len(words)), np.zeros(len(pieces))
    for picked, matrix, lengths in lattice._blocks(words):
        got[picked] = lattice.forward(trie, scores, matrix, lengths)[np.arange(len(picked)), lengths]
        found += lattice.expected(trie, scores, matrix, lengths, counts[picked])
    assert np.allclose(got, totals) and np.allclose(found, uses)


def test_probabilities_of_all_texts_sum_to_at_most_one():
    """Pieces of one letter: the texts over two letters with up to n pieces have the mass of n rounds of a geometric series."""
    pieces, scores = [b" ", b"a", b"b", b""], np.log(np.array([0.2, 0.3, 0.3, 0.2]))
    trie = lattice.build_trie(pieces)
    total = 0.0
    for n in range(6):
        for letters in itertools.product(b" ab", repeat=n):
            text = bytes(letters)
            if text.startswith(b" ") or not text:  # words begin with a blank
                parts = text.split(b" ")[1:]
                logs = 0.0
                for picked, matrix, lengths in lattice._blocks(parts):
                    logs += lattice.forward(trie, scores, matrix, lengths)[np.arange(len(picked)), lengths].sum()
                total += math.exp(logs + scores[-1])
    assert 0.3 < total <= 1


def test_pieces_cover_every_word():
    pieces, scores = lattice.load_pieces(FILE)
    assert len(pieces) == len(set(pieces)) == len(scores) and abs(np.exp(scores).sum() - 1) < 1e-9
    assert {bytes([b]) for b in range(256) if b not in range(9, 14) and not 65 <= b <= 90} <= set(pieces)


@pytest.fixture(scope="module")
def rows(spark):
    odd = [(None, "Ab  zq\x1cé ab"), (900, None), (901, ""), (902, " \n\t"), (903, "x" * 3000 + " tail"), (904, "ab AB"), (904, "ab AB"), (904, "other"), (905, "w " * 2000)]
    plain = [(i, " ".join(f"w{(i * k) % 37}" for k in range(1, i % 9 + 2))) for i in range(60)]
    return odd + plain


def base_of(rows, learn):
    words = Counter()
    for i, text in rows:
        if learn(i):
            words.update((text or "").encode().lower().split())
            words[None] += 1
    n, v = words.total(), len(words)
    out = []
    for i, text in rows:
        tokens = [*(text or "").encode().lower().split(), None]
        out.append((i, len(tokens), sum(words[t] > 0 for t in tokens), n, round(sum(math.log10((words[t] + 1) / (n + v + 1)) for t in tokens), 8)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 300_000])
def test_odd_rows(spark, monkeypatch, rows, hot):
    """Nulls, empty and long texts, repeated rows, other columns; with hardly any and with all words broadcast."""
    monkeypatch.setattr(lattice, "HOT", hot)
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, score int, word string").repartition(3)
    learn = lambda i: i is None or i % 3 > 0
    model = lattice.SubwordLattice(docs, FILE, F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True)))
    got = model.score().collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in got), key=str) == base_of(rows, learn)
    pieces, _ = lattice.load_pieces(FILE)
    trie, scores = lattice.build_trie(pieces), model.scores
    want = []
    for i, text in rows:
        words, logs = (text or "").encode().lower().split(), scores[-1]
        for picked, matrix, lengths in lattice._blocks(words):
            logs += lattice.forward(trie, scores, matrix, lengths)[np.arange(len(picked)), lengths].sum()
        want.append((i, round(logs / math.log(10), 6)))
    assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert lattice.SubwordLattice(docs.limit(0), FILE, F.lit(True)).score().collect() == []


def test_learning_helps_and_nothing_learnt(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = lattice.SubwordLattice(docs, FILE, F.lit(None).cast("boolean"))
    fitted = lattice.SubwordLattice(docs, FILE, F.lit(True))
    a, b = (sum(r.score for r in m.score().collect()) for m in (none, fitted))
    assert a < b < 0
    assert all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 for r in none.score().collect())


def test_query_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = queries.op11_subword_lattice(spark, SMALL).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in got), key=str) == base_of(docs, lambda i: not held(i))
    assert all(r.held_out == held(r.doc_id) and r.score < 0 for r in got)
