"""Toxic spans and semantic votes: exact enumeration, planted words, held-out accuracy, odd input."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stairwell.llm import queries, semantic_votes, toxic_spans
from stairwell.llm.toxic_spans import ToxicSpans, words_of

SMALL = "/root/testdata/sf0.01"


def planted(n: int, seed: int) -> tuple[list[str], list[int]]:
    rng = random.Random(seed)
    plain = [a + b for a in ("ka", "lo", "mi", "tu", "ren", "sol") for b in ("ba", "de", "fi", "go", "hum")]
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["Grumble", "snark", "vileness"]))
        texts.append(" ".join(words) + ".")
        labels.append(int(bad))
    return texts, labels


def enumerated(model: ToxicSpans, words: list[str]) -> np.ndarray:
    ids, _, near = model._chains([words])
    emit, n = model.own[ids] + model.near @ near, len(words)
    total, marginal = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        x = model.start[tags[0]] + sum(e * t for e, t in zip(emit, tags, strict=True))
        weight = math.exp(x + sum(model.move[a, b] for a, b in itertools.pairwise(tags)))
        total += weight
        marginal += weight * np.array(tags)
    return marginal / total


def test_marginals_are_exact():
    model = ToxicSpans({"bad$": 3.0, "wor": 2.0})
    rng = np.random.default_rng(5)
    model.own, model.near = rng.normal(size=3), rng.normal(size=2)
    model.start, model.move = rng.normal(size=2), rng.normal(size=(2, 2))
    texts = [["a"], ["bad", "x", "worst", "b", "bad"], ["x"] * 9, ["worse", "bad"], ["y", "bad", "bad", "word", "z", "q", "bad"]]
    for words, p in zip(texts, model.marginals(texts), strict=True):
        assert np.allclose(p, enumerated(model, words))


def test_planted_words_are_found_with_their_places():
    texts, labels = planted(600, 1)
    model = ToxicSpans.fit(texts, labels)
    texts, labels = planted(300, 2)
    for text, label, (score, spans) in zip(texts, labels, model.score(texts), strict=True):
        assert (score >= 0.7) == bool(label)
        found = [text[s["start"] : s["end"]] for s in spans]
        assert words_of(" ".join(found)) == [w for w in words_of(text) if w in ("grumble", "snark", "vileness")]


def test_toxicity_of_odd_input(spark):
    texts, labels = planted(200, 3)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "1234 !!"), (None, "snark İ snark"), (903, "snark " * 9000), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*enumerate(labels), (None, 1), (5, None), (7777, 1)], "doc_id long, toxic int")
    got = toxic_spans.add_toxicity(docs, toxic_spans.fit(docs, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score == by[902].score == 0 and by[900].spans == []
    assert by[903].score >= 0.7 and [("snark İ snark")[s.start : s.end] for s in by[None].spans] == ["snark", "snark"]
    none = toxic_spans.fit(docs, marks.where("toxic = 0"))
    assert toxic_spans.add_toxicity(docs, none).where("score > 0.01").count() == 0
    empty = toxic_spans.add_toxicity(docs.limit(0), none)
    assert empty.collect() == [] and toxic_spans.fit(docs.limit(0), marks).ids == {}


def test_votes_on_odd_input(spark):
    good = [f"Plain sentences number {i} run on, quietly and well." for i in range(40)]
    bad = [f"LOUD!! {i}!! AGAIN!! " * 5 for i in range(40)]
    rows = list(enumerate(good + bad)) + [(900, None), (901, ""), (None, good[0]), (3, good[3]), (902, "Long plain text, on and on. " * 9000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    marks = spark.createDataFrame([*((i, int(i < 40)) for i in range(80)), (None, 0), (4, None)], "doc_id long, quality int")
    model = semantic_votes.fit(docs, marks)
    got = semantic_votes.add_score(docs, model).collect()
    assert len(got) == len(rows)
    assert all((r.score >= 0.7) == (r.doc_id is None or r.doc_id < 40 or r.doc_id == 902) for r in got if r.doc_id not in (900, 901))
    assert all(abs(r.score - 0.5) < 0.02 for r in got if r.doc_id in (900, 901))
    nothing = semantic_votes.fit(docs.limit(0), marks)
    assert {r.score for r in semantic_votes.add_score(docs, nothing).collect()} == {0.5}
    assert semantic_votes.add_score(docs.limit(0), model).collect() == []


def test_votes_against_all_neighbours_one_by_one():
    """Every text beside every labelled one, by plain sums: the nearest, with ties, vote with the power of their cosine."""
    words = ["calm", "plain", "text", "LOUD", "!!", "again", "runs", "on,"]
    rng = random.Random(4)
    say = lambda: " ".join(rng.choices(words, k=rng.randint(0, 25)))
    learnt = [say() for _ in range(70)] + ["calm text"] * 3
    labels = [int("LOUD" not in t) for t in learnt]
    model = semantic_votes.SemanticVotes.fit(learnt, labels)

    def vector(text: str) -> list[float]:
        terms = semantic_votes.term_vector(text).astype(float) * model.weights
        out = [float(sum(terms[k] * model.axes[k, a] for k in np.flatnonzero(terms))) for a in range(model.axes.shape[1])]
        size = sum(x * x for x in out) ** 0.5
        return [x / size if size else 0.0 for x in out]

    points = [vector(t) for t in learnt]
    texts = [say() for _ in range(40)] + ["", "calm text"]
    for text, got in zip(texts, model.score(texts), strict=True):
        v = vector(text)
        cosines = [sum(a * b for a, b in zip(v, p, strict=True)) for p in points]
        last = sorted(cosines, reverse=True)[semantic_votes.NEIGHBOURS - 1]
        votes = [(max(0.0, c) ** semantic_votes.SHARPNESS, y) for c, y in zip(cosines, labels, strict=True) if c >= last - semantic_votes.TIE]
        total = sum(w for w, _ in votes)
        want = sum(w * y for w, y in votes) / total if total else sum(labels) / len(labels)
        assert got == pytest.approx(want, abs=2e-3)


def test_blocks_do_not_change_votes(monkeypatch):
    texts = [f"text {i} with, commas" * (i % 7) + "!" * (i % 3) for i in range(60)]
    model = semantic_votes.SemanticVotes.fit(texts, [i % 2 for i in range(60)])
    whole = model.score(texts)
    monkeypatch.setattr(semantic_votes, "BLOCK", 7)
    assert np.allclose(whole, model.score(texts))


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.93), ("op10_quality_votes", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SMALL).where("held_out")
    rows = got.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    assert rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least
