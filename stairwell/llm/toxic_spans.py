"""Toxicity: a linear-chain conditional random field over the words of a text, two tags, trained here.

Token labels come from labelled documents: a word is tagged in a toxic document if it occurs in more toxic
documents than chance allows, given the clean ones, after correction for all words that are tried (documents in which it
stands between the same neighbours count once, so copies of a document do not vote twice); every word
of a clean document is untagged. The field
has a weight per lexicon word, one for a lexicon word before or after, a bias, and four
transitions; it is fitted to the labelled tokens' conditional likelihood. Forward-backward gives each word's marginal;
a document's score is the chance that at least one of its conspicuous words is toxic, and runs of words
over one half are its offending spans.

Defined results: null text counts as empty; a text without a word scores 0 and has no spans; without labelled documents of
both kinds every score is 0; repeated rows are scored each; labels of null id or value, or without a
document, are ignored; a column named like a result is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stairwell.llm.common import shared_model
from stairwell.llm.semantic_votes import labelled_sample

SAMPLE_PER_LABEL = 1024  # labelled documents of either label that are fitted
LEXICON = 4096  # words and stems with a weight of their own, at most
STEMS = range(3, 9)  # lengths of stems
ERROR = 1e-3  # chance that any unit at all is tagged by accident
STEPS = 40
PRIOR = 1e-4  # weight of the squared parameters, per labelled token
CONSPICUOUS = 0.05  # marginal from which a word counts for the document
OFFENDING = 0.5
CACHE_WORDS = 400_000  # words whose unit a worker remembers
TOKENS = 400_000  # words whose chains are run at once; a longer text is run alone

_WORD = re.compile(r"[^\W\d_]+")


def _lower(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(_lower(text or ""))


def _columns(x: np.ndarray, fill: float) -> np.ndarray:
    """A sequence cut into columns of about the square root of its length."""
    rows = max(1, math.isqrt(len(x)))
    width = -(-len(x) // rows)
    return np.append(x, np.full(rows * width - len(x), fill)).reshape(width, rows).T.copy()


def _odds(first: np.ndarray, emit: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward odds of tag 1 after every token of chains laid end to end; ``first`` marks where a chain begins.

    A step maps odds r to emit * (m01 + r m11) / (m00 + r m10). The steps of a column are multiplied for all columns
    at once, the columns' products are applied one after the other, and a second pass fills in the tokens.
    """
    n = len(emit)
    first, emit = _columns(first, 1.0), _columns(emit, 1.0)
    # A chain's first token forgets what was before: both rows are the start.
    m = [np.where(first > 0, start[j], move[i, j]) * (emit if j else 1.0) for i in (0, 1) for j in (0, 1)]
    a, b, c, d = (x[0].copy() for x in m)
    for t in range(1, len(emit)):
        m00, m01, m10, m11 = (x[t] for x in m)
        a, b, c, d = a * m00 + b * m10, a * m01 + b * m11, c * m00 + d * m10, c * m01 + d * m11
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    at = np.empty(emit.shape[1])
    r = 1.0
    for k, (w, x, y, z) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        at[k] = r
        r = (x + r * z) / (w + r * y)
    out = np.empty_like(emit)
    for t in range(len(emit)):
        at = (m[1][t] + at * m[3][t]) / (m[0][t] + at * m[2][t])
        out[t] = at
    return out.T.ravel()[:n]


def _units(word: str) -> list[str]:
    return [f"{word}$", *[word[:k] for k in STEMS if k <= len(word)]]


def _evidence(p: np.ndarray) -> float:
    """Sum of -log(1 - p) over the conspicuous words."""
    return float(-np.log(np.maximum(1 - p[p >= CONSPICUOUS], 1e-9)).sum())


def _unit_evidence(texts: list[list[str]], labels: list[int]) -> dict[str, float]:
    """Units that stand in more toxic documents than chance allows, with the evidence for them.

    A unit counts once per document, at its first place, and once per pair of neighbours.
    """
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in ws], "i8") for ws in texts]
    names: dict[str, int] = {}
    units = np.full((len(numbers) + 1, 1 + len(STEMS)), -1, "i8")
    for k, w in enumerate(numbers):
        own = [names.setdefault(u, len(names)) for u in _units(w)]
        units[k, : len(own)] = own
    counts = []
    for y in (0, 1):
        found = [np.empty((0, 3), "i8")]
        for k, ws in enumerate(coded):
            if labels[k] == y and len(ws):
                kinds, at = np.unique(ws, return_index=True)
                sides = np.concatenate([[-1], ws, [-1]])
                context = sides[at] * (len(numbers) + 1) + sides[at + 2]
                width = units.shape[1]
                rows = np.stack([units[kinds].ravel(), np.repeat(context, width), np.repeat(at, width)], 1)
                rows = rows[rows[:, 0] >= 0]
                rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
                found.append(rows[np.unique(rows[:, 0], return_index=True)[1]])
        rows = np.concatenate(found)[:, :2]
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        fresh = np.append(True, (rows[1:] != rows[:-1]).any(1))[: len(rows)]
        counts.append(np.bincount(rows[fresh, 0], minlength=len(names)))
    share = (sum(labels) + 1) / (len(labels) - sum(labels) + 1)
    expected = share * (counts[0] + 1.0)
    c = np.maximum(counts[1], 1)
    strength = np.where(c > expected, c * (np.log(c / expected) - 1) + expected, 0)  # Chernoff's bound of a Poisson tail
    need = math.log((np.count_nonzero(counts[1]) + 1) / ERROR)
    return {u: float(x) for u, x in zip(names, strength, strict=True) if x >= need}


class _Lookup(dict):
    """Word to the id of its unit with the most evidence; 0 without one. Words met are remembered."""

    def __init__(self, ids: dict[str, int], evidence: list[float]) -> None:
        super().__init__()
        self.ids, self.evidence = ids, evidence
        self.heads = {u[:3] for u in ids}

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        short = word[:3] in self.heads or f"{word}$"[:3] in self.heads
        found = [self.ids[u] for u in _units(word) if u in self.ids] if short else []
        best = self[word] = max(found, key=lambda i: self.evidence[i], default=0)
        return best


class ToxicSpans:
    """The fitted field: a weight per unit (0: any other word), neighbour weights, start, transitions; and the
    logistic function of the documents. ``evidence`` names the units, best first."""

    def __init__(self, evidence: dict[str, float]) -> None:
        self.ids = {w: k + 1 for k, w in enumerate(evidence)}
        self.evidence = [0.0, *evidence.values()]
        self.own = np.zeros(len(evidence) + 1)
        self.near = np.zeros(2)
        self.start = np.zeros(2)
        self.move = np.zeros((2, 2))
        self.line = (-8.0, 1.0)
        self.lookup = _Lookup(self.ids, self.evidence)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lookup": _Lookup(self.ids, self.evidence)}

    def _chains(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of texts laid end to end, first-token marks, and the places of lexicon neighbours (before, after)."""
        known = self.lookup
        ids = np.array([known[w] for ws in texts for w in ws], "i8")
        first = np.zeros(len(ids) + 1)
        first[np.cumsum([0, *map(len, texts)])] = 1
        first = first[:-1]
        hit = ids > 0
        near = np.zeros((2, len(ids)))
        near[0, 1:] = hit[:-1] & (first[1:] == 0)
        near[1, :-1] = hit[1:] & (first[1:] == 0)
        return ids, first, near

    def _run(self, ids: np.ndarray, first: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
        emit = np.exp(np.clip(self.own[ids] + self.near @ near, -30, 30))
        start, move = np.exp(self.start), np.exp(self.move)
        ahead = _odds(first, emit, start, move)
        # Backwards, a token's odds are those of what follows it: the same chain turned round, shifted by one.
        last = np.append(first[1:], 1.0)
        turned = _odds(last[::-1], emit[::-1], np.ones(2), move.T)[::-1]
        behind = np.ones(len(emit))
        inner = np.flatnonzero(last[:-1] == 0)
        r = turned[inner + 1]
        behind[inner] = (move[1, 0] + r * move[1, 1]) / (move[0, 0] + r * move[0, 1])
        both = ahead * behind
        return both / (1 + both), emit, ahead, behind

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The chance of every word to be toxic."""
        ids, first, near = self._chains(texts)
        p = self._run(ids, first, near)[0] if len(ids) else np.empty(0)
        return np.split(p, np.cumsum([len(x) for x in texts])[:-1])

    @staticmethod
    def fit(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), steps: int = STEPS) -> ToxicSpans:
        """``weights``: documents that a sampled document of label 0 and of label 1 stands for."""
        words = [words_of(t) for t in texts]
        evidence = _unit_evidence(words, labels)
        best = sorted(evidence, key=lambda u: (-evidence[u], u))[:LEXICON]
        model = ToxicSpans({u: evidence[u] for u in best})
        if not best:
            model.own[:] = -30
            return model
        groups, size = [[]], 0
        for k, ws in enumerate(words):
            if size >= TOKENS // 2:
                groups.append([])
                size = 0
            groups[-1].append(k)
            size += len(ws)
        model._climb([(*model._chains([words[k] for k in g]), np.repeat([labels[k] for k in g], [len(words[k]) for k in g])) for g in groups], steps)
        x = np.array([_evidence(p) for g in groups for p in model.marginals([words[k] for k in g])])
        model._calibrate(x, np.array(labels, "f8"), np.array(weights)[labels])
        return model

    def _calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of the labels on the documents' evidence, by Newton's method with a weak prior."""
        line, rows = np.array([-3.0, 1.0]), np.stack([np.ones(len(x)), x])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(line @ rows, -30, 30)))
            slope = rows @ (weight * (y - p)) - 0.01 * line
            bend = (rows * (weight * p * (1 - p))) @ rows.T + 0.01 * np.eye(2)
            move = np.linalg.solve(bend, slope)
            line += np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-9:
                break
        self.line = (float(line[0]), float(line[1]))

    def _climb(self, groups: list[tuple[np.ndarray, ...]], steps: int) -> None:
        """Ascend the conditional likelihood of tagged groups of texts with per-parameter step sizes."""
        prior = PRIOR * sum(len(g[0]) for g in groups) / len(self.own)
        parts = [self.own, self.near, self.start, self.move]
        self.own[0], self.own[1:] = -4.0, 2.0
        mean, square = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
        for step in range(1, steps + 1):
            slopes = [-prior * x for x in parts]
            for ids, first, near, label in groups:
                for total, part in zip(slopes, self._slope(ids, first, near, (label * (ids > 0)).astype("f8")), strict=True):
                    total += part
            for x, g, m, s in zip(parts, slopes, mean, square, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                x += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    def _slope(self, ids: np.ndarray, first: np.ndarray, near: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """Observed less expected counts of every parameter."""
        p, emit, ahead, behind = self._run(ids, first, near)
        inner, gap, move = np.flatnonzero(first == 0), tags - p, np.exp(self.move)
        expected = np.empty((2, 2))
        seen = np.empty((2, 2))
        left, right = ahead[inner - 1], emit[inner] * behind[inner]
        whole = (move[0, 0] + right * move[0, 1]) + left * (move[1, 0] + right * move[1, 1])
        before, after = tags[inner - 1], tags[inner]
        for i in (0, 1):
            for j in (0, 1):
                expected[i, j] = (move[i, j] * (left if i else 1) * (right if j else 1) / whole).sum()
                seen[i, j] = ((before if i else 1 - before) * (after if j else 1 - after)).sum()
        starts = gap[first > 0].sum()
        return [np.bincount(ids, gap, minlength=len(self.own)), near @ gap, np.array([-starts, starts]), seen - expected]

    def score(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        """Score and offending spans (character offsets) of every text."""
        out: list[tuple[float, list[dict]]] = []
        words: list[list[str]] = []
        count, begin = 0, 0
        for k, text in enumerate(texts):
            words.append(words_of(text))
            count += len(words[-1])
            if count >= TOKENS or k == len(texts) - 1:
                out += [self._verdict(t, p) for t, p in zip(texts[begin : k + 1], self.marginals(words), strict=True)]
                words, count, begin = [], 0, k + 1
        return out

    def _verdict(self, text: str | None, p: np.ndarray) -> tuple[float, list[dict]]:
        spans: list[dict] = []
        if not len(p):
            return 0.0, spans
        if p.max() >= OFFENDING:
            before = -2
            places = [m.span() for m in _WORD.finditer(_lower(text or ""))]
            for k in np.flatnonzero(p >= OFFENDING).tolist():
                if k == before + 1:
                    spans[-1]["end"], spans[-1]["p"] = places[k][1], max(spans[-1]["p"], float(p[k]))
                else:
                    spans.append({"start": places[k][0], "end": places[k][1], "p": float(p[k])})
                before = k
        x = self.line[0] + self.line[1] * _evidence(p)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), spans


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", per_label: int = SAMPLE_PER_LABEL) -> ToxicSpans:
    rows = labelled_sample(docs, labels, label, key, text, per_label)
    sampled = [sum(r[3] == y for r in rows) for y in (0, 1)]
    if not all(sampled):
        return ToxicSpans.fit([], [])
    shares = {r[0]: r[1] for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect()}
    return ToxicSpans.fit([r[2] for r in rows], [r[3] for r in rows], (shares[0] / sampled[0], shares[1] / sampled[1]))


def add_toxicity(docs: DataFrame, model: ToxicSpans, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and spans (start, end, p). The model, bounded by its lexicon, is broadcast."""
    shared = shared_model(docs.sparkSession, model)

    @F.pandas_udf("struct<score:double,spans:array<struct<start:int,end:int,p:double>>>")
    def tagged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(shared().score(part.tolist()), columns=["score", "spans"])

    found = docs.withColumn("__toxic", tagged(F.col(text)))
    return found.withColumn("score", F.col("__toxic.score")).withColumn("spans", F.col("__toxic.spans")).drop("__toxic")
