"""Quality classifier: nearest labelled documents in a latent-semantic space vote by similarity.

Terms are what a text looks like rather than what it says: trigrams of character classes with runs
collapsed, and shares of repeated words. A bounded sample of labelled documents gives the inverse
document frequencies and, by a singular value decomposition, the latent space. The sample's vectors are
broadcast; every document is compared with all of them in blocks by exact cosine, and its nearest ones vote.

Defined results: null text counts as empty; an empty text (no terms, no direction) gets the sample's mean label;
without any labelled document every score is 0.5; all that tie with the last neighbour vote; repeated rows are scored each; labels of null id or value, or without a document, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stairwell.llm.common import shared_model

CLASSES = 16
TERMS = CLASSES**3 + 24
SAMPLE_PER_LABEL = 1024  # labelled documents of either label that are fitted
RANK = 64  # dimensions of the latent space
NEIGHBOURS = 24
TIE = 1e-5  # cosines this close to the last neighbour's are ties, and all of them vote
SHARPNESS = 16  # power of the cosine in a vote's weight
BLOCK = 512  # documents compared at once


def _classes() -> np.ndarray:
    table = np.full(256, 12, "i2")
    table[0x80:] = 2  # letters beyond ASCII mostly; counted as small ones
    for k, chars in enumerate([b" ", b"\t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",;:", b"!?", b"|", b"*", b"&", b"$%#", None, b"<>", b"()[]{}", b"'\"-_"]):
        if chars is not None:
            table[list(chars)] = k
    return table


_CLASS = _classes()


def term_vector(text: str | None) -> np.ndarray:
    """Square roots of the terms' shares in a text, all zero for one without a character."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(TERMS, "f4")
    if not raw:
        return out
    kind = _CLASS[np.frombuffer(raw, "u1")]
    kind = kind[np.flatnonzero(np.diff(kind, prepend=-1))]
    kind = np.concatenate([[1], kind, [1]])  # a line's break before and after
    grams = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
    out[: CLASSES**3] = np.bincount(grams, minlength=CLASSES**3)[: CLASSES**3]
    out[: CLASSES**3] /= len(grams)
    words = raw.split()
    if len(words) > 1:
        same = sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1)
        again = 1 - len(set(words)) / len(words)
        base = CLASSES**3
        out[base + min(7, int(same * 8))] = 0.5 * same
        # How often words come again depends on the length of a text; a share is held against its logarithm.
        level = min(3, int(np.log10(len(words))))
        out[base + 8 + 4 * level + min(3, int(again * 4))] = 0.1
    return np.sqrt(out)


class SemanticVotes:
    """The fitted model: term weights, latent directions, and the sample's directions and labels."""

    def __init__(self, weights: np.ndarray, axes: np.ndarray, points: np.ndarray, labels: np.ndarray) -> None:
        self.weights, self.axes, self.points, self.labels = weights, axes, points, labels

    @staticmethod
    def fit(texts: list[str | None], labels: list[int]) -> SemanticVotes:
        rows = np.array([term_vector(t) for t in texts], "f4").reshape(-1, TERMS)
        weights = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype("f4") + 1
        rows *= weights
        used = np.flatnonzero(rows.any(0))
        part = rows[:, used].astype("f8")
        small = part.T @ part if len(part) >= len(used) else part @ part.T
        values, vectors = np.linalg.eigh(small)
        top = np.argsort(-values)[:RANK]
        top = top[values[top] > 1e-9 * max(values.max(initial=0), 1e-30)]
        base = vectors[:, top] if len(part) >= len(used) else part.T @ vectors[:, top] / np.sqrt(values[top])
        axes = np.zeros((TERMS, len(top)), "f4")
        axes[used] = base
        return SemanticVotes(weights, axes, _unit(rows @ axes), np.array(labels, "f8"))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of the votes for label 1, in exact blocked cosines against the whole sample."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        near = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            rows = np.array([term_vector(t) for t in texts[at : at + BLOCK]], "f4")
            rows = _unit((rows * self.weights) @ self.axes)
            cosine = rows @ self.points.T
            last = np.partition(cosine, -near, axis=1)[:, -near, None]
            row, point = np.nonzero(cosine >= last - TIE)
            weight = np.clip(cosine[row, point], 0, 1).astype("f8") ** SHARPNESS
            total = np.bincount(row, weight, len(rows))
            votes = np.bincount(row, weight * self.labels[point], len(rows))
            out[at : at + BLOCK] = np.where(total > 0, votes / np.where(total > 0, total, 1), self.labels.mean())
        return np.clip(out, 0, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", per_label: int = SAMPLE_PER_LABEL) -> list[tuple[str, int]]:
    """At most ``per_label`` labelled texts of either label, the first in the order of a hash of the id.

    The ids are chosen from the labels alone, so only the sample's texts leave the documents' table.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    order = [F.xxhash64("k"), "k"]
    picked = rows.where("y = 0").orderBy(*order).limit(per_label).unionByName(rows.where("y = 1").orderBy(*order).limit(per_label))
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")
    return sorted((zlib.crc32(str(r.k).encode()), r.k, r.t or "", r.y) for r in found.collect())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_label: int = SAMPLE_PER_LABEL) -> SemanticVotes:
    rows = labelled_sample(docs, labels, label, key, text, per_label)
    return SemanticVotes.fit([r[2] for r in rows], [r[3] for r in rows])


def add_score(docs: DataFrame, model: SemanticVotes, text: str = "text") -> DataFrame:
    """``docs`` with a column score (0 to 1); a column of that name is replaced. The model is broadcast."""
    shared = shared_model(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared().score(part.tolist()))

    return docs.withColumn("score", score(F.col(text)))
