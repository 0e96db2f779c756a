"""Entropic optimal transport between the token clouds of an example.

Spark shuffles the vectors to their example; the numeric loop over one
example's two clouds runs as a grouped Arrow function, one example in memory at
a time.  The cost matrix is never held as a whole: every sweep goes over tiles of it and keeps
a running logarithm of sums, so memory grows with the points of a cloud, not with their square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stairwell.operators.difficulty import EMBEDDING_LAYER, LAST_LAYER

TILE = 1024  # points on either side of a tile


class _Cost:
    """Tiles of the cost |x-y|²/2; a single one is kept, more are made anew for every sweep."""

    def __init__(self, x: np.ndarray, y: np.ndarray, tile: int) -> None:
        self.x, self.y, self.tile = x, y, tile
        self.squares = (x**2).sum(1), (y**2).sum(1)
        self.whole = self._made(0, 0) if max(len(x), len(y)) <= tile else None

    def _made(self, i: int, j: int) -> np.ndarray:
        rows, columns = slice(i, i + self.tile), slice(j, j + self.tile)
        return (self.squares[0][rows, None] + self.squares[1][None, columns] - 2 * self.x[rows] @ self.y[columns].T) / 2

    def at(self, i: int, j: int) -> np.ndarray:
        return self._made(i, j) if self.whole is None else self.whole

    def soft_min(self, eps: float, height: np.ndarray, transposed: bool = False) -> np.ndarray:
        """-eps * log of the sum of exp(height - cost / eps) over the other cloud, for every point."""
        out = []
        mine, other = (self.y, self.x) if transposed else (self.x, self.y)
        for i in range(0, len(mine), self.tile):
            top = total = None
            for j in range(0, len(other), self.tile):
                cost = self.at(j, i).T if transposed else self.at(i, j)
                scores = height[None, j : j + self.tile] - cost / eps
                peak = scores.max(axis=1)
                if top is None:
                    top, total = peak, np.exp(scores - peak[:, None]).sum(axis=1)
                    continue
                higher = np.maximum(top, peak)
                total = total * np.exp(top - higher) + np.exp(scores - higher[:, None]).sum(axis=1)
                top = higher
            out.append(-eps * (top + np.log(total)))
        return np.concatenate(out)


def source_potential(x: np.ndarray, y: np.ndarray, blur: float = 0.05, scaling: float = 0.9, tile: int = TILE) -> float:
    """Sum of the source potential of entropic transport with cost |x-y|²/2.

    Uniform weights; the temperature falls from the squared diameter of both
    clouds to ``blur²`` by ``scaling²`` per step.  Each step averages old and new
    potentials, and a last full step at the final temperature follows (published
    symmetric Sinkhorn iteration).
    """
    points = np.concatenate([x, y])
    diameter = float(np.linalg.norm(points.max(axis=0) - points.min(axis=0)))
    temperatures = [blur**2]
    if diameter > 0:
        ladder = np.exp(np.arange(2 * np.log(diameter), 2 * np.log(blur), 2 * np.log(scaling)))
        temperatures = [diameter**2, *ladder, blur**2]
    cost = _Cost(x, y, tile)
    log_a, log_b = -np.log(len(x)) * np.ones(len(x)), -np.log(len(y)) * np.ones(len(y))
    f, g = cost.soft_min(temperatures[0], log_b), cost.soft_min(temperatures[0], log_a, True)
    for eps in temperatures:
        new_f = cost.soft_min(eps, log_b + g / eps)
        new_g = cost.soft_min(eps, log_a + f / eps, True)
        f, g = (f + new_f) / 2, (g + new_g) / 2
    return float(cost.soft_min(temperatures[-1], log_b + g / temperatures[-1]).sum())


def sinkhorn_difficulty(
    hidden: DataFrame, idx: str = "idx", blur: float = 0.05, scaling: float = 0.9, tile: int = TILE
) -> DataFrame:
    """(``idx``, ``difficulty``) from ``(idx, layer, token_pos, vector)``; clouds of any size, a layer without tokens gives null."""
    rows = hidden.filter(F.col("layer").isin(EMBEDDING_LAYER, LAST_LAYER)).select(
        idx, "layer", F.col("vector").cast("array<double>").alias("vector")
    )

    def score(example: pa.Table) -> pa.Table:
        layer = example["layer"].to_numpy()
        points = example["vector"].combine_chunks().flatten().to_numpy().reshape(len(layer), -1)
        x, y = points[layer == EMBEDDING_LAYER], points[layer == LAST_LAYER]
        value = source_potential(x, y, blur, scaling, tile) if len(x) and len(y) else None
        return pa.table({idx: example[idx][:1], "difficulty": pa.array([value], pa.float64())})

    key_type = hidden.schema[idx].dataType.simpleString()
    # a fixed width: the loop costs far more than its bytes suggest, so partitions must not be merged by size
    width = int(hidden.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, idx).groupBy(idx).applyInArrow(score, f"`{idx}` {key_type}, difficulty double")
