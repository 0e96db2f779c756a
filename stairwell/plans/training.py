"""Whole curricula: from scores or hidden states to stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stairwell.operators import curriculum as cu, difficulty as di
from stairwell.operators.transport import sinkhorn_difficulty
from stairwell.session import materialise

KINDS = ("cumulative", "disjoint", "ordered", "random", "random_cumulative")


def score_examples(
    hidden: DataFrame,
    criterion: str = "wd",
    norm: str = "org",
    idx: str = "idx",
    scaling: float = 0.9,
    batch_size: int | None = None,
) -> DataFrame:
    """(``idx``, ``difficulty``) from ``(idx, layer, token_pos, vector)``.

    ``criterion`` is ``wd`` (optimal transport), ``kl`` (symmetric) or ``kl_one_sided``.
    ``norm`` rescales the vectors first; ``line`` uses the extremes of a batch of
    ``batch_size`` consecutive ids, or of each example without it.
    """
    number = F.floor(F.col(idx) / batch_size) if batch_size else F.col(idx)
    batch = "__batch" if norm == "line" else None
    if criterion == "wd":
        # the clouds are normalised where they lie; a layer of a batch has its own extremes
        ready = hidden.filter(F.col("layer").isin(di.EMBEDDING_LAYER, di.LAST_LAYER))
        if batch:
            ready = ready.withColumn(batch, F.struct(number.alias("n"), "layer"))
        return sinkhorn_difficulty(di.normalise(ready, ["vector"], norm, batch), idx, scaling=scaling)
    paired = di.pair_layers(hidden.withColumn(batch, number), idx, by=batch) if batch else di.pair_layers(hidden, idx)
    return di.kl_difficulty(di.normalise(paired, ["x", "y"], norm, batch), idx, symmetric=criterion == "kl")


def build_curriculum(
    scored: DataFrame,
    kind: str = "cumulative",
    n: int = cu.DEFAULT_LEVELS,
    batch_size: int = 16,
    seed: int = 42,
    gated: bool = True,
    idx: str = "idx",
    batch_scores: bool = False,
) -> DataFrame:
    """(``stage``, ``level``, ``idx``) of a curriculum over ``(idx, difficulty)``.

    ``batch_scores`` gives every example the mean difficulty of its batch.
    The scores are written once: the extremes, the level counts and the samples
    must all see the same numbers, and recomputing a score is expensive.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    if kind.startswith("random"):
        staged = cu.random_stages(scored, n, seed, idx, cumulative=kind == "random_cumulative")
        return staged.select("stage", "level", idx)
    if batch_scores:
        means = di.batch_difficulty(scored, idx, batch_size)
        scored = means.select(idx, F.col("batch_difficulty").alias("difficulty"))
    leveled = cu.difficulty_levels(materialise(scored), n)
    if kind == "ordered":
        return cu.ordered_curriculum(leveled, n, seed, idx)
    sampled = cu.distill_gated(leveled, n, batch_size, seed, idx) if gated else cu.distill_uniform(leveled, n, seed, idx)
    staged = cu.cumulative_stages(sampled, n) if kind == "cumulative" else cu.disjoint_stages(sampled)
    return staged.select("stage", "level", idx)
