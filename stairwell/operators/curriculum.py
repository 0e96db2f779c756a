"""Levels, distilled samples and stages of a training curriculum.

Every operator works on a narrow table ``(idx, difficulty)``; the training rows
are joined by ``idx`` only when a stage is read.  Sampling follows the hash
order of ``sampling``: the same seed gives the same curriculum, and no level is
ever sorted or gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stairwell.operators.difficulty import batch_of
from stairwell.operators.ordering import dense_index
from stairwell.operators.sampling import first_by_hash, pick_by_hash_rank

DEFAULT_LEVELS = 3


def difficulty_levels(df: DataFrame, n: int = DEFAULT_LEVELS, difficulty: str = "difficulty") -> DataFrame:
    """Add ``level``: equal-width bands of the difficulty range, 0 (easy) to n-1.

    The largest difficulty, and with it everything when all are equal, is level n-1.  A null or NaN is an error.
    """
    value = F.col(difficulty).cast("double")
    unknown = F.raise_error(F.lit(f"{difficulty} is null or not a number")).cast("double")
    d = F.when(value.isNull() | F.isnan(value), unknown).otherwise(value)
    span = df.agg(F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")).alias("s")).scalar()
    band = F.floor(n * (d - F.col("__s.lo")) / F.nullif(F.col("__s.hi") - F.col("__s.lo"), F.lit(0.0)))
    top = F.lit(n - 1)
    level = F.when(d == F.col("__s.hi"), top).otherwise(F.least(band, top))
    return df.withColumn("__s", span).withColumn("level", level.cast("int")).drop("__s")


def distill_uniform(leveled: DataFrame, n: int, seed: int, idx: str = "idx") -> DataFrame:
    """1/n of every level, rounded down."""
    quota = F.floor(F.col("group_rows") / n)
    return first_by_hash(leveled, idx, seed, quota, "level").drop("group_rows", "total_rows", "rank_floor")


def distill_gated(leveled: DataFrame, n: int, batch_size: int, seed: int, idx: str = "idx") -> DataFrame:
    """1/n of a level larger than ``total * n // batch_size`` rows; smaller levels stay whole."""
    gate = F.floor(F.col("total_rows") * n / batch_size)
    quota = F.when(F.col("group_rows") > gate, F.floor(F.col("group_rows") / n)).otherwise(F.col("group_rows"))
    return first_by_hash(leveled, idx, seed, quota, "level").drop("group_rows", "total_rows", "rank_floor")


def batch_levels(scored: DataFrame, n: int, batch_size: int, idx: str = "idx", difficulty: str = "difficulty") -> DataFrame:
    """(``batch``, ``difficulty``, ``examples``, ``level``): whole batches as units; ``idx`` is dense."""
    units = scored.groupBy(batch_of(idx, batch_size)).agg(
        F.avg(difficulty).alias("difficulty"), F.count("*").alias("examples")
    )
    return difficulty_levels(units, n)


def distill_batches(units: DataFrame, n: int, batch_size: int, seed: int) -> DataFrame:
    """Kept batches: a level with more than ``gate`` batches keeps ``gate // n`` of them.

    ``gate`` is a level's even share of batches, ``int(examples / batch_size / n)``.
    """
    examples = units.agg(F.sum("examples").cast("double").alias("n")).scalar()
    gate = F.floor(examples / batch_size / n)
    quota = F.when(F.col("group_rows") > gate, F.floor(gate / n)).otherwise(F.col("group_rows"))
    return first_by_hash(units, "batch", seed, quota, "level").drop("group_rows", "total_rows", "rank_floor")


def batch_members(df: DataFrame, batches: DataFrame, batch_size: int, idx: str = "idx") -> DataFrame:
    """The rows of the given batches, with the batches' level and, if staged, stage."""
    marks = batches.select("batch", *[c for c in ("stage", "level") if c in batches.columns])
    return df.withColumn("batch", batch_of(idx, batch_size)).join(marks, "batch")


def cumulative_stages(sampled: DataFrame, n: int) -> DataFrame:
    """Stage i holds the samples of levels 0..i; earlier samples are reused."""
    return sampled.withColumn("stage", F.explode(F.sequence(F.col("level"), F.lit(n - 1))))


def disjoint_stages(sampled: DataFrame) -> DataFrame:
    """Stage i holds the sample of level i only."""
    return sampled.withColumn("stage", F.col("level"))


def ordered_full_set(leveled: DataFrame, idx: str = "idx") -> DataFrame:
    """All rows from easy to hard with their place ``pos``."""
    return dense_index(leveled, "level", "pos", tie=idx)


def ordered_curriculum(leveled: DataFrame, n: int, seed: int, idx: str = "idx") -> DataFrame:
    """(``stage``, ``level``, ``idx``): the ordered full set as stage 0, then n cumulative stages."""
    full = leveled.select(F.lit(0).alias("stage"), "level", idx)
    steps = cumulative_stages(distill_uniform(leveled, n, seed, idx), n)
    return full.unionByName(steps.select((F.col("stage") + 1).alias("stage"), "level", idx))


def random_stages(df: DataFrame, n: int, seed: int, idx: str = "idx", cumulative: bool = False) -> DataFrame:
    """The baseline without difficulty: shuffle, cut into n chunks, keep the first third of each.

    Rows beyond ``n * (total // n)`` are not used.  ``cumulative`` adds each chunk to all
    later stages.
    """
    split = F.floor(F.col("total_rows") / n)
    third = F.floor(F.lit(1 / 3) * split)

    width = F.greatest(split, F.lit(1))

    def chunk(rank: Column) -> Column:
        return F.floor(rank / width)

    def wanted(rank: Column) -> Column:
        return (rank < split * n) & (rank % width < third)

    def inside(before: Column, count: Column) -> Column:
        return wanted(before) & ((before % width) + count <= third)

    def outside(before: Column, count: Column) -> Column:
        between = (before % width >= third) & ((before % width) + count <= width)
        return between | (before >= split * n)

    safe = df.select(idx)
    picked = pick_by_hash_rank(safe, idx, seed, inside, outside, wanted)
    staged = picked.select(idx, chunk(F.col("rank_floor")).cast("int").alias("level"))
    return cumulative_stages(staged, n) if cumulative else disjoint_stages(staged)


def training_plan(full: DataFrame, stages: DataFrame, epochs: int, idx: str = "idx") -> DataFrame:
    """(``plan_pos``, ``kind``, ``idx``): ``epochs`` passes over everything, then the stages."""
    passes = full.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("plan_pos"), F.lit("full").alias("kind"), idx)
    steps = stages.select((F.col("stage") + epochs).alias("plan_pos"), F.lit("stage").alias("kind"), idx)
    return passes.unionByName(steps) if epochs > 0 else steps


def stage_summary(stages: DataFrame) -> DataFrame:
    """(``stage``, ``level``, ``n``): rows per stage and level; a null level is the stage's total."""
    counted = stages.rollup("stage", "level").agg(F.count("*").alias("n"))
    return counted.filter("stage is not null")


def level_summary(leveled: DataFrame, n: int, batch_size: int) -> DataFrame:
    """(``level``, ``n``, ``threshold``, ``total``): level sizes and the gate they are held against."""
    sizes = leveled.groupBy("level").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per level
    return sizes.select(
        "level", "n", F.floor(total * n / batch_size).alias("threshold"), total.alias("total")
    )


def stage_rows(data: DataFrame, stages: DataFrame, stage: int, idx: str = "idx") -> DataFrame:
    """The training rows of one stage."""
    wanted = stages.filter(F.col("stage") == stage).select(idx)
    return data.join(wanted, idx, "left_semi")
