"""Difficulty of an example from how far its last-layer vectors are from its embeddings.

Input is a table ``(idx, layer, token_pos, vector)`` or the paired form with one
row per token and columns ``x`` (embedding layer) and ``y`` (last layer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stairwell.functions.arrays import linear_scale, log_softmax, softmax, vector_sum

EMBEDDING_LAYER, LAST_LAYER = 0, -1
TILE = 256  # components of a tile's side
MOMENT_BYTES = 256 << 20  # open tiles of a task


def pair_layers(
    hidden: DataFrame, idx: str = "idx", first: int = EMBEDDING_LAYER, last: int = LAST_LAYER, by: str | None = None
) -> DataFrame:
    """One row per token with its vector in both layers; a vector that is missing is null.

    ``(idx, layer, token_pos)`` is unique.  The rows go once to their ``by`` (a column of ``hidden`` that an
    example's rows share, such as its batch; default: the example), where the two layers lie side by side
    in order of the tokens; what is grouped by ``by`` afterwards needs no further shuffle.
    """
    keys = list(dict.fromkeys([by or idx, idx, "token_pos"]))
    wanted = hidden.filter(F.col("layer").isin(first, last)).select(*keys, "layer", "vector").repartition(by or idx)
    token = Window.partitionBy(*keys).orderBy((F.col("layer") == last).cast("int"))
    begins = F.col("layer") == first
    paired = wanted.select(
        *keys,
        F.row_number().over(token).alias("__row"),
        F.when(begins, F.col("vector")).alias("x"),
        F.when(begins, F.lead("vector").over(token)).otherwise(F.col("vector")).alias("y"),
    )
    return paired.filter("__row = 1").drop("__row")


def batch_of(idx: str, batch_size: int) -> Column:
    """Deterministic batch number of a dense id."""
    return F.expr(f"`{idx}` div {int(batch_size)}").alias("batch")


def normalise(df: DataFrame, columns: list[str], kind: str = "org", batch: str | None = None) -> DataFrame:
    """Rescale vector columns: ``org`` and ``Gaussian`` leave them, ``softmax``,
    ``logsoftmax`` work over the components of a vector, ``line`` maps the smallest and largest
    component of the whole batch (of the whole table without ``batch``) to 0 and 1.
    """
    if kind in ("org", "Gaussian"):
        return df
    if kind == "softmax":
        return df.withColumns({c: softmax(F.col(c)) for c in columns})
    if kind in ("logsoftmax", "log_softmax"):
        return df.withColumns({c: log_softmax(F.col(c)) for c in columns})
    if kind != "line":
        raise ValueError(f"unknown normalisation {kind!r}")
    bounds = [
        e.cast("double").alias(f"__{side}_{c}")
        for c in columns
        for side, e in (("lo", F.min(F.array_min(c))), ("hi", F.max(F.array_max(c))))
    ]
    if batch is None:
        limits = df.agg(F.struct(*bounds).alias("b")).scalar()
        ready = df.withColumn("__b", limits)
        scaled = {c: linear_scale(F.col(c), F.col(f"__b.__lo_{c}"), F.col(f"__b.__hi_{c}")) for c in columns}
        return ready.withColumns(scaled).drop("__b")
    ready = df.join(df.groupBy(batch).agg(*bounds), batch)
    scaled = {c: linear_scale(F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")) for c in columns}
    return ready.withColumns(scaled).drop(*[f"__{s}_{c}" for c in columns for s in ("lo", "hi")])


def _kl_sum(source: Column, target: Column) -> Column:
    """Sum of ``t (log t - s)``; a target that is no probability (t <= 0) adds nothing."""
    terms = F.zip_with(
        source.cast("array<double>"),
        target.cast("array<double>"),
        lambda s, t: F.when(t > 0, t * (F.log(t) - s)).otherwise(F.lit(0.0)),
    )
    return vector_sum(terms)


def kl_difficulty(paired: DataFrame, key: str = "idx", symmetric: bool = True) -> DataFrame:
    """(``key``, ``difficulty``): divergence averaged over all elements of the key's vectors.

    ``symmetric`` averages both directions, otherwise only x -> y counts.  With a
    batch number as ``key`` the batch is scored as one tensor.
    """
    one = _kl_sum(F.col("x"), F.col("y"))
    both = (one + _kl_sum(F.col("y"), F.col("x"))) / 2 if symmetric else one
    rows = paired.select(key, both.alias("__kl"), F.size("x").alias("__n"))
    return rows.groupBy(key).agg((F.sum("__kl") / F.sum("__n")).alias("difficulty"))


def batch_difficulty(scored: DataFrame, idx: str, batch_size: int, difficulty: str = "difficulty") -> DataFrame:
    """Every example gets the mean difficulty of its batch of ``batch_size`` consecutive ids."""
    mean = F.avg(difficulty).over(Window.partitionBy("batch"))
    return scored.withColumn("batch", batch_of(idx, batch_size)).withColumn("batch_difficulty", mean)


def vector_std(df: DataFrame, vector: str, sample: str | None = None) -> DataFrame:
    """(``dim``, ``std``): population deviation of every component over the samples.

    With ``sample`` the rows of one sample (its tokens) are averaged first.
    """
    keys = [sample] if sample else []
    parts = df.select(*keys, F.posexplode(vector).alias("dim", "value"))
    if sample:
        parts = parts.groupBy(sample, "dim").agg(F.avg("value").alias("value"))
    return parts.groupBy("dim").agg(F.stddev_pop(F.col("value").cast("double")).alias("std"))


def second_moment(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(``group``, ``i``, ``j``, ``value``): sum of outer products of the group's vectors.

    A task adds up tiles of TILE x TILE components over all its rows, of which only those on and above
    the diagonal are computed, and sends each tile of a group once; what is shuffled depends on
    tasks, groups and d², not on rows.  If the open tiles fill MOMENT_BYTES, they are sent and begun anew.
    """
    group_type = df.schema[group].dataType.simpleString()
    rows = df.select(group, vector).filter(F.col(group).isNotNull() & F.col(vector).isNotNull())
    sums = rows.mapInArrow(moment_tiles(group), f"`{group}` {group_type}, i int, j int, value double")
    return sums.groupBy(group, "i", "j").agg(F.sum("value").alias("value"))


def moment_tiles(group: str, tile: int = TILE, most_bytes: int = MOMENT_BYTES):
    """The task of ``second_moment``: batches of (group, vector) to rows (group, i, j, value)."""

    def sent(tiles: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for (label, a, b), block in tiles.items():
            for begin_i, begin_j, values in ((a, b, block), (b, a, block.T))[: 1 if a == b else 2]:
                i, j = np.divmod(np.arange(values.size), values.shape[1])
                columns = [pa.array([label] * values.size, kind), pa.array((i + begin_i).astype(np.int32)), pa.array((j + begin_j).astype(np.int32)), pa.array(values.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=[group, "i", "j", "value"])
        tiles.clear()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple, np.ndarray] = {}
        held, kind = 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind = batch.column(0).type
            width = len(batch.column(1)[0])
            matrix = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, width)
            codes = batch.column(0).dictionary_encode()
            numbers = np.asarray(codes.indices)
            for k, label in enumerate(codes.dictionary.to_pylist()):
                rows = matrix[numbers == k]
                for a in range(0, width, tile):
                    for b in range(a, width, tile):
                        product = rows[:, a : a + tile].T @ rows[:, b : b + tile]
                        if (label, a, b) in tiles:
                            tiles[label, a, b] += product
                        else:
                            tiles[label, a, b] = product
                            held += product.nbytes
                            if held > most_bytes:
                                yield from sent(tiles, kind)
                                held = 0
        yield from sent(tiles, kind)

    return partial
