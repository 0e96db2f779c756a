"""Reproducible sampling in hash order, exact and without a global sort.

Rows are shuffled by ``md5(seed:idx)``.  The leading hex digits of the hash are
an order-preserving, evenly filled slot, so counting rows per slot tells for
nearly every slot whether it lies wholly inside or outside the wanted ranks.
Slots cut by a boundary are split by one more digit, and again, until a
cut slot has at most ``SLOT_ROWS`` rows; only those are ranked one by one.  So the
rows that one task ranks do not grow with the data; what grows, by one round per factor of 16,
is the number of counting rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from stairwell.session import materialise

HEX_DIGITS = 3  # 4096 slots: the first table has at most 4096 rows per group
MOST_DIGITS = 32
SLOT_ROWS = 100_000  # rows of a cut slot that one task ranks
OUTSIDE, INSIDE, CUT, SPLIT = range(4)


def shuffle_hash(seed: int, idx: str | Column) -> Column:
    column = F.col(idx) if isinstance(idx, str) else idx
    return F.md5(F.concat_ws(":", F.lit(str(seed)), column.cast("string")))


def _slot(digits: int) -> Column:
    return F.substring("__hash", 1, digits)


def _judged(slots: DataFrame, inside, outside, digits: int) -> DataFrame:
    """The slots with what becomes of each.  Stored: a few rows, but counting them reads the data."""
    before, count = F.col("__before"), F.col("__count")
    many = (count > SLOT_ROWS) & F.lit(digits < MOST_DIGITS)
    state = F.when(inside(before, count), INSIDE).when(outside(before, count), OUTSIDE).when(many, SPLIT).otherwise(CUT)
    return materialise(slots.withColumn("__state", state))


def slot_tables(hashed: DataFrame, keys: list[str], inside, outside) -> list[DataFrame]:
    """Slots by 3, 4, ... digits; each table splits the slots of the one before that are marked so.

    Every table is counted by a job of its own; the first has at most 4096 rows per group, the others 16 for
    every slot that is split.
    """
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*keys, _slot(HEX_DIGITS).alias("__slot")).agg(F.count("*").alias("__count"))
    slots = counts.select(
        *keys,
        "__slot",
        F.coalesce(F.sum("__count").over(earlier), F.lit(0)).alias("__before"),
        "__count",
        F.sum("__count").over(group).alias("group_rows"),
        F.sum("__count").over(Window.partitionBy()).alias("total_rows"),
    )
    tables = [_judged(slots, inside, outside, HEX_DIGITS)]
    for digits in range(HEX_DIGITS, MOST_DIGITS):
        split = tables[-1].filter(F.col("__state") == SPLIT)
        if split.isEmpty():
            break
        parents = split.select(*keys, F.col("__slot").alias("__parent"), F.col("__before").alias("__from"), "group_rows", "total_rows")
        rows = hashed.select(*keys, "__hash").withColumn("__parent", _slot(digits)).join(F.broadcast(parents), [*keys, "__parent"])
        fixed = ["__parent", "__from", "group_rows", "total_rows"]
        counts = rows.groupBy(*keys, *fixed, _slot(digits + 1).alias("__slot")).agg(F.count("*").alias("__count"))
        siblings = Window.partitionBy(*keys, "__parent").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("__from") + F.coalesce(F.sum("__count").over(siblings), F.lit(0))
        slots = counts.select(*keys, "__slot", before.alias("__before"), "__count", "group_rows", "total_rows")
        tables.append(_judged(slots, inside, outside, digits + 1))
    return tables


def pick_by_hash_rank(
    df: DataFrame,
    idx: str,
    seed: int,
    inside: Callable[[Column, Column], Column],
    outside: Callable[[Column, Column], Column],
    keep: Callable[[Column], Column],
    group: str | None = None,
) -> DataFrame:
    """Keep the rows whose 0-based hash rank within ``group`` satisfies ``keep``.

    ``inside(before, count)`` and ``outside(before, count)`` say whether a slot
    of ``count`` rows after ``before`` earlier ones is kept or dropped as a whole;
    they and ``keep`` may use ``group_rows`` and ``total_rows``.  The result has the extra
    columns ``group_rows``, ``total_rows`` and ``rank_floor`` (a rank in the same
    kept interval as the row's own).  ``group`` has few values (difficulty levels).
    """
    hashed = df.withColumn("__hash", shuffle_hash(seed, idx))
    keys = [group] if group else []
    tables = slot_tables(hashed, keys, inside, outside)
    first = tables[0].filter(F.col("__state") != OUTSIDE).drop("__count")
    rows = hashed.withColumn("__slot", _slot(HEX_DIGITS)).join(F.broadcast(first), [*keys, "__slot"])
    for digits, table in enumerate(tables[1:], HEX_DIGITS + 1):
        deeper = table.select(*keys, F.col("__slot").alias("__deep"), F.col("__before").alias("__b"), F.col("__state").alias("__s"))
        rows = rows.withColumn("__deep", _slot(digits)).join(F.broadcast(deeper), [*keys, "__deep"], "left")
        found = F.col("__s").isNotNull()
        newer = {"__slot": "__deep", "__before": "__b", "__state": "__s"}
        rows = rows.withColumns({old: F.when(found, F.col(new)).otherwise(F.col(old)) for old, new in newer.items()}).drop("__deep", "__b", "__s")
    sure = rows.filter(F.col("__state") == INSIDE).withColumn("rank_floor", F.col("__before"))
    order = Window.partitionBy(*keys, "__slot").orderBy("__hash", idx)
    cut = rows.filter(F.col("__state") == CUT).withColumn("rank_floor", F.col("__before") + F.row_number().over(order) - 1)
    cut = cut.filter(keep(F.col("rank_floor")))
    return sure.unionByName(cut).drop("__hash", "__slot", "__before", "__state")


def first_by_hash(df: DataFrame, idx: str, seed: int, quota: Column, group: str | None = None) -> DataFrame:
    """The ``quota`` rows of every group that come first in hash order.

    ``quota`` may use ``group_rows`` and ``total_rows``.
    """
    return pick_by_hash_rank(
        df,
        idx,
        seed,
        inside=lambda before, count: before + count <= quota,
        outside=lambda before, count: before >= quota,
        keep=lambda rank: rank < quota,
        group=group,
    )
