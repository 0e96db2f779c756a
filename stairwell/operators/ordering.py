"""Global order without a single-task sort: running totals, dense ids, average ranks.

A plain ``Window.orderBy`` puts every row into one task.  Here a range shuffle places the
rows into buckets that follow the order, and the placed rows are written once as a table: every
later pass, and every repeated task, sees the same buckets.  Each bucket is summed, the
sums are accumulated on two levels (within groups of buckets, and over the groups), and only
the remainder is accumulated inside each bucket.

Bucket edges are found and kept by Spark's range partitioner in the columns' own types, so
numbers of any size, times and texts keep their exact order.  Its sample has a fixed bound
however many rows there are, and no edge becomes part of a plan: a plan has
the same size for any number of rows.  Edges hold the tie column too, so a value that
repeats, however often, is cut like any other stretch of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stairwell.session import materialise

BUCKET = "__bucket"
PLACE = "__place"
BUCKET_ROWS = 200_000  # rows a bucket should hold; their number grows with the data
GROUP = 4_096  # buckets whose sums are accumulated by one task
BROADCAST_BUCKETS = 500_000  # rows up to which a table of buckets is broadcast


def edge_count(df: DataFrame) -> int:
    """As many buckets as the rows need, and at least the shuffle width."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))


def _known(df: DataFrame, column: str) -> Column:
    """The column; a null has no place in the order and is an error, not a lost row."""
    missing = F.raise_error(F.lit(f"null in order column {column}")).cast(df.schema[column].dataType)
    return F.when(F.col(column).isNull(), missing).otherwise(F.col(column))


def with_order_bucket(df: DataFrame, value: str, tie: str | None = None, edges: int | None = None) -> DataFrame:
    """Add ``__bucket``, non-decreasing in (``value``, ``tie``), and ``__place``, 0.. in each bucket.  Stored.

    Both columns have an order and no nulls.  Rows equal in both share a bucket.
    """
    order = [value] if tie is None else [value, tie]
    known = df.withColumns({c: _known(df, c) for c in order})
    placed = known.repartitionByRange(edges or edge_count(df), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition's number above bit 33, the row's below
    placed = placed.withColumn("__at", at)
    places = {BUCKET: F.shiftright("__at", 33), PLACE: F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}
    return materialise(placed).withColumns(places).drop("__at")


def sums_before(placed: DataFrame, totals: dict[str, Column], more: dict[str, Column] | None = None) -> DataFrame:
    """One row per bucket: the ``totals`` of all buckets before it, as ``__before_<name>``, and its own, with ``more``.  Stored."""
    sums = placed.groupBy(BUCKET).agg(*[c.alias(n) for n, c in {**totals, **(more or {})}.items()])
    sums = materialise(sums).withColumn("__group", F.floor(F.col(BUCKET) / GROUP))
    groups = sums.groupBy("__group").agg(*[F.sum(n).alias(f"__all_{n}") for n in totals])
    # one row per GROUP buckets, that is per GROUP * BUCKET_ROWS rows
    earlier = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("__group", *[F.sum(f"__all_{n}").over(earlier).alias(f"__all_{n}") for n in totals])
    inside = Window.partitionBy("__group").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0)
    based = sums.join(groups, "__group").withColumns(
        {f"__before_{n}": F.coalesce(F.sum(n).over(inside), nothing) + F.coalesce(f"__all_{n}", nothing) for n in totals}
    )
    return materialise(based.drop("__group", *[f"__all_{n}" for n in totals]))


def join_buckets(placed: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows with the columns of their bucket; ``buckets`` is stored and broadcast only if it is small by its count."""
    return placed.join(F.broadcast(buckets) if buckets.count() <= BROADCAST_BUCKETS else buckets, BUCKET)


def running_totals(
    df: DataFrame,
    value: str,
    measures: dict[str, Column],
    tie: str | None = None,
    edges: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` in the order (``value``, ``tie``)."""
    placed = with_order_bucket(df, value, tie, edges).withColumns({f"__m_{n}": m for n, m in measures.items()})
    bases = sums_before(placed, {f"__s_{n}": F.sum(f"__m_{n}") for n in measures}).drop(*[f"__s_{n}" for n in measures])
    inside = Window.partitionBy(BUCKET).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    out = join_buckets(placed, bases)
    out = out.withColumns({n: F.sum(f"__m_{n}").over(inside) + F.col(f"__before___s_{n}") for n in measures})
    return out.drop(BUCKET, PLACE, *[f"__m_{n}" for n in measures], *[f"__before___s_{n}" for n in measures])


def dense_index(df: DataFrame, key: str, name: str = "idx", tie: str | None = None, edges: int | None = None) -> DataFrame:
    """Add 0..n-1 in the order of ``key`` (then ``tie``); the two together are unique."""
    placed = with_order_bucket(df, key, tie, edges)
    bases = sums_before(placed, {"__rows": F.count("*")}).drop("__rows")
    out = join_buckets(placed, bases)
    return out.withColumn(name, F.col("__before___rows") + F.col(PLACE)).drop(BUCKET, PLACE, "__before___rows")


def average_ranks(df: DataFrame, value: str, name: str = "rank", weight: str | None = None) -> DataFrame:
    """(``value``, ``name``): average 1-based rank of every distinct value; a row counts ``weight`` times."""
    size = F.sum(weight) if weight else F.count("*")
    counts = materialise(df.groupBy(value).agg(size.alias("__n")))
    ranked = running_totals(counts, value, {"__upto": F.col("__n")})
    return ranked.select(value, (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias(name))
