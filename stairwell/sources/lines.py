"""Row order of files that Spark reads in splits.

The number of records per split is a table of one row per split; accumulating it gives every record its
place in the file without sorting or gathering the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stairwell.session import materialise

BROADCAST_SPLITS = 500_000  # splits up to which their table is broadcast


def read_records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``value, __file, __split, __at``: raw records with their split and order within it."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__split"),
    )


def _offsets(stored: DataFrame, over: list[str]) -> DataFrame:
    """(``__file``, ``__split``, ``__shift``): what to add to a row's ``__id`` to get its place among the rows of ``over``.

    ``monotonically_increasing_id`` counts on within a split; subtracting the split's smallest id and adding the rows of
    earlier splits gives the place.  One row per split; broadcast if their count allows it.
    """
    splits = stored.groupBy("__file", "__split").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*over).orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")
    shifts = materialise(splits.select("__file", "__split", shift.alias("__shift")))
    return F.broadcast(shifts) if shifts.count() <= BROADCAST_SPLITS else shifts


def number_in_file(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Add 0..n-1 per file to rows that still are in read order (after filters and explodes), and ``file``.

    The rows are written once with their split and order, so counting and numbering see the same rows
    even if the file is replaced or cut differently meanwhile.
    """
    stored = materialise(rows.withColumn("__id", F.monotonically_increasing_id()))
    joined = stored.join(_offsets(stored, ["__file"]), ["__file", "__split"])
    place = (F.col("__id") + F.col("__shift")).alias(name)
    return joined.select(*[c for c in rows.columns if not c.startswith("__")], F.col("__file").alias("file"), place)


def with_position(table: DataFrame, name: str = "pos") -> DataFrame:
    """Add 0..n-1 in file order (files by path) to a table as it comes from its reader.

    ``table`` still has the reader's hidden ``_metadata``; filters and expressions over its rows do no harm.
    The source is parsed once.
    """
    columns = [c for c in table.columns if c != "_metadata"]
    meta = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split")]
    stored = materialise(table.select(*columns, *meta, F.monotonically_increasing_id().alias("__id")))
    joined = stored.join(_offsets(stored, []), ["__file", "__split"])
    return joined.select(*columns, (F.col("__id") + F.col("__shift")).alias(name))


def first_of_file(table: DataFrame, n: int, name: str = "pos") -> DataFrame:
    """The first ``n`` rows in file order (files by path) of a table as it comes from its reader, with their places.

    The rows of each split are counted without their columns, then the source is read once more and only rows before the
    ``n``-th go on; nothing is sorted or gathered. A file that is replaced between the passes is an error.
    """
    columns = [c for c in table.columns if c != "_metadata"]
    meta = {"__file": "file_path", "__split": "file_block_start", "__time": "file_modification_time"}
    marks = [F.col(f"_metadata.{field}").alias(c) for c, field in meta.items()]
    splits = table.select(*marks, F.monotonically_increasing_id().alias("__id")).groupBy(*meta).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")
    shifts = materialise(splits.select(*meta, shift.alias("__shift"), F.col("__n").alias("__rows")))
    near = F.broadcast(shifts) if shifts.count() <= BROADCAST_SPLITS else shifts
    joined = table.select(*columns, *marks, F.monotonically_increasing_id().alias("__id")).join(near, list(meta), "left")
    changed = F.raise_error(F.concat(F.lit("the file changed while it was read: "), F.col("__file"))).cast("long")
    place = F.when(F.col("__shift").isNull(), changed).otherwise(F.col("__id") + F.col("__shift"))
    return joined.select(*columns, place.alias(name)).filter(F.col(name) < n)
