"""Column roles, row selection and the user-function hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from stairwell.operators.ordering import dense_index, running_totals
from stairwell.operators.sampling import shuffle_hash
from stairwell.session import materialise

# The text columns of the known sentence tasks.
TASK_COLUMNS = {
    "cola": ("sentence", None),
    "mnli": ("premise", "hypothesis"),
    "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
}


def _named_or_position(columns: list[str], name: str, position: int) -> str:
    return name if name in columns else columns[position]


def qa_roles(df: DataFrame) -> tuple[str, str, str]:
    """Question, context and answers column: by name, else the first, second and third."""
    names = df.columns
    return tuple(_named_or_position(names, n, i) for i, n in enumerate(("question", "context", "answers")))


def pair_roles(df: DataFrame, task: str | None = None) -> tuple[str, str | None]:
    """The one or two text columns of a sentence task."""
    if task is not None:
        return TASK_COLUMNS[task]
    first, second, *_ = *(c for c in df.columns if c != "label"), None, None
    named = ("sentence1", "sentence2")
    return named if all(c in df.columns for c in named) else (first, second)


def tag_roles(
    df: DataFrame, task: str = "ner", tokens: str | None = None, tags: str | None = None
) -> tuple[str, str]:
    """Token and tag column: as given, else by name, else the first and second."""
    names = df.columns
    return (
        tokens or _named_or_position(names, "tokens", 0),
        tags or _named_or_position(names, f"{task}_tags", 1),
    )


def is_regression(df: DataFrame, label: str = "label", task: str | None = None) -> bool:
    """Regression for the one similarity task, otherwise decided by a floating label."""
    if task is not None:
        return task == "stsb"
    return isinstance(df.schema[label].dataType, (FloatType, DoubleType))


def head(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows in ``order``; all rows when ``n`` is None."""
    return df if n is None else df.orderBy(*order).limit(n)


def first_windows(features: DataFrame, n: int, position: str, window: str = "window") -> DataFrame:
    """The first ``n`` windows in the order of their examples' places and, of an example, of their numbers 0, 1, ...

    Window counts per example are summed up along the places, so no task sorts or holds the ``n`` rows.
    """
    stored = materialise(features)
    sizes = stored.groupBy(position).agg(F.count("*").alias("__n"))
    upto = running_totals(sizes, position, {"__upto": F.col("__n")})
    before = upto.select(position, (F.col("__upto") - F.col("__n")).alias("__before")).filter(F.col("__before") < n)
    return stored.join(before, position).filter(F.col("__before") + F.col(window) < n).drop("__before")


def select_by_index(df: DataFrame, wanted: DataFrame, idx: str = "idx", pos: str = "pos") -> DataFrame:
    """Rows named by ``wanted(pos, idx)``; repeats stay, ``pos`` carries the order, an unknown index is an error."""
    found = wanted.select(pos, idx).join(df.withColumn("__found", F.lit(True)), idx, "left")
    missing = F.raise_error(F.concat(F.lit("no row has index "), F.col(idx).cast("string"))).cast("boolean")
    return found.filter(F.coalesce("__found", missing)).drop("__found")


def add_index(df: DataFrame, key: str, tie: str | None = None, name: str = "idx") -> DataFrame:
    """Append 0..n-1 in the order of ``key``."""
    return dense_index(df, key, name, tie)


def peek(df: DataFrame, idx: str, seed: int, n: int = 3) -> DataFrame:
    """``n`` rows chosen at random, the same ones for the same seed."""
    return df.orderBy(shuffle_hash(seed, idx), idx).limit(n)


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str
) -> DataFrame:
    """Apply a user function to Arrow-sized batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
