"""Helpers the operators share: tables in the shared folder, checked broadcasts, connected components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes up to which a table may be broadcast after it has been counted.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stairwell-llm-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage, survives lost executors, and every later pass sees the very same rows.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for what is written inside: bounds the memory where a row is large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit in BROADCAST_BYTES, else as it is (Spark then joins by shuffle).

    ``df`` must be cheap to count, such as a stored table.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def shared_model(spark: SparkSession, model: object) -> Callable[[], object]:
    """A function that gives workers the broadcast ``model``, unpacked once per task.

    Its class travels with it, as functions do, so workers need no package.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    unpacked: list = []

    def get() -> object:
        if not unpacked:
            unpacked.append(pickle.loads(packed.value))
        return unpacked[0]

    return get


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The spanning forest of one partition's edges, as (node, smallest node of its tree)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): for every id that occurs in the links (a, b), the smallest id it is connected with.

    Each partition first replaces its links by a spanning forest, so at most one row per node and task is
    shuffled. Then large and small stars alternate until the links are stars: every round hangs neighbours
    under their smallest neighbour. Each round is a stored table. Hub nodes meet only in joins, which
    Spark may split, and in a minimum, which is pre-aggregated. Null ends and loops are dropped.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    edges = stored(edges.mapInPandas(_forest, "a long, b long"), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = least.select("a", F.col("m").alias("b"))
        moved = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(kept.unionByName(moved).distinct(), "links")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
