"""Stored features, reused while their configuration stays the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def cache_key(split: str, model: str, max_length: int) -> str:
    """A folder name that depends on the split, the model's last path part and the length."""
    name = model.rstrip("/").rsplit("/", 1)[-1]
    digest = hashlib.sha256(json.dumps([split, name, max_length]).encode()).hexdigest()[:16]
    return f"features-{split}-{digest}"


def cached_features(
    spark: SparkSession,
    folder: str,
    split: str,
    model: str,
    max_length: int,
    build: Callable[[], DataFrame],
    overwrite: bool = False,
) -> DataFrame:
    """Read the stored features, or build and store them first."""
    path = f"{folder.rstrip('/')}/{cache_key(split, model, max_length)}"
    if not overwrite:
        try:
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
