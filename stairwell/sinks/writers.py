"""Predictions, test results, tag lines, generated text and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stairwell.functions.text import strip
from stairwell.operators.classify import capped_samples


def _path(folder: str, name: str, prefix: str | None) -> str:
    return f"{folder.rstrip('/')}/{prefix + '_' if prefix else ''}{name}"


def write_answers(
    folder: str,
    predictions: DataFrame,
    nbest: DataFrame,
    null_odds: DataFrame | None = None,
    prefix: str | None = None,
) -> None:
    """``predictions.json``, ``nbest_predictions.json`` and, with negatives, ``null_odds.json``.

    One JSON record per question.
    """
    predictions.write.mode("overwrite").json(_path(folder, "predictions.json", prefix))
    nbest.write.mode("overwrite").json(_path(folder, "nbest_predictions.json", prefix))
    if null_odds is not None:
        null_odds.write.mode("overwrite").json(_path(folder, "null_odds.json", prefix))


def result_lines(df: DataFrame, index: str, prediction: Column, regression: bool) -> DataFrame:
    """``index, prediction`` as text: three decimals for regression, else the label name."""
    shown = F.format_string("%.3f", prediction.cast("double")) if regression else prediction.cast("string")
    return df.select(F.col(index).alias("index"), shown.alias("prediction"))


def write_test_results(df: DataFrame, path: str, index: str, prediction: Column, regression: bool = False) -> None:
    """Tab-separated ``index, prediction`` in index order across the part files, after one header line."""
    lines = result_lines(df, index, prediction, regression)
    body = lines.select("index", F.to_csv(F.struct("index", "prediction"), {"sep": "\t"}).alias("value"))
    kind = body.schema["index"].dataType
    header = df.sparkSession.range(1).select(F.lit(None).cast(kind).alias("index"), F.lit("\t".join(lines.columns)).alias("value"))
    header.unionByName(body).orderBy(F.asc_nulls_first("index")).select("value").write.mode("overwrite").text(path)


def write_tag_lines(df: DataFrame, path: str, tags: str, order: str) -> None:
    """One line of space-joined tags per sentence, in ``order``."""
    lines = df.orderBy(order).select(F.array_join(tags, " ").alias("value"))
    lines.write.mode("overwrite").text(path)


def write_generated(df: DataFrame, path: str, text: str, order: str) -> None:
    """One stripped prediction per line, in ``order``."""
    lines = df.orderBy(order).select(strip(F.col(text)).alias("value"))
    lines.write.mode("overwrite").text(path)


def with_samples(metrics: DataFrame, rows: DataFrame, split: str, max_samples: int | None = None) -> DataFrame:
    """Add ``<split>_samples``, the number of rows but at most ``max_samples``."""
    n = rows.agg(F.count("*").alias("n")).scalar()
    return metrics.withColumn(f"{split}_samples", capped_samples(n, max_samples))


def metric_document(metrics: DataFrame) -> DataFrame:
    """One row ``value``: the metrics as a flat JSON object.

    ``metrics`` is one row with a column per metric, or (``key``, ``value``) rows, of which there are a few dozen.
    """
    if set(metrics.columns) == {"key", "value"}:
        pairs = F.sort_array(F.collect_list(F.struct("key", "value")))
        return metrics.agg(F.to_json(F.map_from_entries(pairs)).alias("value"))
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The metrics as one flat JSON object, as ``read_metrics`` reads it."""
    metric_document(metrics).coalesce(1).write.mode("overwrite").text(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """Store a table bucketed and sorted by ``keys``, so joins of equally bucketed tables need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
