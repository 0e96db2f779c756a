"""JSON objects used as maps: predictions, no-answer probabilities, metric results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stairwell.sources.json_splits import read_entries


def parse_map(documents: DataFrame, document: str, value: str, value_type: str = "string", key: str = "qid") -> DataFrame:
    """(``pos``, ``key``, ``value``) of JSON objects held in a text column, in the order of their entries.

    Any layout is read. Of a repeated key the last value counts, at the first place; text that is no object is an error.
    """
    entries = F.map_entries(F.from_json(document, f"map<string,{value_type}>", {"mode": "FAILFAST"}))
    rows = documents.select(F.posexplode(entries).alias("pos", "e"))
    last = F.max_by(F.col("e.value"), F.col("pos"))
    # A null value stays a value: the pair, not the value, is compared.
    return rows.groupBy(F.col("e.key").alias(key)).agg(F.min("pos").alias("pos"), last.alias(value)).select("pos", key, value)


def read_map(spark: SparkSession, path: str, value: str, value_type: str = "string", key: str = "qid") -> DataFrame:
    """The entries of the JSON object in a file, of any size: the file is read in splits, each entry is parsed by itself."""
    text = F.concat(F.lit("{"), F.col("text"), F.lit("}"))
    parsed = F.from_json(text, f"map<string,{value_type}>", {"mode": "FAILFAST"})
    rows = read_entries(spark, path).select("pos", F.explode(F.map_entries(parsed)).alias("e"))
    last = F.max_by(F.col("e.value"), F.col("pos"))
    return rows.groupBy(F.col("e.key").alias(key)).agg(F.min("pos").alias("pos"), last.alias(value)).select("pos", key, value)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(``pos``, ``qid``, ``prediction``)."""
    return read_map(spark, path, "prediction")


def read_na_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(``pos``, ``qid``, ``na_prob``)."""
    return read_map(spark, path, "na_prob", "double")


def with_na_probabilities(predictions: DataFrame, na_probs: DataFrame | None = None, qid: str = "qid") -> DataFrame:
    """Add ``na_prob``; 0.0 for every prediction when there is no probability file."""
    if na_probs is None:
        return predictions.withColumn("na_prob", F.lit(0.0))
    joined = predictions.join(na_probs.select(qid, "na_prob"), qid, "left")
    return joined.withColumn("na_prob", F.coalesce("na_prob", F.lit(0.0)))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(``key``, ``value``) of a metric result."""
    return read_map(spark, path, "value", "double", "key").drop("pos")
