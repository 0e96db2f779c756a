"""Sentence and sentence-pair files, and cross-language splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stairwell.sources.lines import with_position


def _extension(path: str) -> str:
    return path.rsplit(".", 1)[-1]


def read_pairs(
    spark: SparkSession,
    files: dict[str, str],
    label_type: str | None = None,
    schema: str | None = None,
    position: str | None = None,
) -> dict[str, DataFrame]:
    """Split name -> table, from CSV with a header or JSON lines.

    The test file must have the training file's extension.  CSV columns come as
    text; ``label_type`` casts the label.  JSON takes ``schema``.
    ``position`` names a column for the rows' places in their file.
    """
    kind = _extension(files["train"])
    if kind not in ("csv", "json"):
        raise ValueError("the training file is csv or json")
    if "test" in files and _extension(files["test"]) != kind:
        raise ValueError("the test file needs the training file's extension")
    tables = {}
    for split, path in files.items():
        if kind == "csv":
            table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        else:
            table = (spark.read.schema(schema) if schema else spark.read).json(path)
        if position:
            table = with_position(table, position)
        if label_type and "label" in table.columns:
            table = table.withColumn("label", F.col("label").cast(label_type))
        tables[split] = table
    return tables


def cross_language_splits(
    df: DataFrame, language: str, train_language: str | None = None, lang: str = "language", split: str = "split"
) -> DataFrame:
    """Training rows in ``train_language`` (else ``language``), all other splits in ``language``."""
    wanted = F.when(F.col(split) == "train", F.lit(train_language or language)).otherwise(F.lit(language))
    return df.filter(F.col(lang) == wanted)


def read_cross_language(
    spark: SparkSession, folder: str, schema: str, language: str, train_language: str | None = None
) -> DataFrame:
    """JSON lines laid out as ``<folder>/split=<s>/language=<l>/``; only the needed folders are read."""
    table = spark.read.schema(schema).json(folder)
    return cross_language_splits(table, language, train_language)
