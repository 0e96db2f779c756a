"""Translation records: one map per row, keyed by language code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def language_code(name: str) -> str:
    """The part before the underscore, as in ``en_XX``."""
    return name.split("_")[0]


def translation_pairs(df: DataFrame, source: str, target: str, prefix: str = "", keys: list[str] | None = None) -> DataFrame:
    """``source`` and ``target`` texts of a ``translation`` map column; the prefix goes before the source."""
    record = F.col("translation")
    return df.select(
        *(keys or []),
        F.concat(F.lit(prefix), record[language_code(source)]).alias("source"),
        record[language_code(target)].alias("target"),
    )


def read_translation(spark: SparkSession, path: str, source: str, target: str, prefix: str = "") -> DataFrame:
    """JSON lines ``{"translation": {code: text, ...}}``."""
    return translation_pairs(spark.read.schema("translation map<string,string>").json(path), source, target, prefix)
